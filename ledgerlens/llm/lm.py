"""Bigram language model by deleted interpolation, counted and looked up in packed blocks.

Texts are cut into blocks of about half a million tokens. A block knows its distinct words and word
pairs as sorted 64-bit keys and asks the counts' owners (ranges of the key space) once for each,
in packed runs; the answers come back as packed counts in the same order. A frequent word is one key
a block, so no owner is hot, and what travels is the number of distinct keys, not of tokens.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, fold, int64, long_id, mix64, n_parts, steps, table
from .ngram_join import runs

BLOCK_TOKENS = 1 << 19
#: Tokens whose keys one range of the key space holds at most, about.
RANGE_TOKENS = 1 << 22
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Steps of a factor of two in which the held-out histogram keeps probabilities.
FINE = 8


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as zstandard of their byte planes; sorted unsigned arrays may be passed as differences."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def unpack(raw: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))  # noqa: S301  written by pack()
    return [np.frombuffer(b, np.uint8).reshape(-1, n).T.copy().reshape(-1).view(kind) if n else np.zeros(0, kind) for kind, n, b in planes]


def gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def small(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


class Block:
    """Tokens of some texts as places among the block's sorted distinct words."""

    def __init__(self, raw: bytes):
        step, self.seq, self.lens, self.ids, self.null, self.part = unpack(raw)
        self.keys = np.cumsum(step, dtype=np.uint64)
        self.part = self.part.astype(np.int64)  # of each text: 0 learnt from, 1 held out for the weights, 2 never learnt from
        self.seq = self.seq.astype(np.int64)
        self.token_part = np.repeat(self.part, self.lens)

    @staticmethod
    def build(hashes: np.ndarray, lens: np.ndarray, ids: np.ndarray, null: np.ndarray, part: np.ndarray) -> bytes:
        keys, seq = np.unique(hashes, return_inverse=True)
        return pack(gaps(keys), seq.astype(np.uint32), lens.astype(np.uint32), ids.astype(np.int64), null.astype(np.uint8), part.astype(np.uint8))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct pair keys, each token's place among them, each token's context (the number of words stands for the beginning)."""
        before = np.empty(len(self.seq), np.int64)
        before[1:] = self.seq[:-1]
        before[np.cumsum(self.lens) - self.lens] = len(self.keys)
        words = np.append(self.keys, BEGIN)
        keys, place = np.unique(mix64(words[before] * np.uint64(0x9E3779B97F4A7C15) + self.keys[self.seq]), return_inverse=True)
        return keys, place, before

    def counts(self, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Learnt and held-out occurrences of each key."""
        return tuple(np.bincount(place[self.token_part == p], minlength=n) for p in (0, 1))


def blocks(docs: DataFrame, mod: int, held: int, tuned: int, id_col: str, text_col: str) -> DataFrame:
    """block, em (held out for the weights), sums over its texts, and the packed block."""
    spec = "block long, em boolean, docs_0 long, docs_1 long, tokens_0 long, tokens_1 long, tokens_2 long, payload binary"
    names = [x.split()[0] for x in spec.split(", ")]

    def build(batches):
        made = 0
        open_: dict[bool, list] = {False: [], True: []}

        def shut(em):
            nonlocal made
            hashes, lens, ids, null, part = (np.concatenate(x) for x in zip(*open_[em], strict=True))
            open_[em] = []
            made += 1
            sums = [int((part == p).sum()) for p in (0, 1)] + [int(lens[part == p].sum()) for p in (0, 1, 2)]
            row = [(TaskContext.get().partitionId() << 32) + made, em, *sums, Block.build(hashes, lens, ids, null, part)]
            types = [pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch, col in steps(batches):
            w = Words(col, SPACE, True)
            h = np.insert(w.hashes(), w.first[1:], END)
            lens = np.diff(w.first) + 1
            id_ = batch.column(0)
            null = np.asarray(id_.is_null().to_numpy(zero_copy_only=False), bool)
            ids = id_.fill_null(0).to_numpy()
            rem = batch.column(2).to_numpy()
            part = np.where(rem == held, 2, np.where(rem == tuned, 1, 0))
            for em in (False, True):
                own = (part == 1) == em
                if own.any():
                    open_[em].append((h[np.repeat(own, lens)], lens[own], ids[own], null[own], part[own]))
                    if sum(len(x[0]) for x in open_[em]) >= BLOCK_TOKENS:
                        yield shut(em)
        for em in (False, True):
            if open_[em]:
                yield shut(em)

    rows = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).alias("text"), fold(F.col(id_col), mod).cast("int").alias("rem"))
    return table(rows.mapInArrow(build, spec), "lm-blocks")


def answers(made: DataFrame, bits: int) -> DataFrame:
    """For each block and key range: total counts of its keys, in the order of the keys.

    slot is twice the range plus 1 for pairs; known is the number of distinct learnt keys of the
    slot, on one of its rows.
    """

    def ask(batches):
        for batch in batches:
            for block, em, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = Block(raw)
                keys, place, _ = b.pairs()
                out = []
                for kind, (k, (x, y)) in enumerate(((b.keys, b.counts(b.seq, len(b.keys))), (keys, b.counts(place, len(keys))))):
                    edge = np.searchsorted(k >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist() if bits else [0, len(k)]
                    out += [(2 * r + kind, block, em, pack(gaps(k[i:j]), small(x[i:j]), small(y[i:j]))) for r, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if j > i]
                types = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["slot", "block", "em", "payload"])

    def add(batches):
        for t in runs(batches):
            slot = t.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(slot)) + 1, [len(slot)]]).tolist()
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part = t.slice(i, j - i)
                got = [unpack(x.as_py()) for x in part.column(3)]
                size = [len(g[0]) for g in got]
                keys, place = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), return_inverse=True)
                sums = [np.bincount(place, np.concatenate([g[k] for g in got]).astype(float), len(keys)).astype(np.int64) for k in (1, 2)]
                at = np.cumsum([0, *size])
                back = [pack(*(small(s[place[a:b]]) for s in sums)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                known = [int((sums[0] + sums[1] > 0).sum())] + [0] * (len(got) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0).combine_chunks(), part.column(1).combine_chunks(), part.column(2).combine_chunks(), pa.array(back, pa.binary()), pa.array(known, pa.int64())], ["slot", "block", "em", "payload", "known"])

    asked = made.select("block", "em", "payload").mapInArrow(ask, "slot long, block long, em boolean, payload binary")
    asked = asked.repartition("slot").sortWithinPartitions("slot")
    return table(asked.mapInArrow(add, "slot long, block long, em boolean, payload binary, known long"), "lm-answers")


class Counts:
    """A block with the answers to it: per token the counts of the word, its context and the pair."""

    def __init__(self, raw: bytes, slots: np.ndarray, payloads: list[bytes]):
        self.block = b = Block(raw)
        _, place, before = b.pairs()
        got = {kind: [unpack(p) for s, p in zip(slots.tolist(), payloads, strict=True) if s % 2 == kind] for kind in (0, 1)}
        self.word, self.pair, self.context = [], [], []
        for k in (0, 1):  # learnt, held out
            word = np.concatenate([g[k].astype(np.int64) for g in got[0]])
            pair = np.concatenate([g[k].astype(np.int64) for g in got[1]])
            self.word.append(word[b.seq])
            self.pair.append(pair[place])
            self.context.append(np.append(word, 0)[before])
        self.begin = before == len(b.keys)


def gathered(made: DataFrame, replies: DataFrame) -> DataFrame:
    rows = made.select("block", F.lit(-1).cast("long").alias("slot"), "payload").unionByName(replies.select("block", "slot", "payload"))
    return rows.repartition("block").sortWithinPartitions("block", "slot")


def counted(batches):
    for t in runs(batches):
        key = t.column(0).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist()
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            part = t.slice(i, j - i)
            payload = [x.as_py() for x in part.column(2)]
            yield Counts(payload[0], part.column(1).to_numpy()[1:], payload[1:])


def bucket(context: np.ndarray) -> np.ndarray:
    """Contexts share weights by the power of two of their frequency."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def learn_weights(cells: np.ndarray, floor: float, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation of the three weights of each bucket. ``cells``: bucket, pair and word
    probability steps, count; step -1 is probability 0.

    Each weight has a prior of one token, so none vanishes and an unseen word keeps a share of the
    uniform part. Bucket 0 holds the contexts never learnt: they have no pair estimate, so its weight is 0.
    """
    prior = np.ones((66, 3))
    prior[0, 0] = 0
    if not len(cells):
        return prior / prior.sum(1, keepdims=True)
    b, n = cells[:, 0], cells[:, 3].astype(float)
    p = np.column_stack([np.where(cells[:, k] < 0, 0.0, np.exp2(-cells[:, k] / FINE)) for k in (1, 2)] + [np.full(len(n), floor)])
    out = prior / prior.sum(1, keepdims=True)
    for _ in range(rounds):
        mix = out[b] * p
        share = mix / mix.sum(1, keepdims=True) * n[:, None]
        got = np.stack([np.bincount(b, share[:, k], len(out)) for k in range(3)], 1)
        # a bucket with few held-out tokens leans on all of them
        whole = got.sum(0) / got.sum()
        got += (1 + whole) * prior
        out = got / got.sum(1, keepdims=True)
    return out


def score_texts(docs: DataFrame, mod: int = 7, held: int = 2, tuned: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: id, n_tokens, n_known, train_tokens, base_score and score.

    P(w | v) = a * c(v w) / c(v) + b * c(w) / N + c / (V + 1), with (a, b, c) by the power of two of
    c(v). Learns from texts whose id's crc32 modulo ``mod`` is not ``held``. The weights come from
    expectation-maximisation over a histogram of the deleted part (remainder ``tuned``) under the
    counts of the rest; the histogram has a bounded number of cells (frequency bucket, pair and word
    probability in eighths of a factor of two) and covers every token. Scores use all learnt counts.
    base_score is the add-one unigram score. Logarithms are to base 10; each text ends in an end token.

    Defined cases: ids are whole numbers (else TypeError); null texts are empty and have the end token alone; null ids belong to remainder 0;
    repeated rows are scored alike and each counts; other columns are ignored; texts of any length
    are one sequence; an empty table gives an empty result.
    """
    made = blocks(docs, mod, held, tuned, id_col, text_col)
    sums = made.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs_0", "docs_1", "tokens_0", "tokens_1", "tokens_2"))).first()
    total = sums.tokens_0 + sums.tokens_1 + sums.tokens_2
    # Enough ranges to keep the cluster busy and a range within a task's memory. A block writes to the ranges that it
    # has keys of, so messages are never more than distinct keys of blocks, whatever the number of ranges.
    ranges = max(n_parts(docs.sparkSession), total // RANGE_TOKENS)
    replies = answers(made, (ranges - 1).bit_length())
    v = replies.filter("slot % 2 = 0").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    n_all, begin_all = sums.tokens_0 + sums.tokens_1, sums.docs_0 + sums.docs_1
    n_kept, begin_kept = max(1, sums.tokens_0), sums.docs_0
    floor = 1.0 / (v + 1)

    def cells(batches):
        for c in counted(batches):
            context = np.where(c.begin, begin_kept, c.context[0])
            steps_ = [np.where(x > 0, np.rint(-FINE * np.log2(np.maximum(x, 1e-300))), -1).astype(np.int64) for x in (c.pair[0] / np.maximum(context, 1), c.word[0] / n_kept)]
            code, n = np.unique((bucket(context) << 40) | ((steps_[0] + 1) << 20) | (steps_[1] + 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([int64(code), int64(n)], ["code", "n"])

    em = gathered(made.filter("em"), replies.filter("em")).mapInArrow(cells, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    got = np.array([(r.code >> 40, ((r.code >> 20) & 0xFFFFF) - 1, (r.code & 0xFFFFF) - 1, r.n) for r in em.toLocalIterator()], np.int64).reshape(-1, 4)
    weights = learn_weights(got[np.lexsort(got.T[::-1])], floor)

    def score(batches):
        for c in counted(batches):
            b = c.block
            word, pair = c.word[0] + c.word[1], c.pair[0] + c.pair[1]
            context = np.where(c.begin, begin_all, c.context[0] + c.context[1])
            w = weights[bucket(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, n_all) + w[:, 2] * floor
            head = np.cumsum(b.lens.astype(np.int64)) - b.lens
            add = lambda x: np.add.reduceat(x, head)  # noqa: E731, B023
            ids = pa.array(b.ids, pa.int64(), mask=b.null.astype(bool))
            yield pa.RecordBatch.from_arrays(
                [ids, int64(b.lens), int64(add((word > 0).astype(np.int64))), pa.array(add(np.log10((word + 1) / (n_all + v + 1)))), pa.array(add(np.log10(p)))],
                ["id", "n_tokens", "n_known", "base_score", "score"],
            )

    out = gathered(made, replies).mapInArrow(score, "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
