"""Benchmark decontamination: prefix-filtered containment join of item windows against documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, Words, int64, ngram_hash, steps, table

#: (window, item) rows that one pass holds on the driver and sends to executors: at most about 60 MB.
BLOCK_ROWS = 200_000


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """item, words (the window's words, one space between); an item shorter than a window is one window."""

    def cut(batches):
        for batch, col in steps(batches):
            w = Words(col, PUNCT, True)
            names = batch.column(0).to_pylist()
            who, what = [], []
            for d, name in enumerate(names):
                lo, hi = w.first[d], w.first[d + 1]
                words = [w.text(k) for k in range(lo, hi)]
                for k in range(max(1, len(words) - window + 1) if words else 0):
                    who.append(name)
                    what.append(b" ".join(words[k : k + window]))
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(what, pa.binary())], ["item", "words"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item string, words binary").distinct()


class Block:
    """Windows of one pass, with their shingles; after rank() the postings of their necessary tokens."""

    def __init__(self, rows: list, shingle: int):
        self.texts = sorted({bytes(r.words) for r in rows})
        place = {t: k for k, t in enumerate(self.texts)}
        pairs = sorted((place[bytes(r.words)], r.item) for r in rows)
        self.items = [i for _, i in pairs]
        self.item_at = np.searchsorted([k for k, _ in pairs], np.arange(len(self.texts) + 1))
        w = Words(pa.array(self.texts, pa.binary()).cast(pa.string()), PUNCT, False)
        self.len = np.diff(w.first)
        h = w.hashes()
        width = int(self.len.max(initial=1))
        self.word = np.zeros((len(self.texts), width), np.uint64)
        for k in range(width):
            has = self.len > k
            self.word[has, k] = h[w.first[:-1][has] + k]
        self.grain = np.minimum(self.len, shingle)  # a short window's shingles are as long as it is
        self.tokens = []  # (grain, hash) of each shingle in use
        self.window, self.offset, self.grains, self.hash = [], [], [], []
        for g in np.unique(self.grain).tolist():
            own = np.flatnonzero(self.grain == g)
            for k in range(width - g + 1):
                has = own[self.len[own] >= k + g]
                if len(has):
                    self.window.append(has)
                    self.offset.append(np.full(len(has), k))
                    self.grains.append(np.full(len(has), g))
                    self.hash.append(np.array([ngram_hash(self.word[i, k : k + g], g)[0] for i in has], np.uint64))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.window, self.offset, self.grains, self.hash = cat(self.window, np.int64), cat(self.offset, np.int64), cat(self.grains, np.int64), cat(self.hash, np.uint64)
        self.all = {g: np.unique(self.hash[self.grains == g]) for g in np.unique(self.grains).tolist()}

    def rank(self, counts: dict[int, np.ndarray]) -> None:
        """Keeps for each window its rarest shingle: a document that contains the window has it. Windows
        with a shingle that no document has are dropped."""
        freq = np.zeros(len(self.hash), np.int64)
        for g, known in self.all.items():
            own = self.grains == g
            freq[own] = counts[g][np.searchsorted(known, self.hash[own])]
        order = np.lexsort((self.offset, self.hash, freq, self.window))
        first = order[np.unique(self.window[order], return_index=True)[1]]
        first = first[freq[first] > 0]
        self.post = {}
        for g in self.all:
            own = first[self.grains[first] == g]
            own = own[np.argsort(self.hash[own], kind="stable")]
            keys, at = np.unique(self.hash[own], return_index=True)
            self.post[g] = (keys, np.append(at, len(own)), self.window[own], self.offset[own])
        del self.window, self.offset, self.grains, self.hash, self.all


def found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``values`` whose value is among the sorted ``keys``, and which key it is."""
    if not len(keys) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = np.zeros(1 << 16, bool)  # most values go at this table
    small[keys >> np.uint64(48)] = True
    at = np.flatnonzero(small[values >> np.uint64(48)])
    k = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
    ok = keys[k] == values[at]
    return at[ok], k[ok]


def shingles(w: Words, h: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of g words in a row of one document, and where they start."""
    m = max(0, len(h) - g + 1)
    at = np.flatnonzero(w.doc[:m] == w.doc[g - 1 : g - 1 + m])
    return ngram_hash(h, g)[at], at


def count_shingles(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """How often documents have each shingle of the block (a bounded number of them)."""
    known = docs.sparkSession.sparkContext.broadcast(block.all)

    def count(batches):
        sums = {g: np.zeros(len(k), np.int64) for g, k in known.value.items()}
        for _, col in steps(batches):
            w = Words(col, PUNCT, True)
            h = w.hashes()
            for g, keys in known.value.items():
                sums[g] += np.bincount(found(keys, shingles(w, h, g)[0])[1], minlength=len(keys))
        for g, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), int64(at), int64(n[at])], ["g", "k", "n"])

    out = {g: np.zeros(len(k), np.int64) for g, k in block.all.items()}
    for r in docs.select("text").mapInArrow(count, "g int, k long, n long").groupBy("g", "k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.g][r.k] = r.n
    return out


def match_block(docs: DataFrame, block: Block, out: tuple[str, str, str]) -> DataFrame:
    """Adds the block's hits to the columns of spans and items."""
    _, span_col, item_col = out
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def match(batches):
        b: Block = sent.value
        for batch, col in steps(batches):
            w = Words(col, PUNCT, True)
            h = w.hashes()
            spans = [set(map(tuple, x)) for x in batch.column(batch.schema.get_field_index(span_col)).to_pylist()]
            items = [set(x) for x in batch.column(batch.schema.get_field_index(item_col)).to_pylist()]
            for g, (keys, at, windows, offsets) in b.post.items():
                values, places = shingles(w, h, g)
                p, k = found(keys, values)
                n = at[k + 1] - at[k]
                entry = np.arange(n.sum()) + np.repeat(at[k] - np.cumsum(n) + n, n)
                win = windows[entry]
                where = np.repeat(places[p], n)
                doc = w.doc[where]
                start = where - offsets[entry]
                end = start + b.len[win]
                ok = (start >= w.first[doc]) & (end <= w.first[doc + 1])  # length and place
                win, start, doc, end = win[ok], start[ok], doc[ok], end[ok]
                same = np.ones(len(win), bool)
                for i in range(b.word.shape[1]):
                    has = b.len[win] > i
                    same[has] &= h[start[has] + i] == b.word[win[has], i]
                for x, s, d, e in zip(*(a[same].tolist() for a in (win, start, doc, end)), strict=True):
                    if b.texts[x] == b" ".join([w.text(i) for i in range(s, e)]):
                        lo = int(w.first[d])
                        spans[d].add((s - lo, e - lo))
                        items[d].update(b.items[b.item_at[x] : b.item_at[x + 1]])
            rest = [batch.column(i) for i, f in enumerate(batch.schema.names) if f not in out]
            names = [f for f in batch.schema.names if f not in out]
            ranges = pa.array([[list(x) for x in merged(s)] for s in spans], pa.list_(pa.list_(pa.int64())))
            found_in = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*rest, int64(np.diff(w.first)), ranges, found_in], [*names, *out])

    schema = docs.select(*[c for c in docs.columns if c not in out], *out).schema
    return docs.mapInArrow(match, schema)


def merged(spans: set) -> list:
    out: list = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_rows: int = BLOCK_ROWS, out: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """Input rows (text under the name ``text``) plus n_words, spans (merged word ranges [lo, hi)) and items,
    under the names ``out``.

    A window of an item is contained in a document exactly where its words follow one another. Of
    each window only its rarest shingle over the documents is looked up (containment of the whole
    set needs a prefix of one token); a match is a candidate if the window fits between the
    document's ends at that offset, and counts if all words are the same byte for byte.

    The benchmark is the stated query set: it goes over the documents in blocks of ``block_rows``
    (window, item) rows, so what is broadcast never depends on its size, and documents are never
    shuffled. Beyond one block the running result is written between passes.

    Defined cases: null or empty texts have no words; items without words have no windows; a null
    item id reads as the empty string; repeated items or documents are each judged alike; input
    columns of the names ``out`` are replaced; any text length works; an empty benchmark
    or document table gives no hits or no rows.
    """
    out = tuple(out)
    docs = docs.drop(*out)
    if text_col != "text":
        docs = docs.drop("text").withColumnRenamed(text_col, "text")
    windows = table(item_windows(items, window, item_col, item_text), "item-windows")
    blocks = max(1, -(-windows.count() // block_rows))
    deal = F.pmod(F.xxhash64("words", "item"), F.lit(blocks))
    empty = F.array().cast("array<array<bigint>>")
    rows = docs.withColumns(dict(zip(out, (F.lit(0).cast("long"), empty, F.array().cast("array<string>")), strict=True)))
    for k in range(blocks):
        block = Block(windows.filter(deal == k).collect(), shingle)
        block.rank(count_shingles(docs, block))
        rows = match_block(rows, block, out)
        if k + 1 < blocks:
            rows = table(rows, "decontaminate")
    return rows
