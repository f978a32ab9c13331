"""N-gram Jaccard join on token-combination prefixes, and the components of its links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, discard, int64, long_id, mix64, ngram_hash, recording, steps, table

#: Counters of the frequency sketch (a byte each when broadcast: 16 MB) and the pieces it travels in.
SLOT_BITS, PIECES = 24, 64
#: Words of 64 bits in a parity bitmap, and the shingles that one describes; larger sets are cut into parts.
MAP_WORDS, PART = 16, 1024
#: Shingles of a group that one task holds; two blocks of a larger group meet in a task.
BLOCK_SHINGLES = 1 << 20
#: Words that all bitmaps of a task may have together.
TASK_WORDS = 1 << 22


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each text's distinct k-word shingles, ordered by both; a text of fewer words,
    but not none, has its whole sequence as the only one."""
    h = w.hashes()
    n = np.diff(w.first)
    m = max(0, len(h) - k + 1)
    at = np.flatnonzero(w.doc[:m] == w.doc[k - 1 : k - 1 + m])
    doc, value = [w.doc[at]], [ngram_hash(h, k)[at]]
    for short in range(1, k):
        own = np.flatnonzero(n == short)
        if len(own):
            doc.append(own)
            value.append(ngram_hash(h, short)[w.first[own]])
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def set_keys(doc: np.ndarray, value: np.ndarray, n_docs: int, seed: int) -> tuple[np.ndarray, ...]:
    """Size and 128-bit hash of each text's set."""
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    n = np.diff(first)
    full = n > 0
    k1, k2 = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
    if full.any():
        head = first[:-1][full]
        for out, salt in ((k1, 2 * seed + 1), (k2, 2 * seed + 2)):
            out[full] = np.add.reduceat(mix64(value + np.uint64(salt)), head)
    return n, k1, k2


def moduli(n: np.ndarray) -> np.ndarray:
    """Into how many parts sets of so many shingles are cut: a power of two, 1 up to PART."""
    return 1 << np.ceil(np.log2(np.maximum(n, PART) / PART)).astype(np.int64)


def part_tokens(value: np.ndarray, modulus: np.ndarray) -> np.ndarray:
    """The part that each token falls into."""
    return ((value >> np.uint64(20)) & (modulus.astype(np.uint64) - np.uint64(1))).astype(np.int64)


def listings(n: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which sets are cut into how many parts: by their own size, and where it differs by that of the
    smallest set they could be linked to, so that linked sets have a cut in common.

    Two sets that reach the threshold reach it in one of their common parts at least (the parts'
    intersections and unions add up to the sets'), so parts can be joined in place of large sets.
    """
    own, lower = moduli(n), moduli(-(-num * n // den))
    return [(np.flatnonzero(n > 0), own), (np.flatnonzero((n > 0) & (lower != own)), lower)]


def set_parts(doc: np.ndarray, value: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """text, part (modulus + residue), size and parity bitmap of each part, ordered by text."""
    out = []
    for which, modulus in listings(n, num, den):
        used = np.zeros(len(n), bool)
        used[which] = True
        own = used[doc]
        d, v = doc[own], value[own]
        head = np.cumsum(np.where(used, modulus, 0)) - np.where(used, modulus, 0)
        total = int(modulus[which].sum())
        at = head[d] + part_tokens(v, modulus[d])
        bits = np.zeros((total, MAP_WORDS), np.uint64)
        word = ((v >> np.uint64(6)) & np.uint64(MAP_WORDS - 1)).astype(np.int64)
        np.bitwise_xor.at(bits.reshape(-1), at * MAP_WORDS + word, np.uint64(1) << (v & np.uint64(63)))
        m = modulus[which]
        code = np.repeat(m, m) + np.arange(total) - np.repeat(head[which], m)
        out.append((np.repeat(which, m), code, np.bincount(at, minlength=total), bits))
    text, code, size, bits = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], code[order], size[order], bits[order]


def described(texts: DataFrame, k: int, num: int, den: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """One pass over all texts: a row per text (doc_id, n, k1, k2, and its parts' codes, sizes and bitmaps),
    and a sketch of how many texts have shingles of each slot, a fixed number of counters over all
    texts that stop at 255."""
    size = 1 << SLOT_BITS
    step = size // PIECES
    spec = "doc_id long, n int, k1 long, k2 long, parts array<int>, sizes array<int>, bits binary, piece int, counts binary"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in spec.split(", ")]

    def rows(**given):
        m = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given.get(f, pa.nulls(m, t)) for f, t in zip(names, types, strict=True)], names)

    def describe(batches):
        sums = np.zeros(size, np.uint32)
        for batch, col in steps(batches):
            doc, value = shingle_sets(Words(col, SPACE, True), k)
            np.add.at(sums, (value >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.uint32(1))
            n, k1, k2 = set_keys(doc, value, len(col), seed)
            text, code, sized, bits = set_parts(doc, value, n, num, den)
            first = np.searchsorted(text, np.arange(len(col) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (code, sized)]
            maps = [bits[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield rows(
                doc_id=batch.column(0), n=pa.array(n.astype(np.int32)), k1=int64(k1), k2=int64(k2),
                parts=lists[0], sizes=lists[1], bits=pa.array(maps, pa.binary()),
            )
        c = zstandard.ZstdCompressor(level=1)
        packed = [c.compress(np.minimum(sums[i * step : (i + 1) * step], 255).astype(np.uint8).tobytes()) for i in range(PIECES)]
        yield rows(piece=pa.array(range(PIECES), pa.int32()), counts=pa.array(packed, pa.binary()))

    def add(batches):
        total: dict[int, np.ndarray] = {}
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(d.decompress(raw), np.uint8).astype(np.uint16)
                total[piece] = np.minimum(total[piece] + got, 255) if piece in total else got
        c = zstandard.ZstdCompressor(level=1)
        packed = [c.compress(x.astype(np.uint8).tobytes()) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], ["piece", "counts"])

    made = table(texts.mapInArrow(describe, spec), "sets")
    out = np.zeros(size, np.uint8)
    d = zstandard.ZstdDecompressor()
    pieces = made.filter("piece IS NOT NULL").select("piece", "counts").repartition("piece")
    for r in pieces.mapInArrow(add, "piece int, counts binary").collect():  # PIECES rows
        out[r.piece * step : (r.piece + 1) * step] = np.frombuffer(d.decompress(bytes(r.counts)), np.uint8)
    return made.filter("piece IS NULL").drop("piece", "counts"), out


def prefix_keys(value: np.ndarray, freq: np.ndarray, num: int, den: int, often: int) -> np.ndarray:
    """Index keys of one set. Tokens are ordered rarest first. Sets that reach the threshold share a
    token in their prefixes of n - ceil(t n) + 1, and two in those one longer. Rare tokens of the
    prefix are keys alone. If no rare token is shared there, all shared ones are frequent, so pairs of
    the longer prefix's frequent tokens are the other keys."""
    n = len(value)
    p = n - -(-num * n // den) + 1
    order = np.lexsort((value, freq))[: p + 1]
    f = freq[order] >= often
    rare = value[order[:p]][~f[:p]]
    many = np.sort(value[order][f])
    if len(many) < 2:
        return rare
    i, j = np.triu_indices(len(many), 1)
    return np.concatenate([rare, mix64(many[i] * np.uint64(0x9E3779B97F4A7C15) + mix64(many[j]))])


def runs(batches):
    """(key, rows) of each run of equal first columns in sorted batches, rows as a table; runs may span batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(0).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        # everything between the first and the last run is whole
        first, last = cut[1], cut[-2]
        if key is not None and keys[0] == key:
            held.append(batch.slice(0, first))
            if len(cut) == 2:
                continue
            yield pa.Table.from_batches(held)
            if last > first:
                yield pa.Table.from_batches([batch.slice(first, last - first)])
        else:
            if held:
                yield pa.Table.from_batches(held)
            if last > 0:
                yield pa.Table.from_batches([batch.slice(0, last)])
        held, key = [batch.slice(last)], keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def postings(texts: DataFrame, k: int, num: int, den: int, seed: int, counts: np.ndarray) -> DataFrame:
    """key, node (the set's 64-bit hash), part and prev of every part that another one could be linked to.

    prev is the key before this one in the part's own list (0 at its head). Two parts with one key and
    one prev have met under that prev, and whether two parts may be linked does not depend on the key;
    so parts of one prev are not held against each other, and a key whose parts all have one prev is
    dropped. Down their common keys any two parts meet where their prevs differ or a list begins.
    """
    load = float(counts.mean())
    often = int(min(255, max(64, 8 * load)))  # where all slots are full every token is frequent: pairs of them still find all
    least = -(-num // (den - num))  # smaller sets link to equal sets only
    sent = texts.sparkSession.sparkContext.broadcast(counts)
    names = ["key", "node", "part", "prev"]

    def listed(batches):
        freq_of = sent.value
        seen: set[int] = set()
        for _, col in steps(batches):
            doc, value = shingle_sets(Words(col, SPACE, True), k)
            n, k1, _ = set_keys(doc, value, len(col), seed)
            first = np.concatenate([[0], np.cumsum(n)])
            freq = freq_of[(value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            got: list[list] = [[], [], [], []]

            def add(node, part, tokens, often_seen):
                x = prefix_keys(tokens, often_seen, num, den, often)
                for a, b in zip(got, (x, np.full(len(x), node), np.full(len(x), part, np.int32), np.append(np.uint64(0), x[:-1])), strict=True):  # noqa: B023
                    a.append(b)

            fresh = np.zeros(len(n), bool)
            for d in np.flatnonzero(n >= least).tolist():
                if int(k1[d]) not in seen:  # copies within a task send their keys once
                    fresh[d] = True
                    if len(seen) < 1 << 20:
                        seen.add(int(k1[d]))
            for which, modulus in listings(n, num, den):
                for d in which[fresh[which]].tolist():
                    lo, hi, m = first[d], first[d + 1], int(modulus[d])
                    if m == 1:
                        add(k1[d], 1, value[lo:hi], freq[lo:hi])
                        continue
                    part = part_tokens(value[lo:hi], modulus[d])
                    order = np.argsort(part, kind="stable")
                    tokens = mix64(value[lo:hi][order] ^ mix64(np.uint64(m)))  # keys of one cut meet each other only
                    edge = np.searchsorted(part[order], np.arange(m + 1)).tolist()
                    for r, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                        if j > i:
                            add(k1[d], m + r, tokens[i:j], freq[lo:hi][order][i:j])
            if got[0]:
                key, node, part, prev = map(np.concatenate, got)
                yield pa.RecordBatch.from_arrays([int64(key), int64(node), pa.array(part), int64(prev)], names)

    def shared(batches):
        for t in runs(batches):
            key, node, part, prev = (t.column(i).to_numpy() for i in range(4))
            order = np.lexsort((node, key))
            key, node, part, prev = key[order], node[order], part[order], prev[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, part, prev = key[new], node[new], part[new], prev[new]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(head, len(key)))
            alike = np.maximum.reduceat(prev, head) == np.minimum.reduceat(prev, head)
            keep = np.repeat((size > 1) & ~(alike & (prev[head] != 0)), size)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, part, prev)], names)

    spec = "key long, node long, part int, prev long"
    return texts.select("text").mapInArrow(listed, spec).repartition("key").sortWithinPartitions("key").mapInArrow(shared, spec)


def few_bits(n: np.ndarray, bits: np.ndarray, u: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether set u may reach the threshold with each other: their parity bitmaps differ in no more bits
    than the sets may (each differing token flips one bit)."""
    total = n[u] + n[others]
    room = total - 2 * (-(-num * total // (num + den)))
    return np.bitwise_count(bits[u] ^ bits[others]).sum(1) <= room


class Sets:
    """Disjoint sets of numbers, for the edges that a task has found."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        """One edge for each number but the least of its set."""
        pairs = [(self.root(x), x) for x in self.up]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], ["a", "b"])


def forest(n: np.ndarray, num: int, den: int, test, joined: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span, with those already ``joined`` (one number a set), the graph whose edges
    ``test(u, others)`` tells among sets whose sizes are in ratio: each vertex is held against those
    not yet reached, so a group of near copies takes one pass over it, not one for each member."""
    out: list[tuple[int, int]] = []
    left = np.argsort(n, kind="stable")
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            known = joined[left] == joined[u]
            if known.any():
                queue += left[known].tolist()
                left = left[~known]
            sizes = n[left]
            lo, hi = np.searchsorted(sizes, -(-num * n[u] // den), "left"), np.searchsorted(sizes, den * n[u] // num, "right")
            near = left[lo:hi]
            if not len(near):
                continue
            hit = test(u, near)
            if hit.any():
                reached = near[hit].tolist()
                out += [(u, v) for v in reached]
                queue += reached
                left = np.concatenate([left[:lo], near[~hit], left[hi:]])
    return out


def candidates(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that span the sets that may reach the threshold under some key: of each task one for
    each set at most. ``members``: key, prev, node, n, bits."""

    def pairs(batches):
        found = Sets()
        for t in runs(batches):
            key, prev, node, n = (t.column(i).to_numpy() for i in range(4))
            n = n.astype(np.int64)
            bits = np.frombuffer(b"".join(x.as_py() for x in t.column(4)), "<u8").reshape(len(key), -1)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                name = node[lo:hi].tolist()
                joined = np.array([found.root(x) for x in name])
                if (joined == joined[0]).all():
                    continue
                m, b, before = n[lo:hi], bits[lo:hi], prev[lo:hi]

                def test(u, others):
                    apart = (before[others] != before[u]) | (before[u] == 0)  # noqa: B023
                    apart[apart] = few_bits(m, b, u, others[apart], num, den)  # noqa: B023
                    return apart

                for u, v in forest(m, num, den, test, joined):
                    found.join(name[u], name[v])
        yield found.edges()

    rows = members.select("key", "prev", "node", "n", "bits").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(pairs, "a long, b long")


def meet(texts: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that span, with what is joined, the linked sets of each task, tested on the whole sets.
    ``rows``: task, node, joined."""

    def test(batches):
        for t in runs(batches):
            task = t.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
            out: set = set()
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part = t.slice(lo, hi - lo).combine_chunks().to_batches()
                docs, sets, name, joined, n = [], [], [], [], []
                for batch, col in steps(part):
                    doc, value = shingle_sets(Words(col, SPACE, True), k)
                    docs.append(doc + sum(map(len, name)))
                    sets.append(value)
                    name.append(batch.column(1).to_numpy())
                    joined.append(batch.column(2).to_numpy())
                    n.append(np.bincount(doc, minlength=len(col)))
                docs, sets, name, joined, n = map(np.concatenate, (docs, sets, name, joined, n))
                first = np.cumsum(n) - n
                words = max(MAP_WORDS, min(1 << (int(n.max()) >> 5).bit_length(), 1 << (TASK_WORDS // len(n)).bit_length() >> 1))
                bits = np.zeros((len(n), words), np.uint64)
                word = ((sets >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)
                np.bitwise_xor.at(bits.reshape(-1), docs * words + word, np.uint64(1) << (sets & np.uint64(63)))

                def linked(u, others):
                    ok = few_bits(n, bits, u, others, num, den)  # noqa: B023
                    cand = others[ok]
                    if len(cand):
                        m = n[cand]  # noqa: B023
                        ends = np.cumsum(m)
                        value = sets[np.arange(ends[-1]) + np.repeat(first[cand] - ends + m, m)]  # noqa: B023
                        mine = sets[first[u] : first[u] + n[u]]  # noqa: B023
                        found = mine[np.minimum(np.searchsorted(mine, value), len(mine) - 1)] == value
                        common = np.add.reduceat(found.astype(np.int64), ends - m)
                        ok[ok] = den * common >= num * (n[u] + m - common)  # noqa: B023
                    return ok

                for u, v in forest(n, num, den, linked, joined):
                    out.add((int(min(name[u], name[v])), int(max(name[u], name[v]))))
            if out:
                pairs = sorted(out)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in pairs], pa.int64()) for i in range(2)], ["a", "b"])

    rows = texts.withColumnRenamed("doc_id", "node").join(rows, "node").select("task", "node", "joined", "text")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(test, "a long, b long")


def verified_links(texts: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that span every group's sets of similarity num / den or more, tested on the whole sets.

    ``groups``: node, label and n. All sets that may be linked share a label. Groups are cut into blocks
    of about BLOCK_SHINGLES, a task each. Of a group of several blocks the least set of each component
    found goes on to a second meeting, and only where that leaves more than one component do its
    blocks meet pairwise, sets of one component not being held against each other again. So a large
    group of near copies is read three times at most; one whose sets mostly do not link is quadratic in blocks.
    """

    def blocked(rows: DataFrame) -> DataFrame:
        size = rows.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("g"))
        return rows.join(size, "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))

    def known(rows: DataFrame, links: DataFrame) -> DataFrame:
        labels = components(links).select("node", F.col("label").alias("_root"))
        return rows.join(labels, "node", "left").withColumn("joined", F.coalesce("_root", "node")).drop("_root")

    alone = F.xxhash64("label", "own").alias("task")
    rows = blocked(groups)
    links = table(meet(texts, rows.select(alone, "node", F.col("node").alias("joined")), k, num, den), "links")
    large = table(rows.filter("g > 1"), "large")
    if large.isEmpty():
        return links
    part = table(known(large, links), "joined") if not links.isEmpty() else large.withColumn("joined", F.col("node"))
    heads = blocked(part.filter("node = joined").select("label", "node", "n"))
    links = table(links.unionByName(meet(texts, heads.select(alone, "node", F.col("node").alias("joined")), k, num, den)), "links")
    if not links.isEmpty():
        part = table(known(large, links), "joined")
    split = part.groupBy("label").agg(F.min("joined").alias("a"), F.max("joined").alias("b")).filter("a < b").select("label")
    part = part.join(split, "label", "left_semi")
    other = F.explode(F.array_remove(F.sequence(F.lit(0), F.col("g") - 1), F.col("own")))
    pairs = part.withColumn("other", other).select(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "node", "joined")
    return links.unionByName(meet(texts, pairs, k, num, den))


def components(links: DataFrame) -> DataFrame:
    """node and label (its component's least node) for all nodes of the links (a, b).

    Alternates the two star steps: every node's larger neighbours, then its smaller ones, move to its
    least neighbour. Both are a min per node and a join; a node with very many links is one group
    for the partial aggregate and a skewed join, which AQE splits.
    """
    spark = links.sparkSession
    with recording() as old:
        e = table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    while True:
        with recording() as new:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
            large = table(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
            e = table(small.distinct(), "cc")
        discard(spark, old + new[:1])
        old = new[1:]
        if e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():  # all edges lead to roots
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def jaccard_components(
    docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", seed: int = 0
) -> DataFrame:
    """Per document: id, n_shingles and component_id, the least id reachable by links of similarity num / den or more.

    Equal sets collapse first, so exact copies are one node wherever they are. Nodes meet under
    prefix keys (sets of more than PART shingles in parts), where sizes and parity bitmaps tell which
    may be linked; these candidates join nodes into groups, which hold every linked pair. Each group's
    whole sets are then tested, a set only against sets not yet reached, so linked groups are not squared.
    The components are those of all links, though pairs within a component are not all listed.

    Defined cases: ids are whole numbers (else TypeError); null or empty texts have no set, are linked
    with nothing and are their own component; rows with a null id are returned with a null component;
    rows of one id are one document as far as links go; ties need no order, as components do not
    depend on it; other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))

    sets, counts = described(texts, shingle, num, den, seed)
    # equal sets have equal parts: any copy's will do
    kinds = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n")
    nodes = table(kinds.agg(F.min("doc_id").alias("node"), *(F.min(c).alias(c) for c in ("parts", "sizes", "bits"))), "nodes")
    if not nodes.groupBy("k1").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
        return jaccard_components(docs, shingle, num, den, id_col, text_col, seed + 1)  # two sets with one 64-bit hash
    texts = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    posted = postings(texts, shingle, num, den, seed, counts).withColumnRenamed("node", "k1")
    width = 8 * MAP_WORDS
    parts = nodes.select("k1", "node", "bits", F.posexplode(F.arrays_zip("parts", "sizes")).alias("at", "part"))
    parts = parts.select("k1", "node", F.col("part.parts").alias("part"), F.col("part.sizes").alias("n"), F.expr(f"substring(bits, at * {width} + 1, {width})").alias("bits"))
    with recording() as scratch:
        pairs = table(candidates(posted.join(parts, ["k1", "part"]), num, den), "pairs")
        labels = None
        if not pairs.isEmpty():
            groups = components(pairs).join(nodes.groupBy("node").agg(F.sum("n").alias("n")), "node")
            links = table(verified_links(texts, groups, shingle, num, den), "links")
            labels = None if links.isEmpty() else table(components(links), "components")
    if labels is not None:
        scratch.remove(scratch[-1])
    discard(texts.sparkSession, scratch)
    out = sets.select("doc_id", "n", "k1", "k2").join(nodes.select("k1", "k2", "n", "node"), ["k1", "k2", "n"], "left")
    if labels is not None:
        out = out.join(labels, "node", "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("long"))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), found.alias("component_id"))
