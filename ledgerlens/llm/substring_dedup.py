"""Substring dedup by super-k-mer partitioning: windows of words that an earlier document has are removed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SpanHash, Words, int64, long_id, mix64, ngram_hash, sliding_min, steps, table

#: Most windows of one super-k-mer: text that repeats one word does not make endless ones.
RUN = 256
#: Most distinct contents of a minimiser that one task takes together; beyond, its bucket is split, with the same result.
HOT = 1024


def super_kmers(w: Words, window: int, mini: int) -> tuple[np.ndarray, ...]:
    """text, first word, windows, minimiser and 128-bit content hash of each super-k-mer.

    The minimiser of a window is the least hash among its runs of ``mini`` words. Consecutive windows
    of one text with one minimiser form a super-k-mer; equal windows have equal minimisers.
    """
    h = w.hashes()
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    least = sliding_min(mix64(ngram_hash(h, mini)), window - mini + 1)
    at = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (w.doc[at[1:]] != w.doc[at[:-1]])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    if size.max(initial=0) > RUN:
        cuts = -(-size // RUN)
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        left = np.repeat(size, cuts) - k * RUN
        head, size = np.repeat(head, cuts) + k * RUN, np.minimum(left, RUN)
    lo = at[head]
    a, b = SpanHash(h)(lo, lo + size + window - 1)
    return w.doc[lo], lo - w.first[w.doc[lo]], size, least[lo], a, b


def window_owners(packed: list[bytes], owner: np.ndarray, window: int) -> list[np.ndarray]:
    """For each packed string the least owner of each of its windows, over all strings of the bucket."""
    w = Words(pa.array(packed, pa.binary()).cast(pa.string()), SPACE, False)
    n = np.diff(w.first) - window + 1
    text = np.repeat(np.arange(len(packed)), n)
    lo = w.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    a, b = SpanHash(w.hashes())(lo, lo + window)
    order = np.lexsort((owner[text], b, a))
    same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    head = np.concatenate([[0], np.flatnonzero(~same) + 1])
    size = np.diff(np.append(head, len(order)))
    raw = w.data.tobytes()
    start, end = w.starts[lo], w.ends[lo + window - 1]
    first = np.repeat(order[head], size)  # the least owner comes first
    out = owner[text[first]]
    result = np.empty(len(order), np.int64)
    result[order] = out
    for i in np.flatnonzero(first != order).tolist():  # equal hashes are equal words, checked byte by byte
        x, y = first[i], order[i]
        if raw[start[x] : end[x]] != raw[start[y] : end[y]]:
            mine = raw[start[y] : end[y]]
            twins = [j for j in np.flatnonzero(first == x).tolist() if raw[start[order[j]] : end[order[j]]] == mine]
            result[y] = min(int(owner[text[order[j]]]) for j in twins)
    return np.split(result, np.cumsum(n)[:-1])


def seconds(w: Words, window: int, mini: int) -> np.ndarray:
    """The second minimiser of the window at each word: least hash, in another order, of runs of half a window."""
    half = max(mini, window // 2)
    return sliding_min(mix64(ngram_hash(w.hashes(), half) ^ np.uint64(0xC2B2AE3D27D4EB4F)), window - half + 1)


def located(batches, window: int):
    """Finds wanted contents in their texts: words, SpanHash, fields of the contents, their ids and first words."""
    for batch, col in steps(batches):
        w = Words(col, SPACE, False)
        lists = batch.column(batch.schema.get_field_index("wanted"))
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        field = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        lo = w.first[doc] + field("at")
        ok = np.flatnonzero(lo + field("n") + window - 1 <= w.first[doc + 1])  # an id's other text may be shorter
        span = SpanHash(w.hashes())
        x, y = span(lo[ok], lo[ok] + field("n")[ok] + window - 1)
        ok = ok[(x.view(np.int64) == field("k1")[ok]) & (y.view(np.int64) == field("k2")[ok])]
        yield w, span, flat.take(pa.array(ok)), batch.column(0).to_numpy()[doc[ok]], lo[ok]


def repeated_spans(docs: DataFrame, window: int = 50, mini: int = 8, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id and spans: word ranges covered by windows that also start in a document of a smaller id.

    1. One pass lists super-k-mers without their text: minimiser, content hash, document, place.
    2. Only minimisers seen in two documents go on (partial aggregates first: a hot passage leaves a task
       once). Their equal contents collapse.
    3. One packed string a distinct content, from its first document, goes to its minimiser's
       bucket, where sorting the windows finds the first document of each, words compared bytewise.
       Buckets of more than ``hot`` distinct contents are split: see split_bucket().
    4. Places join their content's windows and keep those whose first document is smaller.
    """
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spec = "doc_id long, at int, n int, mini long, k1 long, k2 long"

    def listed(batches):
        for batch, col in steps(batches):
            doc, at, n, least, a, b = super_kmers(Words(col, SPACE, False), window, mini)
            ids = batch.column(0).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([int64(ids), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), int64(least), int64(a), int64(b)], spec.replace(" long", "").replace(" int", "").split(", "))

    places = table(texts.mapInArrow(listed, spec), "places")
    key = ["mini", "k1", "k2"]
    # joins are merged at every size: nothing is broadcast, so the disk and the driver's part grow with the input only
    shared = places.groupBy("mini").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("mini")
    places = table(places.join(shared.hint("merge"), "mini", "left_semi"), "places-shared")
    kinds = table(places.groupBy(*key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "kinds")
    sizes = kinds.groupBy("mini").agg((F.count("*") > hot).alias("hot"))
    kinds = table(kinds.join(sizes.hint("merge"), "mini"), "kinds-shared").hint("merge")
    wanted = places.withColumnRenamed("doc_id", "lo").join(kinds, [*key, "lo"]).groupBy(*key, "lo", "hi", "hot").agg(F.min("at").alias("at"), F.max("n").alias("n"))
    wanted = table(wanted, "wanted")

    def packed(batches):
        for w, _, found, ids, lo in located(batches, window):
            hi = lo + found.field("n").to_numpy(zero_copy_only=False) + window - 1
            rows = [w.joined(x, y) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(found.field(f) for f in key), int64(ids), found.field("hi"), pa.array(rows, pa.binary())], [*key, "lo", "hi", "words"])

    cool = wanted.filter("NOT hot").groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list(F.struct(*key, "hi", "at", "n")).alias("wanted"))
    strings = texts.join(cool.hint("merge"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(packed, "mini long, k1 long, k2 long, lo long, hi long, words binary")
    owners = table(window_runs(strings, window), "owners")
    if not kinds.filter("hot").isEmpty():
        owners = owners.unionByName(split_bucket(texts, table(wanted.filter("hot"), "hot-wanted"), window, mini))
    spans = places.join(owners.hint("merge"), key).filter("owner < doc_id").select("doc_id", F.struct((F.col("at") + F.col("a")).alias("lo"), (F.col("at") + F.col("b") + (window - 1)).alias("hi")).alias("span"))
    return spans.groupBy("doc_id").agg(F.collect_set("span").alias("spans"))


def split_bucket(texts: DataFrame, wanted: DataFrame, window: int, mini: int) -> DataFrame:
    """Owners of the windows of minimisers with many distinct contents, without one task meeting them all.

    Windows leave as hashes, and partial aggregates find those that two documents hold: what merely
    stands around a hot passage goes no further. What is left of a content travels in runs of
    windows that share a second minimiser too, to that minimiser's bucket; equal runs collapse. What is asked of
    the texts is written first, so that its size is known and the texts are not shuffled for a few documents.
    """
    key = ["mini", "k1", "k2"]
    about = [*key, "hi", "at", "n"]
    lists = lambda rows, *more: texts.join(rows.groupBy("doc_id").agg(F.collect_list(F.struct(*about, *more)).alias("wanted")), "doc_id").select("doc_id", "text", "wanted")

    def windows(batches):
        for _, span, found, ids, lo in located(batches, window):
            n = found.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            x, y = span(lo[row] + off, lo[row] + off + window)
            cols = [found.field(f).take(pa.array(row)) for f in about]
            yield pa.RecordBatch.from_arrays([int64(ids[row]), *cols, pa.array(off.astype(np.int32)), int64(x), int64(y)], ["doc_id", *about, "off", "wa", "wb"])

    rows = wanted.withColumnRenamed("lo", "doc_id")
    spec = "doc_id long, mini long, k1 long, k2 long, hi long, at int, n int, off int, wa long, wb long"
    seen = table(lists(rows).mapInArrow(windows, spec), "hot-windows")
    twice = seen.groupBy("wa", "wb").agg(F.min("doc_id").alias("a"), F.max("hi").alias("b")).filter("a < b").select("wa", "wb")
    kept = seen.join(twice, ["wa", "wb"], "left_semi").groupBy("doc_id", *about).agg(F.array_sort(F.collect_set("off")).alias("offs"))
    kept = table(kept, "hot-kept")

    def runs(batches):
        for w, span, found, ids, lo in located(batches, window):
            offs = found.field("offs")
            row = np.repeat(np.arange(len(offs)), np.asarray(offs.value_lengths()))
            off = offs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = lo[row] + off
            least = seconds(w, window, mini)[at]
            head = np.ones(len(at), bool)
            head[1:] = (row[1:] != row[:-1]) | (np.diff(off) != 1) | (least[1:] != least[:-1])
            head = np.flatnonzero(head)
            size = np.diff(np.append(head, len(at)))
            x, y = at[head], at[head] + size + window - 1
            k1, k2 = span(x, y)
            words = [w.joined(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
            of = [found.field(f).take(pa.array(row[head])) for f in (*key, "hi")]
            yield pa.RecordBatch.from_arrays([int64(least[head]), int64(k1), int64(k2), int64(ids[row[head]]), of[3], pa.array(words, pa.binary()), *of[:3], pa.array(off[head].astype(np.int32))], [*key, "lo", "hi", "words", "of", "of1", "of2", "off"])

    spec = "mini long, k1 long, k2 long, lo long, hi long, words binary, of long, of1 long, of2 long, off int"
    cut = table(lists(kept, "offs").mapInArrow(runs, spec), "hot-runs")
    strings = cut.groupBy(*key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("words").alias("words"))
    owners = cut.select(*key, "of", "of1", "of2", "off").join(window_runs(strings, window), key)
    return table(owners.select(F.col("of").alias("mini"), F.col("of1").alias("k1"), F.col("of2").alias("k2"), (F.col("a") + F.col("off")).alias("a"), (F.col("b") + F.col("off")).alias("b"), "owner"), "hot-owners")


def window_runs(strings: DataFrame, window: int) -> DataFrame:
    """Sends packed strings (mini, k1, k2, lo, hi, words) to their buckets: runs a..b of windows and the first document of each."""

    def bucket(batches):
        def done(rows):
            mini, k1, k2, lo, hi, words = (np.array([r[i] for r in rows]) if i < 5 else [r[i] for r in rows] for i in range(6))
            out = []
            for r, owner in enumerate(window_owners(words, lo, window)):
                head = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
                tail = np.append(head[1:], len(owner))
                for a, b in zip(head.tolist(), tail.tolist(), strict=True):
                    if owner[a] < hi[r]:
                        out.append((int(mini[r]), int(k1[r]), int(k2[r]), a, b, int(owner[a])))
            return out

        held, group, size = [], None, 0
        ready: list = []

        def batch_of(rows):
            t = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t[i]) for i in range(6)], ["mini", "k1", "k2", "a", "b", "owner"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != group and held and size >= 1 << 20:  # several buckets are worked on together
                    ready += done(held)
                    held, size = [], 0
                    if len(ready) > 20_000:
                        yield batch_of(ready)
                        ready = []
                group = row[0]
                held.append(row)
                size += len(row[5])
        if held:
            ready += done(held)
        yield batch_of(ready)

    spec = "mini long, k1 long, k2 long, a int, b int, owner long"
    return strings.repartition("mini").sortWithinPartitions("mini").mapInArrow(bucket, spec)


def remove_repeats(docs: DataFrame, window: int = 50, mini: int = 8, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per document: id, n_words, n_removed, spans (word ranges removed) and kept (remaining words, one space between).

    Defined cases: ids are whole numbers (else TypeError); null texts have no words; texts shorter than a window lose nothing; rows with a
    null id neither lose words nor take them from others; rows of one id count as one document, so
    they take nothing from each other; other columns are ignored; an empty table stays empty.
    """
    spans = repeated_spans(docs, window, mini, id_col, text_col, hot)
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")).join(spans.hint("merge"), "doc_id", "left")

    def cut(batches):
        for batch, col in steps(batches, column="text"):
            w = Words(col, SPACE, False)
            diff = np.zeros(len(w) + 1, np.int64)
            lists = batch.column(batch.schema.get_field_index("spans"))
            n = np.asarray(lists.value_lengths().fill_null(0))
            doc = np.repeat(np.arange(len(n)), n)
            flat = lists.flatten()
            lo, hi = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) + w.first[doc] for f in ("lo", "hi"))
            hi = np.minimum(hi, w.first[doc + 1])
            lo = np.minimum(lo, hi)
            np.add.at(diff, lo, 1)
            np.add.at(diff, hi, -1)
            gone = np.cumsum(diff)[:-1] > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(w.first[:-1], len(gone))) * (np.diff(w.first) > 0) if len(n) else np.zeros(0, np.int64)
            kept, ranges = [], []
            for d in range(len(n)):
                a, b = int(w.first[d]), int(w.first[d + 1])
                if not removed[d]:
                    kept.append(w.joined(a, b))
                    ranges.append([])
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[True], gone[a:b], [True]]).astype(np.int8)))
                runs = edge.reshape(-1, 2).tolist()  # words that stay
                kept.append(b" ".join(w.joined(a + x, a + y) for x, y in runs))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
                ranges.append(edge.reshape(-1, 2).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), int64(np.diff(w.first)), int64(removed), pa.array(ranges, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    out = rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<array<long>>, kept string")
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
