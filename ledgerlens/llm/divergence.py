"""Source divergence audit: how each source's words differ from its language's and from other sources'."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, mix64, n_parts, steps, table

#: Counters of the sketch of document frequencies: rows, counters a row (a byte each), and the pieces it travels in.
ROWS, WIDTH, PIECES = 4, 1 << 22, 64
#: Parts per unit of all probabilities.
UNIT = 1_000_000_000

_ALL = np.arange(256)
#: Bytes between terms: every ASCII character but letters.
NO_LETTER = (_ALL < 0x80) & ~(((_ALL >= 0x41) & (_ALL <= 0x5A)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)))


class Terms:
    """The distinct terms of a run of texts and, for each text, how often it has each.

    ``values``: the terms. ``doc``, ``term``, ``n``: one entry for each pair of text and term that occurs.
    """

    def __init__(self, text: pa.Array):
        w = Words(text, NO_LETTER, True)
        self.values, code = w.distinct()
        pair, self.n = np.unique(w.doc * max(1, len(self.values)) + code, return_counts=True)
        self.doc, self.term = np.divmod(pair, max(1, len(self.values)))
        first = np.zeros(len(self.values), np.int64)
        first[code[::-1]] = np.arange(len(w))[::-1]
        self.hash = w.hashes()[first] if len(w) else np.zeros(0, np.uint64)


def _codes(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, null as '', and the code of each row."""
    coded = col.fill_null("").dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _cells(term: np.ndarray, lang: np.ndarray) -> list[np.ndarray]:
    """The counter of each (language, term) in each row of the sketch."""
    h = mix64(term * np.uint64(0x9E3779B97F4A7C15) + lang)
    return [(mix64(h + np.uint64(r)) >> np.uint64(8)) & np.uint64(WIDTH - 1) for r in range(ROWS)]


def _hashes(langs: pa.Array) -> np.ndarray:
    """A hash of each language."""
    out = [int.from_bytes(hashlib.blake2b(x.as_py().encode(), digest_size=8).digest(), "little") for x in langs]
    return np.array(out, np.uint64)


def _piece(numbers: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
    packed = [zstandard.ZstdCompressor(level=1).compress(c.tobytes()) for c in counts]
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], ["piece", "counts"])


def document_sketch(docs: DataFrame, least: int) -> np.ndarray:
    """Count-min sketch of how many documents of its language have each term; counters stop at ``least``.

    Each task adds up its own texts; the tasks' sketches are added piece by piece on the executors.
    Its size is fixed, however long the input.
    """
    step = ROWS * WIDTH // PIECES

    def count(batches):
        own = np.zeros((ROWS, WIDTH), np.uint8)
        seen = False
        for batch, text in steps(batches):
            t = Terms(text)
            langs, lang = _codes(batch.column("lang"))
            pair = np.unique(lang[t.doc] * max(1, len(t.values)) + t.term, return_counts=True)
            which, term = np.divmod(pair[0], max(1, len(t.values)))
            seen = seen or len(term) > 0
            add = np.minimum(pair[1], least)
            for r, cell in enumerate(_cells(t.hash[term], _hashes(langs)[which])):
                # several terms of a step may share a counter: their documents are added before it is capped
                at, back = np.unique(cell, return_inverse=True)
                more = np.bincount(back, weights=add, minlength=len(at)).astype(np.int64)
                own[r, at.astype(np.int64)] = np.minimum(own[r, at.astype(np.int64)] + more, least)
        if seen:
            parts = own.reshape(PIECES, step)
            some = np.flatnonzero(parts.any(axis=1))
            yield _piece(some.tolist(), [parts[k] for k in some])

    def add(batches):
        sums, unpack = {}, zstandard.ZstdDecompressor()
        for batch in batches:
            for p, c in zip(batch.column("piece").to_pylist(), batch.column("counts"), strict=True):
                got = np.frombuffer(unpack.decompress(c.as_py()), np.uint8)
                sums[p] = np.minimum(sums[p].astype(np.int16) + got, least).astype(np.uint8) if p in sums else got
        yield _piece(list(sums), list(sums.values()))

    spec = "piece int, counts binary"
    made = docs.select("text", "lang").mapInArrow(count, spec).repartition("piece").mapInArrow(add, spec)
    out = np.zeros((PIECES, step), np.uint8)
    for row in made.collect():  # PIECES rows
        out[row.piece] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.counts)), np.uint8)
    return out.reshape(ROWS, WIDTH)


def term_counts(docs: DataFrame, sketch: np.ndarray, least: int) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents): exact for every term that ``least`` documents of
    its language may have; a term that the sketch rules out is dropped before anything is shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(zstandard.ZstdCompressor().compress(sketch.tobytes()))

    def count(batches):
        known = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value), np.uint8).reshape(ROWS, WIDTH)
        for batch, text in steps(batches):
            t = Terms(text)
            m = max(1, len(t.values))
            langs, lang = _codes(batch.column("lang"))
            sources, source = _codes(batch.column("source"))
            pair, at = np.unique(lang[t.doc] * m + t.term, return_inverse=True)
            which, term = np.divmod(pair, m)
            likely = np.ones(len(pair), bool)
            for r, cell in enumerate(_cells(t.hash[term], _hashes(langs)[which])):
                likely &= known[r, cell.astype(np.int64)] >= least
            keep = likely[at]
            key = (lang[t.doc] * max(1, len(sources)) + source[t.doc])[keep] * m + t.term[keep]
            key, at = np.unique(key, return_inverse=True)
            n, d = (np.bincount(at, weights=x, minlength=len(key)).astype(np.int64) for x in (t.n[keep], np.ones(int(keep.sum()))))
            group, term = np.divmod(key, m)
            which, origin = np.divmod(group, max(1, len(sources)))
            texts = [langs.take(pa.array(which)), sources.take(pa.array(origin)), t.values.take(pa.array(term)).cast(pa.binary())]
            names = ["lang", "source", "term", "n", "docs"]
            yield pa.RecordBatch.from_arrays([x.cast(pa.string()) for x in texts] + [pa.array(n), pa.array(d)], names)

    found = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kinds)), exact at any size."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + kinds).cast("decimal(20,0)"))


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); below 2^63 as shares are at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """How far each source's words lie from those of every other source of its language, and its most telling terms.

    lang, source, part, item, value, rank. Part ``pair`` has the other sources, part ``term`` the
    ``top`` terms that the source has oftener than its language.

    The sum over all kept terms of a pair is taken sparsely: a term that neither source has adds the same
    each time, terms of one source alone depend on their count only and are summed by distinct count, and
    only terms that both have are joined.

    Defined cases: null text, lang and source are ''; every row is a document, repeated rows too, and needs
    no id; a group without terms has shares of no occurrence; a language without kept terms has pairs of
    value 0 and no terms; a language with one source has no pairs; an empty table gives no rows; further
    columns are ignored.
    """
    spark = docs.sparkSession
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    docs = docs.select(*blank)
    counts = table(term_counts(docs, document_sketch(docs, least), least), "term-counts")
    words = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("in_docs"))
    words = words.filter(F.col("in_docs") >= least).select("lang", "term", "all")
    kept = table(counts.join(words, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "kept-terms")

    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    whole = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count(F.lit(1)).alias("kinds"))
    group = docs.select("lang", "source").distinct().join(size, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0)
    group = table(group.withColumn("base", F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds")))), "groups")

    # a group with a third of all terms is dealt over many tasks where the groups are too many to be sent to all
    salts = min(n_parts(spark), 256)
    salt = F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")
    salted = group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = kept.withColumn("salt", salt).join(salted, ["lang", "source", "salt"])
    p, q = share(F.col("n"), F.col("total"), F.col("kinds")), share(F.col("all"), F.col("lang_total"), F.col("kinds"))
    rows = table(rows.select("lang", "source", "term", "base", p.alias("p"), q.alias("q")), "term-shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    told = told.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    other = group.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"), F.col("own").alias("other_own"))
    pairs = group.select("lang", "source", "base", "kinds", "own").join(other, "lang").filter("source <> item")
    neither = (F.col("kinds") - F.col("own") - F.col("other_own")) * excess(F.col("base"), F.col("other_base"))
    flat = pairs.select("lang", "source", "item", F.when(F.col("kinds") > 0, neither).otherwise(F.lit(0).cast("long")).alias("value"))
    # each row below has what it adds to its pair (there) and to the pair turned round (back)
    level = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    level = level.join(pairs.select("lang", "source", "item", "other_base"), ["lang", "source"])
    p, b = F.col("p"), F.col("other_base")
    alone = level.select("lang", "source", "item", (F.col("m") * excess(p, b)).alias("there"), (F.col("m") * excess(b, p)).alias("back"))
    left = rows.select("lang", "term", "source", F.col("p").alias("pa"), F.col("base").alias("ba"))
    right = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("pb"), F.col("base").alias("bb"))
    pa_, pb, ba, bb = (F.col(c) for c in ("pa", "pb", "ba", "bb"))
    there = excess(pa_, pb) - excess(pa_, bb) - excess(ba, pb) + excess(ba, bb)
    back = excess(pb, pa_) - excess(pb, ba) - excess(bb, pa_) + excess(bb, ba)
    both = left.join(right, ["lang", "term"]).filter("source < item").select("lang", "source", "item", there.alias("there"), back.alias("back"))
    sums = alone.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    turned = F.array(
        F.struct("source", "item", F.col("there").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")),
    )
    sums = sums.select("lang", F.explode(turned).alias("x")).select("lang", "x.*").unionByName(flat)
    far = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    far = far.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best))
    return far.unionByName(told).select("lang", "source", "part", "item", "value", "rank")
