"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, table

#: Words: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank`` (from 1) in a total order without one task seeing all rows: range partitions, then offsets."""
    parts = table(df.repartitionByRange(n_parts(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "ranked")
    ends = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_r", rank).join(starts, "_part").withColumn("rank", F.col("_r") + F.col("_before")).drop("_part", "_r", "_before")


def water_level(sources: DataFrame) -> tuple[int, int]:
    """(num, den) of the level: a source of weight w gets min(cap, w * num / den).

    ``sources``: weight, cap and size, all whole numbers. Clamps sources above their cap and shares
    the rest by weight until none is above; each round is one aggregate that returns four numbers.
    """
    total = sources.agg(F.sum("size")).first()[0] or 0
    num, den, clamped = total, 0, -1
    while True:
        over = F.lit(False) if den == 0 else F.col("cap") * F.lit(den) < F.col("weight") * F.lit(num)
        row = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        n, caps, weights = (x or 0 for x in row)
        if n == clamped or not weights:
            return num, max(den, 1)
        num, den, clamped = total - caps, weights, n if den else -1


def mix_sources(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target (of its source) and taken (copies times size).

    Sources in code point order (null last) take ``weights`` in turn; targets share the sum of all
    sizes, at most ``max_epochs`` times a source's own size. A source at f = target / source_size
    takes every document floor(f) times and, for the rest, documents in the order of a seeded hash
    while the middle of the next one lies below the remaining words: the miss is at most half a document.

    No source is ever gathered in one task: the hash order is cut into 4096 runs a source, runs are
    summed, and only the documents of a run are ordered together.

    Defined cases: null or empty texts have size 0 and take 0; a null source is a source; a source
    of size 0 has target 0; documents with one id (or null) are ordered by id then size, and equal
    rows are told apart by nothing but their order, which leaves the sums the same; other columns
    are ignored; an empty table gives an empty result.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    size = word_count(F.col("text")) if size is None else size
    rows = table(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("size"), key.alias("_key")).withColumn("_run", F.substring("_key", 1, 3)), "mix")
    runs = table(rows.groupBy("_source", "_run").agg(F.sum("size").alias("size")), "mix-runs")
    sources = ranked(runs.groupBy("_source").agg(F.sum("size").alias("size")), F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("decimal(38,0)")
    cap = F.col("size") * max_epochs
    sources = table(sources.select("_source", F.col("size").cast("decimal(38,0)").alias("size"), weight.alias("weight"), cap.cast("decimal(38,0)").alias("cap")), "mix-sources")
    num, den = map(int, water_level(sources))
    target = F.least(F.col("cap").cast("double"), F.col("weight").cast("double") * F.lit(float(num)) / F.lit(float(den)))
    sources = sources.select("_source", F.col("size").cast("long").alias("source_size"), target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    before = F.sum("size").over(Window.partitionBy("_source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_source", "_run", F.coalesce(before, F.lit(0)).alias("_before")).alias("r")
    runs = runs.join(sources.alias("s"), F.expr("r._source <=> s._source")).select("r._source", "_run", "_before", "source_size", "target", "_whole", "_rest").alias("r")
    inside = F.sum("size").over(Window.partitionBy("_source", "_run").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).alias("d")
    out = rows.join(runs, F.expr("d._source <=> r._source AND d._run = r._run"))
    extra = F.when(F.col("_before") + F.col("_inside") + F.col("size") / 2 <= F.col("_rest"), 1).otherwise(0)
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", ((F.col("_whole") + extra) * F.col("size")).alias("taken"))
