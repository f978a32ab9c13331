"""Exact dedup by 128-bit content hash with a byte check inside every group; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: str = "min", normalise=ascii_lower, digest=F.md5) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the 128-bit hash of the normalised text *and* the text itself, so rows of
    one group are equal byte for byte whatever the hash does. Equal rows collapse in each map task
    before the shuffle: a group holding a third of the table leaves a task as one row, and each
    distinct text crosses the network once per task at most. Rows then meet their group by hash
    alone (slim rows; a hot hash is one row on the group side, so AQE splits the other side).
    Only hashes that two different texts share send texts through a second join.

    ``keep``: which id of a group stays, "min" or "max". ``digest``: column function for the 128-bit hash, in hexadecimal.

    Defined cases: a null text counts as empty; empty texts are equal to each other; null ids never
    win while the group has another id, and a group of null ids only has a null keep_id with every
    row kept; rows repeating one (id, text) are all kept, as an id names one document; texts of any
    length are compared whole; other columns are ignored; an empty table gives an empty result.
    """
    norm: Column = normalise(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_t")).select("_id", "_t", F.unhex(digest(F.col("_t").cast("binary"))).alias("_h"))
    pick = F.min if keep == "min" else F.max
    groups = rows.groupBy("_h", "_t").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("_h", F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    groups = table(groups, "exact-groups")
    shared = groups.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_h")
    if shared.isEmpty():  # no two texts share a hash
        out = rows.drop("_t").join(groups, "_h")
    else:
        shared = table(shared, "exact-shared")
        clash = rows.join(shared, "_h", "left_semi")
        clash_groups = clash.groupBy("_h", "_t").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        clashed = clash.join(clash_groups, ["_h", "_t"]).withColumn("text_sha256", F.sha2(F.col("_t").cast("binary"), 256))
        out = rows.drop("_t").join(groups.join(shared, "_h", "left_anti"), "_h").drop("_h").unionByName(clashed.drop("_h", "_t"))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.expr("_id <=> keep_id").alias("kept"), "text_sha256")
