"""The account graph as two tables: vertices and weighted directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money


def _mean_gap():
    span = F.unix_micros(F.col("last_txn").cast("timestamp")) - F.unix_micros(F.col("first_txn").cast("timestamp"))
    return F.when((F.col("frequency") > 1) & (F.col("first_txn") != F.col("last_txn")), span / 1e6 / (F.col("frequency") - 1)).otherwise(0.0)


def edges(txns: DataFrame, *extra: str) -> DataFrame:
    """One row per (src, dst): weight, frequency, amounts, first and last time, mean gap in seconds."""
    rows = txns.withColumnsRenamed({"sender_id": "src", "receiver_id": "dst"}).groupBy(*extra, "src", "dst").agg(
        money("amount").alias("weight"), F.count(F.lit(1)).alias("frequency"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
        F.min("timestamp").alias("first_txn"), F.max("timestamp").alias("last_txn"),
    )
    return rows.withColumn("avg_amount", F.col("weight") / F.col("frequency")).withColumn("avg_inter_txn_gap", _mean_gap())


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of old and new transactions together; every measure merges, so the result equals a full build."""
    rows = old.unionByName(new).groupBy("src", "dst").agg(
        F.sum(F.col("weight").cast("decimal(28,2)")).cast("double").alias("weight"), F.sum("frequency").alias("frequency"), F.min("min_amount").alias("min_amount"),
        F.max("max_amount").alias("max_amount"), F.min("first_txn").alias("first_txn"), F.max("last_txn").alias("last_txn"),
    )
    return rows.withColumn("avg_amount", F.col("weight") / F.col("frequency")).withColumn("avg_inter_txn_gap", _mean_gap())


def vertices(accounts: DataFrame | None, edge: DataFrame) -> DataFrame:
    """Accounts and edge ends; ends without an account have no attributes but the defaults."""
    ids = edge.select(F.explode(F.array("src", "dst")).alias("account_id"))
    if accounts is None:
        return ids.distinct().select("account_id", *(F.lit(v).alias(k) for k, v in (("account_type", "unknown"), ("kyc_level", "unknown"), ("region", "unknown"), ("is_fraud", False), ("fraud_role", "normal"))))
    ids = ids.unionByName(accounts.select("account_id")).distinct()
    has = set(accounts.columns)
    pick = lambda name, source, default: F.coalesce(F.col(source), F.lit(default)).alias(name) if source in has else F.lit(default).alias(name)
    return ids.join(accounts, "account_id", "left").select(
        "account_id", pick("account_type", "account_type", "unknown"), pick("kyc_level", "kyc_level", "unknown"),
        pick("region", "geographic_region", "unknown"), pick("is_fraud", "is_fraud", False), pick("fraud_role", "fraud_role", "normal"),
    )


def rolling_windows(txns: DataFrame, days: tuple[int, ...] = (7, 30, 90), lifetime: bool = True, reference=None) -> DataFrame:
    """Edges of each window ending at ``reference`` (default: the last transaction), in one pass.

    Each transaction is exploded into the windows it lies in, so one aggregate builds all graphs.
    """
    if reference is None:
        reference = txns.agg(F.max("timestamp")).first()[0]
        if reference is None:
            raise ValueError("no transactions")
    ref = F.lit(reference).cast("timestamp_ntz")
    age = [F.when((F.col("timestamp") <= ref) & (F.col("timestamp") >= ref - F.expr(f"interval {d} days")), F.lit(f"window_{d}d")) for d in days]
    keys = F.array_compact(F.array(*age, *([F.lit("lifetime")] if lifetime else [])))
    return edges(txns.withColumn("window_key", F.explode(keys)), "window_key")


def window(graphs: DataFrame, key: str) -> DataFrame:
    got = graphs.filter(F.col("window_key") == key)
    if got.isEmpty():
        raise KeyError(key)
    return got.drop("window_key")


def primary_graph(graphs: DataFrame) -> DataFrame:
    """The lifetime graph, or else the first window by key."""
    keys = [r[0] for r in graphs.select("window_key").distinct().orderBy("window_key").limit(64).collect()]
    return window(graphs, "lifetime" if "lifetime" in keys else keys[0])


def undirected(edge: DataFrame) -> DataFrame:
    """Distinct pairs u < v, without loops."""
    return edge.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
