"""Behavioural features of accounts: one aggregate a direction, one window pass for timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, money, seconds, zero
from .ordered import WHOLE, neighbour


def _side(txns: DataFrame, me: str, other: str, word: str) -> DataFrame:
    return txns.groupBy(F.col(me).alias("account_id")).agg(
        money("amount").alias(f"{word}_volume"),
        (F.sum(F.col("amount").cast("decimal(28,2)")).cast("double") / F.count("amount")).alias(f"avg_{word}_amount"),
        F.max("amount").alias(f"max_{word}_amount"),
        F.count(F.lit(1)).alias(f"{word}_txn_count"),
        F.count_distinct(F.coalesce(F.col(other).cast("string"), F.lit("\0"))).alias(f"{word}_counterparty_diversity"),
    )


def incoming(txns: DataFrame) -> DataFrame:
    return _side(txns, "receiver_id", "sender_id", "incoming")


def outgoing(txns: DataFrame) -> DataFrame:
    return _side(txns, "sender_id", "receiver_id", "outgoing")


def receive_to_send_delay(txns: DataFrame) -> DataFrame:
    """Hours from the last receipt to the first sending, at least 0; 0 where a side is missing."""
    got = txns.groupBy(F.col("receiver_id").alias("account_id")).agg(F.max("timestamp").alias("last_incoming"))
    sent = txns.groupBy(F.col("sender_id").alias("account_id")).agg(F.min("timestamp").alias("first_outgoing"))
    hours = F.greatest(seconds("last_incoming", "first_outgoing"), F.lit(0)) / 3600.0
    return got.join(sent, "account_id", "full_outer").select("account_id", zero(hours).alias("receive_to_send_delay_hours"))


def both_directions(txns: DataFrame) -> DataFrame:
    """One row per account and side of a transaction."""
    return txns.select(F.explode(F.array("sender_id", "receiver_id")).alias("account_id"), "timestamp")


def activity_gaps(txns: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Burst index (spread of gaps over their mean) and dormancy (longest gap over the active span).

    An account of more than ``whole`` rows is worked on in pieces of its time."""
    rows = neighbour(both_directions(txns), ["account_id"], ["timestamp"], "timestamp", "before", whole=whole)
    rows = rows.withColumn("gap", seconds("before", "timestamp"))
    agg = rows.groupBy("account_id").agg(
        F.stddev_samp("gap").alias("sd"), F.avg("gap").alias("mean"), F.max("gap").alias("longest"), seconds(F.min("timestamp"), F.max("timestamp")).alias("span")
    )
    return agg.select("account_id", zero(F.col("sd") / (F.col("mean") + EPS)).alias("burst_index"), zero(F.col("longest") / (F.col("span") + EPS)).alias("dormancy_score"))


def repeat_ratio(txns: DataFrame) -> DataFrame:
    pairs = txns.groupBy("sender_id", "receiver_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(F.col("sender_id").alias("account_id")).agg((zero(F.sum(F.when(F.col("n") > 1, F.col("n")))) / (F.sum("n") + EPS)).alias("repeat_transfer_ratio"))


def balance_ratios(sides: DataFrame) -> DataFrame:
    """From the outer join of both sides; a missing side makes both ratios 0."""
    i, o = F.col("incoming_volume"), F.col("outgoing_volume")
    return sides.withColumns({"net_balance_ratio": zero((i - o) / (i + o + EPS)), "velocity_score": zero(o / (i + EPS))})


def behavioral_features(txns: DataFrame) -> DataFrame:
    """All 16 features; accounts without transactions are absent."""
    sides = balance_ratios(incoming(txns).join(outgoing(txns), "account_id", "full_outer"))
    for part in (receive_to_send_delay(txns), activity_gaps(txns), repeat_ratio(txns)):
        sides = sides.join(part, "account_id", "left")
    return sides.na.fill(0)
