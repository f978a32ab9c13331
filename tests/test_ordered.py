"""Neighbours in an order within keys, cut into pieces or not, against plain windows; plans over accounts that hold much."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import behavioral, ordered, sequences


def events(spark, n=4000):
    """A third of the rows has one key; times repeat, and some keys, times and values are null."""
    i = F.col("id")
    t0 = dt.datetime(2024, 1, 1)
    key = F.when(i % 3 == 0, "hub").when(i % 50 == 1, None).otherwise(F.concat(F.lit("k"), (i % 40).cast("string")))
    at = F.when(i % 97 == 0, None).otherwise(F.timestamp_micros(F.unix_micros(F.lit(t0).cast("timestamp")) + F.pmod(F.xxhash64(i), F.lit(n // 2)) * 1_000_000))
    return spark.range(n).select(key.alias("k"), at.cast("timestamp_ntz").alias("t"), i.alias("i"), F.when(i % 11 != 0, i * 10).alias("v")).repartition(5)


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("whole", [20, 500, 10_000])
def test_neighbours_equal_a_plain_window(spark, ahead, whole):
    df = events(spark)
    got = ordered.neighbour(df, ["k"], ["t", "i"], "v", "x", ahead, whole)
    want = df.withColumn("x", (F.lead if ahead else F.lag)("v").over(Window.partitionBy("k").orderBy("t", "i")))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    row = lambda r: tuple(r)
    assert sorted(map(row, got.collect()), key=repr) == sorted(map(row, want.collect()), key=repr)


def test_cuts_are_sketched_once(spark):
    """A second sketch may cut elsewhere: then edge rows of one cut would meet pieces of another."""
    got = ordered.neighbour(events(spark), ["k"], ["t", "i"], "v", "x", whole=100)
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_of_a_heavy_key_are_even(spark):
    df = events(spark)
    heavy = ordered.pieces(df, ["k"], "t", whole=100).collect()
    hub = [r for r in heavy if r.k == "hub"]
    assert len(hub) == 1 and hub[0].cuts == sorted(hub[0].cuts)
    n = df.filter("k = 'hub'").count()
    assert abs(len(hub[0].cuts) + 1 - n / 100) <= 3
    micros = F.unix_micros(F.col("t").cast("timestamp"))
    place = F.size(F.filter(F.array(*map(F.lit, hub[0].cuts)), lambda c: c <= micros))
    assert max(r["count"] for r in df.filter("k = 'hub' AND t IS NOT NULL").groupBy(place).count().collect()) <= 200


def test_no_rows_and_no_heavy_key(spark):
    df = events(spark)
    assert ordered.pieces(df, ["k"], "t") is None
    assert ordered.neighbour(df.limit(0), ["k"], ["t", "i"], "v", "x").count() == 0


def transfers(spark, n=3000):
    i = F.col("id")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64(i), F.lit(1_000_000)))
    return spark.range(n).select(i.alias("transaction_id"), F.when(i % 3 == 0, 0).otherwise(i % 50 + 1).alias("sender_id"), (i % 53 + 100).alias("receiver_id"), (i % 90 + 1.5).alias("amount"), at.cast("timestamp_ntz").alias("timestamp"))


def test_gaps_do_not_depend_on_pieces(spark):
    df = transfers(spark)
    cut = {r.account_id: r for r in behavioral.activity_gaps(df, whole=60).collect()}
    plain = {r.account_id: r for r in behavioral.activity_gaps(df).collect()}
    assert set(cut) == set(plain)
    for k, r in plain.items():
        assert cut[k].burst_index == pytest.approx(r.burst_index, rel=1e-12) and cut[k].dormancy_score == r.dormancy_score


def test_oldest_events_are_limited_before_they_meet(spark):
    """The oldest 200 events of an account are kept where its rows lie, so a heavy account sends 200 a task."""
    plan = sequences.sequence_rows(transfers(spark), 200)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
