"""Streams that keep their state by key, tables of single reads, and saved models."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import scoring
from ledgerlens.sources import io
from ledgerlens.streaming import ingest

DAY = dt.datetime(2025, 3, 1)


def put(spark, path, rows):
    """rows: id, from, to, amount, hours after DAY."""
    full = [(str(i), a, b, float(x), DAY + dt.timedelta(hours=h), "p2p") for i, a, b, x, h in rows]
    spark.createDataFrame(full, "transaction_id string, sender_id string, receiver_id string, amount double, timestamp timestamp_ntz, transaction_type string").coalesce(1).write.mode("append").parquet(path)


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_restarted_query_goes_on_from_its_state(spark, tmp_path):
    log = ingest.ChangeLog(spark, f"{tmp_path}/edges", ["src", "dst"])
    with pytest.raises(FileNotFoundError):
        log.read()
    go = lambda: ingest.running_edges(ingest.read_stream(spark, f"{tmp_path}/in"), log, f"{tmp_path}/state").awaitTermination()
    put(spark, f"{tmp_path}/in", [(k, f"a{k}", f"b{k % 7}", 10, k % 5) for k in range(3000)])
    go()
    put(spark, f"{tmp_path}/in", [(9000, "a1", "b1", 5, 50), (9001, "new", "b1", 2, 1)])
    go()
    go()  # nothing new: nothing changes
    got = {(r.src, r.dst): (r.weight, r.frequency, r.last_txn) for r in log.read().collect()}
    assert len(got) == 3001
    assert got["a1", "b1"] == (15.0, 2, DAY + dt.timedelta(hours=50)) and got["new", "b1"][:2] == (2.0, 1) and got["a2", "b2"][:2] == (10.0, 1)
    first, second = (folder_bytes(f"{tmp_path}/edges/epoch={k}") for k in (0, 1))
    assert spark.read.parquet(f"{tmp_path}/edges/epoch=1").count() == 2 and second < first / 3


def test_windows_drop_what_comes_too_late(spark, tmp_path):
    log = ingest.ChangeLog(spark, f"{tmp_path}/windows", ["window_start", "src", "dst"])
    go = lambda: log.follow(ingest.sliding_edges(ingest.read_stream(spark, f"{tmp_path}/in"), "2 days", "1 day", "1 day"), f"{tmp_path}/state").awaitTermination()
    put(spark, f"{tmp_path}/in", [(1, "a", "b", 10, 0), (2, "a", "b", 1, 24 * 10)])
    go()
    # a day behind the newest is in time, five days are not: its windows have been let go
    put(spark, f"{tmp_path}/in", [(3, "a", "b", 100, 24 * 10 - 20), (4, "a", "b", 1000, 24 * 5)])
    go()
    got = {r.window_start.replace(tzinfo=None): (r.weight, r.frequency) for r in log.read().collect()}
    day = lambda n: DAY + dt.timedelta(days=n)
    assert got == {day(-1): (10.0, 1), day(0): (10.0, 1), day(8): (100.0, 1), day(9): (101.0, 2), day(10): (1.0, 1)}


def test_panes_fold_to_the_windows_and_their_state_is_on_disk(spark, tmp_path):
    """One key of state a day and edge, not one a window; the state store keeps files of its own, no rows in the heap."""
    rows = [(k, f"a{k % 3}", f"b{k % 2}", 1 + k % 5, 5 * k % 400) for k in range(300)]
    put(spark, f"{tmp_path}/in", rows)
    log = ingest.ChangeLog(spark, f"{tmp_path}/panes", ["pane", "src", "dst"])
    run = log.follow(ingest.pane_edges(ingest.read_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/state")
    run.awaitTermination()
    state = next(p["stateOperators"][0] for p in run.recentProgress if p["stateOperators"][0]["numRowsUpdated"])
    assert state["numRowsUpdated"] == len({(a, b, h // 24) for _, a, b, _, h in rows})
    assert any(k.startswith("rocksdb") for k in state["customMetrics"])
    key = ["window_start", "src", "dst", "weight", "frequency"]
    got = ingest.fold_panes(log.read()).select(key).collect()
    want = ingest.sliding_edges(spark.read.parquet(f"{tmp_path}/in")).select(key).collect()
    assert sorted(got) == sorted(want) and len({r.window_start for r in got}) > 20
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", None) is None


def test_a_single_read_opens_one_folder(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("account_id"), (F.col("id") * 2).alias("risk_score"))
    io.save_buckets(rows, f"{tmp_path}/scores")
    one = io.point_read(spark, f"{tmp_path}/scores", 77)
    assert one.columns == ["account_id", "risk_score"] and one.collect() == [(77, 154)]
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*account_id", plan)
    assert sorted(io.point_read(spark, f"{tmp_path}/scores", 1, 2, 9999).collect()) == [(1, 2), (2, 4)]
    texts = spark.createDataFrame([("x", 1), ("y", 2)], "account_id string, v int")
    io.save_buckets(texts, f"{tmp_path}/texts", buckets=4)
    assert io.point_read(spark, f"{tmp_path}/texts", "y", buckets=4).collect() == [("y", 2)]
    with pytest.raises(FileNotFoundError):
        io.point_read(spark, f"{tmp_path}/none", 1)


def test_a_saved_meta_model_knows_its_columns(spark, tmp_path):
    s = spark.range(100).select(F.col("id").cast("string").alias("account_id"), (F.col("id") % 7 / 7.0).alias("sig_y"), (F.col("id") % 4 / 4.0).alias("sig_x"))
    y = s.select("account_id", (F.col("sig_x") > 0.6).cast("int").alias("label"))
    m = scoring.MetaModel(2)
    m.fit(s, y)
    m.save(f"{tmp_path}/meta")
    back = scoring.MetaModel().load(f"{tmp_path}/meta")
    turned = s.select("account_id", "sig_x", "sig_y")
    assert back.columns == ["sig_y", "sig_x"]
    assert sorted(back.predict(turned).select("account_id", "probability").collect()) == sorted(m.predict(s).select("account_id", "probability").collect())
