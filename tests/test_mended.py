"""Replayed batches, reloaded encoders, evictions, samples of a forest's trees, absent optional libraries."""

import json
import subprocess
import sys
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import Jdbc
from ledgerlens.operators import sequences, training
from ledgerlens.plans.views import ev, p2p
from ledgerlens.sources import io
from ledgerlens.streaming import ingest

ROOT = Path(__file__).resolve().parent.parent


def test_a_replayed_first_batch_is_not_added_twice(spark, sf_dir, tmp_path):
    rows = p2p(spark, sf_dir).select(*(F.col(c).cast("string").alias(c) for c in ("transaction_id", "sender_id", "receiver_id")), "amount", "timestamp", "transaction_type")
    rows.write.parquet(f"{tmp_path}/in")
    log = ingest.ChangeLog(spark, f"{tmp_path}/edges", ["src", "dst"])
    sums = []
    for state in ("a", "b"):  # a new checkpoint numbers the same files 0 again, as a lost commit does
        ingest.running_edges(ingest.read_stream(spark, f"{tmp_path}/in"), log, f"{tmp_path}/{state}").awaitTermination()
        sums.append(log.read().agg(F.sum("frequency"), F.round(F.sum("weight"), 2)).first())
    assert sums[0] == sums[1] and sums[0][0] == rows.count()


def test_a_reloaded_encoder_scores_alike(spark, sf_dir, tmp_path):
    """On data whose own means differ from those that it was fitted with."""
    stats = sequences.sequence_stats(sequences.sequence_rows(ev(spark, sf_dir), 50), 50)
    stats = stats.withColumn("amount_skew", F.when(F.col("account_id") % 3 > 0, F.col("amount_skew"))).cache()
    encoder = sequences.SequenceEncoder(4).fit(stats)
    part = stats.filter("account_id % 5 = 0").withColumn("amount_skew", F.when(F.col("account_id") % 3 > 0, F.col("amount_skew") + 100))
    want = {r.account_id: r.code for r in encoder.encode(part).collect()}
    encoder.save(f"{tmp_path}/encoder")
    got = {r.account_id: r.code for r in sequences.SequenceEncoder().load(f"{tmp_path}/encoder").encode(part).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=False))


def test_a_full_cache_says_what_it_dropped(spark):
    cache = io.Cache(size=3)
    cache.put(spark.range(5).coalesce(1).select(F.col("id").alias("account_id"), F.lit(1).alias("v")).transform(lambda d: io.cache_entries(d, "risk_score", 60)))
    assert cache.get("risk_score:4") == {"v": 1} and cache.get("risk_score:0") is None
    assert cache.stats()["keys"] == 3 and cache.stats()["evicted"] == 2


def test_each_tree_draws_from_all_rows(spark):
    """One far point in a hundred stands out, though no tree's sample holds many of them; few rows are enough too."""
    rows = spark.range(20_000).select("id", F.array(F.rand(1), F.rand(2)).alias("x"))
    far = F.transform("x", lambda v: v + 9 * F.when(v > 0.5, 1).otherwise(-1))
    rows = rows.withColumn("x", F.when(F.col("id") % 100 == 7, far).otherwise(F.col("x"))).cache()
    got = training.isolation_forest(rows, trees=40, sample=64)
    assert got.count() == 20_000 and got.filter("score <= 0 OR score >= 1").isEmpty()
    means = {r.far: r.score for r in got.groupBy((F.col("id") % 100 == 7).alias("far")).agg(F.avg("score").alias("score")).collect()}
    assert means[True] > means[False] + 0.1
    assert {r.id: r.score for r in training.isolation_forest(rows.repartition(7), trees=40, sample=64).collect()} == {r.id: r.score for r in got.collect()}
    small = training.isolation_forest(rows.limit(5), trees=3, sample=64)
    assert small.count() == 5


def test_entry_without_optional_libraries():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, has, twins = out.stdout.split()
    assert int(n) > 100 and has == "False" and int(twins) > 80


def test_relational_store(spark):
    """Tables, upserts and alerts in an embedded database."""
    store = io.JdbcStore(Jdbc(user=""), url="jdbc:derby:memory:ledger;create=true")
    store.initialize(spark)
    store.initialize(spark)  # what is there stays
    scores = spark.createDataFrame([("a", 80.0, "high"), ("b", 10.0, "low")], "account_id string, risk_score double, risk_level string")
    store.upsert_scores(scores)
    for _ in range(2):
        store.upsert_scores(spark.createDataFrame([("b", 99.0, "critical"), ("c", 1.0, "low")], scores.schema))
    got = {r.account_id: (r.risk_score, r.risk_level) for r in store.read(spark, "risk_scores").collect()}
    assert got == {"a": (80.0, "high"), "b": (99.0, "critical"), "c": (1.0, "low")}
    assert store.read(spark, "risk_scores").filter("updated_at IS NULL").isEmpty()
    alerts = spark.createDataFrame([("a", 80.0, "high", "network_risk")], "account_id string, risk_score double, risk_level string, alert_type string")
    store.insert_alerts(alerts)
    store.insert_alerts(alerts)
    rows = store.read(spark, "alerts").collect()
    assert len({r.alert_id for r in rows}) == 2 and all(not r.resolved and r.created_at for r in rows)
    assert io.high_risk(store.read(spark, "risk_scores")).count() == 2
    assert io.find_alerts(store.read(spark, "alerts")).count() == 2
    store.close()
    store.close()


class Session:
    """Writes what it is told to a file of its own."""

    def __init__(self, folder):
        self.file = open(f"{folder}/{uuid.uuid4().hex}", "w")  # noqa: SIM115

    def run(self, statement, **parameters):
        self.file.write(json.dumps([statement, parameters]) + "\n")

    def close(self):
        self.file.close()


def test_graph_store(spark, tmp_path):
    folder = str(tmp_path)

    def open_session():
        import sys

        sys.path.insert(0, tests)
        from test_mended import Session

        return Session(folder)

    tests = str(ROOT / "tests")
    store = io.GraphStore(open_session, batch=4)
    with pytest.raises(RuntimeError):
        store.setup_schema()
    store.connect()
    store.setup_schema()
    v = spark.range(10).select(F.col("id").alias("account_id"), F.lit("2025-01-01").cast("timestamp").alias("seen"))
    e = spark.range(9).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(2.0).alias("weight"), F.lit(1).alias("frequency"), F.lit("x").alias("other"))
    store.upload(v, e)
    store.clear()
    store.close()
    said = [json.loads(x) for f in tmp_path.iterdir() for x in f.read_text().splitlines()]
    rows = {s: [r for t, p in said if t == s for r in p["rows"]] for s in (io.MERGE_NODES, io.MERGE_EDGES)}
    assert sorted(r["account_id"] for r in rows[io.MERGE_NODES]) == list(range(10)) and rows[io.MERGE_NODES][0]["seen"] == "2025-01-01T00:00:00"
    assert sorted((r["src"], r["dst"]) for r in rows[io.MERGE_EDGES]) == [(i, i + 1) for i in range(9)]
    assert max(len(p["rows"]) for _, p in said if p) <= 4 and set(rows[io.MERGE_EDGES][0]) == {"src", "dst", "weight", "frequency"}
    assert {s for s, p in said if not p} == {"RETURN 1", *io.SCHEMA, io.CLEAR}
