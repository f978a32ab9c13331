"""Hand-built cases with known results."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import Fraud, Settings, Simulation
from ledgerlens.operators import behavioral, embeddings, explain, graph, iterate, metrics, patterns, propagation, scoring, sequences, simulate, structural, training, validate
from ledgerlens.sources import io

T0 = dt.datetime(2025, 1, 1)


def txns(spark, rows):
    return spark.createDataFrame([(f"t{i}", s, r, float(a), T0 + dt.timedelta(seconds=t), "p2p") for i, (s, r, a, t) in enumerate(rows)], "transaction_id string, sender_id string, receiver_id string, amount double, timestamp timestamp_ntz, transaction_type string")


def edges(spark, rows):
    return spark.createDataFrame([(s, d, float(w), int(f)) for s, d, w, f in rows], "src string, dst string, weight double, frequency long")


def verts(spark, ids, fraud=()):
    return spark.createDataFrame([(i, i in fraud) for i in ids], "account_id string, is_fraud boolean")


def as_dict(df, value):
    return {r.account_id: r[value] for r in df.collect()}


def test_one_sided_accounts_have_zero_ratios(spark):
    f = behavioral.behavioral_features(txns(spark, [("a", "b", 10, 0)]))
    assert as_dict(f, "net_balance_ratio") == {"a": 0.0, "b": 0.0}


def test_self_transfer_counts_twice(spark):
    t = txns(spark, [("a", "a", 10, 0), ("a", "b", 5, 100)])
    assert behavioral.both_directions(t).filter("account_id = 'a'").count() == 3
    e = graph.edges(t)
    d = structural.degrees(e, graph.vertices(None, e)).filter("account_id = 'a'").first()
    assert (d.in_degree, d.out_degree) == (1, 2)


def test_clean_batch(spark):
    t = txns(spark, [("a", "b", 10, 0), ("a", "a", 10, 0), ("a", "b", -1, 0)])
    assert io.clean_batch(t.unionByName(t)).count() == 1


def test_cycles(spark):
    e = edges(spark, [("1", "2", 1, 1), ("2", "3", 1, 1), ("3", "1", 1, 1), ("2", "1", 1, 1), ("3", "4", 1, 1), ("4", "4", 1, 1)])
    got = as_dict(patterns.circularity(e, verts(spark, "1234"), 4), "circularity_score")
    assert got == {"1": 1.0, "2": 1.0, "3": 0.5, "4": 0.5}  # loops are cycles


def test_chain_decays(spark):
    e = edges(spark, [("A", "B", 100, 5), ("B", "C", 100, 5), ("C", "D", 100, 5)])
    v = verts(spark, "ABCD", fraud=("A",))
    s = as_dict(propagation.propagate(e, v), "advanced_propagation_score")
    assert s["A"] >= 0.9 and s["A"] >= s["B"] >= s["C"] >= s["D"] >= 0


def test_no_seeds_and_empty_graph(spark):
    e = edges(spark, [("A", "B", 1, 1)])
    assert set(as_dict(propagation.propagate(e, verts(spark, "AB")), "advanced_propagation_score").values()) == {0.0}
    empty = e.filter("false")
    assert propagation.propagate(empty, verts(spark, "A").filter("false")).count() == 0


def test_devices(spark):
    a = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "y"), ("f", None), ("g", "z")], "account_id string, device_fingerprint_id string")
    assert as_dict(patterns.device_cluster(a), "device_cluster_score") == pytest.approx({"a": 0.666667, "b": 0.666667, "c": 1, "d": 1, "e": 1, "f": 0, "g": 0})


def test_bands(spark):
    df = spark.createDataFrame([(str(x), float(x)) for x in (90, 75, 50, 25, 24.99)], "account_id string, s double")
    assert [r[0] for r in df.select(scoring.risk_band("s")).collect()] == ["critical", "high", "medium", "low", "minimal"]


def test_reliability_skips_one(spark):
    df = spark.createDataFrame([(1.0, 0), (0.5, 1)], "p double, label int")
    assert metrics.reliability(df).first().ece == 0.25


def test_constant_column(spark):
    f = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "account_id string, x double")
    assert set(as_dict(scoring.component_scores(f, (("c", ["x"]),)), "c").values()) == {0.0}
    assert metrics.psi(metrics.long_form(f), metrics.long_form(f)).first().psi == 0.0


def test_drift_detects_shift(spark):
    a = spark.range(400).select(F.col("id").cast("string").alias("account_id"), (F.rand(1) * 2).alias("x"))
    same = metrics.feature_drift(a, a).first()
    moved = metrics.feature_drift(a, a.withColumn("x", F.col("x") + 10)).first()
    assert not same.drifted and moved.drifted


def test_strong_components_and_cores(spark):
    e = edges(spark, [("1", "2", 1, 1), ("2", "3", 1, 1), ("3", "1", 1, 1), ("3", "4", 1, 1), ("4", "5", 1, 1), ("5", "4", 1, 1), ("5", "6", 1, 1)])
    v = verts(spark, "1234567")
    assert as_dict(structural.scc_sizes(e, v), "scc_size") == {"1": 3, "2": 3, "3": 3, "4": 2, "5": 2, "6": 1, "7": 1}
    assert as_dict(structural.core_numbers(e, v), "k_core_number") == {"1": 2, "2": 2, "3": 2, "4": 1, "5": 1, "6": 1, "7": 0}
    assert as_dict(structural.clustering(e, v), "clustering_coefficient")["3"] == pytest.approx(0.333333)


def test_betweenness_of_a_path(spark):
    e = edges(spark, [("1", "2", 1, 1), ("2", "3", 1, 1)])
    assert as_dict(structural.betweenness(e, verts(spark, "123")), "betweenness") == {"1": 0.0, "2": 0.5, "3": 0.0}


def test_components(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "u long, v long")
    got = {r.id: r.component for r in iterate.components(p, spark.range(1, 8)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_spectral_is_orthonormal(spark):
    e = edges(spark, [(str(i), str((i * 3 + 1) % 11), 1, 1) for i in range(11)])
    rows = [r.embedding for r in embeddings.spectral_embedding(e, verts(spark, [str(i) for i in range(11)]), 2, 4).collect()]
    assert sum(r[0] * r[0] for r in rows) == pytest.approx(1, abs=1e-6)
    assert sum(r[0] * r[1] for r in rows) == pytest.approx(0, abs=1e-6)


def test_sequences(spark):
    t = txns(spark, [("a", "b", 10, 0), ("b", "a", 20, 3600), ("a", "c", 5, 3600)])
    rows = sequences.sequence_rows(t, 2)
    assert rows.groupBy("account_id").count().filter("count > 2").count() == 0
    assert rows.filter("amount < 0 OR amount > 1 OR delta > 1").count() == 0
    assert sequences.SequenceEncoder().anomaly(sequences.sequence_stats(rows, 2)).filter("anomaly <> 0").count() == 0


def test_simulation_invariants(spark):
    cfg = Simulation(total_accounts=300, simulation_days=90, total_transactions=2000, fraud_ratio=0.05)
    acc, t = simulate.simulate(spark, cfg)
    assert acc.count() == 300 and acc.select("account_id").distinct().count() == 300
    assert t.filter("amount <= 0 OR sender_id = receiver_id").count() == 0
    assert t.filter("is_fraud AND fraud_pattern = 'none'").count() == 0
    got = {r[0] for r in t.filter("is_fraud").select("fraud_pattern").distinct().collect()}
    assert got == {"circular_flow", "device_sharing", "device_sharing_external", "dormant_inbound", "dormant_outbound", "funnel_inbound", "funnel_outbound", "layering"}
    again = simulate.simulate(spark, cfg)[1]
    assert t.exceptAll(again).count() == 0
    assert validate.validate_accounts(acc) == (True, [])


def test_simulation_as_defined(spark):
    cfg = Simulation(total_accounts=4000, simulation_days=120, total_transactions=40_000)
    acc, t = simulate.simulate(spark, cfg)
    rows = acc.collect()
    share = lambda col, v: sum(r[col] == v for r in rows) / len(rows)
    for col, table in (("account_type", simulate.TYPES), ("kyc_level", simulate.KYC), ("geographic_region", simulate.REGIONS)):
        assert all(abs(share(col, v) - w) < 0.03 for v, w in table)
    born = {r.account_id: (r.creation_date, r.fraud_role) for r in rows}
    txns = t.collect()
    ordinary = [r for r in txns if not r.is_fraud]
    assert len({r.transaction_id for r in txns}) == len(txns)
    assert all(born[r.sender_id][1] == "normal" and born[r.sender_id][0].date() <= r.timestamp.date() for r in ordinary)
    per_day = Counter(r.timestamp.date() for r in ordinary)
    late = {d: k for d, k in per_day.items() if d >= dt.date(2025, 2, 1)}
    weekday = [k for d, k in late.items() if d.weekday() < 5]
    weekend = [k for d, k in late.items() if d.weekday() >= 5]
    assert abs(sum(weekday) / len(weekday) / 333 - 1) < 0.06
    assert abs(sum(weekend) / len(weekend) / 133 - 1) < 0.10
    for d in (dt.date(2025, 1, 2), dt.date(2025, 1, 4), dt.date(2025, 1, 8)):  # a draw an account at most
        assert per_day[d] <= 5 * sum(b <= dt.datetime.combine(d, dt.time()) and role == "normal" for b, role in born.values())
    kinds = Counter(r.transaction_type for r in ordinary)
    want = Counter()
    for ty, wt in simulate.TYPES:
        for ky, wk in simulate.KYC:
            mix = next(x[5:] for x in simulate.TEMPLATES if x[:2] == (ty, ky))
            for (kind, _, _), m in zip(simulate.KINDS, mix, strict=True):
                want[kind] += wt * wk * m / sum(mix)
    assert all(abs(kinds[k] / len(ordinary) - want[k]) < 0.03 for k in want)
    night = sum(r.timestamp.hour < 6 for r in ordinary) / len(ordinary)
    assert abs(night - 0.6 / sum(simulate.HOURS)) < 0.01
    part = simulate.allocate(cfg, Fraud())
    roles = Counter(r.fraud_role for r in rows)
    assert 3 <= roles["mule_circular"] <= 8 and 2 <= roles["mule_layer"] <= 6 and roles["originator"] <= 1
    assert roles["mule_dormant"] == part["dormant"][1] - part["dormant"][0]
    bad = [r for r in txns if r.is_fraud]
    inbound = Counter(r.receiver_id for r in bad if r.fraud_pattern == "funnel_inbound")
    assert len(inbound) == roles["mule_funnel"] and all(10 <= k <= 29 for k in inbound.values())
    pairs = [(r.sender_id, r.receiver_id) for r in bad if r.fraud_pattern == "funnel_inbound"]
    assert len(set(pairs)) == len(pairs)
    assert {r.sender_id for r in bad if r.fraud_pattern == "circular_flow"} == {a for a, (_, role) in born.items() if role == "mule_circular"}
    chain = [r for r in bad if r.fraud_pattern == "layering"]
    assert len(chain) % (roles["mule_layer"] + 1) == 0
    devices = {r.device_fingerprint_id for r in rows if r.fraud_role == "mule_device_cluster"}
    assert len(devices) == 1


def test_settings(monkeypatch):
    monkeypatch.setenv("LEDGERLENS_SIM_TOTAL_ACCOUNTS", "7")
    assert Settings.load().simulation.total_accounts == 7
    with pytest.raises(ValueError):
        Fraud(cycle_min=5, cycle_max=3)


def test_stores(spark, tmp_path):
    s = spark.createDataFrame([("a", 80.0), ("b", 10.0)], "account_id string, risk_score double")
    store = io.FileStore(spark, str(tmp_path))
    store.upsert_scores(s)
    store.upsert_scores(s.filter("account_id = 'b'").withColumn("risk_score", F.lit(99.0)))
    assert as_dict(store.read("risk_scores"), "risk_score") == {"a": 80.0, "b": 99.0}
    cache = io.Cache()
    cache.put(io.cache_entries(s, "risk_score", 60))
    assert cache.get("risk_score:a") == {"risk_score": 80.0}
    cache.invalidate("a")
    assert cache.get("risk_score:a") is None
    with pytest.raises(FileNotFoundError):
        io.load_parquet(spark, txn_path=str(tmp_path / "no"), acc_path=str(tmp_path / "no"))


def test_csv_and_report(spark, tmp_path):
    t = txns(spark, [("a", "b", 10, 0)])
    t.write.option("header", True).csv(str(tmp_path / "t"))
    spark.createDataFrame([("a",)], "account_id string").selectExpr("account_id", "null creation_date", "'x' account_type", "'y' kyc_level", "'z' geographic_region").withColumn("creation_date", F.lit(None).cast("string")).write.option("header", True).csv(str(tmp_path / "a"))
    got, _ = io.load_csv(spark, str(tmp_path / "t"), str(tmp_path / "a"))
    assert got.first().amount == 10.0
    s = spark.createDataFrame([("a", 80.0)], "account_id string, risk_score double")
    d = explain.decompose("a", behavioral.behavioral_features(t), s, 3)
    assert len(d["top_features"]) == 3 and "error" in explain.decompose("zz", s, s)
    assert "Account a" in explain.account_report("a", d, t, str(tmp_path)).read_text()


def test_temporal_split_fills_empty(spark):
    t = txns(spark, [("a", "b", 1, i) for i in range(10)])
    a = spark.createDataFrame([("a",), ("b",), ("c",)], "account_id string")
    assert training.temporal_split(t, a, fill_empty=False).count() == 2


def test_meta_model_single_class(spark):
    s = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "account_id string, sig_x double")
    m = scoring.MetaModel(2)
    assert m.fit(s, spark.createDataFrame([("a", 0), ("b", 0)], "account_id string, label int")) == {"skipped": True}
    assert set(as_dict(m.predict(s), "probability").values()) == {0.0}


def test_validation_messages(spark):
    t = txns(spark, [("a", "a", -5, 0)])
    ok, errors = validate.validate_transactions(t)
    assert not ok and len(errors) == 2
    assert validate.validate_transactions(t.drop("amount"))[1] == ["missing columns: ['amount']"]
    assert validate.label_leaks(["x", "is_fraud"]) == ["is_fraud"]
    assert validate.k_squared(spark.createDataFrame([(1000, 0.0, 0.0)], "n long, skew double, kurt double")).first().p_value > 0.9
