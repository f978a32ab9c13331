"""The registered queries do the whole job: all accounts, all dimensions, production bounds."""

import datetime as dt
from collections import Counter, defaultdict

import numpy as np

from ledgerlens.operators import explain, structural
from ledgerlens.plans import catalog, pipeline
from ledgerlens.plans.views import accounts, p2p, read

QUERIES = catalog.queries()


def ids(df):
    return {r.account_id for r in df.select("account_id").distinct().collect()}


def test_top_features_of_every_account(spark, sf_dir):
    got = QUERIES["h1_top_features"](spark, sf_dir)
    every = ids(catalog.vertex_table(spark, sf_dir))
    assert ids(accounts(spark, sf_dir)) <= every
    assert got.count() == 5 * len(every)
    some = sorted(every)[:25]
    features = catalog.r6(catalog.relational_features(spark, sf_dir)).filter(catalog.F.col("account_id").isin(some))
    cols = [c for c in features.columns if c not in explain.NOT_FEATURES and c != "account_id"]
    want = {(r.account_id, i + 1, c, float(r[c])) for r in features.collect() for i, c in enumerate(sorted(cols, key=lambda c: (-abs(float(r[c])), c))[:5])}
    assert {tuple(r) for r in got.filter(catalog.F.col("account_id").isin(some)).collect()} == want


def test_timeline_of_every_account(spark, sf_dir):
    n = Counter()
    for r in p2p(spark, sf_dir).select("sender_id", "receiver_id", catalog.F.to_date("timestamp").alias("day")).collect():
        n[r.sender_id, r.day] += 1
        n[r.receiver_id, r.day] += 1
    days = defaultdict(list)
    for a, day in n:
        days[a].append(day)
    want = {(a, min(x) + dt.timedelta(k)): 0 for a, x in days.items() for k in range((max(x) - min(x)).days + 1)} | dict(n)
    assert {(r.account_id, r.day): r.n for r in QUERIES["j9_timeline"](spark, sf_dir).collect()} == want


def test_anomalies_beyond_the_eighth_dimension(spark, tmp_path):
    """Two groups and one vector apart, all alike in the first eight dimensions."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(41):
        x = np.zeros(64)
        x[20 if i < 20 else 40 if i < 40 else 60] = 1.0
        x[8:] += 0.01 * rng.standard_normal(56)
        rows.append((i, x.tolist()))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    n1, n2, n3, n4 = (QUERIES[n](spark, str(tmp_path)).collect() for n in ("n1_isolation_forest", "n2_local_outlier_factor", "n3_density_deviation", "n4_combined_anomaly"))
    assert len({r.score for r in n1}) > 1
    assert max(n2, key=lambda r: r.lof).id == 40
    assert {r.id: r.cluster for r in n3} == {i: 0 if i < 20 else 20 if i < 40 else None for i in range(41)}
    assert n4[0].id == 40


def test_local_outlier_factor_by_brute_force(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    assert x.shape[1] == 64
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, :10]
    dist = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(dist, dist[:, -1][near]).mean(1) + 1e-10)
    want = lrd[near].mean(1) / lrd
    got = {r.id: r.lof for r in QUERIES["n2_local_outlier_factor"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    assert max(abs(got[r.vec_id] - w) for r, w in zip(rows, want, strict=True)) < 2e-6


def graph_of(spark, monkeypatch, arcs):
    e = spark.createDataFrame([(a, b, 1.0, 1) for a, b in arcs], "src long, dst long, weight double, frequency long")
    v = spark.createDataFrame([(i,) for i in sorted({x for arc in arcs for x in arc})], "account_id long")
    monkeypatch.setattr(catalog, "edge_table", lambda s, d: e)
    monkeypatch.setattr(catalog, "vertex_table", lambda s, d: v)


def test_rings_of_up_to_eight_are_circular(spark, monkeypatch):
    rings = [range(0, 4), range(10, 15), range(20, 28)]
    graph_of(spark, monkeypatch, [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))])
    got = {r.account_id: r.circularity_score for r in QUERIES["d1_circularity"](spark, "").collect()}
    assert got == {i: 1.0 for r in rings for i in r}


def test_layering_of_seven_edges(spark, monkeypatch):
    graph_of(spark, monkeypatch, [*((i, i + 1) for i in range(7)), (0, 7), (7, 0)])
    assert {r.account_id: r.layering_depth for r in QUERIES["d3_layering_depth"](spark, "").collect()}[0] == 7


def test_evaluate_runs_at_production_sizes(spark, sf_dir, monkeypatch):
    used = []
    monkeypatch.setattr(pipeline, "evaluate", lambda acc, txns, sizes: used.append(sizes) or {"scores": acc})
    QUERIES["evaluate"](spark, sf_dir)
    assert used == [pipeline.Sizes()]


def test_betweenness_is_exact_on_small_graphs(spark, monkeypatch):
    """A binary tree of 100 vertices: all of a vertex's ancestors reach all of its descendants through it."""
    n = 100
    graph_of(spark, monkeypatch, [((i - 1) // 2, i) for i in range(1, n)])
    above, below = [0] * n, [0] * n
    for i in range(1, n):
        above[i] = above[(i - 1) // 2] + 1
        up = i
        while up:
            up = (up - 1) // 2
            below[up] += 1
    want = {i: round(above[i] * below[i] / ((n - 1) * (n - 2)), 8) for i in range(n)}
    assert {r.account_id: r.betweenness for r in QUERIES["c4_betweenness"](spark, "").collect()} == want
    direct = structural.betweenness
    monkeypatch.setattr(structural, "betweenness", lambda *a, **b: (_ for _ in ()).throw(StopAsyncIteration(direct(*a, **b))))
    try:
        structural.structural_features(catalog.edge_table(spark, ""), catalog.vertex_table(spark, ""))
    except StopAsyncIteration as e:
        assert {r.account_id: r.betweenness for r in e.args[0].collect()} == want
    else:
        raise AssertionError("betweenness was not asked for")
