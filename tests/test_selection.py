"""Exact quantiles and neighbours from an index, against numpy over all values and all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import neighbours, training
from ledgerlens.operators.quantiles import exact_quantiles, group_median

PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)


def columns(spark, n=6000):
    rng = np.random.default_rng(3)
    a = rng.normal(size=n)
    rows = [(float(a[i]), float(i % 3), 5.0 if i % 2 else float(i), None if i % 7 else float(i) ** 3, -0.0 if i % 2 else 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "a double, few double, half double, holes double, zeros double").repartition(7)


@pytest.mark.parametrize("sorted_rows", [50_000, 200, 3])
def test_quantiles_equal_numpy_however_often_brackets_are_narrowed(spark, sorted_rows):
    df = columns(spark)
    got = exact_quantiles(df, df.columns, PROBS, sorted_rows)
    table = df.toPandas()
    for c in df.columns:
        want = np.quantile(table[c].dropna().to_numpy(), PROBS)
        assert got[c] == pytest.approx(want.tolist(), rel=1e-12, abs=1e-12), c


def test_quantiles_of_nothing_of_one_value_and_with_nan(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, float("nan")), (3.0, None, float("nan"))], "x double, none double, odd double")
    got = exact_quantiles(df, ["x", "none", "odd"], (0.0, 0.5))
    assert got["x"] == [1.0, 2.0] and got["none"] == [None, None]
    assert got["odd"][0] == 2.0 and math.isnan(got["odd"][1])
    assert exact_quantiles(df.limit(0), ["x"], (0.5,)) == {"x": [None]}
    assert exact_quantiles(df, [], (0.5,)) == {}


def test_medians_of_groups_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g, v in zip(rng.choice(5, 20_000, p=[0.6, 0.2, 0.1, 0.05, 0.05]), rng.normal(size=20_000), strict=True)] + [(9, 1.0), (10, 1.0), (10, 4.0), (11, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    got = {r.g: r.median for r in group_median(df, "g", "v").collect()}
    want = df.toPandas().dropna().groupby("g")["v"].median().to_dict()
    assert got == pytest.approx(want, rel=1e-12)


def vectors(spark, kind, n=400, dim=6):
    rng = np.random.default_rng(11)
    x = {"even": rng.normal(size=(n, dim)), "clusters": rng.normal(size=(8, dim))[rng.integers(0, 8, n)] + 0.05 * rng.normal(size=(n, dim)), "copies": np.repeat(rng.normal(size=(4, dim)), n // 4, 0)}[kind]
    return x, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>").repartition(5)


@pytest.mark.parametrize("kind", ["even", "clusters", "copies"])
def test_nearest_rows_equal_all_pairs(spark, kind):
    x, rows = vectors(spark, kind)
    got = neighbours.knn(rows, 5, pivots=12, block=40).toPandas().sort_values(["id", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, 1, kind="stable")[:, :5]
    assert got["other"].to_numpy().reshape(-1, 5).tolist() == order.tolist()
    assert np.allclose(got["d"].to_numpy().reshape(-1, 5), np.take_along_axis(d, order, 1), atol=1e-12)


def test_fewer_rows_than_neighbours_and_no_rows(spark):
    _, rows = vectors(spark, "even", 4)
    assert neighbours.knn(rows, 10).count() == 12
    assert neighbours.knn(rows.limit(1), 10).count() == 0
    assert neighbours.knn(rows.limit(0), 10).count() == 0


def plain_density(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    cluster = [None] * len(x)
    for i in np.flatnonzero(core):
        if cluster[i] is None:
            todo = [i]
            while todo:
                u = todo.pop()
                if cluster[u] is None:
                    cluster[u] = int(i)
                    todo += [v for v in np.flatnonzero(near[u] & core) if cluster[v] is None]
    for i in np.flatnonzero(~core):
        around = [cluster[j] for j in np.flatnonzero(near[i] & core)]
        cluster[i] = min(around) if around else None
    score = np.ones(len(x))
    for c in {c for c in cluster if c is not None}:
        me = [i for i, k in enumerate(cluster) if k == c]
        d = np.sqrt(((x[me] - x[me].mean(0)) ** 2).sum(1))
        score[me] = d / (3 * np.median(d) + 1e-8)
    return cluster, score


@pytest.mark.parametrize("kind, eps", [("even", 1.4), ("clusters", 0.12), ("copies", 0.5)])
def test_density_equals_plain_search(spark, kind, eps):
    x, rows = vectors(spark, kind)
    got = {r.id: r for r in training.density_deviation(rows, eps, 5).collect()}
    cluster, score = plain_density(x, eps, 5)
    assert [got[i].cluster for i in range(len(x))] == cluster
    # of exact copies the distance to the centre is rounding, over which nothing is claimed
    if kind != "copies":
        assert [got[i].score for i in range(len(x))] == pytest.approx(score.tolist(), abs=1e-6)


def test_rows_visit_only_cells_that_can_matter(spark):
    """Well-separated clusters: a row's radius reaches into few cells, so far fewer pairs are met than exist."""
    x, rows = vectors(spark, "clusters", 800)
    index = neighbours.pivot_index(rows, pivots=28)
    least, _ = index.bounds(x)
    assert ((least <= 0.3) & (index.n > 0)).mean() < 0.4


def test_combined_anomaly_weighs_scaled_scores(spark):
    make = lambda name, v: spark.createDataFrame(list(enumerate(v)), f"id long, {name} double")
    out = training.combined_anomaly(make("score", [0.0, 5.0, 10.0]), make("lof", [1.0, 1.0, 3.0]), make("score", [2.0, 1.0, 1.0]))
    assert [(r.id, r.anomaly_score) for r in out.collect()] == [(2, 0.7), (0, 0.3), (1, 0.2)]


def test_outlier_has_the_highest_factor(spark):
    rows = spark.range(60).select("id", F.array(F.when(F.col("id") == 59, 50.0).otherwise(F.col("id") % 8 * 1.0), F.floor(F.col("id") / 8) * 1.0).alias("x"))
    lof = training.local_outlier_factor(rows, 5).orderBy(F.desc("lof")).first()
    assert lof.id == 59 and lof.lof > 5


def test_robust_scaling_takes_median_and_interquartile_range(spark):
    df = spark.createDataFrame([("a", 1.0, 7), ("b", 2.0, 7), ("c", 3.0, 7), ("d", None, 7), ("e", 9.0, 7)], "account_id string, v double, same int")
    got = {r.id: r.x for r in training.robust_scaled(df).collect()}
    q = np.quantile([1.0, 2.0, 3.0, 9.0], (0.25, 0.5, 0.75))
    for k, v in (("a", 1.0), ("b", 2.0), ("c", 3.0), ("e", 9.0)):
        assert got[k] == pytest.approx([(v - q[1]) / (q[2] - q[0]), 0.0])
    assert got["d"] == [0.0, 0.0]
