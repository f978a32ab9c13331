"""Shapley values of trees and the truncated SVD against dense and brute-force versions."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.operators import embeddings
from ledgerlens.operators.factor import truncated_svd
from ledgerlens.operators.shapley import node_table, tree_shap

COLUMNS = ["p", "q", "r", "s"]


def table(spark):
    rng = random.Random(4)
    rows = [(i, *(rng.choice([0.0, 1.0, 2.5, rng.random() * 3]) for _ in COLUMNS)) for i in range(400)]
    rows = [(*r, float(r[1] + r[2] * r[3] > 2.2)) for r in rows]
    return spark.createDataFrame(rows, "account_id long, p double, q double, r double, s double, label double").withColumn("w", F.lit(1.0) + F.col("label"))


def expected(tree, k, x, known):
    """Value of the subtree where known features are followed and others go both ways by training weight."""
    n = tree[k]
    if n["left"] < 0:
        return n["value"]
    if n["feature"] in known:
        return expected(tree, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], x, known)
    part = tree[n["left"]]["cover"] / n["cover"]
    return part * expected(tree, n["left"], x, known) + (1 - part) * expected(tree, n["right"], x, known)


@pytest.mark.parametrize("kind", [GBTClassifier, RandomForestClassifier])
def test_tree_shap_by_all_subsets(spark, kind):
    rows = table(spark)
    x = VectorAssembler(inputCols=COLUMNS, outputCol="f").transform(rows)
    size = {"maxIter": 5} if kind is GBTClassifier else {"numTrees": 5}
    model = kind(featuresCol="f", labelCol="label", weightCol="w", maxDepth=4, seed=3, **size).fit(x)
    forest = kind is RandomForestClassifier
    got = {r.account_id: r for r in tree_shap(model, COLUMNS, rows).collect()}
    raw = vector_to_array("probability" if forest else "rawPrediction")[1]
    margin = {r.account_id: r.m for r in model.transform(x).select("account_id", raw.alias("m")).collect()}
    trees: dict = {}
    for r in node_table(model, spark).collect():
        trees.setdefault(r.tree, {})[r.node] = r
    share = 1 / len(trees) if forest else 1.0
    value = lambda x, known: sum(share * t[0]["weight"] * expected(t, 0, x, known) for t in trees.values())
    assert len(got) == 400
    for r in rows.collect():
        g = got[r.account_id]
        assert g.base_value + sum(g[c] for c in COLUMNS) == pytest.approx(margin[r.account_id], abs=1e-9)
    for r in rows.limit(25).collect():
        x = [r[c] for c in COLUMNS]
        for i, c in enumerate(COLUMNS):
            others = [j for j in range(4) if j != i]
            want = sum(
                math.factorial(k) * math.factorial(3 - k) / 24 * (value(x, {*s, i}) - value(x, set(s)))
                for k in range(4) for s in itertools.combinations(others, k)
            )
            assert got[r.account_id][c] == pytest.approx(want, abs=1e-9)


def test_truncated_svd_against_dense(spark):
    rng = np.random.default_rng(3)
    dense = np.zeros((60, 45))
    for _ in range(500):
        dense[rng.integers(60), rng.integers(45)] = rng.random() * 4
    dense[7] = 0
    entries = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)], "a long, b long, v double")
    rows, sizes = truncated_svd(entries.repartition(3), 6)
    u, s, vt = np.linalg.svd(dense)
    assert sizes == pytest.approx(s[:6].tolist(), rel=0.01)
    got = np.zeros((60, 6))
    for r in rows.collect():
        got[r.id] = r.x
    want = u[:, :6] * s[:6]
    # what six dimensions can hold of the matrix, and the leading one itself
    assert (got**2).sum() == pytest.approx((want**2).sum(), rel=0.01)
    assert np.abs(np.abs(got[:, 0]) - np.abs(want[:, 0])).max() < 0.05
    assert not got[7].any() and (got**3).sum(0).min() >= 0


def test_svd_of_small_rank(spark):
    entries = spark.createDataFrame([(i, j, 2.0) for i in range(5) for j in range(4)], "a long, b long, v double")
    rows, sizes = truncated_svd(entries, 3)
    assert sizes == pytest.approx([2 * math.sqrt(20), 0, 0], abs=1e-5)
    assert all(r.x == pytest.approx([4.0, 0, 0], abs=1e-5) for r in rows.collect())


def test_k_squared_by_hand(spark):
    """The published steps of the test, in plain Python."""
    from ledgerlens.operators.validate import k_squared

    def plain(n, skew, kurt):
        y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
        b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
        w2 = -1 + math.sqrt(2 * (b2 - 1))
        z1 = math.asinh(y / math.sqrt(2.0 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
        x = (kurt + 3 - 3.0 * (n - 1) / (n + 1)) / math.sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) ** 2 * (n + 3) * (n + 5)))
        root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
        a = 6.0 + 8.0 / root * (2.0 / root + math.sqrt(1 + 4.0 / root**2))
        t = (1 - 2.0 / a) / (1 + x * math.sqrt(2.0 / (a - 4)))
        z2 = (1 - 2.0 / (9 * a) - math.copysign(abs(t) ** (1 / 3), t)) / math.sqrt(2.0 / (9 * a))
        return z1 * z1 + z2 * z2, math.exp(-(z1 * z1 + z2 * z2) / 2)

    rows = [(8, 0.5, -1.0), (100, -0.2, 0.3), (5000, 0.01, 0.02), (300_000, 1.5, 4.0), (7, 0.1, 0.1)]
    got = k_squared(spark.createDataFrame(rows, "n long, skew double, kurt double")).collect()
    for r, (n, s, k) in zip(got, rows, strict=True):
        assert (r.n, r.skew, r.kurt) == (n, s, k)
        assert (r.k2, r.p_value) == ((None, None) if n < 8 else pytest.approx(plain(n, s, k), rel=1e-9))


def test_cooccurrence_meets_each_pair_once(spark):
    """Against plain counting, without a join of every step with all steps around it; short walks and repeats too."""
    rows = [(w, s, (w * w + s * (w % 3 + 1)) % 7) for w in range(12) for s in range(w)]
    got = embeddings.cooccurrence(spark.createDataFrame(rows, "walk long, step int, vertex long"), 3)
    want = Counter((a, b) for w, s, a in rows for x, t, b in rows if w == x and abs(s - t) <= 3 and a != b)
    assert {(r.a, r.b): r.n for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
