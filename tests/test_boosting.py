"""Boosted trees against a plain search for the best split, and on a planted rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.boosting import Booster, Tree
from ledgerlens.operators.training import SupervisedTrainer


def planted(spark, n=1500):
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(n, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95)).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "account_id long, a double, b double, c double, is_fraud int").repartition(6)


def test_first_split_has_the_largest_gain(spark):
    x, y, df = planted(spark)
    b = Booster(trees=1, depth=1, bins=8).fit(df, ["a", "b", "c"], "is_fraud")
    tree = b.model[0]
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gains = {(c, k): worth(x[:, c] <= cut) + worth(x[:, c] > cut) for c in range(3) for k, cut in enumerate(b.cuts[c])}
    best = max(gains, key=gains.get)
    assert (tree.column[0], tree.bin[0]) == best
    low = x[:, best[0]] <= b.cuts[best[0]][best[1]]
    for node, m in ((1, low), (2, ~low)):
        assert tree.value[node] == pytest.approx(-0.05 * g[m].sum() / (h[m].sum() + 1), abs=1e-4)


def test_growth_takes_the_leaf_of_largest_gain_first():
    full = Tree(np.array([0, 0, 0, 0, -1, 0, -1]), np.zeros(7, int), np.arange(7.0))
    gain = np.array([9.0, 2.0, 5.0, 8.0, 0, 1.0, 0])
    grown = lambda leaves: set(np.flatnonzero(Booster(depth=2, leaves=leaves)._best_first(full, gain).column >= 0).tolist())
    assert grown(1) == set() and grown(2) == {0} and grown(3) == {0, 2} and grown(4) == {0, 1, 2}


def test_reruns_and_partitions_agree_and_the_rule_is_learnt(spark):
    _, y, df = planted(spark)
    one = Booster(trees=12, depth=3, leaves=5, step=0.3, staged_trees=5).fit(df, ["a", "b", "c"], "is_fraud")
    two = Booster(trees=12, depth=3, leaves=5, step=0.3, staged_trees=100).fit(df.repartition(3, "b"), ["a", "b", "c"], "is_fraud", cuts=one.cuts)
    assert all((s.column == t.column).all() and (s.bin == t.bin).all() and np.allclose(s.value, t.value, atol=1e-5) for s, t in zip(one.model, two.model, strict=True))
    got = one.predict(df).toPandas()
    assert ((got["probability"] > 0.5) == (got["is_fraud"] == 1)).mean() > 0.97


def test_growth_stops_where_validation_no_longer_gains(spark):
    """Validation labels are noise, so precision there peaks early; the trees up to the peak are kept."""
    _, _, df = planted(spark, 600)
    df = df.withColumn("v", F.col("account_id") % 3 == 0).withColumn("label", F.when(F.col("v"), F.pmod(F.xxhash64("account_id"), F.lit(2))).otherwise(F.col("is_fraud")))
    b = Booster(trees=15, depth=2, step=0.3, patience=2).fit(df, ["a", "b", "c"], "label", validation="v")
    assert len(b.model) == 1 + int(np.argmax(b.history)) and len(b.history) < 15


def test_no_rows_one_class_and_constant_columns(spark):
    _, _, df = planted(spark, 60)
    with pytest.raises(ValueError):
        Booster(trees=1).fit(df.limit(0), ["a"], "is_fraud")
    flat = Booster(trees=2, depth=2).fit(df.withColumn("k", F.lit(3.0)), ["k"], "is_fraud")
    assert all((t.column == -1).all() for t in flat.model)
    sure = Booster(trees=2, depth=2).fit(df.withColumn("is_fraud", F.lit(1)), ["a"], "is_fraud").predict(df)
    assert sure.agg(F.min("probability")).first()[0] > 0.99


def test_trainer_keeps_the_best_of_three(spark):
    _, _, df = planted(spark, 900)
    t = SupervisedTrainer(scale=0.03)
    got = t.train(df.filter("account_id % 4 <> 0"), df.filter("account_id % 4 = 0"))
    assert set(got) == {"boosted_deep", "boosted_leafwise", "random_forest"} and min(got.values()) > 0.85
    assert got[t.best] == max(got.values())
