"""Loops that do not need each other run side by side."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import community, embeddings, iterate, structural
from ledgerlens.plans import catalog


def meeting(n, column, value):
    """A step that ends only when ``n`` steps have begun."""
    barrier = threading.Barrier(n, timeout=30)
    return lambda name: lambda edge, ids, *_, **__: barrier.wait() is not None and ids.select("account_id", value.alias(name or column))


def graph(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 1), (1, 2, 1.0, 1)], "src long, dst long, weight double, frequency long")
    return e, spark.range(3).select(F.col("id").alias("account_id"))


def test_structural_loops_begin_together(spark, monkeypatch):
    step = meeting(5, None, F.lit(1))
    for name in ("betweenness", "pagerank", "clustering", "core_numbers", "scc_sizes"):
        monkeypatch.setattr(structural, name, step(name))
    monkeypatch.setattr(structural, "louvain", lambda e, ids: ids.withColumn("community_id", F.lit(0)))
    got = structural.structural_features(*graph(spark)).orderBy("account_id").collect()
    assert [r.betweenness for r in got] == [1, 1, 1] and [r.out_degree for r in got] == [1, 1, 0]


def test_embedding_halves_begin_together(spark, monkeypatch):
    step = meeting(2, None, F.array(F.lit(1.0)))
    monkeypatch.setattr(embeddings, "spectral_embedding", step("embedding"))
    monkeypatch.setattr(embeddings, "walks", step("walk"))
    monkeypatch.setattr(embeddings, "cooccurrence", lambda w: w)
    monkeypatch.setattr(embeddings, "walk_embedding", lambda w, ids, dim: ids.select("account_id", F.array(F.lit(2.0)).alias("embedding")))
    assert {tuple(r.embedding) for r in embeddings.graph_embedding(*graph(spark), 2).collect()} == {(1.0, 2.0)}


def test_halves_of_graph_drift_begin_together(spark, sf_dir, monkeypatch):
    barrier = threading.Barrier(6, timeout=60)

    def meets(f):
        return lambda *args: barrier.wait() is not None and f(*args)

    for module, name in ((structural, "clustering"), (structural, "scc_sizes"), (iterate, "components")):
        monkeypatch.setattr(module, name, meets(getattr(module, name)))
    got = {r.metric: (r.baseline, r.current) for r in catalog.w7_graph_drift(spark, sf_dir).collect()}
    assert len(got) == 14 and all(a > 0 and b > 0 for a, b in (got["n_edges"], got["n_wcc"], got["n_scc"]))


def test_first_moves_and_labels_begin_together(spark, monkeypatch):
    barrier, met = threading.Barrier(2, timeout=30), set()

    def meets(name):
        step = getattr(community, name)

        def first(*args):
            if name not in met:
                met.add(name)
                barrier.wait()
            return step(*args)

        return first

    for name in ("_moved", "_spread"):
        monkeypatch.setattr(community, name, meets(name))
    arcs = [(a, b) for k in (0, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(3, 4)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src long, dst long, weight double")
    got = community.louvain(e, spark.range(8).select(F.col("id").alias("account_id"))).collect()
    assert {r.account_id: r.community_id for r in got} == {k: k // 4 * 4 for k in range(8)}


def test_a_failing_step_is_raised(spark):
    with pytest.raises(ZeroDivisionError):
        iterate.together(spark, lambda: spark.range(1), lambda: 1 / 0)
