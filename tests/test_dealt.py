"""Loops whose graph is dealt out once, and steps that shuffle no more than they must."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import embeddings, explain, iterate, neighbours, propagation, structural
from ledgerlens.plans import catalog


@pytest.fixture
def plans(monkeypatch):
    """Name and plan of each stage table written, in order."""
    got = []

    def noted(write, place):
        def one(df, *args, **more):
            name = more.get("name") or (args[place] if len(args) > place else "stage")
            got.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return write(df, *args, **more)

        return one

    whole, dealt = iterate.stage, iterate.stage_by
    for module in (iterate, structural, propagation, embeddings):
        monkeypatch.setattr(module, "stage", noted(whole, 0))
        monkeypatch.setattr(module, "stage_by", noted(dealt, 9))
    return got


def shuffles(plans, name):
    return [plan.count("Exchange hashpartitioning") for n, plan in plans if n == name]


@pytest.fixture
def graph(spark):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(200)})
    edge = spark.createDataFrame([(s, t, 1.0 + s, 1) for s, t in rows if s != t], "src long, dst long, weight double, frequency long")
    return edge, spark.createDataFrame([(i, i % 7 == 0) for i in range(60)], "account_id long, is_fraud boolean")


def test_rank_and_cores_shuffle_their_state_only(graph, plans):
    structural.pagerank(*graph, iterations=3, tolerance=None)
    assert shuffles(plans, "pagerank") == [1, 1, 1]
    plans.clear()
    structural.core_numbers(*graph)
    assert max(shuffles(plans, "core")[2:]) <= 2
    assert not any("BroadcastHashJoin" in plan for n, plan in plans)


def test_propagation_shuffles_its_state_only(graph, plans):
    edge, vertex = graph
    propagation.iterate(propagation.transition(edge), vertex.select("account_id", F.col("is_fraud").cast("double").alias("score")), iterations=3, tolerance=None)
    steps = [plan for name, plan in plans if name == "risk"][1:]
    assert len(steps) == 3 and all(p.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" not in p for p in steps)


def test_a_step_of_walks_shuffles_the_walkers_once(graph, plans):
    got = embeddings.walks(*graph, 2, 5)
    steps = [plan for name, plan in plans if name == "walk"][1:]
    assert len(steps) == 4 and all(p.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" not in p for p in steps)
    assert got.filter("step = 4").count() <= 120


def test_neighbours_beyond_one_piece_are_walked(spark, monkeypatch):
    """A hub of 11 neighbours in pieces of 4: the walks are the same as in one piece."""
    edge = spark.createDataFrame([(0, i) for i in range(1, 12)], "src long, dst long")
    ids = spark.createDataFrame([(i,) for i in range(12)], "account_id long")
    once = sorted(map(tuple, embeddings.walks(edge, ids, 3, 4).collect()))
    monkeypatch.setattr(embeddings, "PIECE", 4)
    assert sorted(map(tuple, embeddings.walks(edge, ids, 3, 4).collect())) == once
    assert len({v for w, s, v in once if s and v}) > 4


def test_components_send_no_tables_to_the_driver(graph, plans):
    edge, vertex = graph
    ids = vertex.select(F.col("account_id").alias("id"))
    iterate.components(edge.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), ids)
    iterate.strong_components(edge, ids)
    loops = [plan for name, plan in plans if name in ("cc", "scc", "scc-colour", "scc-inside", "scc-member", "scc-arcs")]
    assert len(loops) > 8 and not any("BroadcastHashJoin" in plan for plan in loops)


def test_idle_days_are_not_shuffled(spark):
    at = lambda day: datetime.datetime(2024, 1, day, 9)
    t = spark.createDataFrame([(1, 2, at(1)), (1, 2, at(1)), (1, 3, at(5)), (3, 1, at(4))], "sender_id long, receiver_id long, timestamp timestamp_ntz")
    out = explain.timeline(t)
    got = {(r.account_id, r.day.day): r.n for r in out.collect()}
    assert got == {(1, 1): 2, (1, 2): 0, (1, 3): 0, (1, 4): 1, (1, 5): 1, (2, 1): 2, (3, 4): 1, (3, 5): 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(sequence") < plan.index("Exchange") and "Join" not in plan


def test_chains_read_the_ledger_once(spark, sf_dir):
    assert not any("lineitem" in f for f in catalog.d6_suspicious_chains(spark, sf_dir).inputFiles())


def test_rows_sent_to_cells_are_bounded(spark, monkeypatch):
    """A task sends rows with their vectors in pieces, however many pivots there are."""
    rows = spark.range(3000).select("id", F.array(*(F.rand(k) for k in range(4))).alias("x"))
    rows = iterate.stage(rows, "points")
    index, sent = neighbours.pivot_index(rows, 50), []
    kind = type(rows)
    direct = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, *a, **b: sent.append(f) or direct(self, f, *a, **b))
    got = {r.id: r.n for r in neighbours.within(index, 9.0).collect()}
    assert set(got.values()) == {3000}
    pdf = pd.DataFrame({"id": range(3000), "x": [[0.5] * 4] * 3000, "radius": 9.0})
    sizes = [len(p) for p in sent[0](iter([pdf]))]
    assert sum(sizes) == 3000 * int((index.n > 0).sum()) and max(sizes) <= neighbours.VISITS
