"""All 35 features of a small ledger, those of the graph against plain searches, and the score made of them."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from test_graph_search import all_cycles, depth_of

from ledgerlens.functions.schemas import BEHAVIORAL, FRAUD, STRUCTURAL
from ledgerlens.operators import behavioral, graph, scoring
from ledgerlens.plans import pipeline

N = 14


def distances(succ, s):
    """Hops and numbers of shortest paths from s."""
    hop, paths, front = {s: 0}, defaultdict(float, {s: 1.0}), [s]
    while front:
        nxt = []
        for a in front:
            for b in succ[a]:
                if b not in hop:
                    hop[b] = hop[a] + 1
                    nxt.append(b)
                if hop[b] == hop[a] + 1:
                    paths[b] += paths[a]
        front = nxt
    return hop, paths


def plain_betweenness(ids, succ):
    from_ = {s: distances(succ, s) for s in ids}
    out = dict.fromkeys(ids, 0.0)
    for s in ids:
        hop, paths = from_[s]
        for t in ids:
            for v in ids:
                if len({s, t, v}) == 3 and t in hop and v in hop and t in from_[v][0] and hop[v] + from_[v][0][t] == hop[t]:
                    out[v] += paths[v] * from_[v][1][t] / paths[t]
    n = len(ids)
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def plain_pagerank(ids, weight, steps):
    n, total = len(ids), defaultdict(float)
    for (a, _), w in weight.items():
        total[a] += w
    rank = dict.fromkeys(ids, 1 / n)
    for _ in range(steps):
        new = dict.fromkeys(ids, 0.15 / n + 0.85 * sum(r for v, r in rank.items() if not total[v]) / n)
        for (a, b), w in weight.items():
            new[b] += 0.85 * rank[a] * w / total[a]
        rank = new
    return rank


def plain_cores(ids, near):
    out, left, k = {}, set(ids), 0
    while left:
        low = [v for v in left if len(near[v] & left) <= k]
        for v in low:
            out[v] = k
        left -= set(low)
        k += not low
    return out


def test_all_features_by_plain_python(spark):
    rng = random.Random(11)
    t0 = dt.datetime(2025, 1, 1)
    txns = [(i, rng.randrange(N), rng.randrange(N), float(rng.randint(1, 900)), t0 + dt.timedelta(hours=rng.randrange(900)), "p2p") for i in range(45)]
    acc = [(i, f"dev{i % 5}" if i % 3 else f"own{i}", i % 6 == 0) for i in range(N)]
    t = spark.createDataFrame(txns, "transaction_id long, sender_id long, receiver_id long, amount double, timestamp timestamp_ntz, transaction_type string")
    a = spark.createDataFrame(acc, "account_id long, device_fingerprint_id string, is_fraud boolean")
    e = graph.edges(t)
    v = graph.vertices(a, e)
    table = pipeline.feature_table(e, v, t, a)
    assert set(table.columns) == {"account_id", *STRUCTURAL, *BEHAVIORAL, *FRAUD} and len(table.columns) == 36
    got = {r.account_id: r for r in table.collect()}
    assert set(got) == set(range(N))

    weight = defaultdict(float)
    for _, s, r, x, _, _ in txns:
        weight[s, r] += x
    arcs, ids = sorted(weight), range(N)
    succ, near = defaultdict(set), defaultdict(set)
    for s, r in arcs:
        succ[s].add(r)
        if s != r:
            near[s].add(r)
            near[r].add(s)
    reach = {s: set(distances(succ, s)[0]) for s in ids}
    cycles = all_cycles(arcs, 8)
    most = max(sum(x in c for c in cycles) for x in ids)
    depth, between, rank, core = depth_of(arcs, 7), plain_betweenness(ids, succ), plain_pagerank(ids, weight, 30), plain_cores(ids, near)
    group = {i: got[i].community_id for i in ids}
    for i in ids:
        g, d = got[i], len(near[i])
        links = sum(y in near[x] for x in near[i] for y in near[i]) / 2
        same = [j for j in ids if group[j] == group[i]]
        inner = sum(group[s] == group[r] == group[i] for s, r in arcs)
        assert g.circularity_score == pytest.approx(sum(i in c for c in cycles) / most)
        assert g.layering_depth == depth.get(i, 0)
        assert g.betweenness == pytest.approx(between[i], abs=1e-7)
        assert g.pagerank == pytest.approx(rank[i], abs=N * 1e-6)  # ends by tolerance
        assert g.k_core_number == core[i]
        assert g.scc_size == sum(i in reach[j] for j in reach[i])
        assert g.clustering_coefficient == pytest.approx(2 * links / (d * (d - 1)) if d > 1 else 0, abs=1e-6)
        assert g.subgraph_density == pytest.approx(inner / (len(same) * (len(same) - 1)) if len(same) > 1 else 0, abs=1e-6)
        assert (g.in_degree, g.out_degree) == (sum(r == i for _, r in arcs), sum(s == i for s, _ in arcs))
    apart = {r.account_id: r for r in behavioral.behavioral_features(t).collect()}
    assert all(getattr(got[i], c) == pytest.approx(getattr(apart[i], c) or 0) for i in apart for c in BEHAVIORAL)
    scores = scoring.static_scores(table).collect()
    assert len(scores) == N and all(0 <= r.risk_score <= 100 for r in scores)
