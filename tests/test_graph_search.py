"""Cycles, layering and communities against plain searches on small graphs."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import community, paths, patterns


def frame(spark, arcs):
    return spark.createDataFrame([(a, b, float(w), 1) for a, b, w in arcs], "src long, dst long, weight double, frequency long")


def vertices(spark, n):
    return spark.range(n).select(F.col("id").alias("account_id"))


def random_arcs(rng, n, m, loops=True):
    out = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return sorted(a for a in out if loops or a[0] != a[1])


def all_cycles(arcs, bound):
    succ = defaultdict(list)
    for a, b in arcs:
        succ[a].append(b)
    out = []

    def walk(path):
        for b in succ[path[-1]]:
            if b == path[0]:
                out.append(tuple(path))
            elif b > path[0] and b not in path and len(path) < bound:
                walk([*path, b])

    for a in list(succ):
        walk([a])
    return out


def depth_of(arcs, cutoff):
    succ, into = defaultdict(set), {b for _, b in arcs}
    for a, b in arcs:
        if a != b:
            succ[a].add(b)
    out = {}

    def walk(v, path):
        best = len(path) - 1 if len(path) > 1 and path[-1] in succ[v] else 0
        if len(path) <= cutoff:
            for b in succ[path[-1]] - set(path):
                best = max(best, walk(v, [*path, b]))
        return best

    for v in {a for a, _ in arcs}:
        out[v] = walk(v, [v]) if v in into else 0
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 9, 26), (2, 14, 40), (3, 40, 60)])
def test_cycles_and_depths_by_plain_search(spark, seed, n, m):
    arcs = random_arcs(random.Random(seed), n, m)
    e = frame(spark, [(a, b, 1) for a, b in arcs])
    want = all_cycles(arcs, 8)
    for bound in (8, 3, 1):
        got = [tuple(r.path) for r in paths.cycles(e, bound).collect()]
        assert sorted(got) == sorted(c for c in want if len(c) <= bound)
    hits = Counter(v for c in want for v in c)
    got = {r.account_id: r.circularity_score for r in patterns.circularity(e, vertices(spark, n)).collect()}
    top = max(hits.values(), default=1)
    assert got == pytest.approx({v: hits[v] / top for v in range(n)})
    for cutoff in (7, 4):
        depth = depth_of(arcs, cutoff)
        got = {r.account_id: r.layering_depth for r in patterns.layering_depth(e, vertices(spark, n), cutoff).collect()}
        assert got == {v: depth.get(v, 0) for v in range(n)}


def test_depth_beyond_the_thin_arcs(spark):
    """The one path to a successor uses arcs that the first look leaves out."""
    chain = [(0, 1), *((k, k + 1) for k in range(1, 7)), (0, 7)]
    noise = [(k, 100 + 20 * k + j) for k in range(7) for j in range(20)] + [(300 + j, k) for k in range(1, 8) for j in range(20)] + [(9, 0)]
    e = frame(spark, [(a, b + 7 * (b == 7) * 0, 1) for a, b in chain + [(6, 7)] + noise])
    got = dict(paths.layering(e, 7, thin=1).collect())
    assert got[0] == 7 and got[1] == 1


def test_no_edges(spark):
    e = frame(spark, [])
    assert patterns.circularity(e, vertices(spark, 2)).collect() == [(0, 0.0), (1, 0.0)]
    assert patterns.layering_depth(e, vertices(spark, 2)).filter("layering_depth > 0").count() == 0
    assert sorted(community.louvain(e, vertices(spark, 2)).collect()) == [(0, 0), (1, 1)]


# ---- communities


def plain_modularity(arcs, part):
    w = Counter()
    for a, b, x in arcs:
        w[min(a, b), max(a, b)] += x
    m = 2 * sum(w.values())
    inside, degree = 0.0, Counter()
    for (a, b), x in w.items():
        degree[part[a]] += x
        degree[part[b]] += x
        inside += 2 * x * (part[a] == part[b])
    return inside / m - sum(d * d for d in degree.values()) / m**2


def partitions(n):
    def grow(part, k):
        if len(part) == n:
            yield part
        else:
            for c in range(k + 1):
                yield from grow([*part, c], max(k, c + 1))

    yield from grow([], 0)


@pytest.mark.parametrize("seed,inside,across,share", [(1, 0.5, 0.12, 0.94), (2, 0.9, 0.05, 0.98)])
def test_louvain_near_the_optimum(spark, seed, inside, across, share):
    """Of all partitions the best has little more: next to nothing where there are groups, and some where there are hardly any."""
    rng = random.Random(seed)
    arcs = [(a, b, rng.choice([1, 1, 2, 5])) for a, b in itertools.permutations(range(8), 2) if rng.random() < (inside if a // 4 == b // 4 else across)] + [(0, 0, 1)]
    best = max(plain_modularity(arcs, p) for p in partitions(8))
    e, v = frame(spark, arcs), vertices(spark, 8)
    found = community.louvain(e, v)
    part = dict(found.collect())
    value = community.modularity(e, found)
    assert value == pytest.approx(plain_modularity(arcs, part), abs=1e-12)
    assert value >= share * best
    assert dict(community.louvain(e, v).collect()) == part and all(part[c] == c <= a for a, c in part.items())


def test_louvain_finds_planted_groups(spark):
    """Thirty cliques in a ring: found whole, over several levels, and never below label propagation."""
    arcs = [(10 * g + a, 10 * g + b, 1) for g in range(30) for a, b in itertools.combinations(range(10), 2)] + [(10 * g, (10 * g + 10) % 300, 1) for g in range(30)]
    rng = random.Random(5)
    loose = [(a, b, 1) for a, b in random_arcs(rng, 300, 900, loops=False)]
    for arcs_ in (arcs, arcs + loose[:200]):
        e, v = frame(spark, arcs_), vertices(spark, 301)
        found = community.louvain(e, v)
        value = community.modularity(e, found)
        assert value >= community.modularity(e, community.label_propagation(e, v)) - 1e-12
        part = dict(found.collect())
        assert len(part) == 301 and part[300] == 300
        if arcs_ is arcs:
            assert all(part[10 * g + k] == part[10 * g] for g in range(30) for k in range(10)) and value > 0.85
