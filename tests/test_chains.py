"""Chains run between all sources and all sinks."""

import random

from oracle import same

from ledgerlens.operators import graph, patterns, structural
from ledgerlens.plans import catalog


def chains(spark, arcs, cutoff=10):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src long, dst long, weight double")
    v = graph.vertices(None, e)
    return {r.account_id: r.suspicious_chain_length for r in patterns.suspicious_chains(e, v, structural.degrees(e, v), cutoff).collect()}


def by_hand(arcs, cutoff=10):
    """The least shortest path from each source to each vertex, vertex by vertex."""
    out, into = {}, set()
    for a, b in sorted(set(arcs)):
        out.setdefault(a, []).append(b)
        into.add(b)
    length = dict.fromkeys({x for arc in arcs for x in arc}, 0)
    for s in (x for x in out if x not in into):
        front, seen = {s: (s,)}, {s}
        for _ in range(cutoff):
            new = {}
            for x, path in front.items():
                for y in out.get(x, []):
                    if y not in seen:
                        new[y] = min(new.get(y, (*path, y)), (*path, y))
            seen |= set(new)
            front = new
            for y, path in front.items():
                for x in path if y not in out else ():
                    length[x] = max(length[x], len(path))
    return length


def test_chains_of_more_than_fifty_sources_and_sinks(spark):
    # each source pays its own sink, later ones by way of more vertices
    arcs = []
    for s in range(60):
        path = [s, *(1000 + 10 * s + k for k in range(s // 20 + 1)), 9000 + s]
        arcs += zip(path, path[1:])
    got = chains(spark, arcs)
    assert got == by_hand(arcs)
    assert got[59] == got[9059] == 5


def test_chains_equal_plain_search(spark):
    rng = random.Random(5)
    for size, many in ((40, 60), (90, 150)):
        arcs = [(rng.randrange(size), rng.randrange(size)) for _ in range(many)]
        arcs += [(500 + rng.randrange(9), rng.randrange(size)) for _ in range(12)]
        arcs = [a for a in arcs if a[0] != a[1]]
        assert chains(spark, arcs) == by_hand(arcs)
    assert chains(spark, arcs, 3) == by_hand(arcs, 3)


def test_chain_query_equals_its_sql_over_all_accounts(spark, sf_dir):
    same(spark, catalog.d6_suspicious_chains, catalog.oracle_sql()["d6_suspicious_chains"], sf_dir)
    assert catalog.d6_suspicious_chains(spark, sf_dir).filter("suspicious_chain_length = 0").isEmpty()
