"""Structural features of the account graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import zero
from .brandes import dependencies
from .community import louvain
from .graph import both_ways, undirected
from .iterate import stage, stage_by, strong_components, together


def degrees(edge: DataFrame, ids: DataFrame) -> DataFrame:
    """In, out and total degree, weighted degrees and out/in ratio. A loop counts once on each side."""
    weight = F.col("weight").cast("decimal(28,2)")
    ends = edge.select(F.explode(F.array(F.struct(F.col("dst").alias("account_id"), F.lit(1).alias("i"), F.lit(0).alias("o"), weight.alias("w")), F.struct(F.col("src").alias("account_id"), F.lit(0).alias("i"), F.lit(1).alias("o"), weight.alias("w")))).alias("e")).select("e.*")
    agg = ends.groupBy("account_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum(F.col("w") * F.col("i")).cast("double").alias("wi"), F.sum(F.col("w") * F.col("o")).cast("double").alias("wo"))
    i, o = zero("i").cast("long"), zero("o").cast("long")
    return ids.select("account_id").join(agg, "account_id", "left").select(
        "account_id", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("total_degree"), zero("wi").alias("weighted_in_degree"), zero("wo").alias("weighted_out_degree"),
        F.round(F.when(i > 0, o / F.nullif(i, F.lit(0))).otherwise(o.cast("double")), 6).alias("degree_ratio"),
    )


def pagerank(edge: DataFrame, ids: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """Edge-weighted PageRank; the mass of vertices without out-edges is spread evenly. ``tolerance`` None runs all iterations.

    Edges and vertices lie in buckets, so only what goes along the edges is shuffled. An iteration is one join and one aggregate, written once with what each vertex got. Two sums over that
    table, the mass that went along edges and the change, are all that the driver sees: the rest of the mass is
    what was spread, and the next iteration adds it where it reads the table.
    """
    v = stage_by(ids.select("account_id").distinct(), "account_id", name="pagerank-ids", dealt=True)
    n = v.count()
    if n == 0:
        return v.withColumn("pagerank", F.lit(0.0))
    out = edge.groupBy("src").agg(F.sum("weight").alias("total"))
    p = stage_by(edge.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "src", name="pagerank-edges")
    rank, mass = v.withColumn("pagerank", F.lit(1.0 / n)), 1.0
    for _ in range(iterations):
        got = p.join(rank.withColumnRenamed("account_id", "src").hint("merge"), "src").groupBy(F.col("dst").alias("account_id"))
        got = got.agg(F.sum(F.col("p") * F.col("pagerank")).alias("got"))
        old = rank if tolerance is not None else v
        new = stage_by(old.withColumnRenamed("pagerank", "old").join(got.hint("merge"), "account_id", "left").withColumn("got", zero("got")), "account_id", name="pagerank", dealt=True)
        sent = new.agg(F.sum("got")).first()[0]
        value = F.lit((1 - damping) / n) + F.lit(damping) * (F.col("got") + F.lit((mass - sent) / n))
        rank = new.select("account_id", value.alias("pagerank"))
        mass = 1 - damping + damping * mass
        if tolerance is not None and new.agg(F.sum(F.abs(value - F.col("old")))).first()[0] < n * tolerance:
            break
    return rank.select("account_id", F.round("pagerank", 8).alias("pagerank"))


def _oriented(pairs: DataFrame) -> DataFrame:
    """Each pair from its end of lower (degree, id): out-degrees stay below the square root of the edges."""
    degree = both_ways(pairs).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    a, b = degree.select("u", F.col("d").alias("du")), degree.select(F.col("u").alias("v"), F.col("d").alias("dv"))
    low = F.expr("du < dv OR (du = dv AND u < v)")
    return pairs.join(a, "u").join(b, "v").select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b"))


def clustering(edge: DataFrame, ids: DataFrame) -> DataFrame:
    """Undirected, unweighted local clustering; loops are ignored."""
    pairs = stage(undirected(edge), "pairs")
    arcs = stage(_oriented(pairs), "arcs")
    x, y = arcs.select("a", F.col("b").alias("x")), arcs.select("a", F.col("b").alias("y"))
    wedge = x.join(y, "a").filter("x <> y").join(arcs.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"])
    corner = wedge.select(F.explode(F.array("a", "x", "y")).alias("account_id")).groupBy("account_id").agg(F.count(F.lit(1)).alias("t"))
    degree = both_ways(pairs).groupBy(F.col("u").alias("account_id")).agg(F.count(F.lit(1)).alias("d"))
    value = F.when(F.col("d") >= 2, 2.0 * zero("t") / (F.col("d") * (F.col("d") - 1)))
    return ids.select("account_id").join(degree, "account_id", "left").join(corner, "account_id", "left").select("account_id", F.round(zero(value), 6).alias("clustering_coefficient"))


def core_numbers(edge: DataFrame, ids: DataFrame) -> DataFrame:
    """Largest k whose k-core holds the vertex; loops are left out.

    Every vertex starts at its degree and takes the h-index of its neighbours' values until none
    moves, which is the core number. Values are counted per vertex before they are ordered, so a
    vertex with very many neighbours is a few rows.
    """
    near = stage_by(both_ways(undirected(edge)), "v", name="core")
    value = stage_by(near.groupBy("u").agg(F.count(F.lit(1)).alias("k")), "u", name="core", dealt=True)
    high = Window.partitionBy("u").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        seen = near.join(value.withColumnRenamed("u", "v").hint("merge"), "v").groupBy("u", "k").agg(F.count(F.lit(1)).alias("n"))
        h = seen.select("u", F.least("k", F.sum("n").over(high)).alias("h")).groupBy("u").agg(F.max("h").alias("h"))
        new = stage_by(value.join(h.hint("merge"), "u").select("u", F.least("k", "h").alias("k"), (F.col("h") < F.col("k")).alias("moved")), "u", name="core", dealt=True)
        value = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return ids.select("account_id").join(value, F.col("account_id") == F.col("u"), "left").select("account_id", zero("k").cast("long").alias("k_core_number"))


def scc_sizes(edge: DataFrame, ids: DataFrame) -> DataFrame:
    found = strong_components(edge, ids.select(F.col("account_id").alias("id")).distinct())
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("scc_size"))
    return found.join(size, "component").select(F.col("id").alias("account_id"), "scc_size")


def community_density(edge: DataFrame, community: DataFrame) -> DataFrame:
    """Directed edges inside a community over n (n - 1); 0 for one vertex."""
    a, b = (community.select(F.col("account_id").alias(k), F.col("community_id").alias(c)) for k, c in (("src", "ca"), ("dst", "cb")))
    inner = edge.join(a, "src").join(b, "dst").filter("ca = cb").groupBy(F.col("ca").alias("community_id")).agg(F.count(F.lit(1)).alias("m"))
    size = community.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
    density = size.join(inner, "community_id", "left").select("community_id", F.round(F.when(F.col("n") > 1, zero("m") / (F.col("n") * (F.col("n") - 1)).cast("double")).otherwise(0.0), 6).alias("subgraph_density"))
    return community.join(density, "community_id").select("account_id", "community_id", "subgraph_density")


def betweenness(edge: DataFrame, ids: DataFrame, pivots: int = 500, max_depth: int = 30, seed: int = 42) -> DataFrame:
    """Brandes from pivots (lowest seeded hashes; all vertices where they are few), all pivots at once.

    Forward, level by level: shortest-path counts of (pivot, vertex). Backward: dependencies from
    the deepest level up, along the arcs on shortest paths. Pivots travel packed, a row an arc and level.
    Directed, unweighted, normalised like full betweenness.
    """
    ids = stage(ids.select("account_id").distinct(), "betweenness-ids")
    n = ids.count()
    if n < 3:
        return ids.withColumn("betweenness", F.lit(0.0))
    first = F.xxhash64(F.lit(seed), "account_id"), F.col("account_id")
    chosen = ids.orderBy(*first).limit(pivots).select(F.col("account_id").alias("x"), (F.row_number().over(Window.orderBy(*first)) - 1).alias("number"))
    arcs = stage(edge.filter("src <> dst").select("src", "dst").distinct(), "betweenness-arcs")
    total = dependencies(stage(chosen, "pivots"), arcs, max_depth)
    if total is None:
        return ids.withColumn("betweenness", F.lit(0.0))
    k = min(pivots, n)
    scale = (n / k) / ((n - 1) * (n - 2))
    return ids.join(total, "account_id", "left").select("account_id", F.round(zero("d") * scale, 8).alias("betweenness"))


def structural_features(edge: DataFrame, ids: DataFrame) -> DataFrame:
    """All 13 features of every vertex."""
    edge, ids = stage(edge, "edges"), stage(ids.select("account_id").distinct(), "ids")
    loops = (
        lambda: betweenness(edge, ids), lambda: pagerank(edge, ids, iterations=30), lambda: clustering(edge, ids),
        lambda: core_numbers(edge, ids), lambda: scc_sizes(edge, ids), lambda: community_density(edge, louvain(edge, ids)),
    )
    parts = [degrees(edge, ids), *together(edge.sparkSession, *loops)]
    return reduce(lambda a, b: a.join(b, "account_id", "left"), parts)
