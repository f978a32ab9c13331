"""Building blocks of iterative graph operators: stage tables, breadth-first search, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import both_ways, undirected

#: Least parts of training rows, and most rows of a part on average.
SPREAD, SPREAD_ROWS = 24, 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master may go without one."""
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes a loop's state to the shared folder and reads it back: no growing lineage, nothing lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, *keys: str, name: str = "stage", dealt: bool = False) -> DataFrame:
    """stage() in buckets of ``keys``, as many as shuffle partitions: joins and groups by all of them find it dealt out already.

    A loop writes its graph so once, and only its state is shuffled. ``dealt``: the rows lie so in tasks as they are computed.
    """
    n, spark = n_parts(df.sparkSession), df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, *keys)
    rows.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def spread(rows: DataFrame, n: int, key: str = "account_id") -> DataFrame:
    """``n`` rows, or about that many, for a trainer that works on them where they lie: small files and broadcast joins may leave
    all of them to one task. Parts, and the rows' order in them, follow from ``key`` and ``n`` alone, so sampling by part agrees between reruns."""
    return rows.repartition(max(SPREAD, -(-n // SPREAD_ROWS)), key).sortWithinPartitions(key)


def together(spark: SparkSession, *steps: Callable[[], Any]) -> Sequence[Any]:
    """The steps' results in order; loops of small jobs that do not need each other run side by side."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def bfs(pairs: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """id and dist of all vertices within ``max_hops`` of any seed: one frontier for all seeds.

    ``pairs``: u < v. ``seeds``: id. Each hop joins the frontier with the neighbours and drops
    vertices reached before.
    """
    near = stage(both_ways(pairs), "bfs-pairs")
    reached = stage(seeds.select("id").distinct().withColumn("dist", F.lit(0)), "bfs")
    front = reached
    for hop in range(1, max_hops + 1):
        front = front.join(near, front.id == near.u).select(F.col("v").alias("id")).distinct().join(reached.select("id"), "id", "left_anti")
        front = stage(front.withColumn("dist", F.lit(hop)), "bfs")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def components(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and component (least id) by label minima with pointer jumping."""
    near = stage_by(both_ways(pairs), "v", name="cc-pairs")
    label = stage_by(ids.select("id", F.col("id").alias("component")), "id", name="cc")
    while True:
        least = near.join(label.hint("merge"), near.v == label.id).groupBy("u").agg(F.min("component").alias("m"))
        new = label.join(least.hint("merge"), label.id == least.u, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        new = stage_by(new, "id", name="cc", dealt=True)
        jump = new.alias("a").join(new.alias("b").hint("merge"), F.expr("a.component = b.id")).select("a.id", F.expr("b.component").alias("component"), "a.old")
        jump = stage_by(jump, "id", name="cc")
        label = jump.drop("old")
        if jump.filter("component <> old").isEmpty():
            return label


def strong_components(edge: DataFrame, ids: DataFrame) -> DataFrame:
    """id and component: vertices that reach each other, named by their least id.

    Rounds of trimming (a vertex without in- or out-edges among the rest stands alone) and forward
    colouring: the largest id that reaches each vertex is its colour; within a colour, the vertices
    that reach the colour's root are its component.
    """
    arcs = stage(edge.filter("src <> dst").select("src", "dst").distinct(), "scc-arcs")
    rest = stage(ids.select("id"), "scc")
    done = None
    while True:
        while True:  # trim
            live = rest.join(arcs.select(F.col("dst").alias("id")).distinct().hint("merge"), "id", "left_semi").join(arcs.select(F.col("src").alias("id")).distinct().hint("merge"), "id", "left_semi")
            live = stage(live, "scc")
            alone = rest.join(live.hint("merge"), "id", "left_anti")
            if alone.isEmpty():
                break
            alone = stage(alone.select("id", F.col("id").alias("component")), "scc-done")
            done = alone if done is None else done.unionByName(alone)
            rest = live
            arcs = stage(arcs.join(rest.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").join(rest.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi"), "scc-arcs")
        if rest.isEmpty():
            return done if done is not None else rest.withColumn("component", F.col("id"))
        colour, ahead = stage_by(rest.withColumn("c", F.col("id")), "id", name="scc-colour"), stage_by(arcs, "src", name="scc-ahead")
        while True:
            most = ahead.join(colour.hint("merge"), ahead.src == colour.id).groupBy("dst").agg(F.max("c").alias("m"))
            new = colour.join(most.hint("merge"), colour.id == most.dst, "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old"))
            new = stage_by(new, "id", name="scc-colour", dealt=True)
            colour = new.drop("old")
            if new.filter("c <> old").isEmpty():
                break
        inside = ahead.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")).hint("merge"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")).hint("merge"), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        inside = stage_by(inside, "dst", "c", name="scc-inside")
        member = stage(colour.filter("id = c"), "scc-member")
        front = member
        while True:  # backwards from the roots, within colours
            front = inside.join(front.select(F.col("id").alias("dst"), "c").hint("merge"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct().join(member.hint("merge"), ["id", "c"], "left_anti")
            front = stage(front, "scc-member")
            if front.isEmpty():
                break
            member = member.unionByName(front)
        member = stage(member, "scc-member")
        least = member.groupBy("c").agg(F.min("id").alias("component"))
        found = stage(member.join(least, "c").select("id", "component"), "scc-done")
        done = found if done is None else done.unionByName(found)
        rest = stage(rest.join(found.hint("merge"), "id", "left_anti"), "scc")
        arcs = stage(arcs.join(rest.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").join(rest.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi"), "scc-arcs")


def ego_network(edge: DataFrame, center, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Vertices within ``depth`` undirected hops of one vertex, and the edges among them."""
    seeds = edge.sparkSession.range(1).select(F.lit(center).cast(edge.schema["src"].dataType).alias("id"))
    inside = stage(bfs(undirected(edge), seeds, depth), "ego")
    ids = inside.select("id")
    return inside, edge.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
