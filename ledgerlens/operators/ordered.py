"""Neighbouring rows in an order within a key, where a key may hold a third of all rows.

Heavy keys are cut into pieces along the order; each piece is a window partition of its own and takes what comes
before or after it from one edge row a piece. A key's rows at one instant stay together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import stage

#: Keys of at most so many rows are one window partition.
WHOLE = 100_000
#: Heavy keys are cut into pieces of 1/PARTS of all rows, or of WHOLE rows where that is more.
PARTS = 1000


def pieces(rows: DataFrame, key: Sequence[str], order: str, whole: int = WHOLE) -> DataFrame | None:
    """Key columns, ``hot`` and ``cuts`` (ascending microseconds) of the heavy keys, or None where there are none.

    A key is heavy above ``bar`` = max(whole, rows / PARTS) rows and has rows / bar cuts at most, so
    the table has at most PARTS keys and 2 * PARTS cuts, whatever the input's size. It is written: a sketch depends
    on the order that its parts arrive in, and all readers need the same cuts.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    bar = max(whole, (total or 0) // PARTS)
    if (most or 0) <= bar:
        return None
    heavy = sizes.filter(F.col("n") > bar)
    micros = F.unix_micros(F.col(order).cast("timestamp"))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    mine = rows.alias("r").join(F.broadcast(heavy.alias("h")), same).select(*(F.col(f"r.{k}") for k in key), micros.alias("at"), F.col("h.n"))
    # a sketch of at most PARTS quantiles a key; the share of them that a key uses follows its size
    grid = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    marks = mine.groupBy(*key).agg(F.percentile_approx("at", grid, 10 * PARTS).alias("q"), F.max("n").alias("n"))
    step = F.greatest(F.floor(F.lit(float(PARTS)) / F.ceil(F.col("n") / bar)), F.lit(1)).cast("int")
    marks = marks.select(*key, F.lit(True).alias("hot"), F.array_distinct(F.filter("q", lambda v, i: (i + 1) % step == 0)).alias("cuts"))
    return stage(marks, "pieces")


def neighbour(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, name: str, ahead: bool = False, whole: int = WHOLE) -> DataFrame:
    """``rows`` with column ``name``: ``value`` of the row before (or, ``ahead``, after) in ``order`` within ``key``; null at the end.

    The first column of ``order`` is a time; rows without one come first. Columns ``_hot`` and ``_piece`` must be free.
    """
    heavy = pieces(rows, key, order[0], whole)
    shift = F.lead if ahead else F.lag
    if heavy is None:
        return rows.withColumn(name, shift(value).over(Window.partitionBy(*key).orderBy(*order)))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    micros = F.unix_micros(F.col(f"r.{order[0]}").cast("timestamp"))
    place = F.coalesce(F.size(F.filter("h.cuts", lambda c: c <= micros)), F.lit(0))
    dealt = rows.alias("r").join(F.broadcast(heavy.alias("h")), same("r", "h"), "left").select("r.*", F.coalesce("h.hot", F.lit(False)).alias("_hot"), F.when(F.col("h.hot"), place).otherwise(0).alias("_piece"))
    pick = F.min_by if ahead else F.max_by
    edge = dealt.filter("_hot").groupBy(*key, "_piece").agg(pick(F.struct(value), F.struct(*order)).alias("last"))
    edge = edge.select(*key, "_piece", shift("last").over(Window.partitionBy(*key).orderBy("_piece"))[value].alias("_carried"))  # at most PARTS rows a key
    inside = Window.partitionBy(*key, "_piece").orderBy(*order)
    end = F.lead(F.lit(1)).over(inside).isNull() if ahead else F.row_number().over(inside) == 1
    out = dealt.withColumns({name: shift(value).over(inside), "_end": end})
    out = out.alias("a").join(F.broadcast(edge.alias("e")), [*same("a", "e"), F.col("a._piece") == F.col("e._piece"), F.col("a._hot"), F.col("a._end")], "left")
    kept = [F.col(f"a.{c}") for c in rows.columns]
    return out.select(*kept, F.when(F.col("a._hot") & F.col("a._end"), F.col("e._carried")).otherwise(F.col(f"a.{name}")).alias(name))
