"""Exact quantiles by selection: sketches bracket each rank, counts place the bracket, and only its inside is looked at.

No task sees all values of a column. Quantiles interpolate linearly between the two ranks around a position, as ``percentile`` does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 2000
#: A bracket with at most so many values is sorted.
SORTED = 50_000


def _interpolated(position: float, low: float, high: float) -> float:
    below, above = math.floor(position), math.ceil(position)
    return low if below == above or low == high else (above - position) * low + (position - below) * high


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], sorted_rows: int = SORTED) -> dict[str, list[float | None]]:
    """Column to its quantiles at ``probs``; nulls are left out, NaN is above all numbers, a column without values has None.

    Each round reads ``df`` twice for all columns: a sketch inside each rank's bracket narrows it to some 4/ACCURACY of
    what it held, and counts tell how many values lie below. The driver holds a few numbers a column and rank.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    rows = df.select(*((F.col(c).cast("double") + F.lit(0.0)).alias(a) for c, a in at.items()))  # -0.0 becomes 0.0
    size = rows.agg(*(f.alias(f"{k}_{a}") for a in at.values() for k, f in (("n", F.count(a)), ("nan", F.count_if(F.isnan(a))), ("lo", F.min(a)), ("hi", F.max(F.when(~F.isnan(a), F.col(a))))))).first()
    n = {c: size[f"n_{a}"] for c, a in at.items()}
    # rank of a number (from 0) to its bracket: least and largest value, values below it
    value: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int, int]] = {}
    for c, a in at.items():
        numbers = n[c] - size[f"nan_{a}"]
        for rank in {r for p in probs for r in (math.floor((n[c] - 1) * p), math.ceil((n[c] - 1) * p))} if n[c] else ():
            if rank >= numbers:
                value[c, rank] = math.nan
            else:
                open_[c, rank] = (size[f"lo_{a}"], size[f"hi_{a}"], 0, numbers)
    while open_:
        inside = {k: (F.col(at[k[0]]) >= lo) & (F.col(at[k[0]]) <= hi) for k, (lo, hi, _, _) in open_.items()}
        wide = {k: v for k, v in open_.items() if v[0] < v[1] and v[3] > sorted_rows}
        for k, (lo, hi, _, _) in open_.items():
            if lo == hi:
                value[k] = lo
        short = [k for k, v in open_.items() if v[0] < v[1] and v[3] <= sorted_rows]
        if short:
            groups: dict[tuple, list[int]] = {}  # ranks of one column and bracket look at the same values
            for c, rank in short:
                lo, hi, below, _ = open_[c, rank]
                groups.setdefault((c, lo, hi, below), []).append(rank)
            names = list(groups)
            cells = F.array(*(F.struct(F.lit(i).alias("i"), F.when(inside[g[0], groups[g][0]], F.col(at[g[0]])).alias("v")) for i, g in enumerate(names)))
            some = rows.select(F.explode(F.filter(cells, lambda s: s["v"].isNotNull())).alias("e")).groupBy("e.i", "e.v").agg(F.count(F.lit(1)).alias("m"))
            # a bracket holds at most sorted_rows values
            placed = some.withColumn("upto", F.sum("m").over(Window.partitionBy("i").orderBy("v")))
            wants = F.get(F.array(*(F.array(*(F.lit(r - g[3]) for r in groups[g])) for g in names)), F.col("i"))
            for r in placed.filter(F.exists(wants, lambda w: (F.col("upto") > w) & (F.col("upto") - F.col("m") <= w))).collect():  # at most a row a rank
                c, _, _, below = g = names[r["i"]]
                for rank in groups[g]:
                    if r["upto"] - r["m"] <= rank - below < r["upto"]:
                        value[c, rank] = r["v"]
        open_ = {}
        if wide:
            keys = list(wide)
            share = lambda k, by: min(1.0, max(0.0, (k[1] - wide[k][2] + 0.5) / wide[k][3] + by))
            step = 2.0 / ACCURACY
            sketch = rows.agg(*(F.percentile_approx(F.when(inside[k], F.col(at[k[0]])), F.array(F.lit(share(k, -step)), F.lit(share(k, step))), ACCURACY).alias(f"q{i}") for i, k in enumerate(keys))).first()
            cut = {k: (float(sketch[f"q{i}"][0]), float(sketch[f"q{i}"][1])) for i, k in enumerate(keys)}
            # a bracket that does not shrink between two values is cut at its least one
            cut = {k: (lo, lo) if (lo, hi) == wide[k][:2] else (lo, hi) for k, (lo, hi) in cut.items()}
            tell = lambda k, a: ((f"b{a}", F.count_if(inside[k] & (F.col(at[k[0]]) < cut[k][0]))), (f"u{a}", F.count_if(inside[k] & (F.col(at[k[0]]) <= cut[k][1]))),
                                 (f"p{a}", F.max(F.when(inside[k] & (F.col(at[k[0]]) < cut[k][0]), F.col(at[k[0]])))), (f"s{a}", F.min(F.when(inside[k] & (F.col(at[k[0]]) > cut[k][1]), F.col(at[k[0]])))))
            got = rows.agg(*(f.alias(name) for i, k in enumerate(keys) for name, f in tell(k, i))).first()
            for i, k in enumerate(keys):
                lo, hi, below, held = wide[k]
                b, u, want = got[f"b{i}"], got[f"u{i}"], k[1] - below
                if want < b:  # the sketch's error left the rank outside: go on beside the cut
                    open_[k] = (lo, got[f"p{i}"], below, b)
                elif want >= u:
                    open_[k] = (got[f"s{i}"], hi, below + u, held - u)
                else:
                    open_[k] = (*cut[k], below + b, u - b)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        places = [(n[c] - 1) * p for p in probs]
        out[c] = [_interpolated(x, value[c, math.floor(x)], value[c, math.ceil(x)]) if n[c] else None for x in places]
    return out


def group_median(df: DataFrame, key: str, column: str, accuracy: int = 1000) -> DataFrame:
    """``key`` and median, exact: a sketch brackets each group's middle ranks, so only some 8/accuracy of a group is ordered.

    A group's rows are counted where they lie; equal values are counted together before they meet.
    """
    step = 4.0 / accuracy
    v = F.col(column)
    brackets = df.filter(v.isNotNull()).groupBy(key).agg(
        F.percentile_approx(v, F.array(F.lit(0.5 - step), F.lit(0.5 + step)), accuracy).alias("q"), F.count(F.lit(1)).alias("n"),
    )
    rows = df.filter(v.isNotNull()).select(key, v.alias("v")).join(brackets, key)
    below = rows.groupBy(key).agg(F.count_if(F.col("v") < F.col("q")[0]).alias("below"), F.first("n").alias("n"))
    middle = rows.filter((F.col("v") >= F.col("q")[0]) & (F.col("v") <= F.col("q")[1])).groupBy(key, "v").agg(F.count(F.lit(1)).alias("m"))
    placed = middle.join(below, key).withColumn("upto", F.sum("m").over(Window.partitionBy(key).orderBy("v")) + F.col("below"))
    holds = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("m") <= rank), F.col("v")))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    return placed.groupBy(key).agg(((holds(low) + holds(high)) / 2).alias("median"))
