"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x: Column | str) -> Column:
    """A sum that does not depend on the order of rows: cents as decimals, then a double."""
    return F.sum(col(x).cast("decimal(28,2)")).cast("double")


def seconds(a: Column | str, b: Column | str) -> Column:
    """Whole seconds from a to b, cut off."""
    return F.timestamp_diff("SECOND", col(a), col(b))


def zero(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(0))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def risk_band(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 90, "critical").when(s >= 75, "high").when(s >= 50, "medium").when(s >= 25, "low").otherwise("minimal")


def risk_colour(band: Column | str) -> Column:
    """Chart colour of a band."""
    b = col(band)
    return F.when(b == "critical", "#d32f2f").when(b == "high", "#f57c00").when(b == "medium", "#fbc02d").when(b == "low", "#7cb342").otherwise("#388e3c")


def deterministic_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 32)
