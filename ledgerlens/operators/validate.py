"""Validation of ledgers: one aggregate each, results as one-row DataFrames."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import ACCOUNTS, LABEL_COLUMNS, TRANSACTIONS


def missing_columns(df: DataFrame, schema) -> list[str]:
    return [f.name for f in schema if f.name not in df.columns]


def transaction_checks(txns: DataFrame) -> DataFrame:
    """Null counts per column, rows that are not positive or go to their sender, uncastable amounts and times."""
    if gone := missing_columns(txns, TRANSACTIONS):
        raise ValueError(f"missing columns: {gone}")
    amount, time = F.col("amount").try_cast("double"), F.col("timestamp").try_cast("timestamp_ntz")
    return txns.agg(
        F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(f.name).isNull()).alias(f"null_{f.name}") for f in TRANSACTIONS),
        F.count_if(amount.isNull() & F.col("amount").isNotNull()).alias("uncastable_amount"), F.count_if(time.isNull() & F.col("timestamp").isNotNull()).alias("uncastable_timestamp"),
        F.count_if(amount <= 0).alias("non_positive"), F.count_if(F.col("sender_id") == F.col("receiver_id")).alias("self_transfers"),
    )


def validate_transactions(txns: DataFrame) -> tuple[bool, list[str]]:
    if gone := missing_columns(txns, TRANSACTIONS):
        return False, [f"missing columns: {gone}"]
    row = transaction_checks(txns).first().asDict()
    errors = [f"{k}: {v}" for k, v in row.items() if k != "n_rows" and v]
    return not errors, errors


def account_checks(accounts: DataFrame) -> DataFrame:
    if gone := missing_columns(accounts, ACCOUNTS):
        raise ValueError(f"missing columns: {gone}")
    seen = F.count_distinct("account_id") + F.max(F.when(F.col("account_id").isNull(), 1).otherwise(0))
    return accounts.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.coalesce(seen, F.lit(0))).alias("duplicates"))


def validate_accounts(accounts: DataFrame) -> tuple[bool, list[str]]:
    if gone := missing_columns(accounts, ACCOUNTS):
        return False, [f"missing columns: {gone}"]
    n = account_checks(accounts).first()["duplicates"]
    return n == 0, [f"duplicates: {n}"] if n else []


def label_leaks(columns: list[str]) -> list[str]:
    return [c for c in columns if c in LABEL_COLUMNS]


#: Omnibus normality test of two moments in closed form, step by step: a z-score of the skewness, one of the kurtosis,
#: and the chi-squared value of both with two degrees of freedom.
K_SQUARED = (
    ("y", "skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2)))"),
    ("b2", "3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))"),
    ("w2", "sqrt(2 * (b2 - 1)) - 1"),
    ("z1", "asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5D * ln(w2))"),
    ("x", "(kurt + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))"),
    ("root", "6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))"),
    ("a", "6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root)))"),
    ("t", "(1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))"),
    ("z2", "(1 - 2 / (9 * a) - sign(t) * power(abs(t), 1.0D / 3)) / sqrt(2 / (9 * a))"),
    ("k2", "z1 * z1 + z2 * z2"),
    ("p_value", "exp(-k2 / 2)"),
)


def k_squared(moments: DataFrame) -> DataFrame:
    """Adds k2 and p_value to rows of n, skew and kurt; null below eight values or without spread."""
    known = F.col("n") >= 8
    rows = moments.withColumns({"_n": F.col("n"), "n": F.when(known, F.col("n").cast("double"))})
    for name, step in K_SQUARED:
        rows = rows.withColumn(name, F.expr(step))
    return rows.withColumn("n", F.col("_n")).select(*moments.columns, "k2", "p_value")


def amount_lognormality(txns: DataFrame) -> DataFrame:
    """Moments of ln(amount) over positive amounts, and the test of all of them for normality."""
    x = F.ln("amount")
    m = txns.filter("amount > 0").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("log_mean"), F.stddev_pop(x).alias("log_std"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"),
    )
    ok = (F.col("n") >= 8) & (F.col("log_std") > 0.5) & (F.col("log_mean") > 0)
    return k_squared(m).select("n", "log_mean", "log_std", "skew", "kurt", "k2", "p_value", F.coalesce(ok, F.lit(False)).alias("passed"))


def degree_counts(txns: DataFrame) -> DataFrame:
    """Transactions per sender and per receiver, one below the other."""
    return txns.groupBy("sender_id").count().select("count").unionAll(txns.groupBy("receiver_id").count().select("count")).select(F.col("count").alias("degree"))


def degree_summary(txns: DataFrame) -> DataFrame:
    return degree_counts(txns).agg(F.count(F.lit(1)).alias("n"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))


def degree_power_law(txns: DataFrame) -> tuple[float, int, bool]:
    """Exponent and lower end of the best discrete power law of the degrees: for each candidate end the
    approximate likelihood estimate, scored by the largest gap between the distributions."""
    hist = degree_counts(txns).groupBy("degree").agg(F.count(F.lit(1)).alias("n")).orderBy("degree").toPandas()  # one row a degree
    x, n = hist["degree"].to_numpy(float), hist["n"].to_numpy(float)
    best = (math.inf, math.nan, 0)
    above, logs = n[::-1].cumsum()[::-1], (n * np.log(x))[::-1].cumsum()[::-1]
    for i in range(max(0, len(x) - 1)):
        total = above[i]
        if total < 10:
            break
        alpha = 1 + total / (logs[i] - total * math.log(x[i] - 0.5))
        fit = 1 - (x[i:] + 0.5) ** (1 - alpha) / (x[i] - 0.5) ** (1 - alpha)
        gap = abs(n[i:].cumsum() / total - fit).max()
        best = min(best, (gap, alpha, int(x[i])))
    return best[1], best[2], 1.5 < best[1] < 4


def temporal_coverage(txns: DataFrame) -> DataFrame:
    day = txns.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    span = F.floor(F.timestamp_diff("SECOND", F.min("lo"), F.max("hi")) / 86400).cast("long")
    return day.agg(span.alias("span_days"), F.count(F.lit(1)).alias("active_days"), F.avg("n").alias("mean_daily")).withColumn("passed", F.coalesce(F.col("span_days") > 30, F.lit(False)))


def fraud_ratio(accounts: DataFrame) -> DataFrame:
    r = accounts.agg(F.round(F.coalesce(F.count_if("is_fraud") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 6).alias("fraud_ratio"))
    return r.withColumn("passed", (F.col("fraud_ratio") >= 0.001) & (F.col("fraud_ratio") <= 0.05))


def account_coverage(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    ends = txns.select(F.explode(F.array(F.struct(F.col("sender_id").alias("id"), F.lit(1).alias("s")), F.struct(F.col("receiver_id").alias("id"), F.lit(0).alias("s")))).alias("e")).select("e.*")
    ends = ends.groupBy("id").agg(F.max("s").alias("sends"), F.min("s").alias("gets"))
    agg = ends.agg(F.sum("sends").alias("senders"), F.sum(1 - F.col("gets")).alias("receivers"), F.count(F.lit(1)).alias("active"))
    total = accounts.agg(F.count(F.lit(1)).alias("total"))
    return agg.crossJoin(F.broadcast(total)).select("senders", "receivers", "active", F.round(F.col("active") / F.nullif("total", F.lit(0)), 6).alias("coverage")).withColumn("passed", F.coalesce(F.col("coverage") > 0.5, F.lit(False)))


def validate_all(txns: DataFrame, accounts: DataFrame) -> dict:
    """All statistical checks and whether all passed."""
    out = {"lognormality": amount_lognormality(txns).first().asDict(), "temporal": temporal_coverage(txns).first().asDict(), "fraud_ratio": fraud_ratio(accounts).first().asDict(), "coverage": account_coverage(txns, accounts).first().asDict()}
    alpha, least, ok = degree_power_law(txns)
    out["power_law"] = {"alpha": alpha, "xmin": least, "passed": ok}
    out["passed"] = all(v["passed"] for v in out.values())
    return out
