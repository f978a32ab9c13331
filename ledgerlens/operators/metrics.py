"""Model metrics and drift."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import zero
from .graph import undirected
from .quantiles import exact_quantiles


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and rows per distinct score, with running sums from the top, in two steps: ranges of
    scores first, so no task sees all of them at once."""
    s = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("long").alias("y")).groupBy("s").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("r", F.floor(F.col("s") * 1000))
    part = s.groupBy("r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    up = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)  # over at most a few thousand ranges
    part = part.select("r", zero(F.sum("rp").over(up)).alias("bp"), zero(F.sum("rn").over(up)).alias("bn"))
    w = Window.partitionBy("r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.join(part, "r").select("s", "p", "n", (F.sum("p").over(w) + F.col("bp")).alias("tp"), (F.sum("n").over(w) + F.col("bn")).alias("k"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    t = df.agg(F.sum(F.col(label).cast("long")).alias("t"))
    return _by_score(df, score, label).crossJoin(F.broadcast(t)).select(F.col("s").alias("threshold"), F.round(F.col("tp") / F.col("k"), 6).alias("precision"), F.round(zero(F.col("tp") / F.nullif("t", F.lit(0))), 6).alias("recall"))


def ranking_metrics(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: ROC-AUC (ties half), average precision (step sum), precision, recall and false positive rate at the threshold; undefined ones 0."""
    y = F.col(label).cast("long")
    hit = F.col(score) >= threshold
    base = df.agg(F.sum(y).alias("t"), F.sum(1 - y).alias("f"), zero(F.sum(F.when(hit, y))).alias("tp"), zero(F.sum(F.when(hit, 1 - y))).alias("fp"))
    rows = _by_score(df, score, label)
    # negatives of lower scores, plus half of those at the same score, per positive
    curve = rows.crossJoin(F.broadcast(base.select("t", "f"))).agg(
        F.sum(F.col("p") * ((F.col("f") - (F.col("k") - F.col("tp"))) + (F.col("n") - F.col("p")) / 2.0)).alias("u"), F.sum(F.col("p") * F.col("tp") / F.col("k")).alias("ap"),
    )
    div = lambda a, b: F.round(zero(a / F.nullif(b, F.lit(0))), 6)
    t, f = F.col("t").cast("double"), F.col("f").cast("double")
    return base.crossJoin(curve).select(
        div(F.col("u"), t * f).alias("roc_auc"), div(F.col("ap"), t).alias("pr_auc"), div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        div(F.col("tp"), F.col("t")).alias("recall"), div(F.col("fp"), F.col("f")).alias("fpr"),
    )


def at_k(df: DataFrame, ks=(50, 100, 200, 500), score: str = "score", label: str = "label", key: str = "account_id") -> DataFrame:
    """k, precision and recall of the k highest scores (k at most the number of rows)."""
    top = df.orderBy(F.desc(score), key).limit(max(ks)).select(score, key, F.col(label).cast("long").alias("y"))
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc(score), key)))  # max(ks) rows
    total = df.agg(F.sum(F.col(label).cast("long")).alias("t"))
    grid = ranked.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "r", "y").filter("r <= k")
    out = grid.groupBy("k").agg(F.sum("y").alias("tp"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    return out.select("k", F.round(F.col("tp") / F.col("n"), 6).alias("precision_at_k"), F.round(zero(F.col("tp") / F.nullif("t", F.lit(0))), 6).alias("recall_at_k"))


def evaluation_report(models: DataFrame) -> DataFrame:
    """The model of best validation pr_auc. ``models``: model, split, pr_auc ..."""
    return models.filter("split = 'val'").agg(F.max_by("model", F.struct("pr_auc", "model")).alias("best_model"), F.max("pr_auc").alias("val_pr_auc"))


def model_comparison(models: DataFrame, names: tuple[str, ...] = ("roc_auc", "pr_auc", "precision", "recall")) -> DataFrame:
    """model, metric and value on the validation split, 0 where a metric is not given: the bars of a comparison chart."""
    value = lambda c: zero(F.col(c).cast("double")) if c in models.columns else F.lit(0.0)
    bars = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), value(c).alias("value")) for c in names)))
    return models.filter("split = 'val'").select("model", bars.alias("e")).select("model", "e.*")


def reliability(df: DataFrame, p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error; a probability of exactly 1 is in no bin."""
    rows = df.select(F.col(p).cast("double").alias("p"), F.col(label).cast("double").alias("y"))
    brier = rows.agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))), 6).alias("brier"), F.count(F.lit(1)).alias("n"))
    b = rows.filter("p < 1").groupBy(F.floor(F.col("p") * bins).alias("b")).agg(F.count(F.lit(1)).alias("m"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    e = b.agg(zero(F.sum(F.col("m") * F.abs(F.col("mp") - F.col("my")))).alias("e"))
    return brier.crossJoin(e).select("brier", F.round(F.col("e") / F.nullif("n", F.lit(0)), 6).alias("ece"))


# ---- drift


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c != "account_id"]


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or numeric_columns(df)
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("e")).select("e.*")


def drift_baseline(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """feature, mean, std (population), median and quartiles."""
    columns = columns or numeric_columns(df)
    rows = long_form(df, columns).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    q = exact_quantiles(df, columns, (0.5, 0.25, 0.75))
    quantile = lambda i: F.get(F.create_map(*(x for c in columns for x in (F.lit(c), F.array(*(F.lit(v).cast("double") for v in q[c])))))[F.col("feature")], F.lit(i))
    return rows.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *(F.round(quantile(i), 6).alias(n) for i, n in enumerate(("median", "q25", "q75"))))


def psi(a: DataFrame, b: DataFrame, bins: int = 20) -> DataFrame:
    """feature and psi of long-form frames over ``bins`` equal bins of the joint range, counts smoothed by 1."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    span = both.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = F.col("hi") - F.col("lo")
    bin_ = F.when(w < 1e-10, 0).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(w, F.lit(0.0)) * bins), F.lit(bins - 1)))
    cells = both.join(F.broadcast(span), "feature").groupBy("feature", bin_.alias("bin")).agg(F.sum(1 - F.col("side")).alias("a"), F.sum("side").alias("b"), F.max(w).alias("w"))
    n = cells.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.max("w").alias("w"))
    grid = n.select("feature", "na", "nb", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    rows = grid.join(cells.select("feature", F.col("bin").cast("long").alias("bin"), "a", "b"), ["feature", "bin"], "left")
    p, q = (zero("a") + 1.0) / (F.col("na") + bins), (zero("b") + 1.0) / (F.col("nb") + bins)
    return rows.groupBy("feature").agg(F.when(F.max("w") < 1e-10, 0.0).otherwise(F.round(F.sum((q - p) * F.ln(q / p)), 6)).alias("psi"))


def ecdf_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """feature, ks (largest gap of the distributions) and wasserstein (area between them) of long-form frames."""
    both = a.select("feature", "value", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("feature", "value", F.lit(0).alias("a"), F.lit(1).alias("b")))
    steps = both.groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # Ranges of values first, so no task sees all values of a feature: each knows what lies below it and where the next begins.
    bounds = both.groupBy("feature").agg(F.percentile_approx("value", F.array(*(F.lit(k / 64) for k in range(1, 64))), 1000).alias("cuts"))
    steps = steps.join(F.broadcast(bounds), "feature").withColumn("r", F.size(F.filter("cuts", lambda c: c <= F.col("value")))).drop("cuts")
    ranges = steps.groupBy("feature", "r").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"), F.min("value").alias("lo"))
    whole = Window.partitionBy("feature")  # at most 64 ranges a feature
    below = whole.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "feature", "r", zero(F.sum("ra").over(below)).alias("ba"), zero(F.sum("rb").over(below)).alias("bb"),
        F.sum("ra").over(whole).alias("na"), F.sum("rb").over(whole).alias("nb"), F.lead("lo").over(whole.orderBy("r")).alias("next"),
    )
    w = Window.partitionBy("feature", "r").orderBy("value")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda x: (F.sum(x).over(run) + F.col(f"b{x}")) / F.col(f"n{x}").cast("double")
    step = zero(F.coalesce(F.lead("value").over(w), F.col("next")) - F.col("value"))
    rows = steps.join(F.broadcast(ranges), ["feature", "r"]).select("feature", F.abs(share("a") - share("b")).alias("gap"), step.alias("dx"))
    return rows.groupBy("feature").agg(F.round(F.max("gap"), 6).alias("ks"), F.round(F.sum(F.col("gap") * F.col("dx")), 6).alias("wasserstein"))


def ks_p_value(d, n, m):
    """Asymptotic two-sided p-value of a Kolmogorov-Smirnov distance, as a column."""
    en = F.sqrt(n * m / (n + m).cast("double"))
    x = (en + 0.12 + 0.11 / en) * d
    total = F.lit(0.0)
    for k in range(1, 21):
        total = total + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def feature_drift(base: DataFrame, now: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per feature: mean shift, ks, psi, wasserstein, p-value and whether it drifted."""
    a, b = long_form(base, columns), long_form(now, columns)
    m = a.groupBy("feature").agg(F.avg("value").alias("m0"), F.stddev_pop("value").alias("s0"), F.count("value").alias("n0")).join(b.groupBy("feature").agg(F.avg("value").alias("m1"), F.count("value").alias("n1")), "feature")
    rows = m.join(ecdf_distance(a, b), "feature").join(psi(a, b), "feature")
    shift = F.abs(F.col("m1") - F.col("m0")) / (F.col("s0") + 1e-8)
    rows = rows.withColumns({"mean_shift": F.round(shift, 6), "p_value": ks_p_value(F.col("ks"), F.col("n0"), F.col("n1"))})
    return rows.select("feature", "mean_shift", "ks", "psi", "wasserstein", F.round("p_value", 6).alias("p_value"), ((F.col("p_value") < 0.05) | (F.col("mean_shift") > 2) | (F.col("psi") > 0.2)).alias("drifted"))


def drift_summary(drift: DataFrame) -> DataFrame:
    ratio = F.count_if("drifted") / F.count(F.lit(1))
    return drift.agg(F.count(F.lit(1)).alias("features"), F.count_if("drifted").alias("drifted"), F.round(ratio, 4).alias("drift_ratio"), (ratio > 0.3).alias("retrain"))


def prediction_profile(df: DataFrame, score: str = "score") -> DataFrame:
    s = F.col(score).cast("double")
    q = exact_quantiles(df, [score], (0.5, 0.9, 0.99))[score]
    quantiles = (F.round(F.lit(v).cast("double"), 6).alias(n) for n, v in zip(("median", "q90", "q99"), q, strict=True))
    rows = df.agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.avg((s > 0.75).cast("int")).alias("alert_rate"))
    return rows.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *quantiles, F.round("alert_rate", 6).alias("alert_rate"))


def prediction_drift(base: DataFrame, now: DataFrame, score: str = "score") -> DataFrame:
    a, b = (prediction_profile(x, score).select(F.col("mean").alias(f"m{i}"), F.col("std").alias(f"s{i}"), F.col("alert_rate").alias(f"r{i}")) for i, x in enumerate((base, now)))
    one = lambda x: x.select(F.lit("score").alias("feature"), F.col(score).cast("double").alias("value"))
    n = base.agg(F.count(F.lit(1)).alias("n0")).crossJoin(now.agg(F.count(F.lit(1)).alias("n1")))
    rows = a.crossJoin(b).crossJoin(n).crossJoin(ecdf_distance(one(base), one(now)).select("ks"))
    rows = rows.withColumns({"mean_shift": F.round(F.abs(F.col("m1") - F.col("m0")) / (F.col("s0") + 1e-8), 6), "alert_rate_change": F.round(F.abs(F.col("r1") - F.col("r0")), 6), "p_value": ks_p_value(F.col("ks"), F.col("n0"), F.col("n1"))})
    return rows.select("ks", "mean_shift", "alert_rate_change", ((F.col("p_value") < 0.05) | (F.col("mean_shift") > 2) | (F.col("alert_rate_change") > 0.05)).alias("drifted"))


def graph_metrics(edge: DataFrame, ids: DataFrame, with_components: bool = False) -> DataFrame:
    """Size, density, degrees, clustering and leaf and root shares of a graph, one row; component metrics on demand."""
    from .iterate import components, together
    from .structural import clustering, degrees, scc_sizes

    # loops of small jobs that do not need each other
    loops = [lambda: clustering(edge, ids)]
    if with_components:
        loops += [lambda: scc_sizes(edge, ids), lambda: components(undirected(edge), ids.select(F.col("account_id").alias("id")))]
    near, *parts = together(edge.sparkSession, *loops)
    d = degrees(edge, ids)
    m = d.agg(
        F.count(F.lit(1)).alias("n_vertices"), F.sum("in_degree").alias("n_edges"), F.avg("in_degree").alias("avg_in"), F.max("in_degree").alias("max_in"), F.avg("out_degree").alias("avg_out"), F.max("out_degree").alias("max_out"),
        F.sum(F.col("in_degree") * F.col("in_degree") + F.col("out_degree") * F.col("out_degree")).alias("sq"), F.avg((F.col("out_degree") == 0).cast("int")).alias("leaf_ratio"), F.avg((F.col("in_degree") == 0).cast("int")).alias("root_ratio"),
    )
    c = near.agg(F.avg("clustering_coefficient").alias("avg_clustering"))
    n = F.col("n_vertices")
    mean = F.col("n_edges") / n.cast("double")
    std = F.sqrt(F.greatest(F.col("sq") / (2.0 * n) - mean * mean, F.lit(0.0)))
    six = lambda x: F.round(x, 6)
    out = m.crossJoin(c).select(
        "n_vertices", "n_edges", six(F.when(n > 1, F.col("n_edges") / (n * (n - 1)).cast("double")).otherwise(0.0)).alias("density"), six("avg_in").alias("avg_in_degree"), F.col("max_in").alias("max_in_degree"),
        six("avg_out").alias("avg_out_degree"), F.col("max_out").alias("max_out_degree"), six(std).alias("degree_std"), six("avg_clustering").alias("avg_clustering"), six("leaf_ratio").alias("leaf_ratio"), six("root_ratio").alias("root_ratio"),
    )
    if with_components:
        s = parts[0].agg(F.sum(1.0 / F.col("scc_size")).alias("n_scc"), F.max("scc_size").alias("largest"), F.count(F.lit(1)).alias("n"))
        w = parts[1].agg(F.count_distinct("component").alias("n_wcc"))
        out = out.crossJoin(s.select(F.round("n_scc").cast("long").alias("n_scc"), six(F.col("largest") / F.col("n")).alias("largest_scc_ratio"))).crossJoin(w)
    return out


def graph_drift_verdict(drift: DataFrame, least: int = 3) -> DataFrame:
    """How many metrics of a graph drifted, and whether the graph did: ``least`` of them or more."""
    n = F.count_if("drifted")
    return drift.agg(F.count(F.lit(1)).alias("metrics"), n.alias("drifted_metrics"), (n >= least).alias("drifted"))


def graph_drift(base: DataFrame, now: DataFrame, limit: float = 0.3) -> DataFrame:
    """metric, baseline, current, change (relative, or the value itself where the baseline is 0) and drifted."""
    cols = [c for c in base.columns if c in now.columns]
    one = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in cols))).alias("e")).select("e.*")
    rows = one(base, "baseline").join(one(now, "current"), "metric")
    change = F.when(F.col("baseline") == 0, F.abs("current")).otherwise(F.abs(F.col("current") - F.col("baseline")) / F.abs(F.nullif("baseline", F.lit(0.0))))
    return rows.withColumn("change", F.round(change, 6)).withColumn("drifted", F.col("change") > limit)
