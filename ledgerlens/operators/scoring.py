"""Risk scores: robust component scores, blending, bands, calibration, alerts."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Scoring
from ..functions.columns import clip, risk_band
from ..functions.schemas import BEHAVIORAL_SCORE, PROPAGATION_SCORE, STRUCTURAL_SCORE
from .iterate import spread, stage
from .quantiles import exact_quantiles

COMPONENTS = (("behavioral_score", BEHAVIORAL_SCORE), ("structural_score", STRUCTURAL_SCORE), ("propagation_score", PROPAGATION_SCORE))


def component_scores(features: DataFrame, components=COMPONENTS) -> DataFrame:
    """account_id and a 0-100 score a component: mean of robust z-scores, scaled by its range.

    Quantiles are selected exactly, a few numbers a column; all ranges come from one row. ``features`` is read
    several times: pass a written table.
    """
    lists = [(name, [c for c in cols if c in features.columns]) for name, cols in components]
    used = [c for _, cols in lists for c in cols]
    q = exact_quantiles(features, used, (0.25, 0.5, 0.75))
    out = []
    for name, cols in lists:
        z = F.lit(0.0)
        for c in cols:
            low, mid, high = q[c]
            z = z + (F.col(c) - F.lit(mid)) / F.lit((high - low) or 1.0) if mid is not None else F.lit(None).cast("double")
        out.append((z / max(1, len(cols))).alias(name))
    rows = features.select("account_id", *out)
    names = [n for n, _ in lists]
    span = rows.agg(*(f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))))
    scaled = lambda n: F.when(F.col(f"hi_{n}") - F.col(f"lo_{n}") > 1e-8, F.round((F.col(n) - F.col(f"lo_{n}")) / F.nullif(F.col(f"hi_{n}") - F.col(f"lo_{n}"), F.lit(0.0)) * 100, 2)).otherwise(0.0)
    return rows.crossJoin(F.broadcast(span)).select("account_id", *(scaled(n).alias(n) for n in names))


def blend(scores: DataFrame, cfg: Scoring = Scoring(), p: str = "propagation_score") -> DataFrame:
    """Adds risk_score, the weighted mean of the components, and its band."""
    w = (cfg.behavioral_weight, cfg.structural_weight, cfg.propagation_weight)
    # the small term settles exact halves of a hundredth upwards on every engine
    s = F.lit(1e-9) + (F.lit(w[0]) * F.col("behavioral_score") + F.lit(w[1]) * F.col("structural_score") + F.lit(w[2]) * F.col(p)) / F.lit(sum(w))
    return scores.withColumn("risk_score", F.round(clip(s, 0.0, 100.0), 2)).withColumn("risk_level", risk_band("risk_score"))


def contributions(scores: DataFrame, cfg: Scoring = Scoring()) -> DataFrame:
    w = {"behavioral": cfg.behavioral_weight, "structural": cfg.structural_weight, "propagation": cfg.propagation_weight}
    total = sum(w.values())
    return scores.select("account_id", *(F.round(F.lit(v) * F.col(f"{k}_score") / F.lit(total), 4).alias(f"{k}_contribution") for k, v in w.items()), *(F.col(f"{k}_score").alias(f"{k}_raw") for k in w))


def static_scores(features: DataFrame, cfg: Scoring = Scoring()) -> DataFrame:
    """account_id, risk_score, three component scores and risk_level."""
    return blend(component_scores(features), cfg).select("account_id", "risk_score", "behavioral_score", "structural_score", "propagation_score", "risk_level")


def signal_scores(features: DataFrame, propagation: DataFrame | None = None, graph: DataFrame | None = None, sequence: DataFrame | None = None, meta=None, calibrator=None, cfg: Scoring = Scoring(), normalize_propagation: bool = False) -> DataFrame:
    """Scores with sig_* columns. A fitted ``meta`` model decides; without one the components are blended,
    with sig_propagation (0 to 1 unless normalised) in the place of the fraud component where it is given."""
    rows = component_scores(features)
    rows = rows.withColumns({"sig_behavioral": F.col("behavioral_score"), "sig_structural": F.col("structural_score")})
    for name, df in (("sig_propagation", propagation), ("sig_graph", graph), ("sig_sequence", sequence)):
        if df is None:
            rows = rows.withColumn(name, F.col("propagation_score") if name == "sig_propagation" else F.lit(0.0))
        else:
            value = next(c for c in df.columns if c != "account_id")
            rows = rows.join(df.select("account_id", F.col(value).cast("double").alias(name)), "account_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    if normalize_propagation and propagation is not None:
        rows = rows.withColumn("sig_propagation", F.col("sig_propagation") * 100)
    if meta is not None and meta.model is not None:
        p = meta.predict(rows)
        p = calibrator.calibrate(p, "probability") if calibrator is not None else p
        return p.withColumn("risk_score", F.round(clip(F.col("probability") * 100, 0.0, 100.0), 2)).withColumn("risk_level", risk_band("risk_score"))
    return blend(rows, cfg, "sig_propagation")


class MetaModel:
    """Boosted trees over the signal columns, class-balanced, with stratified cross-validation."""

    def __init__(self, trees: int = 20, depth: int = 4, step: float = 0.1, seed: int = 42):
        self.trees, self.depth, self.step, self.seed = trees, depth, step, seed
        self.model = None
        self.columns: list[str] = []

    def _x(self, df: DataFrame) -> DataFrame:
        rows = df
        for c in self.columns:  # by name: a missing signal is 0
            rows = rows.withColumn(c, F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in df.columns else F.lit(0.0))
        return VectorAssembler(inputCols=self.columns, outputCol="_x").transform(rows)

    def _fit(self, rows: DataFrame):
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
        w = F.when(F.col("label") == 1, n.n / (2.0 * n.p)).otherwise(n.n / (2.0 * (n.n - n.p)))
        return GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, subsamplingRate=0.8, seed=self.seed).fit(self._x(spread(rows, n.n)).withColumn("_w", w))

    def fit(self, signals: DataFrame, labels: DataFrame, folds: int = 0) -> dict:
        """``labels``: account_id, label. One class: nothing is learnt."""
        rows = signals.join(labels.select("account_id", F.col("label").cast("double").alias("label")), "account_id")
        self.columns = [c for c, t in signals.dtypes if c != "account_id" and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
        count = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(count) < 2:
            return {"skipped": True}
        out = {}
        if folds:
            from .metrics import ranking_metrics

            k = min(folds, max(2, int(count[1.0])))
            fold = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("account_id", F.lit(self.seed)))) % k
            split = stage(rows.withColumn("_fold", fold), "folds")
            ap = []
            for i in range(k):
                self.model = self._fit(split.filter(F.col("_fold") != i))
                ap.append(ranking_metrics(self.predict(split.filter(F.col("_fold") == i)), "probability", "label").first()["pr_auc"])
            out["pr_auc"] = sum(ap) / len(ap)
        self.model = self._fit(rows)
        return out

    def predict(self, signals: DataFrame) -> DataFrame:
        if self.model is None:
            return signals.withColumn("probability", F.lit(0.0))
        got = self.model.transform(self._x(signals))
        return got.withColumn("_p", vector_to_array("probability")[1]).drop("probability", "_x", "rawPrediction", "prediction").withColumnRenamed("_p", "probability")

    def importance(self) -> list[tuple[str, float]]:
        if self.model is None:
            return []
        return sorted(zip(self.columns, self.model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        """The model and, beside it, the order of its columns."""
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        order = spark.createDataFrame(list(enumerate(self.columns)), "place int, signal string")
        order.coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    def load(self, path: str) -> MetaModel:
        from pyspark.ml.classification import GBTClassificationModel

        self.model = GBTClassificationModel.load(f"{path}/model")
        self.columns = [r.signal for r in SparkSession.active().read.parquet(f"{path}/columns").orderBy("place").collect()]
        return self


class Calibrator:
    """Isotonic probabilities, clipped at the ends; unfitted it returns its input."""

    def __init__(self):
        self.model = None

    def fit(self, df: DataFrame, score: str = "score", label: str = "label") -> Calibrator:
        if df.select(label).distinct().count() > 1:
            self.model = IsotonicRegression(featuresCol="_s", labelCol="_l").fit(VectorAssembler(inputCols=["_v"], outputCol="_s").transform(df.select(F.col(score).cast("double").alias("_v"), F.col(label).cast("double").alias("_l"))))
        return self

    def calibrate(self, df: DataFrame, score: str = "score") -> DataFrame:
        if self.model is None:
            return df
        rows = VectorAssembler(inputCols=[score], outputCol="_s").transform(df)
        return self.model.transform(rows).withColumn(score, clip(F.col("prediction"), 0.0, 1.0)).drop("_s", "prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Calibrator:
        from pyspark.ml.regression import IsotonicRegressionModel

        self.model = IsotonicRegressionModel.load(path)
        return self


def to_risk_score(df: DataFrame, probability: str = "probability") -> DataFrame:
    return df.withColumn("risk_score", clip(F.col(probability) * 100, 0.0, 100.0))


def alert_type(b="behavioral_score", s="structural_score", p="propagation_score"):
    """The largest component names the alert; ties go to network, then structural, then behavioral."""
    top = F.greatest(b, s, p)
    return F.when(F.col(p) == top, "network_risk").when(F.col(s) == top, "structural_anomaly").otherwise("behavioral_anomaly")


def alerts(scores: DataFrame, cfg: Scoring = Scoring(), now=None) -> DataFrame:
    """Alerts of scores at or above the threshold, unresolved."""
    s = F.col("risk_score")
    return scores.filter(s >= cfg.alert_threshold).select(
        "account_id", "risk_score", F.when(s >= cfg.high_risk_threshold, "critical").otherwise("high").alias("severity"), alert_type().alias("alert_type"),
        (F.current_timestamp() if now is None else F.lit(now)).alias("created_at"), F.lit(False).alias("resolved"),
    )


def prioritize(alert: DataFrame, limit: int = 100) -> DataFrame:
    return alert.orderBy(F.desc("risk_score"), "account_id").limit(limit)
