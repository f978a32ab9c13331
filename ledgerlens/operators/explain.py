"""Explanations, serving queries and the data behind the charts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import risk_colour, zero
from .metrics import numeric_columns

NOT_FEATURES = ("account_id", "is_fraud", "fraud_role", "community_id", "is_fraud_label")


def ground_truth(accounts: DataFrame, txns: DataFrame) -> DataFrame:
    """Fraud accounts with number, sum and first pattern of the fraud transactions they sent."""
    sent = txns.filter("is_fraud").groupBy(F.col("sender_id").alias("account_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(28,2)")).cast("double").alias("total"), F.min_by("fraud_pattern", F.struct("timestamp", "transaction_id")).alias("pattern")
    )
    return accounts.filter("is_fraud").join(sent, "account_id", "left").select("account_id", "fraud_role", zero("n").alias("fraud_txn_count"), F.coalesce("total", F.lit(0.0)).alias("total_fraud_amount"), F.coalesce("pattern", F.lit("unknown")).alias("primary_pattern"))


def top_features(features: DataFrame, k: int = 10) -> DataFrame:
    """account_id, rank, feature, value: the k features of largest absolute value, ties by name."""
    cols = [c for c in numeric_columns(features) if c not in NOT_FEATURES]
    rows = features.select("account_id", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols))).alias("e")).select("account_id", "e.*")
    w = Window.partitionBy("account_id").orderBy(F.desc(F.abs("value")), "feature")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def decompose(account_id, features: DataFrame, scores: DataFrame, k: int = 10) -> dict:
    row = scores.filter(F.col("account_id") == account_id).first()
    if row is None:
        return {"error": f"account {account_id} not found"}
    top = top_features(features.filter(F.col("account_id") == account_id), k).orderBy("rank").collect()
    return row.asDict() | {"top_features": [{"feature": r.feature, "value": r.value} for r in top]}


def batch_decompose(features: DataFrame, scores: DataFrame, top_n: int = 50, k: int = 10) -> DataFrame:
    """Top features of the ``top_n`` accounts of highest score, in one pass."""
    top = scores.orderBy(F.desc("risk_score"), "account_id").limit(top_n)
    return top_features(features.join(F.broadcast(top.select("account_id")), "account_id", "left_semi"), k).join(F.broadcast(top.select("account_id", "risk_score")), "account_id")


def path_attribution(model, columns: list[str], values: list[float]) -> dict[str, float]:
    """Contribution of each feature to a tree ensemble's raw score on one row: along each tree's path the
    change of the node's mean prediction goes to the feature that was split on."""
    out = dict.fromkeys(columns, 0.0)

    def mean(node):
        """Mean prediction below a node and the number of rows it was learnt from."""
        if node.subtreeDepth() == 0:
            return node.prediction(), max(1, node.impurityStats().count())
        (a, m), (b, n) = mean(node.leftChild()), mean(node.rightChild())
        return (a * m + b * n) / (m + n), m + n

    for tree, w in zip(model.trees, model.treeWeights, strict=True):
        node = tree._call_java("rootNode")
        while node.subtreeDepth() > 0:
            split = node.split()
            j = split.featureIndex()
            nxt = node.leftChild() if values[j] <= split.threshold() else node.rightChild()
            out[columns[j]] += w * (mean(nxt)[0] - mean(node)[0])
            node = nxt
    return out


def account_activity(txns: DataFrame) -> DataFrame:
    """account_id with counts of transactions sent, received and fraudulent."""
    side = F.explode(F.array(F.struct(F.col("sender_id").alias("account_id"), F.lit(1).alias("s")), F.struct(F.col("receiver_id").alias("account_id"), F.lit(0).alias("s"))))
    bad = F.col("is_fraud").cast("int") if "is_fraud" in txns.columns else F.lit(0)
    return txns.select(side.alias("e"), bad.alias("bad")).select("e.*", "bad").groupBy("account_id").agg(F.sum("s").alias("sent"), F.sum(1 - F.col("s")).alias("received"), F.sum("bad").alias("fraud"))


def account_report(account_id, decomposition: dict, txns: DataFrame, output_dir: str, last: int = 20) -> Path:
    """A Markdown report of one account."""
    mine = txns.filter((F.col("sender_id") == account_id) | (F.col("receiver_id") == account_id))
    n = account_activity(mine).filter(F.col("account_id") == account_id).first()
    rows = mine.orderBy(F.desc("timestamp"), F.desc("transaction_id")).limit(last).collect()
    lines = [f"# Account {account_id}", "", "## Scores", *(f"- {k}: {v}" for k, v in decomposition.items() if k != "top_features"), "", "## Leading features", *(f"- {t['feature']}: {t['value']}" for t in decomposition.get("top_features", []))]
    lines += ["", "## Activity", *(f"- {k}: {n[k] if n else 0}" for k in ("sent", "received", "fraud")), "", "## Latest transactions", *(f"- {r.timestamp} {r.sender_id} -> {r.receiver_id} {r.amount}" for r in rows)]
    path = Path(output_dir) / f"account_{account_id}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return path


# ---- serving


def score_of(scores: DataFrame, account_id) -> DataFrame:
    return scores.filter(F.col("account_id") == account_id)


def scores_of(scores: DataFrame, ids: list) -> DataFrame:
    if not 1 <= len(ids) <= 1000:
        raise ValueError("1 to 1000 ids")
    return scores.filter(F.col("account_id").isin(ids))


def top_scores(scores: DataFrame, limit: int = 50, min_score: float = 0.0) -> DataFrame:
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    return scores.filter(F.col("risk_score") >= min_score).orderBy(F.desc("risk_score"), "account_id").limit(limit)


def list_alerts(scores: DataFrame, limit: int = 50, min_score: float = 75.0) -> DataFrame:
    top = top_scores(scores, limit, min_score)
    return top.select(F.row_number().over(Window.orderBy(F.desc("risk_score"), "account_id")).alias("alert_id"), "account_id", "risk_score", F.when(F.col("risk_score") >= 90, "critical").otherwise("high").alias("severity"))


def alert_stats(scores: DataFrame) -> DataFrame:
    s = F.col("risk_score")
    return scores.agg(F.count_if(s >= 90).alias("critical"), F.count_if((s >= 75) & (s < 90)).alias("high"), F.count_if((s >= 50) & (s < 75)).alias("medium"), F.round(F.avg(s), 4).alias("mean_score"))


# ---- chart data


def risk_histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    b = F.least(F.floor(F.col("risk_score") / (100.0 / bins)), F.lit(bins - 1)).cast("long")
    return scores.groupBy("risk_level", b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("colour", risk_colour("risk_level"))


def component_stack(scores: DataFrame, n: int = 30) -> DataFrame:
    return scores.orderBy(F.desc("risk_score"), "account_id").limit(n).select("account_id", "behavioral_score", "structural_score", "propagation_score")


def pca_scatter(features: DataFrame, columns: int = 20) -> DataFrame:
    """account_id and the first two principal components of the first ``columns`` standardised features."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cols = [c for c in numeric_columns(features) if c not in NOT_FEATURES][:columns]
    rows = VectorAssembler(inputCols=cols, outputCol="x").transform(features.na.fill(0))
    rows = StandardScaler(inputCol="x", outputCol="s", withMean=True).fit(rows).transform(rows)
    out = PCA(k=2, inputCol="s", outputCol="z").fit(rows).transform(rows).select("account_id", vector_to_array("z").alias("z"))
    return out.select("account_id", F.col("z")[0].alias("pc1"), F.col("z")[1].alias("pc2"))


def fraud_network(edge: DataFrame, vertex: DataFrame, per_side: int = 5, cap: int = 500) -> DataFrame:
    """Vertices of the fraud network: fraud accounts and the first successors and predecessors of each, at most ``cap``."""
    bad = vertex.filter("is_fraud").select("account_id")
    out = edge.join(bad.withColumnRenamed("account_id", "src"), "src", "left_semi").select(F.col("src").alias("f"), F.col("dst").alias("o"), F.lit(0).alias("side"))
    into = edge.join(bad.withColumnRenamed("account_id", "dst"), "dst", "left_semi").select(F.col("dst").alias("f"), F.col("src").alias("o"), F.lit(1).alias("side"))
    near = out.unionByName(into).withColumn("r", F.row_number().over(Window.partitionBy("f", "side").orderBy("o"))).filter(F.col("r") <= per_side)
    ids = bad.select("account_id", F.lit(0).alias("p")).unionByName(near.select(F.col("o").alias("account_id"), F.lit(1).alias("p")))
    return ids.groupBy("account_id").agg(F.min("p").alias("p")).orderBy("p", "account_id").limit(cap).select("account_id", (F.col("p") == 0).alias("is_fraud"))


def timeline(txns: DataFrame) -> DataFrame:
    """account_id, day, n: daily transactions from first to last active day, days without any as 0."""
    day = txns.select(F.explode(F.array("sender_id", "receiver_id")).alias("account_id"), F.to_date("timestamp").alias("day")).groupBy("account_id", "day").agg(F.count(F.lit(1)).alias("n"))
    # an active day carries the days up to the next one: what is shuffled are active days only
    until = F.date_sub(F.lead("day").over(Window.partitionBy("account_id").orderBy("day")), 1)
    run = day.select("account_id", F.col("day").alias("active"), "n", F.coalesce(until, "day").alias("until"))
    days = run.select("account_id", "active", "n", F.explode(F.sequence("active", "until")).alias("day"))
    return days.select("account_id", "day", F.when((F.col("day") == F.col("active")) & F.col("account_id").isNotNull(), F.col("n")).otherwise(0).alias("n"))
