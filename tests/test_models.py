"""Trained models on the tables they stage: supervised training, and the meta-model over folds."""

from pyspark.sql import functions as F

from ledgerlens.operators import scoring
from ledgerlens.plans import catalog

QUERIES = catalog.queries()


def test_supervised_training_runs_to_a_prediction_for_every_account(spark, sf_dir):
    rows = QUERIES["t2_supervised"](spark, sf_dir).collect()
    assert rows


def test_meta_model_learns_a_signal_over_folds(spark):
    """The label is the first signal; folds score it, and all probabilities are between 0 and 1."""
    s = spark.range(200).select(F.col("id").cast("string").alias("account_id"), (F.col("id") % 4 / 4.0).alias("sig_x"), (F.col("id") % 7 / 7.0).alias("sig_y"))
    y = spark.range(200).select(F.col("id").cast("string").alias("account_id"), (F.col("id") % 4 == 3).cast("int").alias("label"))
    m = scoring.MetaModel(3)
    assert m.fit(s, y, folds=3)["pr_auc"] == 1.0
    p = {r.account_id: r.probability for r in m.predict(s).collect()}
    assert len(p) == 200 and all(0 <= x <= 1 for x in p.values())
    assert min(p[str(i)] for i in range(200) if i % 4 == 3) > max(p[str(i)] for i in range(200) if i % 4 != 3)
