"""Training rows are dealt out by their key, whatever lay where."""

from pyspark.sql import functions as F

from ledgerlens.operators import iterate, scoring


def test_training_rows_are_never_left_to_one_task(spark):
    rows = spark.range(1000).select(F.col("id").alias("account_id")).coalesce(1)
    assert iterate.spread(rows, 1000).rdd.getNumPartitions() == iterate.SPREAD
    assert iterate.spread(rows, 40 * iterate.SPREAD_ROWS).rdd.getNumPartitions() == 40


def test_the_meta_model_does_not_depend_on_where_rows_lay(spark):
    """Rows are drawn by part for each tree, so parts must follow from the rows alone."""
    s = spark.range(400).select(F.col("id").alias("account_id"), (F.xxhash64("id") % 100 / 100.0).alias("sig_x"), (F.xxhash64("id", F.lit(1)) % 100 / 100.0).alias("sig_y"))
    y = s.select("account_id", (F.col("sig_x") + 0.3 * F.col("sig_y") > 0.2).cast("int").alias("label"))
    got = []
    for rows in (s.coalesce(1), s.repartition(5, "sig_x")):
        m = scoring.MetaModel(2)
        m.fit(rows, y)
        got.append({r.account_id: round(r.probability, 9) for r in m.predict(s).collect()})
    assert got[0] == got[1]
