"""Joins of op 5 that are the same at every size."""

from ledgerlens.llm.substring_dedup import remove_repeats


def test_a_small_table_is_not_broadcast(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, "a " + words), (3, "b c")], "doc_id long, text string")
    out = remove_repeats(docs)
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 60, 3: 0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
