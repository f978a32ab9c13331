"""Every stage of the pipeline on awkward rows, an empty table and columns of clashing names."""

import pytest
from pyspark.sql import functions as F
from test_llm import AWKWARD, frame

from ledgerlens.llm.common import table

PLAIN = [c.split()[0] for c in "doc_id long, text string, lang string, source string, n_chars long".split(", ")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    labels = [(i, 1, i % 2) for i in range(4, 9)] + [(None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, None), (2, ""), (3, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (3, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stages():
    import corpus_pipeline as P

    return P.STAGES


@pytest.mark.parametrize("k", range(4))
def test_awkward_rows_and_clashing_columns(spark, folder, k):
    """All columns come back as they were: score, n_words, spans and items too, in name, type and value."""
    name, stage = stages()[k]
    docs = frame(spark, AWKWARD).withColumns({"n_words": F.lit("seven"), "_toxicity": F.lit(1), "_copies": F.lit("c"), "_copy": F.lit("d"), "n": F.lit(2)})
    out = stage(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    assert all((r.score, r.n_words, r.spans, r["items"], r["_copies"], r.n) == (0.5, "seven", "x", "y", "c", 2) for r in got)
    every = {(r.doc_id, r.text) for r in docs.collect()}
    kept = {(r.doc_id, r.text) for r in got}
    assert kept <= every
    gone = {i for i, _ in every - kept}
    if name == "ngram_jaccard_join":
        assert gone == {6, 8} and len(got) == len(AWKWARD) - 3  # copies of 5 and 7, and the second row of 4
    elif name == "benchmark_decontamination":
        assert gone == {7, 8}
    assert {(1, None), (2, ""), (3, " \t\n"), (None, None), (None, "one")} <= kept


def test_one_id_with_two_texts(spark, folder):
    """Neither of two unrelated texts of one id is lost."""
    rows = [(1, "a b c d e f g h"), (1, "something else entirely in this other row"), (2, "a b c d e f g h"), (1, "a b c d e f g h")]
    got = stages()[1][1](spark, frame(spark, rows), folder).collect()
    assert sorted(r.text for r in got) == sorted({t for i, t in rows if i == 1})


def test_rows_of_one_id_that_differ_elsewhere(spark, folder):
    """Rows of one id and text that differ in another column are no copies; equal rows are, maps and all."""
    rows = [(1, "a b c d e f g h", s, {"k": m}) for s, m in (("x", 1), ("y", 1), ("y", 2), (None, 1), ("x", 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>")
    got = stages()[1][1](spark, docs, folder)
    assert got.dtypes == docs.dtypes
    assert sorted((r.source or "", r.more["k"]) for r in got.collect()) == [("", 1), ("x", 1), ("y", 1), ("y", 2)]


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, folder, k):
    assert stages()[k][1](spark, frame(spark, []), folder).count() == 0


def test_token_output_of_awkward_rows(spark, folder):
    got = stages()[4][1](spark, frame(spark, AWKWARD), folder).collect()
    assert len(got) == len(AWKWARD) and all(r.n_tokens >= 1 for r in got)


def test_pipelines_keep_their_own_tables(spark, folder, tmp_path):
    """A stage over another folder does not delete the tables that an unread result needs."""
    one = stages()[1][1](spark, frame(spark, AWKWARD), folder)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    two = stages()[1][1](spark, frame(spark, AWKWARD), str(tmp_path))
    stages()[2][1](spark, table(two, "test-two"), str(tmp_path))
    assert one.count() == len(AWKWARD) - 3
