import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.compression import LanguageModel, labelled_sample, spans
from ledgerlens.llm.rules import fit_quality


def sample(spark, rows, per_class=100, max_bytes=400_000):
    """rows: label and text, in one partition in this order; the sample, and the texts by label in the order of the ids' hashes."""
    full = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(rows)], "doc_id long, label string, text string").coalesce(1)
    ranked: dict = {}
    for r in full.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        ranked.setdefault(r.label, []).append(r.text)
    return labelled_sample(full.select("doc_id", "text"), full.select("doc_id", "label"), per_class, max_bytes=max_bytes), ranked


def test_each_class_has_its_own_bytes(spark):
    got, ranked = sample(spark, [(c, f"{c}{i:02}" + "x" * 19_997) for c in "ab" for i in range(30)])
    assert got == {c: ranked[c][:10] for c in "ab"}


def test_an_oversized_text_is_skipped(spark):
    got, ranked = sample(spark, [("a", "y" * 500_000), *((c, f"{c}{i} text") for c in "ab" for i in range(20))])
    assert got == {c: [t for t in ranked[c] if len(t) < 500_000] for c in "ab"}
    assert len(got["a"]) == len(got["b"]) == 20


def test_a_class_of_oversized_texts_is_not_lost(spark):
    got, _ = sample(spark, [("a", "y" * 500_000), ("a", "y" * 500_000), ("b", "short")])
    assert got == {"a": ["y" * 50_000], "b": ["short"]}


def test_a_frequent_label_is_sampled_in_hash_order(spark):
    """The bar on hashes lets the same texts through as ordering all of them does."""
    got, ranked = sample(spark, [("a" if i % 9 else "b", f"text {i}") for i in range(6000)], per_class=20)
    assert got == {c: ranked[c][:20] for c in "ab"}


@pytest.mark.parametrize("n", [300])
def test_every_label_is_learned(spark, n):
    got, _ = sample(spark, [(f"l{i}", f"text {i}") for i in range(n)])
    assert got == {f"l{i}": [f"text {i}"] for i in range(n)}


def test_language_is_learned_from_whole_texts():
    """Documents of both languages open with one header of 400 bytes."""
    rng = random.Random(1)
    words = {k: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(300)] for k, letters in (("a", "bcdfgaeiou"), ("b", "lmnprtaeiu"))}
    header = " ".join(f"notice{i:03}" for i in range(40))
    body = lambda k: " ".join(rng.choice(words[k]) for _ in range(1000))
    m = LanguageModel().fit({k: [f"{header} {body(k)}" for _ in range(400)] for k in "ab"})
    want = [k for k in "ab" for _ in range(20)]
    best, _, margin = m.predict(pa.array([f"{header} {body(k)}" for k in want]))
    assert [m.langs[i] for i in best] == want
    assert margin.min() >= m.min_margin


def test_spans():
    texts = [b"short", b"", b"x" * 1000, "\u00e9".encode() * 1000]
    got = spans(texts, 600)
    assert 590 <= len(got) <= 600 and got.startswith(b"short\n")
    assert got.decode().count("x") > 200 and got.decode().count("\u00e9") > 100
    assert spans([b"ab", b"cd"], 600) == b"ab\ncd" and spans([], 600) == b""
    assert len(spans([b"y" * 500] * 50, 600)) <= 600


def test_pipeline_drops_what_the_classifier_calls_toxic(spark, sf_dir, monkeypatch):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "a", 0.69), (2, "b", 0.7), (3, "c", 0.79), (4, "d", 0.8)], "doc_id long, text string, given double")
    monkeypatch.setattr(P, "fit_toxicity", lambda *a: None)
    monkeypatch.setattr(P, "score_toxicity", lambda d, m, out: d.withColumn(out, F.col("given")))
    assert [r.doc_id for r in P.toxicity(spark, docs, sf_dir).collect()] == [1]


def test_labels_without_documents_take_no_place(spark):
    """100 times as many labels of other ids change neither a sample nor a fit."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, ("spam " if i % 2 else "fine words here ") * rng.randint(5, 30)) for i in range(200)], "doc_id long, text string")
    own = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    far = spark.range(10_000, 30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 % 2).cast("int").alias("label"))
    few = labelled_sample(docs, own, 50)
    assert {c: len(t) for c, t in few.items()} == {0: 50, 1: 50}
    assert labelled_sample(docs, own.unionByName(far), 50) == few
    fits = [fit_quality(docs, x.withColumnRenamed("label", "quality"), sample=150) for x in (own, own.unionByName(far))]
    assert fits[0].rules == fits[1].rules and list(fits[0].weights) == list(fits[1].weights) and len(fits[0].rules) > 0
