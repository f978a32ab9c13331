"""The corpus pipeline: five stages from raw documents to token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of documents.
"""

from __future__ import annotations

import functools
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, fresh, recording, shared_dir
from ledgerlens.llm.compression import TOXIC, fit_toxicity, score_toxicity
from ledgerlens.llm.decontaminate import decontaminate
from ledgerlens.llm.mixing import mix_sources
from ledgerlens.llm.ngram_join import jaccard_components
from ledgerlens.llm.queries import tokenizer_path
from ledgerlens.llm.token_files import read_shards, write_shards

#: Stage tables of the latest stage over each data folder. Its output is written before the next
#: stage of that pipeline starts, which deletes them; pipelines over other folders keep theirs.
_held: dict[tuple[str, str], list[str]] = {}


def _tidy(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run = (threading.current_thread().name, sf_dir)
        discard(spark, _held.pop(run, []))
        with recording() as paths:
            out = stage(spark, docs, sf_dir)
        _held[run] = paths
        return out

    return run_stage


def _maps(docs: DataFrame) -> list[str]:
    return [name for name, kind in docs.dtypes if kind.startswith("map<")]


@_tidy
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression classifier rejects.

    Defined cases: null and empty texts have the score of no windows; rows without id or label are
    scored like any others and not learned from; repeated rows are judged alike; further columns,
    also one named score, pass unchanged; an empty table stays empty; without labels of both
    classes nothing is dropped unless all labels are toxic.
    """
    model = fit_toxicity(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "_toxicity")
    return score_toxicity(docs, model, score).filter(F.col(score) < TOXIC).select(docs.columns)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of texts that share 0.8 or more of their five-word shingles the document of the smallest id.

    Defined cases: rows of one id are one document: all that differ in any column stay, equal rows once;
    rows without an id cannot be told apart and stay; null and empty texts link with nothing and
    stay; further columns of any name pass unchanged; an empty table stays empty.
    """
    keep = jaccard_components(docs, shingle=5, num=4, den=5).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi")
    # maps cannot be compared, their entries can
    maps = {n: F.map_entries(c) for n, c in zip(fresh(docs, *(f"_map_{c}" for c in _maps(docs))), _maps(docs), strict=True)}
    kept = kept.withColumns(maps).dropDuplicates([c for c in docs.columns if c not in _maps(docs)] + list(maps))
    return kept.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


@_tidy
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item.

    Defined cases: null and empty texts have no windows and stay, as do rows without an id; repeated
    rows are judged alike; further columns, also ones named n_words, spans or items, pass unchanged;
    an empty benchmark drops nothing; an empty table stays empty.
    """
    n_words, spans, items = names = fresh(docs, "_n_words", "_spans", "_items")
    hits = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=names)
    return hits.filter(F.size(items) == 0).select(docs.columns)


@_tidy
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as its source's target asks, at most three times, and leaves out those not drawn.

    Defined cases: a document without words has nothing to mix and stays once, and so does a row
    without an id; rows of one id are drawn as often as the most drawn of them; a null source is a
    source; further columns of any name pass unchanged; an empty table stays empty.
    """
    drawn = mix_sources(docs).filter("doc_id IS NOT NULL")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("taken") / F.col("size")).cast("int")
    drawn = drawn.groupBy("doc_id").agg(F.max(copies).alias("n"))
    n, copy = fresh(docs, "_copies", "_copy")
    mixed = docs.join(drawn.filter("n > 0").withColumnRenamed("n", n), "doc_id")
    mixed = mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(docs.columns)
    return mixed.unionByName(docs.filter("doc_id IS NULL"))


@_tidy
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns their index, read back: doc_id, start, n_tokens, ids_crc32.

    Defined cases: null texts are empty and have the end id alone; rows without an id come first, and
    repeated rows are written each time; further columns are ignored; an empty table gives no rows.
    """
    return read_shards(write_shards(docs, tokenizer_path()))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", source_mix),
    ("token_output", token_output),
]

#: The classifier and the tokenizer have no SQL form; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each output is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
