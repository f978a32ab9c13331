"""The registered queries of this subpackage: thin digests over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import sql
from .asof import click_orders
from .common import fold
from .compression import TOXIC, fit_language, fit_toxicity, identify_language, score_toxicity
from .decontaminate import decontaminate
from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .lm import score_texts
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .rules import fit_quality, score_quality
from .secrets import find_secrets, listed
from .substring_dedup import remove_repeats
from .token_files import read_shards, write_shards


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(_read(spark, sf_dir, "documents"))
    return out.withColumn("held_out", fold(F.col("doc_id"), 7) == 2)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _read(spark, sf_dir, "labels"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"), keep="max")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs)
    out = identify_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "reliable")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, _read(spark, sf_dir, "labels"))
    out = score_quality(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(_read(spark, sf_dir, "documents"), tokenizer_path()))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.sha2(listed(of("assign", "access", "hex")).cast("binary"), 256)
    return out.select("doc_id", *counts, base.alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_tolerant_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_orders(_read(spark, sf_dir, "clicks"), _read(spark, sf_dir, "sales"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_read(spark, sf_dir, "documents"))


QUERIES = (
    op1_decontamination, op2_lm_scoring, op3_mixing, op4_toxicity, op5_substring_dedup, op6_exact_dedup, op7_language,
    op8_quality, op9_ngram_join, op10_token_files, op11_secrets, op12_tolerant_asof, op13_source_divergence,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": sql.DECONTAMINATION,
        "op3_mixing": sql.MIXING,
        "op5_substring_dedup": sql.SUBSTRING_DEDUP,
        "op6_exact_dedup": sql.EXACT_DEDUP,
        "op9_ngram_join": sql.NGRAM_JOIN,
        "op12_tolerant_asof": sql.TOLERANT_ASOF,
        "op13_source_divergence": sql.SOURCE_DIVERGENCE,
    }
