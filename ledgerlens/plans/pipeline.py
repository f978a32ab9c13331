"""The two end-to-end flows: simulate a ledger, and evaluate one from tables to scores and alerts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import clip, risk_band
from ..operators import behavioral, embeddings, graph, patterns, propagation, scoring, sequences, simulate, structural, training, validate
from ..operators.iterate import stage, together
from ..sources import io


@dataclass(frozen=True)
class Sizes:
    """How large the models and bounded searches are."""

    cycle_bound: int = 8
    layering_cutoff: int = 7
    embedding_dim: int = 64
    walks: int = 10
    walk_length: int = 40
    graph_trees: int = 20
    meta_trees: int = 20
    sequence_len: int = 200


def run_simulation(spark: SparkSession, settings: Settings = Settings(), save: bool = True) -> dict:
    acc, txns = simulate.simulate(spark, settings.simulation, settings.fraud)
    if save:
        io.save_parquet(acc, f"{settings.data_dir}/accounts.parquet")
        io.save_parquet(txns, f"{settings.data_dir}/transactions.parquet")
        txns, acc = io.load_parquet(spark, settings)
    return {"accounts": acc, "transactions": txns, "checks": validate.validate_all(txns, acc)}


def feature_table(edge: DataFrame, vertex: DataFrame, txns: DataFrame, accounts: DataFrame, sizes: Sizes = Sizes(), extra: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The 35 features of every vertex, and optional embedding or propagation columns; nulls and NaN become 0."""
    structure, fraud = together(
        edge.sparkSession, lambda: structural.structural_features(edge, vertex), lambda: patterns.fraud_features(edge, vertex, accounts, sizes.cycle_bound, sizes.layering_cutoff)
    )
    parts = [structure, behavioral.behavioral_features(txns), fraud, *extra]
    rows = reduce(lambda a, b: a.join(b, "account_id", "left"), parts).na.fill(0)
    return rows.select(*(F.nanvl(c, F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def evaluate(accounts: DataFrame, txns: DataFrame, sizes: Sizes = Sizes(), settings: Settings = Settings(), meta: bool = True) -> dict:
    """features, scores and alerts of all accounts, and the meta_model (None without one).

    The meta-model is trained and scored on the same component lists, and calibrated on predictions
    for accounts that its folds did not train on.
    """
    edge = stage(graph.edges(txns), "edges")
    vertex = stage(graph.vertices(accounts, edge), "vertices")
    p = settings.propagation
    features, risk, emb = together(
        edge.sparkSession, lambda: stage(feature_table(edge, vertex, txns, accounts, sizes), "features"),
        lambda: stage(propagation.propagate(edge, vertex, None, p.decay, p.max_hops, p.iterations, p.tolerance), "risk"),
        lambda: stage(embeddings.graph_embedding(edge, vertex, sizes.embedding_dim, sizes.walks, sizes.walk_length), "embedding"),
    )
    labels = stage(vertex.select("account_id", F.col("is_fraud").cast("int").alias("label")), "labels")
    classifier = training.GraphClassifier(trees=sizes.graph_trees)
    classifier.train(emb, labels)
    graph_signal = classifier.predict(emb)
    stats = stage(sequences.sequence_stats(sequences.sequence_rows(txns, sizes.sequence_len), sizes.sequence_len), "stats")
    anomaly = sequences.SequenceEncoder(settings.sequence.dim).fit(stats).anomaly(stats)
    signals = stage(scoring.signal_scores(features, risk, graph_signal, anomaly, cfg=settings.scoring), "signals")
    meta_model = None
    if not (meta and settings.scoring.use_meta_model):
        scores = signals
    else:
        x = signals.select("account_id", *(c for c in signals.columns if c.startswith("sig_")))
        half = F.pmod(F.xxhash64("account_id"), F.lit(2))
        calibrator = scoring.Calibrator()
        if settings.scoring.use_calibration:
            held = []
            for k in (0, 1):
                m = scoring.MetaModel(sizes.meta_trees)
                m.fit(x.filter(half != k), labels)
                held.append(m.predict(x.filter(half == k)))
            calibrator.fit(stage(held[0].unionByName(held[1]).join(labels, "account_id"), "folds"), "probability")
        meta_model = scoring.MetaModel(sizes.meta_trees)
        meta_model.fit(x, labels)
        p_ = calibrator.calibrate(meta_model.predict(x), "probability").select("account_id", "probability")
        base = signals.drop("risk_score", "risk_level").join(p_, "account_id")
        scores = base.withColumn("risk_score", F.round(clip(F.col("probability") * 100, 0.0, 100.0), 2)).withColumn("risk_level", risk_band("risk_score"))
    scores = stage(scores, "scores")
    return {"features": features, "scores": scores, "alerts": scoring.prioritize(scoring.alerts(scores, settings.scoring)), "meta_model": meta_model}


def save_results(results: dict, settings: Settings = Settings()) -> None:
    """Features and scores as tables, and the meta-model where one was learnt."""
    io.save_parquet(results["features"], f"{settings.output_dir}/features.parquet")
    io.save_parquet(results["scores"], f"{settings.output_dir}/risk_scores.parquet")
    if (model := results.get("meta_model")) is not None and model.model is not None:
        model.save(f"{settings.models_dir}/meta_model")


def main(args: list[str] | None = None) -> None:
    """simulate | evaluate, as in ``python -m ledgerlens.plans.pipeline simulate``; settings come from the environment."""
    import sys

    args = sys.argv[1:] if args is None else args
    spark = SparkSession.builder.appName("ledgerlens").getOrCreate()
    settings = Settings.load()
    settings.ensure_dirs()
    if args[:1] == ["simulate"]:
        print(run_simulation(spark, settings)["checks"])
    elif args[:1] == ["evaluate"]:
        txns, acc = io.load_parquet(spark, settings, warn=print)
        e = settings.embedding
        sizes = Sizes(embedding_dim=e.dim, walks=e.num_walks, walk_length=e.walk_length, sequence_len=settings.sequence.max_len)
        results = evaluate(acc, txns, sizes, settings, meta="--skip-meta-model" not in args)
        save_results(results, settings)
        results["scores"].groupBy("risk_level").count().orderBy("risk_level").show()
        print("alerts:", results["alerts"].count())
    else:
        sys.exit(main.__doc__)


if __name__ == "__main__":
    main()
