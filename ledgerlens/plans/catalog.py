"""The registry of queries over the driver's tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behavioral as beh
from ..operators import embeddings as emb
from ..operators import community, explain, graph, iterate, metrics, patterns, propagation, scoring, sequences, shapley, simulate, structural, training, validate
from ..sources import io
from ..streaming import ingest
from . import pipeline, twins
from .views import accounts, ev, ledger, p2p, read

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: The flow's production sizes, which the single queries use too.
BOUNDS = pipeline.Sizes()


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, so that both engines' sums agree."""
    return df.select(*(F.round(F.col(c).cast("double"), 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def edge_table(spark, d):
    return graph.edges(p2p(spark, d))


def vertex_table(spark, d):
    return graph.vertices(accounts(spark, d), edge_table(spark, d))


def relational_features(spark: SparkSession, d: str) -> DataFrame:
    """The features that need no iteration, one row a vertex."""
    # edges, vertices and degrees feed several features: they are written once
    e, acc = iterate.stage(edge_table(spark, d), "edges"), accounts(spark, d)
    v = iterate.stage(graph.vertices(acc, e), "vertices")
    deg = iterate.stage(structural.degrees(e, v), "degrees")
    parts = [deg, beh.behavioral_features(p2p(spark, d)), patterns.funnel(deg), patterns.neighbour_risk(e, v), patterns.device_cluster(acc)]
    return reduce(lambda a, b: a.join(b, "account_id", "left"), parts).na.fill(0)


def score_table(spark: SparkSession, d: str) -> DataFrame:
    # quantiles, ranges and rows each read the features, so they are computed once
    return scoring.static_scores(iterate.stage(r6(relational_features(spark, d)), "features"))


#: Tables of single reads by application and data folder: written by the first query that reads one.
_BUCKETS: dict[tuple[str, str], str] = {}


def score_buckets(spark: SparkSession, d: str) -> str:
    """Path of the scores, dealt out for single reads."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUCKETS:
        path = f"{iterate.shared_dir(spark)}/scores-{uuid.uuid4().hex}"
        io.save_buckets(score_table(spark, d), path)
        _BUCKETS[key] = path
    return _BUCKETS[key]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return score_table(spark, d)


# ---- sources and validation


@query
def s1_parquet_scan(spark, d):
    return read(spark, d, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey", "o_totalprice")


@query
def s3_clean_batch(spark, d):
    return io.clean_batch(ledger(spark, d)).select("transaction_id", "amount", "timestamp")


@query
def s6_point_read(spark, d):
    return io.point_read(spark, score_buckets(spark, d), 7)


@query
def s8_upsert_scores(spark, d):
    s = score_table(spark, d).select("account_id", "risk_score")
    return io.merge_scores(s, s.filter("account_id % 3 = 0").withColumn("risk_score", F.lit(0.0)))


@query
def s10_high_risk(spark, d):
    return io.high_risk(score_table(spark, d), 30.0, 100).select("account_id", "risk_score")


@query
def s11_find_alerts(spark, d):
    a = scoring.alerts(score_table(spark, d), scoring.Scoring(alert_threshold=30.0, high_risk_threshold=50.0), "2025-01-01")
    return io.find_alerts(a, False, 50).select("account_id", "severity", "resolved")


@query
def s12_cache_entries(spark, d):
    return io.cache_entries(score_table(spark, d), "risk_score", 3600)


@query
def s15_graph_upload(spark, d):
    path = f"{iterate.shared_dir(spark)}/graph-{spark.sparkContext.applicationId}"
    io.save_graph(vertex_table(spark, d), edge_table(spark, d), path)
    return io.load_graph(spark, path)[1]


@query
def s16_k_hop(spark, d):
    return iterate.ego_network(edge_table(spark, d), 7, 3)[0].select(F.col("id").alias("account_id"), F.col("dist").cast("long").alias("dist"))


@query
def v1_transaction_checks(spark, d):
    return validate.transaction_checks(p2p(spark, d))


@query
def v2_account_checks(spark, d):
    return validate.account_checks(accounts(spark, d))


@query
def v4_lognormality(spark, d):
    return r6(validate.amount_lognormality(p2p(spark, d)).withColumn("k2", F.round("k2", 3)))


@query
def v5_degree_summary(spark, d):
    return r6(validate.degree_summary(p2p(spark, d)))


@query
def v5_power_law(spark, d):
    alpha, least, ok = validate.degree_power_law(p2p(spark, d))
    return r6(spark.createDataFrame([(float(alpha), int(least), bool(ok))], "alpha double, xmin long, passed boolean"))


@query
def v6_temporal_coverage(spark, d):
    return r6(validate.temporal_coverage(p2p(spark, d)))


@query
def v7_fraud_ratio(spark, d):
    return validate.fraud_ratio(accounts(spark, d))


@query
def v8_account_coverage(spark, d):
    return validate.account_coverage(p2p(spark, d), accounts(spark, d))


@query
def v9_validate_all(spark, d):
    out = validate.validate_all(p2p(spark, d), accounts(spark, d))
    return spark.createDataFrame([(k, bool(v["passed"])) for k, v in out.items() if k != "passed"], "check string, passed boolean")


@query
def s2_csv_scan(spark, d):
    base = f"{iterate.shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    t = p2p(spark, d).select("transaction_id", "sender_id", "receiver_id", "amount", "timestamp", "transaction_type")
    t.write.option("header", True).csv(f"{base}/t")
    accounts(spark, d).select("account_id", "creation_date", "account_type", "kyc_level", "geographic_region").write.option("header", True).csv(f"{base}/a")
    return io.load_csv(spark, f"{base}/t", f"{base}/a")[0].select(F.col("transaction_id").cast("long").alias("transaction_id"), "amount", "transaction_type")


@query
def s13_feature_entries(spark, d):
    return io.cache_entries(r6(beh.behavioral_features(p2p(spark, d))), "features", 1800)


# ---- graph and behaviour


@query
def g1_edges(spark, d):
    return r6(edge_table(spark, d))


@query
def g1_vertices(spark, d):
    return vertex_table(spark, d)


@query
def g2_merge_edges(spark, d):
    t = p2p(spark, d)
    return r6(graph.merge_edges(graph.edges(t.filter("transaction_id % 3 = 0")), graph.edges(t.filter("transaction_id % 3 <> 0"))).select("src", "dst", "weight", "frequency", "min_amount", "max_amount", "first_txn", "last_txn", "avg_amount", "avg_inter_txn_gap"))


@query
def g3_rolling_windows(spark, d):
    return r6(graph.rolling_windows(p2p(spark, d)).select("window_key", "src", "dst", "weight", "frequency"))


@query
def g4_primary_graph(spark, d):
    return r6(graph.primary_graph(graph.rolling_windows(p2p(spark, d))).select("src", "dst", "weight", "frequency"))


@query
def b1_incoming(spark, d):
    return r6(beh.incoming(p2p(spark, d)))


@query
def b2_outgoing(spark, d):
    return r6(beh.outgoing(p2p(spark, d)))


@query
def b3_receive_to_send_delay(spark, d):
    return r6(beh.receive_to_send_delay(p2p(spark, d)))


@query
def b4_b5_activity_gaps(spark, d):
    return r6(beh.activity_gaps(ev(spark, d)))


@query
def b7_repeat_ratio(spark, d):
    return r6(beh.repeat_ratio(p2p(spark, d)))


@query
def b8_behavioral(spark, d):
    return r6(beh.behavioral_features(p2p(spark, d)))


@query
def c1_degrees(spark, d):
    return r6(structural.degrees(edge_table(spark, d), vertex_table(spark, d)))


@query
def c4_betweenness(spark, d):
    return structural.betweenness(edge_table(spark, d), vertex_table(spark, d))


@query
def c5_pagerank(spark, d):
    return r6(structural.pagerank(edge_table(spark, d), vertex_table(spark, d), iterations=30, tolerance=None).withColumn("pagerank", F.col("pagerank") * 100))


@query
def c6_clustering(spark, d):
    return structural.clustering(edge_table(spark, d), vertex_table(spark, d))


@query
def c7_core_numbers(spark, d):
    return structural.core_numbers(edge_table(spark, d), vertex_table(spark, d))


@query
def c8_scc_sizes(spark, d):
    return structural.scc_sizes(edge_table(spark, d), vertex_table(spark, d))


@query
def c9_communities(spark, d):
    return community.louvain(edge_table(spark, d), vertex_table(spark, d))


@query
def c10_community_density(spark, d):
    e, v = edge_table(spark, d), vertex_table(spark, d)
    return structural.community_density(e, v.select("account_id", (F.col("account_id") % 20).alias("community_id")))


# ---- patterns and features


@query
def d1_circularity(spark, d):
    return r6(patterns.circularity(edge_table(spark, d), vertex_table(spark, d), BOUNDS.cycle_bound))


@query
def d2_funnel(spark, d):
    return patterns.funnel(structural.degrees(edge_table(spark, d), vertex_table(spark, d)))


@query
def d3_layering_depth(spark, d):
    return patterns.layering_depth(edge_table(spark, d), vertex_table(spark, d), BOUNDS.layering_cutoff)


@query
def d4_neighbour_risk(spark, d):
    return patterns.neighbour_risk(edge_table(spark, d), vertex_table(spark, d))


@query
def d5_device_cluster(spark, d):
    return patterns.device_cluster(accounts(spark, d))


@query
def d6_suspicious_chains(spark, d):
    # sources, sinks, arcs and vertices each read the edges
    e = iterate.stage(graph.edges(ledger(spark, d)).select("src", "dst", "weight"), "edges")
    v = graph.vertices(None, e)
    return patterns.suspicious_chains(e, v, structural.degrees(e, v))


@query
def f1_features(spark, d):
    return r6(relational_features(spark, d))


#: Full feature tables by application and data folder, which two queries read.
_FEATURES: dict[tuple[str, str], DataFrame] = {}


def all_features(spark, d) -> DataFrame:
    """The definition's 35 features of every vertex; written once an application and data folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FEATURES:
        e = iterate.stage(edge_table(spark, d), "edges")
        v = iterate.stage(vertex_table(spark, d), "vertices")
        _FEATURES[key] = iterate.stage(pipeline.feature_table(e, v, p2p(spark, d), accounts(spark, d), BOUNDS), "all-features")
    return _FEATURES[key]


@query
def f1_all_features(spark, d):
    return all_features(spark, d)


@query
def k4_all_feature_scores(spark, d):
    """The static score of all 35 features."""
    return scoring.static_scores(all_features(spark, d))


@query
def p1_seeds(spark, d):
    return propagation.auto_seeds(vertex_table(spark, d))


@query
def p2_transition(spark, d):
    return r6(propagation.transition(edge_table(spark, d)))


@query
def p5_propagate(spark, d):
    return propagation.propagate(edge_table(spark, d), vertex_table(spark, d), tolerance=None)


@query
def e1_spectral(spark, d):
    return emb.spectral_embedding(edge_table(spark, d), vertex_table(spark, d), BOUNDS.embedding_dim // 2)


@query
def e2_walks(spark, d):
    return emb.walks(edge_table(spark, d), vertex_table(spark, d), BOUNDS.walks, BOUNDS.walk_length)


@query
def e3_cooccurrence(spark, d):
    return emb.cooccurrence(emb.walks(edge_table(spark, d), vertex_table(spark, d), BOUNDS.walks, BOUNDS.walk_length))


@query
def e4_graph_embedding(spark, d):
    both = emb.graph_embedding(edge_table(spark, d), vertex_table(spark, d), BOUNDS.embedding_dim, BOUNDS.walks, BOUNDS.walk_length)
    return emb.embedding_columns(both, "gnn_emb", BOUNDS.embedding_dim)


@query
def q1_sequence_rows(spark, d):
    return r6(sequences.sequence_rows(ev(spark, d), BOUNDS.sequence_len))


@query
def q2_sequence_stats(spark, d):
    return r6(sequences.sequence_stats(sequences.sequence_rows(ev(spark, d), BOUNDS.sequence_len), BOUNDS.sequence_len))


@query
def q5_sequence_anomaly(spark, d):
    s = iterate.stage(sequences.sequence_stats(sequences.sequence_rows(ev(spark, d), BOUNDS.sequence_len), BOUNDS.sequence_len))
    return sequences.SequenceEncoder(8).fit(s).anomaly(s)


@query
def q4_sequence_codes(spark, d):
    s = iterate.stage(sequences.sequence_stats(sequences.sequence_rows(ev(spark, d), BOUNDS.sequence_len), BOUNDS.sequence_len))
    return sequences.SequenceEncoder(4).fit(s).encode(s)


# ---- scores


@query
def k1_component_scores(spark, d):
    return scoring.component_scores(iterate.stage(r6(relational_features(spark, d)), "features"))


@query
def k3_contributions(spark, d):
    return scoring.contributions(scoring.component_scores(iterate.stage(r6(relational_features(spark, d)), "features")))


@query
def k4_static_scores(spark, d):
    return score_table(spark, d)


@query
def k5_signal_scores(spark, d):
    p = vertex_table(spark, d).select("account_id", F.col("is_fraud").cast("double").alias("p"))
    return scoring.signal_scores(iterate.stage(r6(relational_features(spark, d)), "features"), p).select("account_id", "sig_behavioral", "sig_structural", "sig_propagation", "risk_score", "risk_level")


@query
def l1_alerts(spark, d):
    return scoring.alerts(score_table(spark, d), scoring.Scoring(alert_threshold=30.0, high_risk_threshold=50.0), "2025-01-01").drop("created_at")


@query
def l3_prioritize(spark, d):
    return scoring.prioritize(scoring.alerts(score_table(spark, d), scoring.Scoring(alert_threshold=20.0), "2025-01-01"), 25).select("account_id", "risk_score", "alert_type")


def _labelled(spark, d) -> DataFrame:
    s = ((F.col("doc_id") * 37 + F.col("quality") * 400) % 1000) / 1000.0
    return read(spark, d, "labels").select(F.col("doc_id").alias("account_id"), F.col("quality").alias("label"), s.alias("score"))


def _meta(spark, d):
    f = iterate.stage(relational_features(spark, d))
    s = iterate.stage(scoring.component_scores(f))
    y = accounts(spark, d).select("account_id", F.col("is_fraud").cast("int").alias("label"))
    return s, y


@query
def m1_meta_model(spark, d):
    s, y = _meta(spark, d)
    m = scoring.MetaModel(BOUNDS.meta_trees)
    m.fit(s, y)
    return m.predict(s).select("account_id", "probability")


@query
def m4_calibrate(spark, d):
    rows = _labelled(spark, d)
    return scoring.Calibrator().fit(rows).calibrate(rows).select("account_id", "score")


@query
def m5_to_risk_score(spark, d):
    return r6(scoring.to_risk_score(_labelled(spark, d), "score").select("account_id", "risk_score"))


@query
def m6_reliability(spark, d):
    return metrics.reliability(_labelled(spark, d), "score")


@query
def x1_ranking_metrics(spark, d):
    return metrics.ranking_metrics(_labelled(spark, d))


@query
def x2_at_k(spark, d):
    return metrics.at_k(_labelled(spark, d)).withColumn("k", F.col("k").cast("long"))


@query
def x3_evaluation_report(spark, d):
    one = metrics.ranking_metrics(_labelled(spark, d)).select("pr_auc")
    return metrics.evaluation_report(one.select(F.lit("a").alias("model"), F.lit("val").alias("split"), "pr_auc").unionByName(one.select(F.lit("b").alias("model"), F.lit("val").alias("split"), (F.col("pr_auc") / 2).alias("pr_auc"))))


@query
def t1_temporal_split(spark, d):
    return training.temporal_split(p2p(spark, d), accounts(spark, d), fill_empty=False)


@query
def t2_supervised(spark, d):
    f = iterate.stage(relational_features(spark, d).join(accounts(spark, d).select("account_id", "is_fraud"), "account_id"))
    t = training.SupervisedTrainer(scale=0.02)
    t.train(f.filter("account_id % 5 <> 0"), f.filter("account_id % 5 = 0"))
    return t.predict(f).select("account_id", "probability")


@query
def t7_graph_classifier(spark, d):
    x = iterate.stage(emb.spectral_embedding(edge_table(spark, d), vertex_table(spark, d), BOUNDS.embedding_dim // 2))
    c = training.GraphClassifier(trees=BOUNDS.graph_trees)
    c.train(x, accounts(spark, d).select("account_id", F.col("is_fraud").cast("int").alias("label")))
    return c.predict(x)


#: Neighbourhood of unit vectors of 64 dimensions: unrelated ones lie about 1.4 apart.
EPS = 1.2


def _points(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query
def n1_isolation_forest(spark, d):
    return training.isolation_forest(_points(spark, d), trees=200)


@query
def n2_local_outlier_factor(spark, d):
    return r6(training.local_outlier_factor(_points(spark, d), 10))


@query
def n3_density_deviation(spark, d):
    return training.density_deviation(_points(spark, d), EPS, 5)


@query
def n4_combined_anomaly(spark, d):
    p = iterate.stage(_points(spark, d))
    return training.combined_anomaly(training.isolation_forest(p, 200), training.local_outlier_factor(p, 10), training.density_deviation(p, EPS, 5))


# ---- drift


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    f = iterate.stage(r6(beh.behavioral_features(p2p(spark, d))), "halves")
    return f.filter("account_id % 2 = 0"), f.filter("account_id % 2 = 1")


@query
def w1_drift_baseline(spark, d):
    return metrics.drift_baseline(_halves(spark, d)[0])


@query
def w2_ecdf_distance(spark, d):
    a, b = _halves(spark, d)
    return metrics.ecdf_distance(metrics.long_form(a), metrics.long_form(b))


@query
def w2_feature_drift(spark, d):
    return metrics.feature_drift(*_halves(spark, d))


@query
def w3_psi(spark, d):
    a, b = _halves(spark, d)
    return metrics.psi(metrics.long_form(a), metrics.long_form(b))


@query
def w4_drift_summary(spark, d):
    return metrics.drift_summary(metrics.feature_drift(*_halves(spark, d)))


@query
def w5_prediction_profile(spark, d):
    return metrics.prediction_profile(_labelled(spark, d))


@query
def w5_prediction_drift(spark, d):
    s = _labelled(spark, d)
    return metrics.prediction_drift(s.filter("account_id % 2 = 0"), s.filter("account_id % 2 = 1"))


@query
def w6_graph_metrics(spark, d):
    e, v = iterate.stage(edge_table(spark, d), "edges"), iterate.stage(vertex_table(spark, d), "vertices")
    return metrics.graph_metrics(e, v, with_components=True)


@query
def w7_graph_drift(spark, d):
    t = p2p(spark, d)

    def half(k):
        e = iterate.stage(graph.edges(t.filter(f"transaction_id % 2 = {k}")), "half")
        # each loop reads the vertices, and the row is read by metric
        return iterate.stage(metrics.graph_metrics(e, iterate.stage(graph.vertices(None, e), "half"), with_components=True), "half")

    return metrics.graph_drift(*iterate.together(spark, lambda: half(0), lambda: half(1)))


@query
def w7_graph_verdict(spark, d):
    return metrics.graph_drift_verdict(w7_graph_drift(spark, d))


# ---- explanations, serving, charts


@query
def h1_top_features(spark, d):
    return explain.top_features(r6(relational_features(spark, d)), 5).select("account_id", F.col("rank").cast("long").alias("rank"), "feature", "value")


@query
def h2_batch_decompose(spark, d):
    f = iterate.stage(r6(relational_features(spark, d)), "features")
    return explain.batch_decompose(f, scoring.static_scores(f), 20, 5).select("account_id", "risk_score", F.col("rank").cast("long").alias("rank"), "feature", "value")


@query
def h3_path_attribution(spark, d):
    """Contributions of the signals to the meta-model's raw score of one account."""
    s, y = _meta(spark, d)
    m = scoring.MetaModel(trees=3, depth=3)
    m.fit(s, y)
    row = s.filter("account_id = 7").first()
    got = explain.path_attribution(m.model, m.columns, [float(row[c]) for c in m.columns])
    return spark.createDataFrame(sorted(got.items()), "signal string, contribution double")


@query
def h3_shapley(spark, d):
    """Shapley values of the meta-model's signals, for every account."""
    s, y = _meta(spark, d)
    m = scoring.MetaModel(BOUNDS.meta_trees)
    m.fit(s, y)
    return shapley.tree_shap(m.model, m.columns, s)


@query
def m3_importance(spark, d):
    s, y = _meta(spark, d)
    m = scoring.MetaModel(BOUNDS.meta_trees)
    m.fit(s, y)
    return spark.createDataFrame(m.importance(), "signal string, importance double")


@query
def h4_account_activity(spark, d):
    return explain.account_activity(p2p(spark, d))


@query
def y1_ground_truth(spark, d):
    return explain.ground_truth(accounts(spark, d), p2p(spark, d))


@query
def i1_score_of(spark, d):
    return io.point_read(spark, score_buckets(spark, d), 11)


@query
def i2_scores_of(spark, d):
    return explain.scores_of(io.point_read(spark, score_buckets(spark, d), 1, 2, 3, 67), [1, 2, 3, 67])


@query
def i3_top_scores(spark, d):
    return explain.top_scores(score_table(spark, d), 20, 10.0)


@query
def i5_list_alerts(spark, d):
    return explain.list_alerts(score_table(spark, d), 20, 20.0).withColumn("alert_id", F.col("alert_id").cast("long"))


@query
def i6_alert_stats(spark, d):
    return explain.alert_stats(score_table(spark, d))


@query
def j1_risk_histogram(spark, d):
    return explain.risk_histogram(score_table(spark, d))


@query
def j2_pca_scatter(spark, d):
    return explain.pca_scatter(iterate.stage(relational_features(spark, d)))


@query
def j3_component_stack(spark, d):
    return explain.component_stack(score_table(spark, d))


@query
def j4_ego_edges(spark, d):
    return r6(iterate.ego_network(edge_table(spark, d), 7, 2)[1].select("src", "dst", "weight"))


@query
def j5_fraud_network(spark, d):
    return explain.fraud_network(edge_table(spark, d), vertex_table(spark, d))


@query
def j7_model_comparison(spark, d):
    s = _labelled(spark, d)
    rows = [metrics.ranking_metrics(s, threshold=t).withColumns({"model": F.lit(m), "split": F.lit(k)}) for m, k, t in (("a", "val", 0.5), ("b", "val", 0.8), ("b", "test", 0.5))]
    return metrics.model_comparison(reduce(DataFrame.unionByName, rows).drop("recall"))


@query
def j8_pr_curve(spark, d):
    return metrics.pr_curve(_labelled(spark, d))


@query
def j9_timeline(spark, d):
    return explain.timeline(p2p(spark, d))


@query
def stream_clean(spark, d):
    """The ledger as a stream of files, cleaned with dedup within the watermark; equals the batch result."""
    base = f"{iterate.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = p2p(spark, d).select(F.col("transaction_id").cast("string").alias("transaction_id"), F.col("sender_id").cast("string").alias("sender_id"), F.col("receiver_id").cast("string").alias("receiver_id"), "amount", "timestamp", "transaction_type")
    rows.unionByName(rows.filter("amount > 100000")).write.parquet(f"{base}/in")
    out = ingest.clean_stream(ingest.read_stream(spark, f"{base}/in"), "36500 days")
    with ingest.state_on_disk(spark):
        run = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("transaction_id").cast("long").alias("transaction_id"), "amount")


def _stream_rows(spark, d):
    ids = [F.col(c).cast("string").alias(c) for c in ("transaction_id", "sender_id", "receiver_id")]
    return p2p(spark, d).select(*ids, "amount", "timestamp", "transaction_type")


@query
def stream_edges(spark, d):
    """Edges kept up to date over two runs of one query, each with new files, equal the edges of the whole."""
    base = f"{iterate.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = ingest.ChangeLog(spark, f"{base}/edges", ["src", "dst"])
    for part in range(2):
        _stream_rows(spark, d).filter(f"CAST(transaction_id AS bigint) % 2 = {part}").write.mode("append").parquet(f"{base}/in")
        ingest.running_edges(ingest.read_stream(spark, f"{base}/in"), log, f"{base}/state").awaitTermination()
    ends = [F.col(c).cast("long").alias(c) for c in ("src", "dst")]
    return log.read().select(*ends, F.round("weight", 6).alias("weight"), "frequency")


@query
def stream_sliding_edges(spark, d):
    """Edges by week, a new week each day, from a stream with a watermark; equal the windows of the whole."""
    base = f"{iterate.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = ingest.ChangeLog(spark, f"{base}/panes", ["pane", "src", "dst"])
    _stream_rows(spark, d).write.parquet(f"{base}/in")
    log.follow(ingest.pane_edges(ingest.read_stream(spark, f"{base}/in")), f"{base}/state").awaitTermination()
    ends = [F.col(c).cast("long").alias(c) for c in ("src", "dst")]
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return ingest.fold_panes(log.read()).select(start, *ends, F.round("weight", 6).alias("weight"), "frequency")


@query
def evaluate(spark, d):
    """The whole scoring flow at production sizes."""
    return pipeline.evaluate(accounts(spark, d), p2p(spark, d), BOUNDS)["scores"]


@query
def z1_accounts(spark, d):
    return simulate.accounts(spark, simulate.Simulation(total_accounts=1000)).drop("n")


@query
def z6_inject(spark, d):
    return simulate.inject(spark, simulate.Simulation(total_accounts=1000, simulation_days=90))[0]


@query
def z13_simulate(spark, d):
    cfg = simulate.Simulation(total_accounts=500, simulation_days=90, total_transactions=5000)
    return simulate.simulate(spark, cfg)[1]


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return twins.oracle_sql()
