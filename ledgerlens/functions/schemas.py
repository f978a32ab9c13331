"""Table contracts and vocabularies."""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("sender_id", T.StringType()),
        T.StructField("receiver_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("transaction_type", T.StringType()),
    ]
)
ACCOUNTS = T.StructType(
    [
        T.StructField("account_id", T.StringType()),
        T.StructField("creation_date", T.TimestampNTZType()),
        T.StructField("account_type", T.StringType()),
        T.StructField("kyc_level", T.StringType()),
        T.StructField("geographic_region", T.StringType()),
    ]
)
# fixed values: vocabularies of the ledger
ACCOUNT_TYPES = ("savings", "business", "wallet")
KYC_LEVELS = ("basic", "standard", "enhanced", "premium")
TRANSACTION_TYPES = ("p2p", "ecommerce", "bill_payment", "salary")
RISK_LEVELS = ("critical", "high", "medium", "low", "minimal")
LABEL_COLUMNS = ("is_fraud", "fraud_role", "fraud_pattern", "is_fraud_label")
# fixed values: the feature table's columns
STRUCTURAL = ["in_degree", "out_degree", "total_degree", "weighted_in_degree", "weighted_out_degree", "degree_ratio", "betweenness", "pagerank", "clustering_coefficient", "k_core_number", "scc_size", "community_id", "subgraph_density"]
BEHAVIORAL = ["incoming_volume", "avg_incoming_amount", "max_incoming_amount", "incoming_txn_count", "incoming_counterparty_diversity", "outgoing_volume", "avg_outgoing_amount", "max_outgoing_amount", "outgoing_txn_count", "outgoing_counterparty_diversity", "net_balance_ratio", "velocity_score", "receive_to_send_delay_hours", "burst_index", "dormancy_score", "repeat_transfer_ratio"]
FRAUD = ["circularity_score", "funnel_score", "layering_depth", "risk_propagation_score", "device_cluster_score", "suspicious_chain_length"]
# fixed values: the features each component score reads
BEHAVIORAL_SCORE = ["incoming_volume", "outgoing_volume", "net_balance_ratio", "velocity_score", "receive_to_send_delay_hours", "burst_index", "dormancy_score", "incoming_counterparty_diversity", "outgoing_counterparty_diversity", "repeat_transfer_ratio"]
STRUCTURAL_SCORE = ["in_degree", "out_degree", "degree_ratio", "betweenness", "pagerank", "clustering_coefficient", "k_core_number", "scc_size", "subgraph_density"]
PROPAGATION_SCORE = FRAUD


def feature_names() -> list[str]:
    return STRUCTURAL + BEHAVIORAL + FRAUD
