"""The ledger views over the driver's tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import neighbour

ACCOUNTS = """
SELECT c.c_custkey AS account_id, f.first_order AS creation_date,
  CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'savings' WHEN c.c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'business' ELSE 'wallet' END AS account_type,
  CASE WHEN c.c_acctbal < 0 THEN 'basic' WHEN c.c_acctbal < 3000 THEN 'standard' WHEN c.c_acctbal < 7000 THEN 'enhanced' ELSE 'premium' END AS kyc_level,
  r.r_name AS geographic_region,
  CASE WHEN c.c_custkey % 10 = 0 THEN concat('dev_', CAST(c.c_custkey % 70 AS VARCHAR(20))) ELSE concat('own_', CAST(c.c_custkey AS VARCHAR(20))) END AS device_fingerprint_id,
  c.c_custkey % 67 = 0 AS is_fraud,
  CASE WHEN c.c_custkey % 67 <> 0 THEN 'normal' WHEN c.c_custkey % 2 = 0 THEN 'mule_funnel' ELSE 'mule_circular' END AS fraud_role
FROM {customer} c LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM {orders} GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey
"""

P2P = """
SELECT o.o_orderkey AS transaction_id, o.o_custkey AS sender_id, (o.o_custkey * 7 + o.o_orderkey * 13) % k.n AS receiver_id,
  o.o_totalprice AS amount, o.o_orderdate AS "timestamp",
  CASE WHEN o.o_orderpriority LIKE '1%' THEN 'salary' WHEN o.o_orderpriority LIKE '2%' THEN 'ecommerce' WHEN o.o_orderpriority LIKE '3%' THEN 'bill_payment' ELSE 'p2p' END AS transaction_type,
  o.o_custkey % 67 = 0 AS is_fraud,
  CASE WHEN o.o_custkey % 67 <> 0 THEN 'none' WHEN o.o_orderkey % 2 = 0 THEN 'funnel_outbound' ELSE 'circular_flow' END AS fraud_pattern
FROM {orders} o CROSS JOIN (SELECT count(*) AS n FROM {customer}) k
"""

EV = """
SELECT event_id AS transaction_id, user_id AS sender_id, nxt AS receiver_id, value AS amount, ts AS "timestamp", event_type AS transaction_type
FROM (SELECT *, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt FROM {events}) e WHERE nxt IS NOT NULL
"""

LEDGER = """
SELECT l.l_orderkey AS transaction_id, o.o_custkey AS sender_id, 1000000000 + l.l_suppkey AS receiver_id, l.l_extendedprice AS amount,
  l.l_shipdate AS "timestamp", CASE WHEN l.l_returnflag = 'R' THEN 'ecommerce' ELSE 'p2p' END AS transaction_type
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

_TABLES = ("customer", "nation", "region", "orders", "events", "lineitem", "labels", "embeddings")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = [t for t in _TABLES if "{" + t + "}" in text]
    return spark.sql(text.replace('"timestamp"', "`timestamp`"), **{t: read(spark, sf_dir, t) for t in used})


def accounts(spark, sf_dir):
    return view(spark, sf_dir, ACCOUNTS)


def p2p(spark, sf_dir):
    return view(spark, sf_dir, P2P)


def ev(spark, sf_dir):
    """Rows of EV; an event type with a large share of all events is worked on in pieces of its time."""
    e = neighbour(read(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "user_id", "nxt", ahead=True).filter("nxt IS NOT NULL")
    names = {"event_id": "transaction_id", "user_id": "sender_id", "nxt": "receiver_id", "value": "amount", "ts": "timestamp", "event_type": "transaction_type"}
    return e.select(*(F.col(a).alias(b) for a, b in names.items()))


def ledger(spark, sf_dir):
    return view(spark, sf_dir, LEDGER)


def duck(text: str) -> str:
    return text.format(**{t: t for t in _TABLES})


#: Common head of the DuckDB twins.
WITH = f"WITH accounts AS ({duck(ACCOUNTS)}), p2p AS ({duck(P2P)}), ev AS ({duck(EV)})"
WITH_LEDGER = f"WITH ledger AS ({duck(LEDGER)})"
