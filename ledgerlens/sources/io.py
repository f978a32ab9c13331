"""Sources and sinks: files, JDBC, key-value cache, graph store."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..config import Jdbc, Settings
from ..functions.schemas import ACCOUNTS, TRANSACTIONS
from ..operators.validate import validate_accounts, validate_transactions


def _check(txns: DataFrame, accounts: DataFrame) -> list[str]:
    return validate_transactions(txns)[1] + validate_accounts(accounts)[1]


def load_parquet(spark: SparkSession, settings: Settings = Settings(), txn_path: str | None = None, acc_path: str | None = None, warn=None) -> tuple[DataFrame, DataFrame]:
    """Transactions and accounts; failed checks go to ``warn``, a missing table raises FileNotFoundError."""
    try:
        txns = spark.read.parquet(txn_path or f"{settings.data_dir}/transactions.parquet")
        accounts = spark.read.parquet(acc_path or f"{settings.data_dir}/accounts.parquet")
    except AnalysisException as e:
        raise FileNotFoundError(str(e).splitlines()[0]) from e
    if warn is not None:
        for message in _check(txns, accounts):
            warn(message)
    return txns, accounts


def load_csv(spark: SparkSession, txn_path: str, acc_path: str) -> tuple[DataFrame, DataFrame]:
    read = spark.read.option("header", True)
    return read.schema(TRANSACTIONS).csv(txn_path), read.schema(ACCOUNTS).csv(acc_path)


def clean_batch(txns: DataFrame) -> DataFrame:
    """Positive amounts, no self-transfers, one row a transaction id (the earliest, then by the ends)."""
    w = Window.partitionBy("transaction_id").orderBy("timestamp", "sender_id", "receiver_id", "amount")
    return txns.filter((F.col("amount") > 0) & (F.col("sender_id") != F.col("receiver_id"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def save_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


#: Folders that a table of single reads is dealt out over; recorded in the table's own path.
BUCKETS = 64


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def save_buckets(df: DataFrame, path: str, key: str = "account_id", buckets: int = BUCKETS) -> None:
    """Writes a table whose rows lie in a folder by the hash of their key, each in files ordered by it."""
    rows = df.withColumn("bucket", _bucket(F.col(key), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", key)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def point_read(spark: SparkSession, path: str, *keys, key: str = "account_id", buckets: int = BUCKETS) -> DataFrame:
    """The rows of some keys in a table of save_buckets(): only their folders are listed in the scan, and the key is
    pushed down to the row groups' ranges. Raises FileNotFoundError without a table."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    kind = dict(rows.dtypes)[key]
    # folded on the driver, so that the scan knows its folders when it is planned
    asked = spark.range(1).select(*(_bucket(F.lit(k).cast(kind), buckets) for k in keys)).first()
    return rows.filter(F.col("bucket").isin(sorted(set(asked))) & F.col(key).isin(list(keys))).drop("bucket")


# ---- relational store: scores and alerts


def merge_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old scores with new ones in their place, by account."""
    return old.join(new.select("account_id"), "account_id", "left_anti").unionByName(new)


def high_risk(scores: DataFrame, threshold: float = 75.0, limit: int = 100) -> DataFrame:
    return scores.filter(F.col("risk_score") >= threshold).orderBy(F.desc("risk_score"), "account_id").limit(limit)


def find_alerts(alerts: DataFrame, resolved: bool = False, limit: int = 100) -> DataFrame:
    return alerts.filter(F.col("resolved") == F.lit(resolved)).orderBy(F.desc("created_at"), "account_id").limit(limit)


# Tables and columns of the relational store.
TABLES = {
    "accounts": [
        ("account_id", "VARCHAR(32) NOT NULL PRIMARY KEY"), ("creation_date", "TIMESTAMP"), ("account_type", "VARCHAR(20)"), ("kyc_level", "VARCHAR(20)"),
        ("geographic_region", "VARCHAR(50)"), ("device_fingerprint_id", "VARCHAR(24)"), ("is_fraud", "BOOLEAN DEFAULT FALSE"), ("fraud_role", "VARCHAR(30) DEFAULT 'normal'"),
    ],
    "risk_scores": [
        ("account_id", "VARCHAR(32) NOT NULL PRIMARY KEY"), ("behavioral_risk_score", "DOUBLE PRECISION"), ("structural_risk_score", "DOUBLE PRECISION"),
        ("network_propagation_score", "DOUBLE PRECISION"), ("risk_score", "DOUBLE PRECISION"), ("risk_level", "VARCHAR(20)"), ("updated_at", "TIMESTAMP"),
    ],
    "alerts": [
        ("alert_id", "INTEGER GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY"), ("account_id", "VARCHAR(32)"), ("risk_score", "DOUBLE PRECISION"), ("risk_level", "VARCHAR(20)"),
        ("alert_type", "VARCHAR(50)"), ("created_at", "TIMESTAMP"), ("resolved", "BOOLEAN DEFAULT FALSE"),
    ],
}


class JdbcStore:
    """Account, score and alert tables over JDBC. Rows are written and read by the executors; the few
    statements (tables, merge) go through the driver's JVM. Needs the database's driver jar on the class path.

    The executors open their connections task by task, at most ``connections`` at once; the driver holds
    one, from ``initialize`` to ``close``.
    """

    def __init__(self, cfg: Jdbc = Jdbc(), url: str | None = None, connections: int = 30):
        self.cfg, self.url, self.connections, self._held = cfg, url or cfg.url, connections, None

    def _options(self, table: str) -> dict:
        own = {"user": self.cfg.user, "password": self.cfg.password} if self.cfg.user else {}
        return {"url": self.url, "dbtable": table, "batchsize": "10000", "numPartitions": str(self.connections), **own}

    def _connection(self, spark: SparkSession):
        if self._held is None:
            manager = spark._jvm.java.sql.DriverManager
            self._held = manager.getConnection(self.url, self.cfg.user, self.cfg.password) if self.cfg.user else manager.getConnection(self.url)
        return self._held

    def execute(self, spark: SparkSession, *statements: str) -> None:
        """Runs the statements as one transaction."""
        c = self._connection(spark)
        c.setAutoCommit(False)
        try:
            for sql in statements:
                s = c.createStatement()
                s.execute(sql)
                s.close()
            c.commit()
        except Exception:
            c.rollback()
            raise

    def has_table(self, spark: SparkSession, name: str) -> bool:
        found = self._connection(spark).getMetaData().getTables(None, None, name, None)
        return bool(found.next())

    def initialize(self, spark: SparkSession) -> None:
        """Creates the tables that are not there yet, and the index on the alerts' accounts."""
        for name, columns in TABLES.items():
            if not self.has_table(spark, name):
                body = ", ".join(f'"{c}" {kind}' for c, kind in columns)
                index = ['CREATE INDEX "alerts_account" ON "alerts" ("account_id")'] if name == "alerts" else []
                self.execute(spark, f'CREATE TABLE "{name}" ({body})', *index)

    def close(self) -> None:
        if self._held is not None:
            self._held.close()
            self._held = None

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self._options(f'"{table}"')).load()

    def upsert_scores(self, scores: DataFrame) -> None:
        """Scores take the place of the accounts' old ones. The executors write a staging table; one
        statement then merges it, so readers see all of them or none, and a repeated call changes nothing."""
        spark = scores.sparkSession
        columns = [c for c, _ in TABLES["risk_scores"] if c in scores.columns]
        rows = scores.select(*columns).withColumn("updated_at", F.current_timestamp())
        staging = "risk_scores_staging"
        kinds = ", ".join(f"{c} {k.split(' ')[0]}" for c, k in TABLES["risk_scores"] if c in columns and k.startswith("VARCHAR"))
        rows.write.format("jdbc").options(**self._options(f'"{staging}"'), createTableColumnTypes=kinds).mode("overwrite").save()
        names = rows.columns
        sets = ", ".join(f'"{c}" = s."{c}"' for c in names if c != "account_id")
        into, values = ", ".join(f'"{c}"' for c in names), ", ".join(f's."{c}"' for c in names)
        merge = f'MERGE INTO "risk_scores" t USING "{staging}" s ON t."account_id" = s."account_id" WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({into}) VALUES ({values})'
        self.execute(spark, merge, f'DROP TABLE "{staging}"')

    def insert_alerts(self, alerts: DataFrame) -> None:
        """Appends alerts, unresolved and made now unless they say otherwise; ids are the database's."""
        given = {c: F.col(c) for c in alerts.columns}
        columns = [c for c, _ in TABLES["alerts"] if c in given and c != "alert_id"]
        rows = alerts.select(*columns).withColumns({c: v for c, v in (("created_at", F.current_timestamp()), ("resolved", F.lit(False))) if c not in given})
        rows.write.format("jdbc").options(**self._options('"alerts"')).mode("append").save()


class FileStore:
    """The same surface over Parquet folders: a version folder a write and a pointer to the newest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, table: str) -> str:
        return f"{self.root}/{table}/_current"

    def _version(self, table: str) -> int:
        try:
            return self.spark.read.schema("v int").json(self._pointer(table)).agg(F.max("v")).first()[0] or 0
        except AnalysisException:
            return 0

    def read(self, table: str) -> DataFrame:
        v = self._version(table)
        if not v:
            raise FileNotFoundError(table)
        return self.spark.read.parquet(f"{self.root}/{table}/v{v}")

    def write(self, table: str, df: DataFrame) -> None:
        v = self._version(table) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v{v}")
        self.spark.range(1).select(F.lit(v).alias("v")).coalesce(1).write.mode("append").json(self._pointer(table))

    def upsert_scores(self, scores: DataFrame) -> None:
        new = scores.withColumn("updated_at", F.current_timestamp())
        self.write("risk_scores", merge_scores(self.read("risk_scores"), new) if self._version("risk_scores") else new)

    def insert_alerts(self, alerts: DataFrame) -> None:
        self.write("alerts", self.read("alerts").unionByName(alerts) if self._version("alerts") else alerts)


# ---- key-value cache


def cache_entries(df: DataFrame, prefix: str, ttl: int) -> DataFrame:
    """key, value (JSON of the row) and ttl in seconds, as a cache stores them."""
    cols = [c for c in df.columns if c != "account_id"]
    return df.select(F.concat(F.lit(f"{prefix}:"), F.col("account_id").cast("string")).alias("key"), F.to_json(F.struct(*cols)).alias("value"), F.lit(ttl).alias("ttl"))


class Cache:
    """A bounded key-value cache with times to live. ``put`` streams its rows; beyond ``size`` entries the
    longest unwritten make room, as in any cache, and are counted in ``stats``."""

    def __init__(self, size: int = 100_000):
        self.size, self.data, self.evicted = size, {}, 0

    def put(self, entries: DataFrame) -> None:
        now = datetime.now()
        for r in entries.toLocalIterator():
            self.data.pop(r.key, None)
            self.data[r.key] = (now + timedelta(seconds=r.ttl), r.value)
            if len(self.data) > self.size:
                del self.data[next(iter(self.data))]
                self.evicted += 1

    def get(self, key: str):
        hit = self.data.get(key)
        if hit is None or hit[0] < datetime.now():
            self.data.pop(key, None)
            return None
        return json.loads(hit[1])

    def invalidate(self, account_id) -> None:
        for prefix in ("risk_score", "features"):
            self.data.pop(f"{prefix}:{account_id}", None)

    def stats(self) -> dict:
        return {"keys": len(self.data), "bytes": sum(len(v) for _, v in self.data.values()), "evicted": self.evicted}

    def close(self) -> None:
        self.data.clear()


# ---- graph store

# Labels, keys and properties of the property graph, in the statements that write them.
SCHEMA = [
    "CREATE CONSTRAINT account_id IF NOT EXISTS FOR (a:Account) REQUIRE a.account_id IS UNIQUE",
    "CREATE INDEX txn_timestamp IF NOT EXISTS FOR ()-[t:TRANSACTS]-() ON (t.timestamp)",
]
MERGE_NODES = "UNWIND $rows AS row MERGE (a:Account {account_id: row.account_id}) SET a += row"
MERGE_EDGES = (
    "UNWIND $rows AS row MATCH (s:Account {account_id: row.src}) MATCH (r:Account {account_id: row.dst}) "
    "MERGE (s)-[t:TRANSACTS]->(r) SET t.weight = row.weight, t.frequency = row.frequency"
)
CLEAR = "MATCH (n) DETACH DELETE n"


class GraphStore:
    """A property-graph database. ``open_session`` returns an object with run(statement, **parameters) and
    close(); the driver holds one, and each task that writes opens its own.

    Statements merge, so batches that are sent again after a lost executor change nothing.
    """

    def __init__(self, open_session, batch: int = 1000):
        self.open_session, self.batch, self._session = open_session, batch, None

    def connect(self) -> None:
        self._session = self.open_session()
        self._session.run("RETURN 1")

    @property
    def session(self):
        if self._session is None:
            raise RuntimeError("not connected: call connect() first")
        return self._session

    def close(self) -> None:
        if self._session is not None:
            self._session.close()
            self._session = None

    def setup_schema(self) -> None:
        for statement in SCHEMA:
            self.session.run(statement)

    def clear(self) -> None:
        self.session.run(CLEAR)

    def upload(self, vertex: DataFrame, edge: DataFrame) -> None:
        """All vertices, then all edges (weight and frequency), in batches from the executors."""
        self.session  # noqa: B018  raises unless connected
        for df, statement in ((_iso(vertex), MERGE_NODES), (edge.select("src", "dst", "weight", "frequency"), MERGE_EDGES)):
            send_partitions(df, _Sender(self.open_session, statement), self.batch)


class _Sender:
    """Sends a task's batches through one session of its own."""

    def __init__(self, open_session, statement: str):
        self.open_session, self.statement, self.session = open_session, statement, None

    def __call__(self, rows: list[dict]) -> None:
        if self.session is None:
            self.session = self.open_session()
        self.session.run(self.statement, rows=rows)

    def close(self) -> None:
        if self.session is not None:
            self.session.close()


def _iso(df: DataFrame) -> DataFrame:
    """Times as ISO text."""
    return df.select(*(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes))


def save_graph(vertex: DataFrame, edge: DataFrame, path: str) -> None:
    """Vertices and edges (weight and frequency only), times as ISO text."""
    _iso(vertex).write.mode("overwrite").parquet(f"{path}/vertices")
    edge.select("src", "dst", "weight", "frequency").write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def send_partitions(df: DataFrame, send, batch: int = 1000) -> None:
    """Calls ``send(rows)`` on the executors with lists of at most ``batch`` rows; ``send`` must be idempotent, as tasks may be retried."""

    def part(rows):
        held = []
        for r in rows:
            held.append(r.asDict())
            if len(held) == batch:
                send(held)
                held = []
        if held:
            send(held)
        if close := getattr(send, "close", None):
            close()

    df.foreachPartition(part)
