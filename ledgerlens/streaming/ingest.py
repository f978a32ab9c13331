"""Streams of transactions: cleaning with dedup over a watermark, running edges, sliding windows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import money
from ..functions.schemas import TRANSACTIONS
from ..operators.graph import edges


#: State lives on the executor's disk with one bounded cache an executor, not as objects in its heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Stateful queries started inside keep their state on disk; a query takes its settings when it starts.

    A checkpoint that was begun with another store goes on with that one.
    """
    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_stream(spark: SparkSession, path: str, schema=TRANSACTIONS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def clean_stream(txns: DataFrame, late: str = "1 day") -> DataFrame:
    """Positive amounts, no self-transfers, each transaction id once within the watermark."""
    rows = txns.filter((F.col("amount") > 0) & (F.col("sender_id") != F.col("receiver_id"))).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return rows.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["transaction_id"])


class ChangeLog:
    """What a stateful query changed, one folder a micro-batch: each holds the new rows of the keys that the batch touched.

    A batch that is replayed after a failure replaces its own folder, so nothing counts twice; what a batch
    writes is in proportion to the batch. The latest row of a key is its state.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def write(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def read(self) -> DataFrame:
        """The latest row of every key. Raises FileNotFoundError before the first batch."""
        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException as e:
            raise FileNotFoundError(self.path) from e
        kept = [c for c in rows.columns if c not in (*self.keys, "epoch")]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*kept), "epoch").alias("row"))
        return latest.select(*self.keys, "row.*")

    def follow(self, changes: DataFrame, checkpoint: str):
        """Starts a query of the aggregate ``changes``; its state is kept by key in the query's own checkpoint."""
        with state_on_disk(self.spark):
            return changes.writeStream.outputMode("update").foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_edges(txns: DataFrame, log: ChangeLog, checkpoint: str):
    """Starts a query that keeps every edge's measures up to date; a micro-batch reads and writes its own edges alone."""
    return log.follow(edges(txns), checkpoint)


def sliding_edges(txns: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Edge weight and frequency in sliding windows of event time. On a stream, rows that come more than ``late`` behind
    the newest time seen by earlier batches are dropped, and the state of windows that far back with them."""
    rows = txns.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    by = rows.groupBy(F.window("timestamp", length, step), F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"))
    out = by.agg(money("amount").alias("weight"), F.count(F.lit(1)).alias("frequency"))
    return out.select(F.col("window.start").alias("window_start"), "src", "dst", "weight", "frequency")


def pane_edges(txns: DataFrame, step: str = "1 day", late: str = "7 days") -> DataFrame:
    """Edge weight and frequency in panes of event time, one a ``step``; sliding windows are made of them by fold_panes().

    A row is one key of state instead of one in each of its windows. For windows of n steps, ``late`` is the allowed
    lateness and n - 1 steps: then a row counts in all its windows until the last of them ends.
    """
    return sliding_edges(txns, step, step, late).withColumnRenamed("window_start", "pane")


def fold_panes(panes: DataFrame, n: int = 7, step_hours: int = 24) -> DataFrame:
    """Sliding windows of ``n`` panes, one starting with each pane: window_start, src, dst, weight and frequency."""
    starts = F.sequence(F.col("pane") - F.expr(f"interval {(n - 1) * step_hours} hours"), F.col("pane"), F.expr(f"interval {step_hours} hours"))
    rows = panes.select(F.explode(starts).alias("window_start"), "src", "dst", "weight", "frequency")
    return rows.groupBy("window_start", "src", "dst").agg(money("weight").alias("weight"), F.sum("frequency").alias("frequency"))
