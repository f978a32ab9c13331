"""Tolerant as-of join: each event meets the latest order of its key at or before it, within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, table

DAY = 86_400_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone counts as UTC, whatever the session's zone."""
    at = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.unix_micros(at)
    minutes = (F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def winners(orders: DataFrame, best: Column) -> DataFrame:
    """One row per key and time: the largest ``best`` (a struct; nulls in it lose) and how many orders stand there.

    ``orders``: key, at. Aggregated before the shuffle, so a time that very many orders share is a row a task.
    """
    known = orders.filter("key IS NOT NULL AND at IS NOT NULL")
    return known.groupBy("key", "at").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n_tied"))


def asof_join(events: DataFrame, orders: DataFrame, tolerance: int) -> DataFrame:
    """event, key, at and ``found`` (at, best, n_tied), the latest row of ``orders`` at or before the event.

    ``events``: event, key, at. ``orders``: rows of winners(). Both are one table ordered by key and
    time, orders first, and dealt out in pieces of that order, so a key with a third of all rows is
    many pieces. In each piece a window over the key carries the last order on; the last order
    of a key that runs over the edge of a piece is added to the next piece (one row a piece).

    Defined cases: an event without key or time, or with no order within ``tolerance``, has a null
    ``found``; orders without key or time are never met; repeated events are matched each; an empty
    table on either side gives all events unmatched, or no rows. Further columns are left out.
    """
    events = events.select("event", "key", "at")
    live = "key IS NOT NULL AND at IS NOT NULL"
    order = orders.filter(live).select("key", "at", F.lit(0).alias("side"), F.struct("at", "best", "n_tied").alias("found"))
    asks = events.filter(live).withColumn("side", F.lit(1))
    rows = asks.unionByName(order, allowMissingColumns=True)
    dealt = rows.repartitionByRange(n_parts(rows.sparkSession), "key", "at", "side", "event")
    # staged: the pieces must stay the same for both reads, also when an executor is lost
    dealt = table(dealt.withColumn("piece", F.spark_partition_id()), "asof")
    edges = dealt.groupBy("piece").agg(F.min("key").alias("first"), F.max(F.struct("key", "found")).alias("last"))
    ends = edges.select("piece", F.lit(1).alias("end"), "last.key", "last.found")
    heads = edges.select("piece", F.lit(0).alias("end"), F.col("first").alias("key"))
    before = Window.partitionBy("key").orderBy("piece", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = heads.unionByName(ends, allowMissingColumns=True).withColumn("found", F.last("found", True).over(before))
    carried = carried.filter("end = 0 AND found IS NOT NULL")
    carried = carried.select("piece", "key", "found.at", F.lit(0).alias("side"), "found")
    past = Window.partitionBy("piece", "key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.unionByName(carried, allowMissingColumns=True).withColumn("found", F.last("found", True).over(past))
    near = F.when(F.col("at") - F.col("found.at") <= tolerance, F.col("found"))
    met = met.filter("side = 1").select("event", "key", "at", near.alias("found"))
    return met.unionByName(events.filter(f"NOT ({live})"), allowMissingColumns=True)


def click_orders(clicks: DataFrame, sales: DataFrame, tolerance: int = 3 * DAY) -> DataFrame:
    """Each click's order: click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied.

    Every odd hash of an id floors its row's time to the day; two of three orders have a second order
    of the same time. Of orders of one client and time the larger priority wins, then the smaller
    sale_id, then the larger total; nulls lose.

    Defined cases: copies of a click count once (where they differ, the largest client and time are
    taken); clicks without client or time are unmatched, and all clicks without an id are copies of one;
    an order without an id keeps its time, has no second order and counts among the tied; a total
    that is null, not a number or infinite has null cents; empty tables give no rows, or all clicks
    unmatched; further columns are ignored.
    """

    def used(df: DataFrame, key: str, at: str) -> Column:
        h, t = F.crc32(F.col(key).cast("string").cast("binary")), micros(df, at)
        return F.when(h % 2 == 1, t - F.pmod(t, F.lit(DAY))).otherwise(t)

    once = clicks.select("click_id", F.struct("client_id", used(clicks, "click_id", "ts").alias("at")).alias("c"))
    once = once.groupBy("click_id").agg(F.max("c").alias("c"))
    events = once.select(F.col("click_id").alias("event"), F.col("c.client_id").alias("key"), "c.at")

    total = F.col("total").cast("double")
    cents = F.when(F.abs(total) < 9e16, F.floor(F.lit(100.0) * total + 0.5))  # NaN is larger than any number
    sale = F.col("sale_id")
    two = F.crc32(sale.cast("string").cast("binary")) % 3 != 0
    own = F.struct(F.col("priority").cast("long").alias("priority"), sale.alias("sale_id"))
    second = F.struct((6 - F.col("priority")).cast("long").alias("priority"), F.bitwise_not(sale).alias("sale_id"))
    orders = sales.select(
        F.col("client_id").alias("key"), used(sales, "sale_id", "sold_at").alias("at"), cents.alias("cents"),
        F.explode(F.when(two, F.array(own, second)).otherwise(F.array(own))).alias("o"),
    )
    # the complement of an id orders downwards and keeps null least
    best = F.struct("o.priority", F.bitwise_not("o.sale_id").alias("down"), "cents")
    out = asof_join(events, winners(orders, best), tolerance)
    return out.select(
        F.col("event").alias("click_id"), F.col("key").alias("client_id"), F.col("at").alias("ts_us"),
        F.bitwise_not("found.best.down").alias("sale_id"), (F.col("at") - F.col("found.at")).alias("lag_us"),
        F.col("found.best.cents").alias("total_cents"), F.coalesce("found.n_tied", F.lit(0).cast("long")).alias("n_tied"),
    )
