"""Synthetic ledgers: accounts, normal traffic, and five injected fraud patterns. Seeded and reproducible."""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Fraud, Simulation
from ..functions.columns import deterministic_id

# fixed values: vocabularies with their weights
TYPES = (("savings", 0.50), ("business", 0.20), ("wallet", 0.30))
KYC = (("basic", 0.15), ("standard", 0.45), ("enhanced", 0.30), ("premium", 0.10))
REGIONS = (
    ("north_america", 0.25), ("europe_west", 0.20), ("europe_east", 0.10), ("asia_pacific", 0.15),
    ("south_america", 0.10), ("middle_east", 0.05), ("africa", 0.05), ("southeast_asia", 0.10),
)
# fixed values: account type, level, daily rate, mean and deviation of log amount, shares of p2p, ecommerce, bills, salary
TEMPLATES = (
    ("savings", "basic", 1.2, 4.0, 1.2, 0.20, 0.30, 0.30, 0.20),
    ("savings", "standard", 2.0, 4.5, 1.0, 0.15, 0.35, 0.25, 0.25),
    ("savings", "enhanced", 3.0, 5.0, 0.9, 0.15, 0.35, 0.25, 0.25),
    ("savings", "premium", 4.0, 5.5, 0.8, 0.10, 0.40, 0.20, 0.30),
    ("business", "basic", 5.0, 6.0, 1.5, 0.05, 0.10, 0.60, 0.25),
    ("business", "standard", 8.0, 6.5, 1.3, 0.05, 0.10, 0.55, 0.30),
    ("business", "enhanced", 12.0, 7.0, 1.2, 0.05, 0.10, 0.50, 0.35),
    ("business", "premium", 15.0, 7.5, 1.0, 0.05, 0.05, 0.50, 0.40),
    ("wallet", "basic", 2.5, 3.5, 1.3, 0.40, 0.40, 0.10, 0.10),
    ("wallet", "standard", 3.5, 4.0, 1.1, 0.35, 0.40, 0.15, 0.10),
    ("wallet", "enhanced", 4.5, 4.5, 1.0, 0.30, 0.40, 0.15, 0.15),
    ("wallet", "premium", 6.0, 5.0, 0.9, 0.25, 0.40, 0.15, 0.20),
)
# fixed values: kind, shift of the mean and factor of the deviation of log amount
KINDS = (("p2p", -0.8, 1.2), ("ecommerce", -0.3, 0.8), ("bill_payment", -0.5, 0.5), ("salary", 1.5, 0.3))
# fixed values: weight of each hour from midnight on
HOURS = 6 * (0.1,) + 3 * (0.6,) + 8 * (1.0,) + 4 * (0.7,) + 3 * (0.3,)
# fixed values: roles; of an account's roles the last counts
ROLES = ("mule_funnel", "beneficiary", "mule_circular", "originator", "mule_layer", "mule_dormant", "mule_device_cluster")
#: Most beneficiaries that a funnel pays: all of them at the default size, and no square of the mules beyond.
PAID = 31
#: Parts of each day's new accounts and draws that are numbered apart.
CELLS, BLOCK = 64, 4096
START = "2025-01-01 00:00:00"


def unit(seed: int, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the seed and keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *(F.col(k) if isinstance(k, str) else k for k in keys)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def normal(seed: int, *keys) -> Column:
    u, v = F.greatest(unit(seed, *keys), F.lit(1e-12)), unit(seed + 7919, *keys)
    return F.sqrt(-2 * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)


def choose(u: Column, weighted) -> Column:
    total, at, out = sum(w for _, w in weighted), 0.0, None
    for name, w in weighted[:-1]:
        at += w / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return out.otherwise(weighted[-1][0])


def accounts(spark: SparkSession, cfg: Simulation = Simulation()) -> DataFrame:
    s = cfg.seed
    day = F.least(-F.ln(F.greatest(unit(s + 1, "n"), F.lit(1e-12))) * (0.3 * cfg.simulation_days), F.lit(float(cfg.simulation_days - 1)))
    risk = F.array_sort(F.array(*(unit(s + 100 + i, "n") for i in range(9))))[1]  # second of nine uniforms: Beta(2, 8)
    return spark.range(cfg.total_accounts).withColumnRenamed("id", "n").select(
        "n", deterministic_id(F.lit(str(s)), F.col("n").cast("string")).alias("account_id"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.floor(day).cast("int"), secs=(F.pmod(day, F.lit(1.0)) * 86400).cast("decimal(18,6)"))).alias("creation_date"),
        choose(unit(s + 2, "n"), TYPES).alias("account_type"), choose(unit(s + 3, "n"), KYC).alias("kyc_level"), choose(unit(s + 4, "n"), REGIONS).alias("geographic_region"),
        deterministic_id(F.lit("device"), F.lit(str(s)), F.col("n").cast("string")).alias("device_fingerprint_id"), risk.alias("latent_risk_profile"),
    )


def assign_roles(acc: DataFrame, roles: DataFrame) -> DataFrame:
    """``roles``: n, fraud_role; the last in ROLES counts. Others are normal."""
    rank = F.array_position(F.lit(list(ROLES)), F.col("fraud_role"))
    roles = roles.groupBy("n").agg(F.max_by("fraud_role", rank).alias("fraud_role"))
    return acc.join(roles, "n", "left").withColumn("is_fraud", F.col("fraud_role").isNotNull()).withColumn("fraud_role", F.coalesce("fraud_role", F.lit("normal")))


def profile(acc: DataFrame, seed: int) -> DataFrame:
    """Rate, mean and deviation of log amount, and shares of the four kinds, from the template with noise of the account's own."""
    names = ["account_type", "kyc_level", "_rate", "_mu", "_sigma", *(f"share_{k}" for k, _, _ in KINDS)]
    rows = acc.join(F.broadcast(acc.sparkSession.createDataFrame(TEMPLATES, names)), ["account_type", "kyc_level"])
    return rows.withColumns({
        "rate": F.greatest(F.col("_rate") * (1 + 0.1 * normal(seed + 11, "n")), F.lit(0.1)),
        "mu": F.col("_mu") + 0.2 * normal(seed + 12, "n"),
        "sigma": F.greatest(F.col("_sigma") + 0.1 * normal(seed + 13, "n"), F.lit(0.3)),
    }).drop("_rate", "_mu", "_sigma")


def poisson(u: Column, rate: Column, most: int = 5) -> Column:
    """The Poisson number at quantile ``u``, ``most`` at most."""
    term = below = F.exp(-rate)
    out = F.when(u < below, 0)
    for k in range(1, most):
        term = term * rate / k
        below = below + term
        out = out.when(u < below, k)
    return out.otherwise(most)


def _txn(rows: DataFrame, tag: str, sender: Column, receiver: Column, amount: Column, at: Column, kind: Column | str, pattern: str) -> DataFrame:
    """Rows with integer ends, seconds since the start, and an amount; ids come from the tag and ``k``."""
    return rows.select(
        deterministic_id(F.lit(tag), F.col("k").cast("string")).alias("transaction_id"), sender.cast("long").alias("s"), receiver.cast("long").alias("r"), F.round(F.least(F.greatest(amount, F.lit(0.01)), F.lit(1e6)), 2).alias("amount"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=at.cast("decimal(18,6)"))).alias("timestamp"), (F.lit(kind) if isinstance(kind, str) else kind).alias("transaction_type"), F.lit(pattern != "none").alias("is_fraud"), F.lit(pattern).alias("fraud_pattern"),
    ).filter("s <> r")


def normal_transactions(acc: DataFrame, cfg: Simulation = Simulation()) -> DataFrame:
    """Traffic of normal accounts: each day has a budget (less at weekends, with noise) and draws senders among
    the accounts that exist, with replacement and no more draws than accounts; a draw makes one to five
    transactions by the sender's rate until the budget is spent, each to any other account.

    Accounts are numbered by day of creation, in cells, so a draw is a rank and an equi-join; what a
    draw adds to its day is summed in blocks. No window holds a whole day. Only tables of a row
    a day (and cell) are broadcast or ordered in one task.
    """
    n, days, s = cfg.total_accounts, cfg.simulation_days, cfg.seed
    spark = acc.sparkSession
    micros = F.timestamp_diff("MICROSECOND", F.lit(START).cast("timestamp_ntz"), "creation_date")
    senders = acc.filter("fraud_role = 'normal'").withColumn("born", F.ceil(micros / 86400e6).cast("long"))
    senders = senders.withColumn("cell", F.pmod(F.xxhash64("n"), F.lit(CELLS)))
    cells = senders.groupBy("born", "cell").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("born", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("born", "cell").orderBy("n")) - 1
    ranked = profile(senders.join(F.broadcast(cells.withColumn("before", before)), ["born", "cell"]).withColumn("rank", rank), s)

    per_day = cfg.total_transactions / days
    cap = math.ceil(1.6 * per_day) + 1  # beyond six deviations of the noise
    factor = F.when((F.weekday(F.lit(START).cast("date")) + F.col("day")) % 7 >= 5, 0.4).otherwise(1.0)
    budget = F.floor(per_day * F.col("factor"))
    budget = F.least(F.greatest(budget + (0.1 * budget * normal(s + 20, "day")).cast("long"), F.lit(1)), F.lit(cap))
    each = spark.range(days).withColumnRenamed("id", "day").withColumn("factor", factor).withColumn("budget", budget)
    born = cells.groupBy(F.col("born").alias("day")).agg(F.sum("count").alias("new"))
    active = F.coalesce(F.sum("new").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    each = each.join(born, "day", "left").withColumn("active", active).drop("new")

    draws = spark.range(days * cap).select("id", F.expr(f"id div {cap}").alias("day"), (F.col("id") % cap).alias("j"))
    draws = draws.join(F.broadcast(each), "day").filter("j < least(budget, active)")
    draws = draws.withColumn("rank", F.floor(unit(s + 21, "id") * F.col("active"))).join(ranked, "rank")
    count = F.greatest(poisson(unit(s + 28, "id"), F.col("rate") * F.col("factor") * 10 / days), F.lit(1))
    draws = draws.withColumn("count", count).withColumn("block", F.expr(f"j div {BLOCK}"))
    blocks = draws.groupBy("day", "block").agg(F.sum("count").alias("sum"))
    upto = Window.partitionBy("day").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("day", "block", F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("spent"))
    within = Window.partitionBy("day", "block").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("spent") - F.coalesce(F.sum("count").over(within), F.lit(0))
    rows = draws.join(blocks, ["day", "block"]).withColumn("count", F.least("count", left)).filter("count > 0")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int")))).withColumn("k", F.col("id") * 8 + F.col("nth"))

    rows = rows.withColumn("kind", own_choice(unit(s + 27, "k"), {k: F.col(f"share_{k}") for k, _, _ in KINDS}))
    shift, width = (choose_map("kind", {x[0]: x[i] for x in KINDS}) for i in (1, 2))
    amount = F.exp(F.col("mu") + shift + F.greatest(F.col("sigma") * width, F.lit(0.3)) * normal(s + 26, "k"))
    at = F.col("day") * 86400 + choose(unit(s + 23, "k"), tuple(enumerate(HOURS))) * 3600 + F.floor(unit(s + 25, "k") * 3600)
    other = F.pmod(F.col("n") + 1 + F.floor(unit(s + 22, "k") * (n - 1)), F.lit(n))
    return _txn(rows, "normal", F.col("n"), other, amount, at, F.col("kind"), "none")


def own_choice(u: Column, weights: dict[str, Column]) -> Column:
    """A name by weights that differ from row to row."""
    total = sum(weights.values(), F.lit(0.0))
    at, out, names = F.lit(0.0), None, list(weights)
    for name in names[:-1]:
        at = at + weights[name] / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return out.otherwise(names[-1])


def choose_map(column: str, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


def allocate(cfg: Simulation, fraud: Fraud) -> dict[str, tuple[int, int]]:
    """pattern -> [from, to) of the mules, which are the first accounts; a remainder of the shares has no pattern."""
    total = min(max(10, math.floor(cfg.total_accounts * cfg.fraud_ratio)), cfg.total_accounts)
    shares = {"funnel": fraud.funnel_share, "circular": fraud.circular_share, "layering": fraud.layering_share, "dormant": fraud.dormant_share, "device": fraud.device_share}
    sizes = {k: max(1, math.floor(total * v)) for k, v in shares.items()}
    if (asked := sum(sizes.values())) > total:
        sizes = {k: max(1, math.floor(v * total / asked)) for k, v in sizes.items()}
    out, at = {}, 0
    for name, size in sizes.items():
        out[name] = (at, min(at + size, total))
        at = out[name][1]
    return out


def inject(spark: SparkSession, cfg: Simulation = Simulation(), fraud: Fraud = Fraud()) -> tuple[DataFrame, DataFrame]:
    """Fraud transactions of the five patterns (integer ends), and roles: n, fraud_role. Mules are the first accounts.

    Sizes of funnels, bursts and pairs are drawn per group, those of the one ring and the one chain per
    simulation. A pattern with too few mules, or no account outside it, has no transactions.
    """
    s, n, days = cfg.seed + 1000, cfg.total_accounts, cfg.simulation_days
    part = allocate(cfg, fraud)
    dice = random.Random(s)
    out: list[DataFrame] = []
    roles: list[tuple[int, int, str]] = []

    def grid(groups: int, most: int) -> DataFrame:
        rows = spark.range(groups).withColumnRenamed("id", "g").select("g", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("i"))
        return rows.withColumn("k", F.col("g") * 1000 + F.col("i"))

    def between(k: int, lo, hi, *key: str) -> Column:
        """Uniform in [lo, hi)."""
        return lo + unit(s + k, *key) * (hi - lo)

    def day(k: int, lo, hi: int, *key: str) -> Column:
        """Seconds to a whole day in [lo, hi); the last possible day where that is empty."""
        lo = F.least(F.lit(lo) if isinstance(lo, int) else lo, F.lit(max(0, hi - 1)))
        return F.floor(between(k, lo, F.greatest(F.lit(hi), lo + 1), *key)) * 86400

    def lognormal(k: int, mu: float, sigma: float, *key: str) -> Column:
        return F.exp(mu + sigma * normal(s + k, *key))

    def outside(k: int, name: str) -> Column:
        """The i-th of group g's different accounts outside the pattern."""
        lo, hi = part[name]
        m = n - (hi - lo)
        step = 1 + F.floor(unit(s + k, "g") * max(0, m // 32 - 1))
        at = F.pmod(F.floor(unit(s + k + 1, "g") * m) + F.col("i") * step, F.lit(m))
        return F.when(at < lo, at).otherwise(at + (hi - lo))

    def room(name: str) -> int:
        return n - (part[name][1] - part[name][0])

    def add(rows: DataFrame, tag: str, sender, receiver, amount, at, pattern: str) -> None:
        out.append(_txn(rows, tag, sender, receiver, amount, at, "p2p", pattern))

    g, i = F.col("g"), F.col("i")
    lo, hi = part["funnel"]
    funnels = max(1, (hi - lo) // 3)
    paid = min(max(1, funnels // 2), hi - lo - funnels)
    roles += [(lo, lo + funnels, "mule_funnel"), (lo + funnels, lo + funnels + paid, "beneficiary")]
    if hi > lo and room("funnel") > 0:
        begin = day(1, days // 4, days * 3 // 4, "g")
        most = max(fraud.funnel_min_inbound, 29)
        size = F.least(F.greatest(F.lit(fraud.funnel_min_inbound), F.floor(between(2, 10, 30, "g"))), F.lit(room("funnel")))
        rows = grid(funnels, most).filter(i < size)
        add(rows, "funnel-in", outside(3, "funnel"), g + lo, lognormal(5, 6.0, 0.8, "g", "i"), begin + between(6, 0, 43200, "g", "i") + i * 60, "funnel_inbound")
        if paid:
            late = begin + 3600 * between(8, 1, fraud.retention_hours, "g", "i")
            to = lo + funnels + F.pmod(g + i, F.lit(paid))
            add(grid(funnels, min(paid, PAID)), "funnel-out", g + lo, to, lognormal(7, 7.0, 0.5, "g", "i"), late, "funnel_outbound")

    lo, hi = part["circular"]
    if hi - lo >= fraud.cycle_min:
        length = dice.randrange(fraud.cycle_min, min(fraud.cycle_max, hi - lo) + 1)
        roles.append((lo, lo + length, "mule_circular"))
        begin = day(10, days // 4 + g * 5, min(days * 3 // 4, days - 1), "g")
        delay = between(11, 600, 7200, "g", "i") + between(12, 0, 60, "g", "i")
        amount = lognormal(13, 6.5, 0.6, "g") * between(14, 0.90, 1.05, "g", "i")
        add(grid(dice.randrange(2, 6), length), "circular", lo + i, lo + F.pmod(i + 1, F.lit(length)), amount, begin + delay * (i + 1), "circular_flow")

    lo, hi = part["layering"]
    if hi - lo >= fraud.layering_min and room("layering") > 0:
        length = dice.randrange(fraud.layering_min, min(fraud.layering_max, hi - lo) + 1)
        origin = dice.randrange(room("layering"))
        origin += 0 if origin < lo else hi - lo
        roles += [(origin, origin + 1, "originator"), (lo, lo + length - 1, "mule_layer"), (lo + length - 1, lo + length, "beneficiary")]
        begin = day(20, days // 3 + g * 7, min(days * 3 // 4, days - 1), "g")
        delay = between(21, 300, 2700, "g", "i") + between(22, 0, 60, "g", "i")
        amount = F.aggregate(F.sequence(F.lit(0), i), lognormal(23, 7.0, 0.7, "g"), lambda x, hop: x * between(24, 0.85, 0.95, "g", hop))
        sender = F.when(i == 0, origin).otherwise(lo + i - 1)
        add(grid(dice.randrange(2, 5), length), "layering", sender, lo + i, amount, begin + delay * (i + 1), "layering")

    lo, hi = part["dormant"]
    roles.append((lo, hi, "mule_dormant"))
    if hi > lo and room("dormant") > 0:
        latest = min(days - 10, 150)
        asleep = F.lit(min(60, max(1, latest))) if latest <= 60 else F.floor(between(30, 60, latest, "g"))
        wake = F.greatest(F.lit(fraud.dormant_days), asleep) + F.floor(between(31, 1, 5, "g"))
        wake = F.when(wake >= days, max(0, days - 5)).otherwise(wake) * 86400
        size = F.least(F.floor(F.floor(between(32, 8, 25, "g")) / 2) + 1, F.lit(room("dormant")))
        rows, half = grid(hi - lo, 13).filter(i < size), fraud.burst_hours * 1800
        add(rows, "dormant-in", outside(33, "dormant"), g + lo, lognormal(35, 6.0, 1.0, "g", "i"), wake + between(36, 0, half, "g", "i") + i * 180, "dormant_inbound")
        add(rows, "dormant-out", g + lo, outside(37, "dormant"), lognormal(39, 6.5, 0.8, "g", "i"), wake + between(40, half, 2 * half, "g", "i") + i * 120, "dormant_outbound")

    lo, hi = part["device"]
    if hi - lo >= 2:
        roles.append((lo, hi, "mule_device_cluster"))
        rows = grid(hi - lo - 1, 7).filter(i < F.floor(between(50, 3, 8, "g")))
        at = day(51, days // 4, days * 3 // 4, "g", "i") + between(52, 0, 86400, "g", "i") + i * 300
        add(rows, "device", g + lo, g + lo + 1, lognormal(53, 5.5, 0.9, "g", "i"), at, "device_sharing")
        if room("device") > 0:
            rows = grid(hi - lo, 5).filter(i < F.least(F.floor(between(54, 2, 6, "g")), F.lit(room("device"))))
            at = day(55, days // 3, days * 2 // 3, "g", "i") + between(56, 0, 86400, "g", "i")
            add(rows, "device-out", g + lo, outside(57, "device"), lognormal(59, 5.0, 1.0, "g", "i"), at, "device_sharing_external")

    named = [spark.range(a, b).select(F.col("id").alias("n"), F.lit(role).alias("fraud_role")) for a, b, role in roles]
    if not out:
        add(grid(0, 1), "none", g, g, F.lit(1.0), F.lit(0), "none")
    return functools.reduce(DataFrame.unionByName, out), functools.reduce(DataFrame.unionByName, named)


def simulate(spark: SparkSession, cfg: Simulation = Simulation(), fraud: Fraud = Fraud()) -> tuple[DataFrame, DataFrame]:
    """(accounts, transactions) of a whole simulation."""
    bad, roles = inject(spark, cfg, fraud)
    acc = assign_roles(accounts(spark, cfg), roles)
    lo, hi = allocate(cfg, fraud)["device"]
    hi = hi if hi - lo >= 2 else lo
    shared = deterministic_id(F.lit("shared"), F.lit(str(cfg.seed)))
    acc = acc.withColumn("device_fingerprint_id", F.when((F.col("n") >= lo) & (F.col("n") < hi), shared).otherwise(F.col("device_fingerprint_id")))
    txns = normal_transactions(acc, cfg).unionByName(bad)
    ids = acc.select("n", "account_id")
    txns = txns.join(ids.select(F.col("n").alias("s"), F.col("account_id").alias("sender_id")), "s").join(ids.select(F.col("n").alias("r"), F.col("account_id").alias("receiver_id")), "r")
    txns = txns.select("transaction_id", "sender_id", "receiver_id", "amount", "timestamp", "transaction_type", "is_fraud", "fraud_pattern")
    return acc.drop("n"), txns
