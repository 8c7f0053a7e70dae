"""Operational analytics: first-write-wins, quotas, rings, divergence, tiers, costs, forecasts and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .ranks import running


def first_write_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Aggregated, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("__first")).select(*keys, "__first.*")


def first_write_with_ttl(rows: DataFrame, keys: list[str], ts: str, ttl_seconds: int) -> DataFrame:
    """Accepted writes: the first of each key, and each that comes once the last accepted one has expired.

    Each time points to the first one that it would let pass. Such pointers are found by ranks, where a time and its expiry
    are ordered together, and followed from the first time on by doubling: a step reaches as many more as were reached
    before, so the steps grow with the logarithm of a key's accepted writes, and no key's times are gathered.
    """
    gap = ttl_seconds * 1_000_000
    times = rows.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t")).filter("__t IS NOT NULL").distinct()
    both = times.select(*keys, "__t", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("__one"))  # expiries, 0, come before equal times
    placed = running(both.withColumn("__at", F.col("__t") + F.when(F.col("__one") == 0, gap).otherwise(0)), ["__at", "__one"], ["__one"], *keys)
    of = lambda one: F.max(F.when(F.col("__one") == one, F.col("before___one")))
    linked = placed.groupBy(*keys, "__t").agg(of(1).alias("__r"), of(0).alias("__next"), F.max("all___one").alias("__n"))
    linked = staged(linked.withColumn("__next", F.when(F.col("__next") < F.col("__n"), F.col("__next"))).drop("__n"), "expiries")
    named = [f"__k{i}" for i in range(len(keys))]

    def follow(left: DataFrame, jumps: DataFrame) -> DataFrame:
        """left's rows with __to: where the jump from their __next, or from themselves, leads."""
        there = jumps.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col("__r").alias("__from"), F.col("__next").alias("__to")).filter("__to IS NOT NULL")
        same = F.col("__key") == F.col("__from")
        for k, n in zip(keys, named):
            same &= F.col(k).eqNullSafe(F.col(n))
        return left.join(there, same, "left").drop(*named, "__from", "__key")

    reached, jumps = linked.filter("__r = 0").select(*keys, "__r"), linked.drop("__t")
    while jumps.filter("__next IS NOT NULL").limit(1).count():
        new = follow(reached.withColumn("__key", F.col("__r")), jumps).filter("__to IS NOT NULL").select(*keys, F.col("__to").alias("__r"))
        reached = staged(reached.unionByName(new).distinct(), "reached")
        jumps = staged(follow(jumps.withColumn("__key", F.col("__next")), jumps).drop("__next").withColumnRenamed("__to", "__next"), "jumps")
    at = reached.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col("__r").alias("__from"))
    same = F.col("__r") == F.col("__from")
    for k, n in zip(keys, named):
        same &= F.col(k).eqNullSafe(F.col(n))
    return linked.join(at, same, "left_semi").select(*keys, F.timestamp_micros("__t").alias(ts))


def within_quota(rows: DataFrame, tenant: str, ts: str, order: list[str], quota: int) -> DataFrame:
    """rows with admitted: the tenant's first quota rows of a day."""
    w = Window.partitionBy(tenant, F.to_date(ts)).orderBy(*order)
    return rows.withColumn("admitted", F.row_number().over(w) <= quota)


def ring_hash(key: Column) -> Column:
    """First four bytes of the key's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")


def bucket_of(key: Column, buckets: int = 100) -> Column:
    """Twelve hexadecimal digits of SHA-256 modulo buckets."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def divergence(a: Column, b: Column) -> Column:
    """Difference over the mean; zero for two zeros."""
    return F.when(a + b > 0, F.abs(a - b) / ((a + b) / 2)).otherwise(0.0)


def divergence_action(d: Column) -> Column:
    return F.when(d > 0.5, "manual").when(d > 0.2, "replay").when(d > 0.05, "monitor").otherwise("none")


@dataclass(frozen=True)
class Tiers:
    """Seconds since the last access after which a key leaves a tier."""

    hot: int = 3600
    warm: int = 7 * 86400


def tier_of(age_seconds: Column, tiers: Tiers = Tiers()) -> Column:
    return F.when(age_seconds < tiers.hot, "hot").when(age_seconds < tiers.warm, "warm").otherwise("cold")


@dataclass(frozen=True)
class Prices:
    """USD by unit of use."""

    compute: float = 0.00002
    storage: float = 0.000001
    network: float = 0.00009
    anchor: float = 0.001


def budget_action(spent: Column, limit: Column) -> Column:
    share = spent / limit
    return F.when(share >= 1.0, "deny").when(share >= 0.9, "throttle").when(share >= 0.7, "degrade").otherwise("allow")


def reconcile_status(share: Column) -> Column:
    return F.when(share <= 0.03, "reconciled").when(share <= 0.05, "warning").otherwise("discrepancy")


def exponential_level(rows: DataFrame, order: str, value: str, alpha: float, *by: str) -> DataFrame:
    """Level of simple exponential smoothing after each group's last point."""
    from .decisions import ewma

    return ewma(rows, value, [order], alpha, *by).withColumnRenamed("ewma", "level")


def flat_forecast(levels: DataFrame, days: int) -> DataFrame:
    """days rows of each level with bounds at 1.96 times ten per cent."""
    out = levels.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    return out.withColumn("low", F.greatest(F.lit(0.0), F.col("level") * (1 - 0.196))).withColumn("high", F.col("level") * 1.196)


def sliding_rates(rows: DataFrame, ts: str, width: str, slide: str, what: Column, *by: str) -> DataFrame:
    """Rows and the share of them with what, in sliding windows."""
    w = F.window(F.col(ts).cast("timestamp"), width, slide)
    return rows.groupBy(*by, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(what).alias("hits")).select(*by, F.col("w.start").alias("start"), "n", "hits")


def for_duration(rates: DataFrame, firing: Column, start: str, windows: int, *by: str) -> DataFrame:
    """rates where firing held in this window and the ones before it, windows in all."""
    w = Window.partitionBy(*by).orderBy(start).rowsBetween(-(windows - 1), 0)
    return rates.withColumn("__run", F.sum(firing.cast("int")).over(w)).filter(F.col("__run") == windows).drop("__run")


def oversample(rows: DataFrame, label: str, ratio: float = 0.4) -> DataFrame:
    """rows with the minority repeated when its share of the majority is under ratio."""
    counts = rows.groupBy(label).count()
    ends = counts.agg(F.max("count").alias("most"), F.min_by(label, "count").alias("rare"), F.min("count").alias("least"))
    times = F.when((F.col(label) == F.col("rare")) & (F.col("least") / F.col("most") < ratio), F.floor(F.col("most") / F.col("least"))).otherwise(1)
    return rows.crossJoin(F.broadcast(ends)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times.cast("bigint")))).drop("most", "rare", "least")  # ends is one row


def tier_probe(keys: DataFrame, key: str, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """keys with the first tier that holds them, and its value."""
    out = keys
    for name, df in tiers:
        out = out.join(df.select(key, F.struct(F.lit(name).alias("tier"), F.col("value")).alias(f"__{name}")), key, "left")
    found = F.coalesce(*(F.col(f"__{name}") for name, _ in tiers))
    return out.select(*keys.columns, found["tier"].alias("tier"), found["value"].alias("value"))


#: Anchoring strategies by cost of a batch in USD, latency in minutes and reliability.
ANCHORS = (("ethereum", 50.0, 15, 0.9999), ("polygon", 0.5, 5, 0.999), ("opentimestamps", 0.0, 120, 0.99), ("hybrid", 25.0, 10, 0.9995), ("adaptive", 10.0, 30, 0.999))


def best_anchor(strategies: DataFrame, goal: str, max_cost: float, max_minutes: float) -> DataFrame:
    """strategies with score; those over a limit score zero. goal: cost, latency or balanced."""
    cost, speed = 1.0 / (1.0 + F.col("cost")), 1.0 / (1.0 + F.col("minutes") / 60.0)
    value = {"cost": cost, "latency": speed, "balanced": (cost + speed) / 2}[goal]
    ok = (F.col("cost") <= max_cost) & (F.col("minutes") <= max_minutes)
    return strategies.withColumn("score", F.when(ok, value * F.col("reliability")).otherwise(0.0))
