"""Values in force at a time, counter rates, quantiles of histograms, and conditions that last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running, sliding


def in_force(rows: DataFrame, ts: str, changes: DataFrame, changed: str, carried: Sequence[str], *by: str) -> DataFrame:
    """rows with the `carried` columns of the last change of their group at or before their time; nulls before the first.

    A change's number in its group is counted beside the rows over ranges of time (`ranks.running`), and the join is on
    that number, so neither a long timeline nor many rows between two changes meet in one task. Of changes at one time the
    last by `carried` is in force.
    """
    both = rows.select(*by, F.col(ts).alias("__ts"), F.lit(1).alias("__kind"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(changes.select(F.struct(*carried)).schema[0].dataType).alias("__change"))
    marks = changes.select(*by, F.col(changed).alias("__ts"), F.lit(0).alias("__kind"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("__row"), F.struct(*carried).alias("__change"))
    line = both.unionByName(marks).withColumn("__one", (F.col("__kind") == 0).cast("long"))
    numbered = running(line, ["__ts", "__kind", "__change"], ["__one"], *by)
    given = numbered.filter("__kind = 0").select(*(F.col(b).alias(f"__g{k}") for k, b in enumerate(by)), (F.col("before___one") + 1).alias("__number"), "__change")
    same = F.col("before___one") == F.col("__number")
    for k, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__g{k}"))
    asked = numbered.filter("__kind = 1").drop("__change")
    return asked.join(given, same, "left").select("__row.*", *(F.col("__change")[c].alias(c) for c in carried))


def active_versions(log: DataFrame, ts: str, ident: str, *by: str) -> DataFrame:
    """log(action, version) with `active` and `previous` after each entry, for a registry of each group.

    activate puts a version in force, revert swaps it with the previous one, retire leaves none in force, register changes
    nothing. Entries of one time follow by ident. An entry's version depends on the last activation and on how many reverts
    came since, so windows suffice; a registry's log is as long as its history of releases.
    """
    w = Window.partitionBy(*by).orderBy(ts, ident)
    sets = F.col("action").isin("activate", "retire")
    spans = log.withColumn("__span", F.sum(sets.cast("int")).over(w))
    inside = Window.partitionBy(*by, "__span").orderBy(ts, ident)
    odd = F.sum((F.col("action") == "revert").cast("int")).over(inside) % 2 == 1
    put = F.first(F.when(F.col("action") == "activate", F.col("version")), ignorenulls=False).over(inside)
    placed = spans.withColumn("__put", F.when(F.col("__span") > 0, put)).withColumn("__odd", F.coalesce(odd, F.lit(False)))
    last = placed.groupBy(*by, "__span").agg(F.max_by(F.struct("__put", "__odd"), F.struct(ts, ident)).alias("x"))
    # what stood aside before a span: the last span's own version if it ended in force, else what stood aside before it
    order = Window.partitionBy(*by).orderBy("__span")
    ended = last.select(*by, "__span", F.when(~F.col("x.__odd"), F.struct(F.col("x.__put").alias("v"))).alias("__kept"))
    aside = ended.select(*(F.col(b).alias(f"__h{k}") for k, b in enumerate(by)), F.col("__span").alias("__at"), F.last("__kept", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__aside"))
    same = F.col("__span") == F.col("__at")
    for k, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__h{k}"))
    joined = placed.join(aside, same)
    here, there = F.col("__put"), F.col("__aside.v")
    return joined.select(*log.columns, F.when(F.col("__odd"), there).otherwise(here).alias("active"), F.when(F.col("__odd"), here).otherwise(there).alias("previous"))


def increases(samples: DataFrame, value: str, ts: str, *by: str) -> DataFrame:
    """samples of counters with `increase` since the one before in their series; a counter that fell began anew at zero. The
    first sample of a series has none."""
    dealt, w = sliding(samples, [ts, value], 1, *by)
    before = F.first(value).over(w)
    first = F.count(F.lit(1)).over(w) == 1
    step = F.when(first, F.lit(0.0)).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value)).cast("double")
    return dealt.withColumn("increase", step).filter("own").select(*samples.columns, "increase")


def rates(samples: DataFrame, value: str, ts: str, width_s: int, step_s: int, *by: str) -> DataFrame:
    """(by, at, rate): increase a second over the width before each step, for windows that hold a sample. Not extrapolated
    to the window's ends."""
    w = F.window(F.col(ts).cast("timestamp"), f"{width_s} seconds", f"{step_s} seconds")
    each = increases(samples, value, ts, *by).groupBy(*by, w.alias("w")).agg(F.sum("increase").alias("total"))
    return each.select(*by, F.col("w.end").alias("at"), (F.col("total") / width_s).alias("rate"))


def histogram_quantile(q: float, buckets: DataFrame, upper: str, count: str, *by: str) -> DataFrame:
    """(by, quantile) from cumulative buckets by upper bound (the last is infinite): interpolated inside the bucket that
    holds the rank, from zero in the first; the largest finite bound if that is the last; null if there is nothing."""
    held = buckets.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(upper).cast("double").alias("le"), F.col(count).cast("double").alias("n")))).alias("b"))  # as many as there are bounds
    rank = q * F.element_at("b", -1)["n"]
    place = F.aggregate("b", F.lit(0), lambda a, x: a + (x["n"] < rank).cast("int"))
    here, before = F.get("b", place), F.get("b", place - 1)
    low, start = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["n"], F.lit(0.0))
    inside = low + (here["le"] - low) * F.try_divide(rank - start, here["n"] - start)
    found = F.when(F.element_at("b", -1)["n"] > 0, F.when(here["le"] == float("inf"), before["le"]).otherwise(F.coalesce(inside, low)))
    return held.select(*by, found.alias("quantile"))


def firing(states: DataFrame, at: str, on: Column, step_s: int, for_s: int, *by: str) -> DataFrame:
    """states with `firing`: the condition has held at every step for `for_s` seconds up to here. A missing step breaks it."""
    w = Window.partitionBy(*by).orderBy(at)
    seconds = F.unix_timestamp(F.col(at))
    marked = states.withColumn("__on", F.coalesce(on, F.lit(False))).withColumn("__s", seconds)
    starts = F.col("__on") & ~(F.coalesce(F.lag("__on").over(w), F.lit(False)) & (F.col("__s") - F.lag("__s").over(w) == step_s))
    runs = marked.withColumn("__run", F.sum(starts.cast("int")).over(w))
    since = F.min("__s").over(Window.partitionBy(*by, "__run", "__on"))
    return runs.withColumn("firing", F.col("__on") & (F.col("__s") - since >= for_s)).select(*states.columns, "firing")
