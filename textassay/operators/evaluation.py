"""Evaluation of scored, labelled rows: decisions, confusion, calibration, curves, thresholds and tests.

Rows are (method, score, truth[, id]). Curves count rows by score and take running counts over sampled ranges of scores
(`ranks.running`), so no task holds a method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running

RESOLUTION = 10  # decimals of a score in curves: as many as the scorers compute


def decide(score: Column, threshold: Column, margin: float = 0.1, inverted: bool = False) -> Column:
    """ACCEPT from the threshold on, ESCALATE within the margin below it, else REJECT; inverted: low scores are good and the margin is relative."""
    if inverted:
        return F.when(score <= threshold, "ACCEPT").when(score <= threshold * (1 + margin), "ESCALATE").otherwise("REJECT")
    return F.when(score >= threshold, "ACCEPT").when(score >= threshold - margin, "ESCALATE").otherwise("REJECT")


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and ratios by group; escalated rows count as rejected. A ratio over nothing is zero."""
    yes = F.col("decision") == "ACCEPT"
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yes & F.col("truth")).alias("tp"), F.count_if(yes & ~F.col("truth")).alias("fp"),
        F.count_if(~yes & ~F.col("truth")).alias("tn"), F.count_if(~yes & F.col("truth")).alias("fn"), F.count_if(F.col("decision") == "ESCALATE").alias("escalated"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _over(tp, tp + fp), _over(tp, tp + fn)
    r = lambda x: F.round(x, 9)
    return counts.select(
        *by, "n", "tp", "fp", "tn", "fn", r(_over(F.col("escalated"), F.col("n"))).alias("escalation_rate"), r(precision).alias("precision"), r(recall).alias("recall"),
        r(_over(2 * tp, 2 * tp + fp + fn)).alias("f1"), r(_over(tp + tn, F.col("n"))).alias("accuracy"), r(_over(fp, fp + tn)).alias("false_alarm_rate"), r(_over(fn, tp + fn)).alias("miss_rate"),
    )


def calibration(rows: DataFrame, *by: str, bins: int = 10) -> DataFrame:
    """ece_ref and mce_ref take a bin's midpoint against its accepted truths; ece_std the mean score against the truths."""
    binned = rows.withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)))
    per = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("truth") & (F.col("decision") == "ACCEPT"), 1.0).otherwise(0.0)).alias("hits"),
        F.sum(F.when(F.col("truth"), 1.0).otherwise(0.0)).alias("truths"), F.sum("score").alias("scores"),
    )
    gap = F.abs(F.col("hits") / F.col("n") - (F.col("bin") + 0.5) / bins)
    std = F.abs(F.col("truths") - F.col("scores"))
    return per.groupBy(*by).agg(
        F.round(F.sum(gap * F.col("n")) / F.sum("n"), 6).alias("ece_ref"), F.round(F.max(gap), 6).alias("mce_ref"), F.round(F.sum(std) / F.sum("n"), 6).alias("ece_std")
    )


def brier_log_loss(rows: DataFrame, *by: str) -> DataFrame:
    y, p = F.when(F.col("truth"), 1.0).otherwise(0.0), F.greatest(F.least(F.col("score"), F.lit(1 - 1e-10)), F.lit(1e-10))
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return rows.groupBy(*by).agg(F.round(F.avg((F.col("score") - y) * (F.col("score") - y)), 6).alias("brier"), F.round(F.avg(loss), 6).alias("log_loss"))


def score_counts(rows: DataFrame, *by: str) -> DataFrame:
    """(by, score, pos, neg): rows counted by score at the curves' resolution."""
    return rows.groupBy(*by, F.round("score", RESOLUTION).alias("score")).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))


def curve(rows: DataFrame, *by: str) -> DataFrame:
    """One point for each score: tp and fp at or above it, all positives and negatives, tpr, fpr, precision."""
    run = running(score_counts(rows, *by), "score", ["pos", "neg"], *by)
    at = run.select(*by, "score", "pos", "neg", (F.col("all_pos") - F.col("before_pos")).alias("tp"), (F.col("all_neg") - F.col("before_neg")).alias("fp"), F.col("all_pos").alias("p"), F.col("all_neg").alias("n"))
    return at.select("*", _over(F.col("tp"), F.col("p")).alias("tpr"), _over(F.col("fp"), F.col("n")).alias("fpr"), _over(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def areas(rows: DataFrame, *by: str) -> DataFrame:
    """Rank-based ROC area with half credit for ties, the trapezoid from the first point on, and average precision. The
    point before each one follows from its own counts."""
    above_tp, above_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    first = above_tp + above_fp == 0
    before, fpr_before = _over(above_tp, F.col("p")), _over(above_fp, F.col("n"))
    out = curve(rows, *by).groupBy(*by).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("wins"), F.max("p").alias("p"), F.max("n").alias("n"),
        F.sum(F.when(~first, (F.col("fpr") - fpr_before) * (F.col("tpr") + before) / 2)).alias("trapezoid"),
        F.sum((F.col("tpr") - before) * F.col("precision")).alias("auprc"),
    )
    return out.select(*by, F.round(_over(F.col("wins"), F.col("p") * F.col("n")), 6).alias("auroc"), F.round(F.coalesce("trapezoid", F.lit(0.0)), 6).alias("auroc_ref"), F.round("auprc", 6).alias("auprc"))


def best_f1(rows: DataFrame, *by: str) -> DataFrame:
    """The cut with the largest F1, the lowest of ties."""
    f1 = F.round(_over(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), 9)
    return curve(rows, *by).groupBy(*by).agg(F.max_by("score", F.struct(f1, -F.col("score"))).alias("threshold"), F.max(f1).alias("f1"))


def grid_rates(rows: DataFrame, grid: list[float], *by: str) -> DataFrame:
    """tp, fp, fn, tn at every threshold of a short grid, from score counts."""
    counts = score_counts(rows, *by).withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    yes = F.col("score") >= F.col("threshold")
    return counts.groupBy(*by, "threshold").agg(
        F.sum(F.when(yes, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(yes, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~yes, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~yes, F.col("neg")).otherwise(0)).alias("tn"),
    )


def best_of_grid(rows: DataFrame, grid: list[float], measure: str, *by: str) -> DataFrame:
    """The grid threshold with the largest F1 or Youden index, the lowest of ties."""
    r = grid_rates(rows, grid, *by)
    value = {
        "f1": _over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        "youden": _over(F.col("tp"), F.col("tp") + F.col("fn")) - _over(F.col("fp"), F.col("fp") + F.col("tn")),
    }[measure]
    value = F.round(value, 9)
    return r.groupBy(*by).agg(F.max_by("threshold", F.struct(value, -F.col("threshold"))).alias("threshold"), F.max(value).alias(measure))


def pairwise_mcnemar(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Method pairs: discordant counts, the continuity-corrected statistic and its p-value (erfc by a rational approximation)."""
    right = (F.col("decision") == "ACCEPT") == F.col("truth")
    each = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("method", right.alias("ok")))).alias("m"))  # one entry for each method
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["method"] > a["method"]), lambda b: F.struct(a["method"].alias("a"), b["method"].alias("b"), a["ok"].alias("x"), b["ok"].alias("y")))))
    counts = each.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count_if(F.expr("p.x AND NOT p.y")).alias("only_a"), F.count_if(F.expr("p.y AND NOT p.x")).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    gap = F.abs(F.col("only_a") - F.col("only_b")) - 1
    chi = F.when(n > 0, gap * gap / n).otherwise(0.0)
    return counts.select(F.col("a").alias("method_a"), F.col("b").alias("method_b"), "only_a", "only_b", F.round(chi, 6).alias("chi2"), F.round(erfc(F.sqrt(chi / 2)), 6).alias("p_value"))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to about 1e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def separation(rows: DataFrame, *by: str) -> DataFrame:
    """Means and deviations of true and false rows, their distance, and Cohen's d both with population and pooled sample deviations, and t."""
    t, f = F.when(F.col("truth"), F.col("score")), F.when(~F.col("truth"), F.col("score"))
    a = rows.groupBy(*by).agg(
        F.avg(t).alias("mt"), F.avg(f).alias("mf"), F.stddev_pop(t).alias("st"), F.stddev_pop(f).alias("sf"), F.var_samp(t).alias("vt"), F.var_samp(f).alias("vf"), F.count(t).alias("nt"), F.count(f).alias("nf")
    )
    pooled = F.sqrt(((F.col("nt") - 1) * F.col("vt") + (F.col("nf") - 1) * F.col("vf")) / (F.col("nt") + F.col("nf") - 2))
    gap = F.col("mt") - F.col("mf")
    pop = F.sqrt((F.col("st") * F.col("st") + F.col("sf") * F.col("sf")) / 2)
    over = lambda x: F.when(x > 0, gap / x).otherwise(0.0)
    r = lambda x: F.round(x, 6)
    return a.select(
        *by, r(F.col("mt")).alias("mean_true"), r(F.col("mf")).alias("mean_false"), r(F.col("st")).alias("std_true"), r(F.col("sf")).alias("std_false"), r(F.abs(gap)).alias("separation"),
        r(over(pop)).alias("d_pop"), r(over(pooled)).alias("d_pooled"), r(over(pooled * F.sqrt(1 / F.col("nt") + 1 / F.col("nf")))).alias("t"),
    )


def two_sample_ks(rows: DataFrame, value: str, is_second: Column, *by: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples by group, and its p-value by ten terms of the series."""
    counts = rows.groupBy(*by, value).agg(F.count_if(~is_second).alias("a"), F.count_if(is_second).alias("b"))
    run = running(counts, value, ["a", "b"], *by).filter("all_a > 0 AND all_b > 0")
    share = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.col(f"all_{c}")
    d = run.groupBy(*by).agg(F.max(F.abs(share("a") - share("b"))).alias("d"), F.max("all_a").alias("n1"), F.max("all_b").alias("n2"))
    en = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0), lambda acc, j: acc + 2 * F.pow(F.lit(-1.0), (j - 1).cast("double")) * F.exp(-2.0 * j * j * lam * lam))
    return d.select(*by, "n1", "n2", F.round("d", 9).alias("ks"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)), 6).alias("p_value"))


def bootstrap(rows: DataFrame, id_col: str, replicates: int, *by: str) -> DataFrame:
    """2.5 and 97.5 percentiles and deviation of resampled accuracy, precision and recall.

    A row's weight in a replicate is Poisson(1), drawn from a hash of its id and the replicate, so resampling needs no
    random state and one shuffle of partial sums.
    """
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.col("k").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = F.lit(0)
    total, p = 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        weight = F.when(u >= total, k).otherwise(weight)
        p /= k
    yes = F.col("decision") == "ACCEPT"
    w = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0))
    drawn = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    per = drawn.groupBy(*by, "k").agg(F.sum("w").alias("n"), w(yes & F.col("truth")).alias("tp"), w(yes & ~F.col("truth")).alias("fp"), w(~yes & F.col("truth")).alias("fn"))
    measures = {"accuracy": (F.col("n") - F.col("fp") - F.col("fn"), F.col("n")), "precision": (F.col("tp"), F.col("tp") + F.col("fp")), "recall": (F.col("tp"), F.col("tp") + F.col("fn"))}
    out = []
    for name, (a, b) in measures.items():
        v = F.round(_over(a, b), 9)
        out += [F.round(F.percentile(v, F.lit(0.025)), 6).alias(f"{name}_low"), F.round(F.percentile(v, F.lit(0.975)), 6).alias(f"{name}_high"), F.round(F.stddev_pop(v), 6).alias(f"{name}_se")]
    return per.groupBy(*by).agg(*out)


def permutation(rows: DataFrame, id_col: str, a: str, b: str, permutations: int) -> DataFrame:
    """Accuracy difference of methods a and b, and the share of sign-flipped permutations at least as far from zero."""
    right = ((F.col("decision") == "ACCEPT") == F.col("truth")).cast("int")
    each = rows.filter(F.col("method").isin(a, b)).groupBy(id_col).agg((F.sum(F.when(F.col("method") == a, right).otherwise(0)) - F.sum(F.when(F.col("method") == b, right).otherwise(0))).alias("gap"))
    flip = F.conv(F.substring(F.sha2(F.concat_ws("#", F.col(id_col).cast("string"), F.col("k").cast("string")), 256), 1, 2), 16, 10).cast("int") % 2 == 0
    sums = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(permutations)))).groupBy("k").agg(F.sum(F.when((F.col("k") > 0) & flip, -F.col("gap")).otherwise(F.col("gap"))).alias("s"), F.count(F.lit(1)).alias("n"))
    seen = F.max(F.when(F.col("k") == 0, F.col("s")))
    both = sums.agg(seen.alias("s"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("k") > 0, F.abs("s")))).alias("all"))  # one number for each permutation
    return both.select(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.round(F.col("s") / F.col("n"), 9).alias("difference"), F.round(F.size(F.filter("all", lambda x: x >= F.abs("s"))) / permutations, 9).alias("p_value"))
