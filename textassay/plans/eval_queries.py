"""Evaluation of the text scorers against the quality labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators.ranks import quantiles
from ..staging import staged
from .registry import Registry, table
from .text_queries import CONSISTENCY, SCORES_SQL, scores

query = Registry()

#: Methods and their thresholds.
THRESHOLDS = {"consistency": 0.45, "density": 0.6, "diversity": 0.6, "judged": 0.5}
MARGIN = 0.1
_T = "CASE method " + " ".join(f"WHEN '{m}' THEN {t}" for m, t in THRESHOLDS.items()) + " END"
METHODS_SQL = f"""SELECT doc_id, source, lang, method, score, truth, CASE WHEN score >= t THEN 'ACCEPT' WHEN score >= t - {MARGIN} THEN 'ESCALATE' ELSE 'REJECT' END AS decision
  FROM (SELECT doc_id, source, lang, method, score, truth, ({_T})::DOUBLE AS t FROM (
    SELECT s.doc_id, source, lang, quality = 1 AS truth, unnest(['consistency', 'density', 'diversity', 'judged']) AS method,
      unnest([{CONSISTENCY}, density, diversity, judged]) AS score FROM ({SCORES_SQL}) s JOIN labels l ON s.doc_id = l.doc_id))"""


def method_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, method, score, truth, decision) of every labelled document and method."""
    marked = scores(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"))
    wide = marked.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id").withColumn("consistency", F.expr(CONSISTENCY))
    long = wide.select("doc_id", "source", "lang", "truth", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score"), F.lit(t).alias("t")) for m, t in THRESHOLDS.items()))).alias("x"))
    return long.select("doc_id", "source", "lang", "x.method", "x.score", "truth", E.decide(F.col("x.score"), F.col("x.t"), MARGIN).alias("decision"))


def _sql(body: str) -> str:
    return f"WITH m AS ({METHODS_SQL}) {body}"


def _r(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END, 9)"


@query(_sql("SELECT method, decision, count(*) AS n FROM m GROUP BY 1, 2"))
def method_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return method_rows(spark, sf_dir).groupBy("method", "decision").agg(F.count(F.lit(1)).alias("n"))


_YES, _F = "decision = 'ACCEPT'", "count(*) FILTER (WHERE {})"
_CONF = f"""SELECT {{0}}, n, tp, fp, tn, fn, {_r('e', 'n')} AS escalation_rate, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall, {_r('2 * tp', '2 * tp + fp + fn')} AS f1,
  {_r('tp + tn', 'n')} AS accuracy, {_r('fp', 'fp + tn')} AS false_alarm_rate, {_r('fn', 'tp + fn')} AS miss_rate
  FROM (SELECT {{0}}, count(*) AS n, {_F.format(_YES + ' AND truth')} AS tp, {_F.format(_YES + ' AND NOT truth')} AS fp, {_F.format('NOT ' + _YES + ' AND NOT truth')} AS tn,
    {_F.format('NOT ' + _YES + ' AND truth')} AS fn, {_F.format("decision = 'ESCALATE'")} AS e FROM m GROUP BY {{0}})"""


@query(_sql(_CONF.format("method")))
def confusion_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(method_rows(spark, sf_dir), "method")


@query(_sql(_CONF.format("method, source")))
def confusion_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(method_rows(spark, sf_dir), "method", "source")


@query(_sql("""SELECT method, round(sum(abs(hits / n - (bin + 0.5) / 10) * n) / sum(n), 6) AS ece_ref, round(max(abs(hits / n - (bin + 0.5) / 10)), 6) AS mce_ref, round(sum(abs(truths - scores)) / sum(n), 6) AS ece_std
  FROM (SELECT method, least(floor(score * 10), 9) AS bin, count(*) AS n, count(*) FILTER (WHERE truth AND decision = 'ACCEPT')::DOUBLE AS hits, count(*) FILTER (WHERE truth)::DOUBLE AS truths, sum(score) AS scores FROM m GROUP BY 1, 2) GROUP BY 1"""))
def calibration_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration(method_rows(spark, sf_dir), "method")


@query(_sql("""SELECT method, round(avg((score - y) * (score - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss
  FROM (SELECT method, score, truth::INT::DOUBLE AS y, greatest(least(score, 1 - 1e-10), 1e-10) AS p FROM m) GROUP BY 1"""))
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.brier_log_loss(method_rows(spark, sf_dir), "method")


_CURVE = """c AS (SELECT method, round(score, 10) AS score, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg FROM m GROUP BY 1, 2),
  k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY method) AS p, sum(neg) OVER (PARTITION BY method) AS n FROM c WINDOW w AS (PARTITION BY method ORDER BY score DESC))"""


def _curve(body: str) -> str:
    return f"WITH m AS ({METHODS_SQL}), {_CURVE} {body}"


@query(_curve("SELECT method, score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / p, 9) AS tpr, round(fp / n, 9) AS fpr, round(tp / (tp + fp), 9) AS precision FROM k"))
def roc_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 9).alias(c)
    return E.curve(method_rows(spark, sf_dir), "method").select("method", "score", "tp", "fp", r("tpr"), r("fpr"), r("precision"))


@query(_curve("""SELECT method, round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 6) AS auroc, round(coalesce(sum((fpr - fb) * (tpr + tb) / 2), 0.0), 6) AS auroc_ref, round(sum((tpr - coalesce(tb, 0)) * prec), 6) AS auprc
  FROM (SELECT *, lag(tpr) OVER w AS tb, lag(fpr) OVER w AS fb FROM (SELECT *, tp / p AS tpr, fp / n AS fpr, tp / (tp + fp) AS prec FROM k) WINDOW w AS (PARTITION BY method ORDER BY score DESC)) GROUP BY 1"""))
def auroc_auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.areas(method_rows(spark, sf_dir), "method")


@query(_curve("""SELECT method, score AS threshold, f1 FROM (SELECT method, score, f1, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, score) AS r
  FROM (SELECT *, round(2 * tp / (tp + fp + p), 9) AS f1 FROM k)) WHERE r = 1"""))
def best_f1_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_f1(method_rows(spark, sf_dir), "method")


_GRID = """g AS (SELECT method, threshold, sum(pos) FILTER (WHERE score >= threshold) AS tp, sum(neg) FILTER (WHERE score >= threshold) AS fp, sum(pos) FILTER (WHERE score < threshold) AS fn, sum(neg) FILTER (WHERE score < threshold) AS tn
  FROM c, (SELECT unnest([{0}]) AS threshold) GROUP BY 1, 2), z AS (SELECT method, threshold, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn FROM g)"""
GRID_101 = [round(i / 100, 2) for i in range(101)]
GRID_YOUDEN = [round(0.1 + 0.05 * i, 2) for i in range(17)]


def _grid(grid: list[float], value: str, name: str) -> str:
    listed = ", ".join(f"{g}::DOUBLE" for g in grid)
    return _curve(f", {_GRID.format(listed)} SELECT method, threshold, v AS {name} FROM (SELECT method, threshold, v, row_number() OVER (PARTITION BY method ORDER BY v DESC, threshold) AS r FROM (SELECT *, round({value}, 9) AS v FROM z)) WHERE r = 1").replace(") , g AS", "), g AS")


@query(_grid(GRID_101, "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END", "f1"))
def best_f1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_of_grid(method_rows(spark, sf_dir), GRID_101, "f1", "method")


@query(_grid(GRID_YOUDEN, "tp::DOUBLE / (tp + fn) - fp::DOUBLE / (fp + tn)", "youden"))
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_of_grid(method_rows(spark, sf_dir), GRID_YOUDEN, "youden", "method")


_ERFC = "(((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))"


@query(_sql(f"""SELECT method_a, method_b, only_a, only_b, round(chi, 6) AS chi2, round({_ERFC}, 6) AS p_value FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM (SELECT *, sqrt(chi / 2) AS x
  FROM (SELECT *, CASE WHEN only_a + only_b > 0 THEN pow(abs(only_a - only_b) - 1, 2)::DOUBLE / (only_a + only_b) ELSE 0.0 END AS chi FROM (
    SELECT a.method AS method_a, b.method AS method_b, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS only_a, count(*) FILTER (WHERE b.ok AND NOT a.ok) AS only_b
    FROM (SELECT *, (decision = 'ACCEPT') = truth AS ok FROM m) a JOIN (SELECT *, (decision = 'ACCEPT') = truth AS ok FROM m) b ON a.doc_id = b.doc_id AND a.method < b.method GROUP BY 1, 2))))"""))
def mcnemar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pairwise_mcnemar(method_rows(spark, sf_dir))


@query(_sql("""SELECT method, round(mt, 6) AS mean_true, round(mf, 6) AS mean_false, round(st, 6) AS std_true, round(sf, 6) AS std_false, round(abs(mt - mf), 6) AS separation,
  round(CASE WHEN pop > 0 THEN (mt - mf) / pop ELSE 0.0 END, 6) AS d_pop, round(CASE WHEN pooled > 0 THEN (mt - mf) / pooled ELSE 0.0 END, 6) AS d_pooled,
  round(CASE WHEN pooled > 0 THEN (mt - mf) / (pooled * sqrt(1 / nt + 1 / nf)) ELSE 0.0 END, 6) AS t
  FROM (SELECT *, sqrt((st * st + sf * sf) / 2) AS pop, sqrt(((nt - 1) * vt + (nf - 1) * vf) / (nt + nf - 2)) AS pooled FROM (
    SELECT method, avg(score) FILTER (WHERE truth) AS mt, avg(score) FILTER (WHERE NOT truth) AS mf, stddev_pop(score) FILTER (WHERE truth) AS st, stddev_pop(score) FILTER (WHERE NOT truth) AS sf,
      var_samp(score) FILTER (WHERE truth) AS vt, var_samp(score) FILTER (WHERE NOT truth) AS vf, count(*) FILTER (WHERE truth) AS nt, count(*) FILTER (WHERE NOT truth) AS nf FROM m GROUP BY 1))"""))
def label_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.separation(method_rows(spark, sf_dir), "method")


@query(_sql("SELECT method, lang, CASE WHEN stddev_pop(score) > 1e-9 THEN round(covar_pop(score, truth::INT) / (stddev_pop(score) * stddev_pop(truth::INT)), 6) END AS correlation FROM m GROUP BY 1, 2"))
def label_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-biserial correlation of scores and labels; null for constant scores."""
    y = F.col("truth").cast("double")
    both = F.stddev_pop("score") * F.stddev_pop(y)
    return method_rows(spark, sf_dir).groupBy("method", "lang").agg(F.when(F.stddev_pop("score") > 1e-9, F.round(F.try_divide(F.covar_pop("score", y), both), 6)).alias("correlation"))


@query(f"""SELECT a, b, round(r, 6) AS correlation FROM (SELECT {", ".join(f"corr({x}, {y}) AS {x}_{y}" for x, y in (("diversity", "repetition"), ("diversity", "density"), ("repetition", "density")))} FROM ({SCORES_SQL}))
  CROSS JOIN LATERAL (VALUES ('diversity', 'repetition', diversity_repetition), ('diversity', 'density', diversity_density), ('repetition', 'density', repetition_density)) v(a, b, r)""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = (("diversity", "repetition"), ("diversity", "density"), ("repetition", "density"))
    one = scores(table(spark, sf_dir, "documents")).agg(*(F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"{a}_{b}", 6).alias("correlation")) for a, b in pairs))).alias("x")).select("x.*")


@query(_sql("""SELECT method, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS median,
  round(quantile_cont(score, 0.75), 6) AS q75, round(quantile_cont(score, 0.05), 6) AS outlier_cut FROM m GROUP BY 1"""))
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(method_rows(spark, sf_dir).select("method", "score"), "scores")
    basic = rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"))
    cuts = {"q25": 0.25, "median": 0.5, "q75": 0.75, "outlier_cut": 0.05}
    return basic.join(quantiles(rows, "score", cuts, "method").select("method", *(F.round(c, 6).alias(c) for c in cuts)), "method")


_BINS = "c AS (SELECT method, least(floor(score * 30), 29)::BIGINT AS bin, count(*) AS n FROM m GROUP BY 1, 2), f AS (SELECT g.method, g.bin, coalesce(c.n, 0) AS n FROM (SELECT method, bin FROM (SELECT DISTINCT method FROM m), (SELECT unnest(range(30)) AS bin)) g LEFT JOIN c ON c.method = g.method AND c.bin = g.bin)"


@query(f"WITH m AS ({METHODS_SQL}), {_BINS} SELECT method, bin, n FROM (SELECT *, lag(n) OVER w AS b, lead(n) OVER w AS a FROM f WINDOW w AS (PARTITION BY method ORDER BY bin)) WHERE n > b AND n > a")
def histogram_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of a 30-bin histogram that rise above both neighbours."""
    from pyspark.sql import Window

    rows = method_rows(spark, sf_dir)
    counts = rows.groupBy("method", F.least(F.floor(F.col("score") * 30), F.lit(29)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = counts.select("method").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long")))).join(counts, ["method", "bin"], "left").fillna(0, ["n"])
    w = Window.partitionBy("method").orderBy("bin")
    return full.select("*", F.lag("n").over(w).alias("b"), F.lead("n").over(w).alias("a")).filter("n > b AND n > a").select("method", "bin", "n")


_LANGS = ("de", "en", "es", "fr")


@query(_sql(f"SELECT method, {', '.join(f'''round(avg(CASE WHEN lang = '{x}' THEN ((decision = 'ACCEPT') = truth)::INT END), 6) AS {x}''' for x in _LANGS)} FROM m GROUP BY 1"))
def ablation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of methods by language, languages as columns."""
    right = ((F.col("decision") == "ACCEPT") == F.col("truth")).cast("int")
    return method_rows(spark, sf_dir).withColumn("ok", right).groupBy("method").pivot("lang", list(_LANGS)).agg(F.round(F.avg("ok"), 6))


_U = "(('0x' || substr(sha256(doc_id::VARCHAR || '|' || k::VARCHAR), 1, 8))::BIGINT)::DOUBLE / 4294967296.0"


def _poisson() -> str:
    out, total, p = "0", 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        out = f"CASE WHEN u >= {total!r}::DOUBLE THEN {k} ELSE {out} END"
        p /= k
    return out


_V = {"accuracy": ("n - fp - fn", "n"), "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn")}


@query(_sql(", d AS (SELECT method, k, truth, decision = 'ACCEPT' AS yes, " + _poisson() + " AS w FROM (SELECT m.*, k, " + _U + " AS u FROM m, (SELECT unnest(range(1, 51)) AS k))), r AS (SELECT method, k, sum(w) AS n, "
            "coalesce(sum(w) FILTER (WHERE yes AND truth), 0) AS tp, coalesce(sum(w) FILTER (WHERE yes AND NOT truth), 0) AS fp, coalesce(sum(w) FILTER (WHERE NOT yes AND truth), 0) AS fn FROM d GROUP BY 1, 2), v AS (SELECT method, "
            + ", ".join(f"round(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END, 9) AS {n}" for n, (a, b) in _V.items()) + " FROM r) SELECT method, "
            + ", ".join(f"round(quantile_cont({n}, 0.025), 6) AS {n}_low, round(quantile_cont({n}, 0.975), 6) AS {n}_high, round(stddev_pop({n}), 6) AS {n}_se" for n in _V) + " FROM v GROUP BY 1").replace(") , d AS", "), d AS"))
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap(method_rows(spark, sf_dir), "doc_id", 50, "method")


@query(_sql(""", e AS (SELECT doc_id, sum(CASE WHEN method = 'consistency' THEN ok ELSE 0 END) - sum(CASE WHEN method = 'diversity' THEN ok ELSE 0 END) AS gap FROM (SELECT *, ((decision = 'ACCEPT') = truth)::INT AS ok FROM m) GROUP BY 1),
  p AS (SELECT k, sum(CASE WHEN k > 0 AND ('0x' || substr(sha256(doc_id::VARCHAR || '#' || k::VARCHAR), 1, 2))::INT % 2 = 0 THEN -gap ELSE gap END) AS s, count(*) AS n FROM e, (SELECT unnest(range(0, 101)) AS k) GROUP BY 1)
  SELECT 'consistency' AS method_a, 'diversity' AS method_b, round(o.s::DOUBLE / o.n, 9) AS difference, round((SELECT count(*) FROM p WHERE k > 0 AND abs(p.s) >= abs(o.s))::DOUBLE / 100, 9) AS p_value FROM p o WHERE k = 0""").replace(") , e AS", "), e AS"))
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.permutation(method_rows(spark, sf_dir), "doc_id", "consistency", "diversity", 100)


@query("""WITH c AS (SELECT event_type, ts::DATE >= DATE '2024-01-16' AS late, value AS v FROM events), g AS (SELECT event_type, v, count(*) FILTER (WHERE NOT late) AS a, count(*) FILTER (WHERE late) AS b FROM c GROUP BY 1, 2),
  k AS (SELECT event_type, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY event_type) AS na, sum(b) OVER (PARTITION BY event_type) AS nb FROM g WINDOW w AS (PARTITION BY event_type ORDER BY v)),
  d AS (SELECT event_type, max(abs(ca / na - cb / nb)) AS d, max(na)::BIGINT AS n1, max(nb)::BIGINT AS n2 FROM k WHERE na > 0 AND nb > 0 GROUP BY 1),
  l AS (SELECT *, (en + 0.12 + 0.11 / en) * d AS lam FROM (SELECT *, sqrt(n1 * n2 / (n1 + n2)) AS en FROM d))
  SELECT event_type, n1, n2, round(d, 9) AS ks, round(least(1.0, greatest(0.0, list_sum(list_transform(range(1, 11), lambda j: 2 * pow(-1, j - 1) * exp(-2.0 * j * j * lam * lam))))), 6) AS p_value FROM l""")
def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of event values between the first and the second half of the month."""
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("v"), (F.col("ts") >= F.lit("2024-01-16").cast("timestamp")).alias("late"))
    return E.two_sample_ks(rows, "v", F.col("late"), "event_type")


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, shares = table(spark, sf_dir, "events"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    n = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.join(quantiles(events, "value", shares, "event_type").select("event_type", *(F.round(c, 6).alias(c) for c in shares)), "event_type")
