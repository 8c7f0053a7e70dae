"""Summaries of documents and vectors, their verification, risk and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pcs as P
from ..functions import text as T
from ..operators import decisions as D
from ..staging import staged
from .eval_queries import METHODS_SQL, method_rows
from .registry import Registry, table
from .text_queries import SCORES_SQL, scores

query = Registry()

SCALES = (2, 4, 8, 16)
_LOW = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
_SLOPES = "list_sort([(l[2] - l[1]), (l[3] - l[2]), (l[4] - l[3]), (l[3] - l[1]) / 2, (l[4] - l[2]) / 2, (l[4] - l[1]) / 3])"
#: A summary of each document: boxes at scale 2^k are the different k-character prefixes of its words.
PCS_SQL = f"""SELECT *, CASE WHEN list_min(counts) > 0 THEN round({_SLOPES}[4], 9) END AS recomputed_d, CASE WHEN list_min(counts) > 0 THEN {_SLOPES} END AS sl FROM (
  SELECT *, list_transform(counts, lambda c: CASE WHEN c > 0 THEN log2(c) END) AS l, CASE WHEN doc_id % 5 = 0 THEN 0.2 ELSE 0.0 END AS bump FROM (
  SELECT s.doc_id, s.source, sha256(s.text) AS merkle_root, (s.doc_id % 7)::BIGINT AS epoch, diversity AS coh_star, density AS r, 0.4::DOUBLE AS budget, CASE WHEN s.doc_id % 3 = 0 THEN 'sticky' ELSE 'mixed' END AS regime,
    [len(list_distinct(list_transform(w, lambda x: x[1:1]))), len(list_distinct(list_transform(w, lambda x: x[1:2]))), len(list_distinct(list_transform(w, lambda x: x[1:3]))), len(list_distinct(list_transform(w, lambda x: x[1:4])))] AS counts
  FROM ({SCORES_SQL}) s JOIN (SELECT doc_id, {_LOW} AS w FROM documents) d ON s.doc_id = d.doc_id))"""
D_HAT_SQL = "coalesce(round(recomputed_d + bump, 9), 0.0)"


def summaries(docs: DataFrame) -> DataFrame:
    """Summaries of PCS_SQL with a claimed D_hat that is off by 0.2 for every fifth document."""
    base = scores(docs).withColumn("w", T.words(F.lower("text")))
    counts = F.array(*(F.size(F.array_distinct(F.transform("w", _prefix(k)))).cast("bigint") for k in (1, 2, 3, 4)))
    rows = base.select(
        "doc_id", "source", F.sha2("text", 256).alias("merkle_root"), (F.col("doc_id") % 7).alias("epoch"), F.col("diversity").alias("coh_star"), F.col("density").alias("r"), F.lit(0.4).alias("budget"),
        F.when(F.col("doc_id") % 3 == 0, "sticky").otherwise("mixed").alias("regime"), F.array(*map(F.lit, SCALES)).alias("scales"), counts.alias("counts"),
    )
    with_d = rows.withColumn("slopes", P.slopes(F.col("scales"), F.col("counts"))).withColumn("recomputed_d", F.round(P.median(F.col("slopes")), 9))
    claimed = F.round(F.col("recomputed_d") + F.when(F.col("doc_id") % 5 == 0, 0.2).otherwise(0.0), 9)
    return with_d.withColumn("D_hat", F.coalesce(claimed, F.lit(0.0)))


def _prefix(k: int):
    return lambda x: F.substring(x, 1, k)


def _pcs(body: str) -> str:
    return f"WITH p AS (SELECT *, {D_HAT_SQL} AS d_hat FROM ({PCS_SQL})) {body}"


@query(_pcs("SELECT doc_id, counts[1]::BIGINT AS n2, counts[2]::BIGINT AS n4, counts[3]::BIGINT AS n8, counts[4]::BIGINT AS n16, recomputed_d AS dhat_upper, round((sl[3] + sl[4]) / 2, 9) AS dhat_average FROM p"))
def dhat_theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summaries(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *(F.col("counts")[k].alias(f"n{s}") for k, s in enumerate(SCALES)), F.col("recomputed_d").alias("dhat_upper"), F.round(P.median(F.col("slopes"), "avg"), 9).alias("dhat_average"))


_REGIME = "CASE WHEN coh_star >= 0.70 AND d_hat <= 1.5 THEN 'sticky' WHEN d_hat >= 2.6 THEN 'non_sticky' ELSE 'mixed' END"
_BUDGET = "round(least(1.0, greatest(0.0, 0.10 + 0.30 * (1 - r) + 0.50 * greatest(0.0, d_hat - 2.2) + 0.20 * coh_star)), 9)"
_REASON = f"""CASE WHEN recomputed_d IS NULL THEN 'D_hat recomputation failed' WHEN abs(d_hat - recomputed_d) > 0.15 THEN 'D_hat out of tolerance' WHEN coh_star < 0 OR coh_star > 1.05 THEN 'coh_star out of bounds'
  WHEN regime <> {_REGIME} THEN 'regime mismatch' WHEN abs(budget - {_BUDGET}) > 0.01 THEN 'budget deviation' ELSE '' END"""


@query(_pcs(f"SELECT doc_id, sha256(merkle_root || '|' || epoch || '|' || source) AS pcs_id, reason IN ('', 'regime mismatch', 'budget deviation') AS accepted, reason <> '' AS escalated, recomputed_d, round(rb, 6) AS recomputed_budget, reason FROM (SELECT *, {_REASON} AS reason, {_BUDGET} AS rb FROM p)"))
def pcs_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six ordered checks of every summary."""
    rows = summaries(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", P.pcs_id(F.col("merkle_root"), F.col("epoch"), F.col("source")).alias("pcs_id"), P.verdict().alias("v")).select("doc_id", "pcs_id", "v.accepted", "v.escalated", "v.recomputed_d", F.round("v.recomputed_budget", 6).alias("recomputed_budget"), "v.reason")


@query(_pcs("""SELECT doc_id, CASE WHEN counts[2] < counts[1] OR counts[3] < counts[2] OR counts[4] < counts[3] THEN 'counts' WHEN coh_star < 0 OR coh_star > 1.05 THEN 'coherence' WHEN r < 0 OR r > 1 THEN 'compressibility'
  WHEN d_hat < 0 OR d_hat > 3.5 THEN 'dimension' WHEN d_hat < 0.5 OR d_hat > 3.0 THEN 'strict dimension' WHEN NOT regexp_full_match(merkle_root, '[0-9a-fA-F]{64}') THEN 'merkle root' END AS failed FROM p"""))
def sanity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(table(spark, sf_dir, "documents")).select("doc_id", P.sanity(strict=True).alias("failed"))


_CONF = "CASE WHEN d_hat < 1.5 THEN d_hat / 1.5 WHEN d_hat <= 2.5 THEN 1.0 ELSE greatest(0.5, 1.0 - (d_hat - 2.5)) END"


@query(_pcs(f"""SELECT doc_id, round(sv, 6) AS slope_variance, sv < 0.05 AS stable, round(c1, 6) AS dimension_confidence, CASE WHEN r < 0.5 THEN 'repetitive' WHEN r > 0.8 THEN 'high entropy' ELSE 'normal' END AS category,
  round(CASE WHEN mean > 0.5 THEN exp(-6.0 * pow(mean - 0.5, 2)) ELSE 1 - c1 * coh_star * c3 END, 6) AS error_bound, CASE WHEN mean > 0.5 THEN exp(-6.0 * pow(mean - 0.5, 2)) ELSE 1 - c1 * coh_star * c3 END <= 0.02 AS meets
  FROM (SELECT *, (c1 + coh_star + c3) / 3 AS mean FROM (SELECT *, coalesce(list_var_samp(sl), 0.0) AS sv, {_CONF} AS c1, abs(r - 0.5) * 2 AS c3 FROM p))"""))
def proof_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope variance, confidences and the ensemble bound of every summary."""
    rows = summaries(table(spark, sf_dir, "documents"))
    c = [P.dimension_confidence(F.col("D_hat")), F.col("coh_star"), F.abs(F.col("r") - 0.5) * 2]
    bound = P.ensemble_bound(c)
    variance = F.coalesce(P.sample_variance(F.col("slopes")), F.lit(0.0))
    return rows.select("doc_id", F.round(variance, 6).alias("slope_variance"), (variance < 0.05).alias("stable"), F.round(c[0], 6).alias("dimension_confidence"), P.compressibility_class(F.col("r")).alias("category"), F.round(bound["upper"], 6).alias("error_bound"), bound["meets"].alias("meets"))


_ANOMALY = f"""least(1.0, CASE WHEN d_hat < 0.5 THEN (0.5 - d_hat) / 0.5 WHEN d_hat > 2.8 THEN (d_hat - 2.8) / 0.7 ELSE 0.0 END * 0.3 + CASE WHEN coh_star > 0.8 AND d_hat > 2.5 THEN (coh_star - 0.8) * (d_hat - 2.5) ELSE 0.0 END * 0.25
  + CASE WHEN r < 0.1 THEN (0.1 - r) / 0.1 WHEN r > 0.95 THEN (r - 0.95) / 0.05 ELSE 0.0 END * 0.2 + CASE WHEN regime <> {_REGIME} THEN 0.1 ELSE 0.0 END)"""


@query(_pcs(f"SELECT doc_id, round({_ANOMALY}, 9) AS anomaly, CASE WHEN {_ANOMALY} >= 0.9 AND 1 - coh_star <= 0.2 THEN 'block' WHEN {_ANOMALY} >= 0.5 THEN 'guardrail' ELSE 'pass' END AS action, round(1 - coh_star + CASE WHEN abs({_ANOMALY} - 0.9) < 0.1 THEN 0.5 ELSE 0.0 END, 9) AS priority FROM p"))
def anomaly_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive anomaly score, guardrail action and labelling priority."""
    rows = summaries(table(spark, sf_dir, "documents")).withColumn("a", P.anomaly_score())
    unsure = 1 - F.col("coh_star")
    return rows.select("doc_id", F.round("a", 9).alias("anomaly"), P.guardrail(F.col("a"), unsure).alias("action"), F.round(P.learning_priority(F.col("a"), unsure), 9).alias("priority"))


_TOTAL = "(d_hat + coh_star + r + budget)"
_H = " + ".join(f"CASE WHEN {x} > 0 THEN -({x} / {_TOTAL}) * ln({x} / {_TOTAL}) ELSE 0.0 END" for x in ("d_hat", "coh_star", "r", "budget"))
_RISK = f"1.0 / (1.0 + exp(-(-0.5 + 0.3 * d_hat - 0.5 * coh_star - 0.4 * r - 0.6 * budget + 0.2 * ({_H}))))"


@query(_pcs(f"""SELECT doc_id, round(k, 9) AS risk, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high, CASE WHEN k >= 0.35 THEN 'high_risk' WHEN hi - lo >= 0.18 THEN 'wide_confidence_interval' ELSE 'low_risk_narrow_ci' END AS reason
  FROM (SELECT *, greatest(0.0, k - 0.196 * sqrt(k * (1 - k))) AS lo, least(1.0, k + 0.196 * sqrt(k * (1 - k))) AS hi FROM (SELECT doc_id, {_RISK} AS k FROM p))"""))
def risk_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic risk with its interval, and the route taken."""
    names = ("D_hat", "coh_star", "r", "budget")
    f = {n: F.col(n) for n in names} | {"signal_entropy": P.signal_entropy(*(F.col(n) for n in names))}
    rows = summaries(table(spark, sf_dir, "documents")).withColumn("k", P.risk(f)).withColumn("ci", P.risk_interval(F.col("k")))
    return rows.select("doc_id", F.round("k", 9).alias("risk"), F.round("ci.low", 9).alias("ci_low"), F.round("ci.high", 9).alias("ci_high"), P.route(F.col("k"), F.col("ci.high") - F.col("ci.low"), below=0.35, narrow=0.18).alias("reason"))


@query(_pcs(f"""SELECT source, count(*) AS n, count(*) FILTER (WHERE v >= 2) AS accepted, round(avg(v), 6) AS mean_votes, round(avg(c), 6) AS mean_confidence FROM (SELECT source, a::INT + b::INT + e::INT AS v, (CASE WHEN a THEN 0.9 ELSE 0.0 END + CASE WHEN b THEN coh_star ELSE 0.0 END + CASE WHEN e THEN r ELSE 0.0 END) / 3 AS c
  FROM (SELECT *, coalesce(abs(d_hat - recomputed_d) <= 0.15, false) AS a, coh_star >= 0.7 AS b, r >= 0.6 AS e FROM p)) GROUP BY 1"""))
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three strategies: recomputation, coherence, compressibility."""
    agrees = F.coalesce(F.abs(F.col("D_hat") - F.col("recomputed_d")) <= 0.15, F.lit(False))
    v = D.vote([agrees, F.col("coh_star") >= 0.7, F.col("r") >= 0.6], [F.lit(0.9), F.col("coh_star"), F.col("r")], 2)
    rows = summaries(table(spark, sf_dir, "documents")).select("source", v.alias("v"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("v.accepted").alias("accepted"), F.round(F.avg("v.votes"), 6).alias("mean_votes"), F.round(F.avg("v.confidence"), 6).alias("mean_confidence"))


_SC = f"(SELECT method, round(1 - score, 10) AS nc, truth FROM ({METHODS_SQL}))"
_QUANT = f"""q AS (SELECT method, n, round(s[lo] + least(1.0, greatest(0.0, h - lo)) * (s[least(lo + 1, n)] - s[lo]), 9) AS q_interpolated, round(quantile, 9) AS q_linear, s[least(ceil(round(h, 9)), n)::BIGINT] AS q_ceiling
  FROM (SELECT *, least(greatest(floor(h), 1), n)::BIGINT AS lo FROM (SELECT method, list(nc ORDER BY nc) AS s, count(*) AS n, (1 - 0.1::DOUBLE) * (count(*) + 1) AS h, quantile_cont(nc, 0.9) AS quantile FROM {_SC} WHERE truth GROUP BY 1)))"""


@query(f"WITH {_QUANT} SELECT * FROM q")
def conformal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of nonconformity on correct rows by three definitions."""
    rows = method_rows(spark, sf_dir).filter("truth").select("method", F.round(1 - F.col("score"), 10).alias("nc"))
    return D.conformal_quantiles(rows, "nc", 0.1, "method")


@query(f"WITH {_QUANT} SELECT s.method, CASE WHEN nc <= q_ceiling THEN 'ACCEPT' WHEN nc <= q_ceiling + 0.05 THEN 'ESCALATE' ELSE 'REJECT' END AS decision, truth, count(*) AS n FROM {_SC} s JOIN q ON q.method = s.method GROUP BY 1, 2, 3")
def conformal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = method_rows(spark, sf_dir).select("method", "truth", F.round(1 - F.col("score"), 10).alias("nc"))
    q = D.conformal_quantiles(rows.filter("truth"), "nc", 0.1, "method").select("method", "q_ceiling")
    decided = rows.join(q, "method").select("method", D.conformal_decision(F.col("nc"), F.col("q_ceiling")).alias("decision"), "truth")
    return decided.groupBy("method", "decision", "truth").agg(F.count(F.lit(1)).alias("n"))


_DELTAS = (0.05, 0.1, 0.2)


@query(f"""WITH s AS (SELECT method, round(1 - score, 10) AS nc, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT) % 2 = 0 AS calib FROM ({METHODS_SQL}) WHERE truth),
  q AS (SELECT method, delta, list(nc ORDER BY nc)[least(ceil(round((1 - delta) * (count(*) + 1), 9)), count(*))::BIGINT] AS t FROM s, (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS delta) WHERE calib GROUP BY 1, 2)
  SELECT s.method, delta, count(*) AS n, round(avg((nc > t)::INT), 6) AS miscoverage, round(1.96 * sqrt(avg((nc > t)::INT) * (1 - avg((nc > t)::INT)) / count(*)), 6) AS half_width FROM s JOIN q ON q.method = s.method WHERE NOT calib GROUP BY 1, 2""")
def coverage_by_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured miscoverage on the half of correct rows that did not calibrate."""
    half = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint") % 2 == 0
    rows = method_rows(spark, sf_dir).filter("truth").select("method", F.round(1 - F.col("score"), 10).alias("nc"), half.alias("calib"))
    rows = staged(rows, "scores")
    tested = D.conformal_quantiles(rows.filter("calib"), "nc", list(_DELTAS), "method").select("method", "delta", F.col("q_ceiling").alias("t"))
    out = rows.filter("NOT calib").join(tested, "method").withColumn("miss", (F.col("nc") > F.col("t")).cast("int"))
    m = F.avg("miss")
    return out.groupBy("method", "delta").agg(F.count(F.lit(1)).alias("n"), F.round(m, 6).alias("miscoverage"), F.round(1.96 * F.sqrt(m * (1 - m) / F.count(F.lit(1))), 6).alias("half_width"))


@query(r"""SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, v: 0.3 * v + 0.7 * a), 6) AS ewma FROM events GROUP BY 1""")
def ewma_tenant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.ewma(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "value", ["ts", "event_id"], 0.3, "user_id")
    return out.select("user_id", "n", F.round("ewma", 6).alias("ewma"))


@query("""SELECT user_id, event_id, round(avg((value > 100)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS recent_rate,
  round((value - avg(value) OVER b) / nullif(stddev_pop(value) OVER b, 0), 4) AS z FROM events WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def rolling_tenant_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of large values in a user's last 50 events, and each value's z-score against the user's earlier ones."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before, recent = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-49, 0)
    e = table(spark, sf_dir, "events")
    spread = F.stddev_pop("value").over(before)
    return e.select(
        "user_id", "event_id", F.round(F.avg((F.col("value") > 100).cast("int")).over(recent), 6).alias("recent_rate"), F.round(F.try_divide(F.col("value") - F.avg("value").over(before), F.nullif(spread, F.lit(0.0))), 4).alias("z")
    )


@query(f"""WITH m AS (SELECT doc_id, score, truth, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM ({METHODS_SQL}) WHERE method = 'consistency'), t AS (SELECT least(r // (n // 3), 2)::INT AS third, score, truth FROM m),
  a AS (SELECT third, count(*) AS n, round(avg((score >= 0.45) = truth), 6) AS accuracy, round(abs(avg(score) - avg(truth::INT)), 6) AS gap FROM (SELECT *, score >= 0.45 AS yes FROM t) GROUP BY 1) SELECT third, n, gap, accuracy FROM a""".replace("avg((score >= 0.45) = truth)", "avg(((score >= 0.45) = truth)::INT)"))
def fairness_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and calibration gap of three contiguous groups of documents."""
    rows = D.contiguous_thirds(method_rows(spark, sf_dir).filter("method = 'consistency'").select("doc_id", "score", "truth"), "doc_id")
    right = ((F.col("score") >= 0.45) == F.col("truth")).cast("int")
    return rows.groupBy("third").agg(F.count(F.lit(1)).alias("n"), F.round(F.abs(F.avg("score") - F.avg(F.col("truth").cast("int"))), 6).alias("gap"), F.round(F.avg(right), 6).alias("accuracy"))


_GRIDS = (2, 4, 8)


@query("""WITH e AS (SELECT label, vec_id, d, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM (SELECT label, vec_id, unnest(range(1, 4)) AS d, unnest(embedding[1:3])::DOUBLE AS v FROM embeddings) WINDOW w AS (PARTITION BY label, d)),
  g AS (SELECT label, vec_id, s, list(least(floor(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END * s), s - 1)::BIGINT ORDER BY d) AS cell FROM e, (SELECT unnest([2, 4, 8]) AS s) GROUP BY 1, 2, 3)
  SELECT label, s::INT AS scale, count(DISTINCT cell) AS boxes FROM g GROUP BY 1, 2""")
def voxel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied boxes of the first three dimensions, scaled to each label's range, at three scales."""
    e = table(spark, sf_dir, "embeddings").select("label", *(F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(3)))
    span = e.groupBy("label").agg(*(f(f"x{k}").alias(f"{n}{k}") for k in range(3) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    joined = e.join(F.broadcast(span), "label").withColumn("scale", F.explode(F.array(*map(F.lit, _GRIDS))))  # one row a label
    at = lambda k: F.least(F.floor(F.when(F.col(f"hi{k}") > F.col(f"lo{k}"), (F.col(f"x{k}") - F.col(f"lo{k}")) / (F.col(f"hi{k}") - F.col(f"lo{k}"))).otherwise(0.0) * F.col("scale")), F.col("scale") - 1)
    return joined.select("label", "scale", F.struct(at(0).alias("a"), at(1).alias("b"), at(2).alias("c")).alias("cell")).groupBy("label", "scale").agg(F.count_distinct("cell").alias("boxes"))


@query("""WITH e AS (SELECT label, vec_id, d, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings) WINDOW w AS (PARTITION BY label, d)),
  g AS (SELECT label, vec_id, s, list(least(floor(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END * s), s - 1)::BIGINT ORDER BY d) AS cell FROM e, (SELECT unnest([2, 4, 8]) AS s) GROUP BY 1, 2, 3)
  SELECT label, s::INT AS scale, count(DISTINCT cell) AS boxes FROM g GROUP BY 1, 2""")
def voxel_counts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied boxes of all dimensions, scaled to each label's range, at three scales."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    each = e.select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "lo", "hi"))).alias("span"))
    joined = e.join(F.broadcast(span), "label").withColumn("scale", F.explode(F.array(*map(F.lit, _GRIDS))))  # one row a label

    def at(x, k):
        lo, hi = F.col("span")[k]["lo"], F.col("span")[k]["hi"]
        return F.least(F.floor(F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0) * F.col("scale")), F.col("scale") - 1).cast("int")

    return joined.select("label", "scale", F.transform("v", at).alias("cell")).groupBy("label", "scale").agg(F.count_distinct("cell").alias("boxes"))


@query("""WITH u AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)
  SELECT a.label, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1""")
def mean_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pairwise cosine of each label's vectors in closed form: no pairs are made."""
    u = table(spark, sf_dir, "embeddings").select("label", F.posexplode(T.unit(F.col("embedding"))).alias("d", "x"))
    sums = u.groupBy("label", "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    per = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    return per.select("label", F.round((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))
