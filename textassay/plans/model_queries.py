"""Normalised scores, gates, model features and rollout decisions over scored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import combined as C
from ..functions import text as T
from ..operators import evaluation as E
from ..operators.ranks import quantiles
from ..staging import staged
from .eval_queries import METHODS_SQL, method_rows
from .registry import Registry, table
from .text_queries import CONSISTENCY, SCORES_SQL, char_perplexity, scores
from .text_queries import query as text_query
from .verify_queries import D_HAT_SQL, PCS_SQL, summaries

query = Registry()
query_sql = text_query.sql

#: Steps of a rollout in percent, gates of a deployment.
STEPS, STEP_MINUTES, SHORTER = (5, 10, 25, 50, 100), 60, 0.75
MIN_AUC, MAX_DROP = 0.82, 0.05


def _sql(body: str) -> str:
    return f"WITH m AS ({METHODS_SQL}) {body}"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents")).withColumn("consistency", F.expr(CONSISTENCY))


_SCORED_SQL = f"SELECT *, {CONSISTENCY} AS consistency FROM ({SCORES_SQL})"


#: D_hat, coherence, compressibility, perplexity and truth of each document.
SIGNALS_SQL = f"""SELECT p.doc_id, p.source, d_hat, coh_star, r, budget, perplexity, counts, quality = 1 AS truth FROM (SELECT *, {D_HAT_SQL} AS d_hat FROM ({PCS_SQL})) p
  JOIN ({query_sql["char_perplexity"]}) x ON x.doc_id = p.doc_id LEFT JOIN labels l ON l.doc_id = p.doc_id"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of SIGNALS_SQL; D_hat under its own name."""
    rows = summaries(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"))
    return rows.join(char_perplexity(spark, sf_dir).drop("entropy"), "doc_id").join(labels, "doc_id", "left")


_C = lambda x, hi=1.0, lo=0.0: f"least({hi}::DOUBLE, greatest({lo}::DOUBLE, {x}))"
_LOG = _C("ln(perplexity) / ln(100)")
_TASKS = ", ".join(f"round({a} * (1 - {_C('d_hat / 3.5')}) + {b} * abs(coh_star - 0.7) + {c} * (1 - r) + {e} * {_LOG}, 7) AS {t}" for t, (a, b, c, e) in C.TASK_WEIGHTS.items())
_PLATEAU = lambda x, lo, hi, over: f"CASE WHEN {x} < {lo} THEN greatest(0.0, {x} / {lo}) WHEN {x} <= {hi} THEN 1.0 ELSE greatest(0.0, 1 - ({x} - {hi}) / {over}) END"


@query(f"""SELECT doc_id, round({_LOG}, 7) AS log_perplexity, round(1 - 1 / perplexity, 7) AS inverse_perplexity, round(({_C('perplexity', 20, 1)} - 1) / 19, 7) AS clipped_perplexity, {_TASKS},
  round(0.35 * (1 - {_C('d_hat / 3.5')}) + 0.40 * (1 - {_C('coh_star / 1.05')}) + 0.25 * least(1.0, abs({_C('r')} - 0.65) / 0.65), 7) AS calibrated, round(0.4 * (2.5 - d_hat) / 2.5 + 0.3 * (1 - coh_star) + 0.3 * (1 - r), 7) AS nonconformity,
  round(0.5 * (1 - {_C('d_hat / 3.0')}) + 0.3 * (1 - coh_star) + 0.2 * (1 - r), 7) AS hallucination,
  round({_C(f"0.35 * {_PLATEAU('d_hat', 1.5, 2.5, 0.5)} + 0.25 * {_PLATEAU('coh_star', 0.3, 0.6, 0.4)} + 0.40 * {_PLATEAU('r', 0.4, 0.7, 0.3)}")}, 7) AS normality FROM ({SIGNALS_SQL})""")
def combined_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity by three normalisers, and the signals combined in each named way."""
    d, coh, r, p = (F.col(c) for c in ("D_hat", "coh_star", "r", "perplexity"))
    named = {f"{n}_perplexity": C.normalised_perplexity(p, how) for n, how in (("log", "log"), ("inverse", "inv"), ("clipped", "clip"))} | {t: C.suspicion(d, coh, r, p, t) for t in C.TASK_WEIGHTS}
    named |= {"calibrated": C.calibrated_anomaly(d, coh, r), "nonconformity": C.nonconformity(d, coh, r), "hallucination": C.hallucination(d, coh, r), "normality": C.normality(d, coh, r)}
    return signals(spark, sf_dir).select("doc_id", *(F.round(x, 7).alias(n) for n, x in named.items()))


#: Gates of a rollout, and the cost of a decision.
MOST_P95, MOST_ESCALATED, LEAST_CONTAINED, MOST_COST = 200.0, 0.02, 0.98, 0.0015
ACCEPT_COST, ESCALATE_COST = 0.001, 0.005
_GATES_SQL = f"(p95 > {MOST_P95})::INT + (escalation_rate > {MOST_ESCALATED})::INT + (containment_rate < {LEAST_CONTAINED})::INT + (cost_per_task > {MOST_COST})::INT"
_HEALTH_SQL = f"""SELECT user_id % 10 AS version, quantile_cont(value, 0.95) AS p95, avg((event_type = 'error')::INT) AS escalation_rate, 1 - avg((event_type = 'error' AND value > 100)::INT) AS containment_rate,
  sum(CASE WHEN event_type = 'error' THEN {ESCALATE_COST} ELSE {ACCEPT_COST} END) / nullif(count(*) FILTER (WHERE event_type <> 'error'), 0) AS cost_per_task FROM events GROUP BY 1"""


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p95 latency, escalation, containment and cost per trusted task of each version (the last digit of the user's number)."""
    bad = F.col("event_type") == "error"
    e = table(spark, sf_dir, "events").withColumn("version", F.col("user_id") % 10)
    cost = F.sum(F.when(bad, ESCALATE_COST).otherwise(ACCEPT_COST)) / F.nullif(F.count_if(~bad), F.lit(0))
    per = e.groupBy("version").agg(F.avg(bad.cast("int")).alias("escalation_rate"), (1 - F.avg((bad & (F.col("value") > 100)).cast("int"))).alias("containment_rate"), cost.alias("cost_per_task"))
    return per.join(quantiles(e, "value", {"p95": 0.95}, "version"), "version")


@query(f"""SELECT version, round(p95, 6) AS p95, round(escalation_rate, 9) AS escalation_rate, round(containment_rate, 9) AS containment_rate, round(cost_per_task, 9) AS cost_per_task, {_GATES_SQL} AS failed,
  CASE WHEN {_GATES_SQL} >= 2 THEN 'rollback' WHEN {_GATES_SQL} = 1 THEN 'pause' ELSE 'continue' END AS action FROM ({_HEALTH_SQL})""")
def canary_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four gates of a rollout by version: two or more that fail roll back, one pauses."""
    over = (F.col("p95") > MOST_P95, F.col("escalation_rate") > MOST_ESCALATED, F.col("containment_rate") < LEAST_CONTAINED, F.col("cost_per_task") > MOST_COST)
    failed = sum((F.coalesce(x.cast("int"), F.lit(0)) for x in over), F.lit(0))
    rounded = [F.round("p95", 6).alias("p95"), *(F.round(c, 9).alias(c) for c in ("escalation_rate", "containment_rate", "cost_per_task"))]
    return health(spark, sf_dir).withColumn("failed", failed).select("version", *rounded, "failed", F.when(F.col("failed") >= 2, "rollback").when(F.col("failed") == 1, "pause").otherwise("continue").alias("action"))


@query(f"""WITH h AS ({_HEALTH_SQL}), c AS (SELECT * FROM h WHERE version = 0) SELECT h.version, round((h.p95 - c.p95) / c.p95 * 100, 6) AS latency_delta, round((h.containment_rate - c.containment_rate) / c.containment_rate * 100, 6) AS containment_delta,
  round((h.cost_per_task - c.cost_per_task) / c.cost_per_task * 100, 6) AS cost_delta, CASE WHEN h.p95 > 200 OR h.containment_rate < 0.98 THEN 'high' WHEN (h.cost_per_task - c.cost_per_task) / c.cost_per_task * 100 > 10 THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN h.p95 > 200 OR h.containment_rate < 0.98 OR (h.cost_per_task - c.cost_per_task) / c.cost_per_task * 100 > 10 THEN 'reject' ELSE 'approve' END AS recommendation FROM h, c WHERE h.version > 0""")
def canary_against_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version's health against the control's, version 0: relative changes, the risk and what is advised."""
    h = staged(health(spark, sf_dir), "health")
    names = ("p95", "containment_rate", "cost_per_task")
    control = h.filter("version = 0").select(*(F.col(c).alias(f"{c}_0") for c in names))
    delta = {n: (F.col(c) - F.col(f"{c}_0")) / F.col(f"{c}_0") * 100 for n, c in zip(("latency_delta", "containment_delta", "cost_delta"), names)}
    breached = (F.col("p95") > 200) | (F.col("containment_rate") < 0.98)
    risk = F.when(breached, "high").when(delta["cost_delta"] > 10, "medium").otherwise("low")
    advice = F.when(breached | (delta["cost_delta"] > 10), "reject").otherwise("approve")
    return h.filter("version > 0").crossJoin(F.broadcast(control)).select("version", *(F.round(x, 6).alias(n) for n, x in delta.items()), risk.alias("risk"), advice.alias("recommendation"))  # control is one row


@query(f"""SELECT event_type, s.k::INT AS step, s.pct::INT AS percent, ({STEP_MINUTES} * pow(CASE WHEN healthy THEN {SHORTER} ELSE 1.0 END, s.k))::DOUBLE AS minutes
  FROM (SELECT event_type, avg(value) >= 0.4 AS healthy FROM events GROUP BY 1), (SELECT unnest(range(0, {len(STEPS)})) AS k, unnest({list(STEPS)}) AS pct) s""")
def canary_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each rollout; a healthy one shortens every further step by a quarter."""
    per = table(spark, sf_dir, "events").groupBy("event_type").agg((F.avg("value") >= 0.4).alias("healthy"))
    steps = F.posexplode(F.array(*map(F.lit, STEPS))).alias("step", "percent")
    shrink = F.pow(F.when(F.col("healthy"), SHORTER).otherwise(1.0), F.col("step"))
    return per.select("event_type", "healthy", steps).select("event_type", "step", "percent", (STEP_MINUTES * shrink).alias("minutes"))


@query("SELECT e.event_id, coalesce(d.text, '') AS text FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id")
def scores_with_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with their texts, empty where there is none."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text")
    rows = table(spark, sf_dir, "events").select("event_id")
    return rows.join(texts, "event_id", "left").select("event_id", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS seen FROM documents d")
def dedup_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row's key is held already."""
    held = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("held", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(held, "doc_id", "left").select("doc_id", F.coalesce("held", F.lit(False)).alias("seen"))


@query("SELECT event_id, event_type IN ('click', 'purchase') AS selective, 1 + (event_type IN ('click', 'purchase'))::INT + (value > 0.5)::INT AS regions FROM events")
def replication_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row of listed kinds is replicated, and to how many regions in all."""
    listed = F.array_contains(F.array(F.lit("click"), F.lit("purchase")), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", listed.alias("selective"), (1 + listed.cast("int") + (F.col("value") > 0.5).cast("int")).alias("regions"))


#: A break after a mark, before white space and a capital. Without look-around: a capital after it is marked first.
_SPLIT = r"(?<=[.!?])\s+(?=[A-Z])"
_PARTS = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 10)"


@query(f"SELECT doc_id, len({_PARTS})::INT AS sentences, coalesce(list_max(list_transform({_PARTS}, lambda x: length(x))), 0)::INT AS longest FROM documents")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of ten characters or more, marks kept, split before a capital that follows a mark and white space; and the longest one's length."""
    parts = F.filter(F.transform(F.split("text", _SPLIT), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= 10)
    rows = table(spark, sf_dir, "documents").select("doc_id", parts.alias("p"))
    return rows.select("doc_id", F.when(F.col("p").isNull(), None).otherwise(F.size("p")).alias("sentences"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"))


_LOWER = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
_GRAMS = lambda k: f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))"
_POINTS = " + ".join(f"(len(w) > 5 AND len(list_distinct({_GRAMS(k)})) < 0.7::DOUBLE * len({_GRAMS(k)}))::INT" for k in (3, 4, 5))
_SAID = r"list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"


@query(f"""SELECT doc_id, points, CASE WHEN points >= 2 THEN 'likely repetition' WHEN length(text) < 50 THEN 'too short' WHEN len(list_distinct(w))::DOUBLE / len(w) < 0.3 THEN 'possible repetition' ELSE 'review' END AS class
  FROM (SELECT *, {_POINTS} + CASE WHEN len(s) > 2 AND len(list_distinct(list_filter(s, lambda x: x <> ''))) < 0.8::DOUBLE * len(s) THEN 2 ELSE 0 END AS points FROM (SELECT doc_id, text, {_LOWER} AS w, {_SAID} AS s FROM documents WHERE text IS NOT NULL))""")
def outlier_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for 3- to 5-grams of which over 30 % repeat and two for sentences of which over 20 % do; the first class that fits."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    rows = docs.select("doc_id", "text", T.words(F.lower("text")).alias("w"), F.transform(F.split("text", r"\.", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")).alias("s"))
    n = F.size("w")
    gram = lambda k: F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))
    repeats = lambda k: F.when(n > 5, T.let(gram(k), lambda g: (F.size(F.array_distinct(g)) < 0.7 * F.size(g)).cast("int"))).otherwise(0)
    said = F.when((F.size("s") > 2) & (F.size(F.array_distinct(F.filter("s", lambda x: x != ""))) < 0.8 * F.size("s")), 2).otherwise(0)
    kind = F.when(F.col("points") >= 2, "likely repetition").when(F.length("text") < 50, "too short").when(F.size(F.array_distinct("w")) / n < 0.3, "possible repetition").otherwise("review")
    return rows.withColumn("points", repeats(3) + repeats(4) + repeats(5) + said).select("doc_id", "points", kind.alias("class"))


#: Weights of an access within the hour, and costs of a miss and of a promotion.
ACCESS = {"hour_of_day": 0.4, "day_of_week": 0.3, "recent_frequency": 0.2, "tenant_activity": 0.1}
MISS_COST, PROMOTION_COST = 10.0, 2.0


@query(f"""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') AS recent, max(ts) AS last FROM events GROUP BY 1), t AS (SELECT max(n) AS most FROM u),
  p AS (SELECT user_id, 1 / (1 + exp(-({ACCESS['hour_of_day']} * hour(last) / 23 + {ACCESS['day_of_week']} * dayofweek(last) / 6 + {ACCESS['recent_frequency']} * recent::DOUBLE / n + {ACCESS['tenant_activity']} * n::DOUBLE / most))) AS p FROM u, t)
  SELECT user_id, round(p, 9) AS p, round(p * {MISS_COST} - (1 - p) * {PROMOTION_COST}, 9) AS benefit FROM p""")
def access_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of a further access by a logistic score of hour, weekday, recent share and activity, and what promotion is worth."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")).alias("recent"), F.max("ts").alias("last"))
    most = per.agg(F.max("n").alias("most"))
    z = ACCESS["hour_of_day"] * F.hour("last") / 23 + ACCESS["day_of_week"] * (F.dayofweek("last") - 1) / 6 + ACCESS["recent_frequency"] * F.col("recent") / F.col("n") + ACCESS["tenant_activity"] * F.col("n") / F.col("most")
    p = 1 / (1 + F.exp(-z))
    return per.crossJoin(F.broadcast(most)).select("user_id", F.round(p, 9).alias("p"), F.round(p * MISS_COST - (1 - p) * PROMOTION_COST, 9).alias("benefit"))  # most is one row


@query("""SELECT event_type, hits, misses, round(misses::DOUBLE / n, 9) AS miss_rate FROM (SELECT event_type, count(*) FILTER (WHERE k > 1) AS hits, count(*) FILTER (WHERE k = 1) AS misses, count(*) AS n
  FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY 1)""")
def promotion_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first event of a kind misses, further ones hit: counted by distinct users and without a window."""
    per = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c"))
    both = per.groupBy("event_type").agg(F.sum(F.col("c") - 1).alias("hits"), F.count(F.lit(1)).alias("misses"))
    return both.select("event_type", "hits", "misses", F.round(F.col("misses") / (F.col("hits") + F.col("misses")), 9).alias("miss_rate"))


_AUC_SQL = """SELECT {0}, sum(neg * (tp - pos / 2)) / nullif(max(p) * max(n), 0) AS auc, (max(p) + max(n))::BIGINT AS rows FROM (SELECT *, sum(pos) OVER (PARTITION BY {0} ORDER BY score DESC) AS tp, sum(pos) OVER (PARTITION BY {0}) AS p, sum(neg) OVER (PARTITION BY {0}) AS n
  FROM (SELECT {0}, round(score, 10) AS score, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg FROM m GROUP BY ALL)) GROUP BY {0}"""


@query(_sql(f""", a AS ({_AUC_SQL.format('method')}) SELECT method, round(auc, 6) AS auc, round(max(auc) OVER () - auc, 6) AS drop, round(auc, 6) >= {MIN_AUC} AND round(max(round(auc, 6)) OVER () - round(auc, 6), 6) <= {MAX_DROP} AS deploy FROM a""").replace(") , a AS", "), a AS"))
def deploy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a scorer may be deployed: its ROC area is high enough and little under that of the one in force, the best."""
    per = staged(E.areas(method_rows(spark, sf_dir), "method").select("method", F.col("auroc").alias("auc")), "areas")
    best = per.agg(F.max("auc").alias("best"))
    drop = F.round(F.col("best") - F.col("auc"), 6)
    return per.crossJoin(F.broadcast(best)).select("method", "auc", drop.alias("drop"), ((F.col("auc") >= MIN_AUC) & (drop <= MAX_DROP)).alias("deploy"))  # best is one row


@query(f"""SELECT s.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(diversity, 0.0) AS diversity, coalesce(density, 0.0) AS density, coalesce(quality, (consistency >= 0.45)::INT)::INT AS label,
  CASE WHEN quality IS NOT NULL THEN 1.0 WHEN consistency >= 0.45 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM ({_SCORED_SQL}) s LEFT JOIN labels l ON l.doc_id = s.doc_id""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, absent ones zero, with the reviewed label or else one derived from the decision at lower confidence."""
    rows = _scored(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id", "left")
    good = F.col("consistency") >= 0.45
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        "doc_id", zero("n_words"), zero("diversity"), zero("density"), F.coalesce("quality", good.cast("int")).alias("label"),
        F.when(F.col("quality").isNotNull(), 1.0).when(good, 0.6).otherwise(0.5).alias("confidence"),
    )


#: Stumps of a small boosted ensemble: feature, cut, value below, value from the cut on.
LEARNING_RATE = 0.1
STUMPS = (("diversity", 0.5, -0.6, 0.4), ("density", 0.6, -0.3, 0.3), ("repetition", 0.4, 0.2, -0.8), ("specificity", 0.1, -0.1, 0.2))


@query(f"""SELECT doc_id, round(1 / (1 + exp(-{LEARNING_RATE} * ({" + ".join(f"CASE WHEN {c} < {cut} THEN {lo} ELSE {hi} END" for c, cut, lo, hi in STUMPS)})::DOUBLE)), 9) AS p,
  list_sort([{", ".join(f"{{'w': round(abs(CASE WHEN {c} < {cut} THEN {lo} ELSE {hi} END)::DOUBLE, 9), 'f': '{c}'}}" for c, cut, lo, hi in STUMPS)}], 'DESC')[1].f AS top_feature FROM ({SCORES_SQL})""")
def stump_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boosted sum of stumps, each times the learning rate, through the logistic function, and the feature that moved it most."""
    votes = {c: F.when(F.col(c) < cut, lo).otherwise(hi) for c, cut, lo, hi in STUMPS}
    by = F.sort_array(F.array(*(F.struct(F.round(F.abs(v), 9).alias("w"), F.lit(c).alias("f")) for c, v in votes.items())), asc=False)
    total = reduce(Column.__add__, votes.values())
    return scores(table(spark, sf_dir, "documents")).select("doc_id", F.round(1 / (1 + F.exp(-LEARNING_RATE * total)), 9).alias("p"), by[0]["f"].alias("top_feature"))


@query(_sql(f""", k AS (SELECT method, (doc_id % 30)::INT AS day, score, truth FROM m), w AS (SELECT method, d.day AS day, score, truth FROM k JOIN (SELECT unnest(range(6, 30))::INT AS day) d ON k.day BETWEEN d.day - 6 AND d.day),
  a AS ({_AUC_SQL.format('method, day').replace('FROM m', 'FROM w')}), b AS ({_AUC_SQL.format('method').replace('FROM m', 'FROM m').replace('AS auc', 'AS base')})
  SELECT a.method, day, a.rows, round(coalesce(auc, 0), 6) AS auc, a.rows >= 30 AND auc IS NOT NULL AND round(base, 6) - round(auc, 6) > {MAX_DROP} AS drifted FROM a JOIN b ON a.method = b.method WHERE a.rows > 0""").replace(") , k AS", "), k AS"))
def week_auc_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC area over each seven days (documents' days are their ids modulo 30) against that over all: a fall beyond the bound, on enough rows, is drift."""
    rows = staged(method_rows(spark, sf_dir).select("method", (F.col("doc_id") % 30).cast("int").alias("of"), "score", "truth"), "scores")
    seven = rows.withColumn("day", F.explode(F.sequence(F.greatest("of", F.lit(6)), F.least(F.col("of") + 6, F.lit(29))))).filter("day - of BETWEEN 0 AND 6")
    sizes = seven.groupBy("method", "day").agg(F.count(F.lit(1)).alias("rows"), (F.max("truth") != F.min("truth")).alias("both"))
    base = E.areas(rows, "method").select("method", F.col("auroc").alias("base"))
    both = E.areas(seven, "method", "day").select("method", "day", F.col("auroc").alias("auc")).join(sizes, ["method", "day"]).join(base, "method")
    return both.select("method", "day", "rows", "auc", ((F.col("rows") >= 30) & F.col("both") & (F.col("base") - F.col("auc") > MAX_DROP)).alias("drifted"))


@query(_sql("""SELECT source, method, accepted, escalated, rejected, round((accepted * 0.01 + escalated * 0.25 + rejected * 0.02)::DOUBLE, 6) AS cost, round((accepted * 0.01 + escalated * 0.25 + rejected * 0.02)::DOUBLE * 30, 6) AS monthly
  FROM (SELECT source, method, count(*) FILTER (WHERE decision = 'ACCEPT') AS accepted, count(*) FILTER (WHERE decision = 'ESCALATE') AS escalated, count(*) FILTER (WHERE decision = 'REJECT') AS rejected FROM m GROUP BY 1, 2)"""))
def decision_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the decisions of a source and method cost a day, and in a month of such days."""
    of = lambda d: F.count_if(F.col("decision") == d)
    per = method_rows(spark, sf_dir).groupBy("source", "method").agg(of("ACCEPT").alias("accepted"), of("ESCALATE").alias("escalated"), of("REJECT").alias("rejected"))
    cost = F.col("accepted") * 0.01 + F.col("escalated") * 0.25 + F.col("rejected") * 0.02
    return per.select("*", F.round(cost, 6).alias("cost"), F.round(cost * 30, 6).alias("monthly"))
