"""Studies over the signals and the events: feature subsets, scales, resampling, attributions, versions, rates."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import combined as C
from ..functions import pcs as P
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import timeline as L
from ..operators.strategies import Strategies
from ..staging import staged
from .eval_queries import METHODS_SQL, THRESHOLDS, method_rows
from .model_queries import SIGNALS_SQL, signals
from .registry import Registry, table
from .verify_queries import D_HAT_SQL, PCS_SQL, SCALES, summaries

query = Registry()

FEATURES = ("low_dimension", "odd_coherence", "compressible", "perplexity")
#: Feature subsets of the ablation.
SUBSETS = {
    "dimension": FEATURES[:1], "coherence": FEATURES[1:2], "compressibility": FEATURES[2:3], "perplexity": FEATURES[3:],
    "dimension+compressibility": (FEATURES[0], FEATURES[2]), "compressibility+perplexity": FEATURES[2:], "signals": FEATURES[:3], "all": FEATURES,
}
_C = lambda x: f"least(1.0, greatest(0.0, {x}))"
_FEATURES_SQL = f"SELECT doc_id, {_C('1 - ' + _C('d_hat / 3.5'))} AS low_dimension, abs(coh_star - 0.7) AS odd_coherence, 1 - r AS compressible, {_C('ln(perplexity) / ln(100)')} AS perplexity, NOT truth AS truth FROM ({SIGNALS_SQL}) WHERE truth IS NOT NULL"


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four signals of labelled documents, 0 to 1 and higher for the more suspect; truth is that the text is bad."""
    rows = signals(spark, sf_dir).filter("truth IS NOT NULL")
    return rows.select(
        "doc_id", (1 - C.clipped(F.col("D_hat") / 3.5)).alias("low_dimension"), F.abs(F.col("coh_star") - 0.7).alias("odd_coherence"), (1 - F.col("r")).alias("compressible"),
        C.normalised_perplexity(F.col("perplexity")).alias("perplexity"), (~F.col("truth")).alias("truth"),
    )


def _areas_sql(rows: str, by: str) -> str:
    return f"""SELECT {by}, round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 6) AS auroc, round(sum((tp / p - (tp - pos) / p) * (tp / (tp + fp))), 6) AS auprc
  FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n
    FROM (SELECT {by}, round(score, 10) AS score, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg FROM ({rows}) GROUP BY ALL) WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)) GROUP BY {by}"""


_SUBSETS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS subset, {' + '.join(f'{1 / len(s)!r} * {f}' for f in s)} AS score, truth FROM f" for n, s in SUBSETS.items())


@query(f"WITH f AS ({_FEATURES_SQL}) {_areas_sql(_SUBSETS_SQL, 'subset')}")
def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC area and average precision of each subset of the signals, equally weighted."""
    return M.subset_areas(feature_rows(spark, sf_dir), FEATURES, SUBSETS).select("subset", "auroc", "auprc")


@query()
def optimised_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the signals that the search finds, beside each signal alone, equal weights and the named starts."""
    rows = staged(feature_rows(spark, sf_dir).drop("doc_id"), "features")
    found = M.optimise_weights(rows, FEATURES, list(C.TASK_WEIGHTS.values())[1:])
    return spark.createDataFrame([(n, *map(float, w), float(a)) for n, (w, a) in found.items()], "candidate string, " + ", ".join(f"{f} double" for f in FEATURES) + ", auroc double")


#: Sets of scales, by their places.
SCALE_SETS = {"2,4": (0, 1), "2,4,8": (0, 1, 2), "2,4,8,16": (0, 1, 2, 3), "4,8,16": (1, 2, 3)}
REPLICATES = 40


def _slope_sql(places: tuple[int, ...]) -> str:
    pairs = [f"(l[{j + 1}] - l[{i + 1}]) / {j - i}" for n, i in enumerate(places) for j in places[n + 1 :]]
    return f"list_sort([{', '.join(pairs)}])[{len(pairs) // 2 + 1}]"


def _draw_sql(k: int) -> str:
    u = f"(('0x' || substr(sha256(doc_id::VARCHAR || '|{k // 8}'), {8 * (k % 8) + 1}, 8))::BIGINT)::DOUBLE / 4294967296.0"
    out, total, p = "0", 0.0, 0.36787944117144233
    for w in range(1, 9):
        total += p
        out = f"CASE WHEN {u} >= {total!r}::DOUBLE THEN {w} ELSE {out} END"
        p /= w
    return out


_DRAWS_SQL = lambda v, by: f"SELECT {by}, k, sum(w * {v}) / sum(w) AS draw FROM (SELECT *, unnest(range({REPLICATES})) AS k, unnest([{', '.join(map(_draw_sql, range(REPLICATES)))}]) AS w FROM rows) WHERE {v} IS NOT NULL GROUP BY ALL"
_SCALES_SQL = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS scales, {_slope_sql(s)} AS d, truth FROM s WHERE list_min(counts) > 0" for n, s in SCALE_SETS.items())


@query(f"""WITH s AS (SELECT p.doc_id, counts, list_transform(counts, lambda c: log2(c)) AS l, quality = 0 AS truth FROM ({PCS_SQL}) p JOIN labels USING (doc_id)), rows AS ({_SCALES_SQL}), a AS ({_areas_sql('SELECT scales, -d AS score, truth FROM rows', 'scales')}),
  v AS (SELECT scales, var_pop(draw) AS variance FROM ({_DRAWS_SQL('d', 'scales')}) GROUP BY 1), n AS (SELECT scales, count(*) AS n, avg(d) AS mean FROM rows GROUP BY 1)
  SELECT a.scales, n, round(mean, 6) AS mean, round(variance, 8) AS variance, auroc FROM a JOIN v USING (scales) JOIN n USING (scales)""")
def scale_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each set of scales: the mean dimension, its variance over bootstrap replicates, and the ROC area of low dimension."""
    rows = summaries(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("truth")), "doc_id").filter(F.array_min("counts") > 0)
    of = lambda s: F.array(*(F.col("counts")[k] for k in s))
    each = [F.struct(F.lit(n).alias("scales"), P.median(P.slopes(F.array(*(F.lit(SCALES[k]) for k in s)), of(s))).alias("d")) for n, s in SCALE_SETS.items()]
    long = staged(rows.select("doc_id", "truth", F.explode(F.array(*each)).alias("x")).select("doc_id", "truth", "x.scales", "x.d"), "scales")
    drawn = M.resampled_means(long, "doc_id", ["d"], REPLICATES, "scales").select("scales", "n", F.round("mean_d", 6).alias("mean"), F.round(M.variance(F.col("draws_d")), 8).alias("variance"))
    return drawn.join(E.areas(long.withColumn("score", -F.col("d")), "scales").select("scales", "auroc"), "scales")


@query(f"""WITH m AS ({METHODS_SQL}), rows AS (SELECT doc_id, 1 AS one, sum(CASE method WHEN 'consistency' THEN ok WHEN 'diversity' THEN -ok ELSE 0 END) AS gap FROM (SELECT *, ((decision = 'ACCEPT') = truth)::INT AS ok FROM m) GROUP BY 1),
  d AS (SELECT list_sort(list(draw)) AS x FROM ({_DRAWS_SQL('gap', 'one')})) SELECT (SELECT count(*) FROM rows) AS n, round((SELECT avg(gap) FROM rows), 9) AS difference, round(x[floor(len(x) * 0.025)::INT + 1], 9) AS low, round(x[floor(len(x) * 0.975)::INT + 1], 9) AS high FROM d""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference in accuracy of two scorers and its interval, both resampled with the same draws."""
    ok = ((F.col("decision") == "ACCEPT") == F.col("truth")).cast("int")
    gap = F.sum(F.when(F.col("method") == "consistency", ok).when(F.col("method") == "diversity", -ok).otherwise(0))
    rows = method_rows(spark, sf_dir).groupBy("doc_id").agg(gap.alias("gap"))
    found = M.resampled_means(rows, "doc_id", ["gap"], REPLICATES).withColumn("i", M.interval(F.col("draws_gap")))
    return found.select("n", F.round("mean_gap", 9).alias("difference"), F.round("i.low", 9).alias("low"), F.round("i.high", 9).alias("high"))


_RISKY = ("D_hat", "coh_star", "r", "budget")


def _risk(f: dict[str, Column]) -> Column:
    return P.risk({n: f[n] for n in _RISKY} | {"signal_entropy": P.signal_entropy(*(f[n] for n in _RISKY))})


@cache
def _shapley_sql() -> str:
    """Weighted marginal gains over all subsets of the other features."""
    names = ("d_hat", "coh_star", "r", "budget")

    def risk(inside: frozenset) -> str:
        x = {n: n if n in inside else f"base_{n}" for n in names}
        total = "(" + " + ".join(x.values()) + ")"
        h = " + ".join(f"CASE WHEN {v} > 0 THEN -({v} / {total}) * ln({v} / {total}) ELSE 0.0 END" for v in x.values())
        return f"(1.0 / (1.0 + exp(-(-0.5 + 0.3 * {x['d_hat']} - 0.5 * {x['coh_star']} - 0.4 * {x['r']} - 0.6 * {x['budget']} + 0.2 * ({h})))))"

    subsets = [frozenset(n for k, n in enumerate(names) if code >> k & 1) for code in range(16)]
    column = {s: f"v{code}" for code, s in enumerate(subsets)}
    weight = {0: 0.25, 1: 1 / 12, 2: 1 / 12, 3: 0.25}
    gains = {n: " + ".join(f"{weight[len(s)]!r} * ({column[s | {n}]} - {column[s]})" for s in subsets if n not in s) for n in names}
    listed = ", ".join(f"{{'size': round(abs({g}), 9), 'f': '{_RISKY[names.index(n)]}', 'v': {g}}}" for n, g in gains.items())
    return f"""WITH p AS (SELECT *, {D_HAT_SQL} AS d_hat FROM ({PCS_SQL})), b AS (SELECT {', '.join(f'round(avg({n}), 9) AS base_{n}' for n in names)} FROM p),
  v AS (SELECT doc_id, {', '.join(f'{risk(s)} AS {c}' for s, c in column.items())} FROM p, b), g AS (SELECT doc_id, v15 - v0 AS moved, [{listed}] AS x FROM v)
  SELECT doc_id, round(moved, 9) AS moved, list_sort(x, 'DESC')[1].v AS largest, list_sum(list_transform(x, lambda e: abs(e.v))) AS size FROM g"""


@query(_shapley_sql().replace("list_sum(list_transform(x, lambda e: abs(e.v))) AS size", "round(list_sum(list_transform(x, lambda e: abs(e.v))), 6) AS size").replace("round(moved, 9)", "round(moved, 6)").replace("list_sort(x, 'DESC')[1].v AS", "round(abs(list_sort(x, 'DESC')[1].v), 6) AS"))
def risk_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each summary's risk against that of the mean summary, divided among the signals; the largest share and the sum of sizes."""
    rows = summaries(table(spark, sf_dir, "documents")).select("doc_id", *_RISKY)
    means = rows.agg(*(F.round(F.avg(n), 9).alias(f"base_{n}") for n in _RISKY))
    values, base = {n: F.col(n) for n in _RISKY}, {n: F.col(f"base_{n}") for n in _RISKY}
    explained = rows.crossJoin(F.broadcast(means)).select("doc_id", (_risk(values) - _risk(base)).alias("moved"), M.attributions(_risk, values, base, F.col("doc_id")).alias("a"))  # means is one row
    size = F.aggregate("a", F.lit(0.0), lambda s, x: s + F.abs(x["value"]))
    return explained.select("doc_id", F.round("moved", 6).alias("moved"), F.round(F.abs(F.col("a")[0]["value"]), 6).alias("largest"), F.round(size, 6).alias("size"))


_LOG_SQL = "SELECT event_type AS model, ts, event_id, CASE WHEN event_id % 7 = 0 THEN 'retire' WHEN event_id % 4 = 1 THEN 'revert' WHEN event_id % 4 = 2 THEN 'register' ELSE 'activate' END AS action, 'v' || event_id AS version FROM events WHERE event_id % 50 = 3"


def release_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry's log for each kind of event, drawn from its rows."""
    i = F.col("event_id")
    action = F.when(i % 7 == 0, "retire").when(i % 4 == 1, "revert").when(i % 4 == 2, "register").otherwise("activate")
    return table(spark, sf_dir, "events").filter(i % 50 == 3).select(F.col("event_type").alias("model"), "ts", "event_id", action.alias("action"), F.concat(F.lit("v"), i.cast("string")).alias("version"))


@query(f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS k FROM ({_LOG_SQL})),
  s AS (SELECT DISTINCT model, 0::BIGINT AS k, NULL::TIMESTAMP AS ts, NULL::BIGINT AS event_id, NULL::VARCHAR AS active, NULL::VARCHAR AS previous FROM l
    UNION ALL SELECT l.model, l.k, l.ts, l.event_id, CASE l.action WHEN 'activate' THEN l.version WHEN 'retire' THEN NULL WHEN 'revert' THEN s.previous ELSE s.active END, CASE WHEN l.action IN ('activate', 'retire', 'revert') THEN s.active ELSE s.previous END FROM s JOIN l ON l.model = s.model AND l.k = s.k + 1),
  a AS (SELECT e.event_type AS model, e.value, s.active, s.previous FROM events e ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, ts ORDER BY event_id DESC) AS last FROM s WHERE k > 0) WHERE last = 1) s ON e.event_type = s.model AND e.ts >= s.ts)
  SELECT model, active, previous, count(*) AS n, round(sum(value), 4) AS total FROM a GROUP BY ALL""")
def version_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the version in force when they came and the one a revert would bring back; nulls before the first and after a retirement."""
    log = L.active_versions(release_log(spark, sf_dir), "ts", "event_id", "model")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), "ts", "value")
    placed = L.in_force(rows, "ts", log.select("model", "ts", "event_id", "active", "previous"), "ts", ["event_id", "active", "previous"], "model")
    return placed.groupBy("model", "active", "previous").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: Upper bounds of the latency histogram, and the rules: window and step in seconds, bound, and how long it must hold.
BOUNDS = (10.0, 25.0, 50.0, 100.0, 200.0, 400.0)
WIDTH_S, STEP_S, FOR_S = 6 * 3600, 3600, 2 * 3600
MOST_ERRORS, MOST_LATENCY, LOW_REPEATS, HIGH_REPEATS = 0.25, 150.0, 0.10, 0.90
_W = f"SELECT *, unnest(range(0, {WIDTH_S // STEP_S})) AS j FROM events"


@query(f"""WITH e AS (SELECT *, to_timestamp((epoch_us(ts) // 1000000 // {STEP_S} + 1 + j) * {STEP_S}) AT TIME ZONE 'UTC' AS step FROM ({_W})), per AS (SELECT step, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE seen) AS repeats,
    {', '.join(f'count(*) FILTER (WHERE value <= {b}) AS b{k}' for k, b in enumerate(BOUNDS))} FROM (SELECT e.*, f.earliest < e.event_id AS seen FROM e JOIN (SELECT user_id, min(event_id) AS earliest FROM events GROUP BY 1) f ON f.user_id = e.user_id) GROUP BY 1),
  q AS (SELECT *, 0.95 * n AS rank FROM per), h AS (SELECT *, CASE {' '.join(f"WHEN b{k} >= rank THEN {BOUNDS[k - 1] if k else 0.0} + ({b} - {BOUNDS[k - 1] if k else 0.0}) * (rank - {f'b{k - 1}' if k else 0}) / (b{k} - {f'b{k - 1}' if k else 0})" for k, b in enumerate(BOUNDS))} ELSE {BOUNDS[-1]} END AS p95 FROM q),
  c AS (SELECT step, unnest(['errors', 'latency', 'low repeats', 'high repeats']) AS rule, unnest([errors::DOUBLE / n, p95, repeats::DOUBLE / n, repeats::DOUBLE / n]) AS value, unnest([errors::DOUBLE / n > {MOST_ERRORS}, p95 > {MOST_LATENCY}, repeats::DOUBLE / n < {LOW_REPEATS}, repeats::DOUBLE / n > {HIGH_REPEATS}]) AS active FROM h),
  r AS (SELECT *, epoch(step)::BIGINT - {STEP_S} * row_number() OVER (PARTITION BY rule, active ORDER BY step) AS run FROM c)
  SELECT strftime(step, '%Y-%m-%d %H:%M:%S') AS step, rule, round(value, 6) AS value, active, active AND epoch(step)::BIGINT - min(epoch(step)::BIGINT) OVER (PARTITION BY rule, active, run) >= {FOR_S} AS firing FROM r""")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error share, p95 latency from a histogram, and shares of repeated users over sliding windows, from counters that are
    scraped each hour and begin anew each day; a rule fires once it has held for two hours."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    rows = e.join(first, "user_id").select(F.date_trunc("hour", "ts").alias("hour"), "event_type", "value", (F.col("first") < F.col("event_id")).alias("seen"))
    counts = {"n": F.lit(True), "errors": F.col("event_type") == "error", "repeats": F.col("seen")} | {f"b{k}": F.col("value") <= b for k, b in enumerate(BOUNDS)}
    hourly = rows.groupBy("hour").agg(*(F.count_if(c).cast("double").alias(n) for n, c in counts.items()))  # one row an hour
    series = hourly.select("hour", F.explode(F.array(*(F.struct(F.lit(n).alias("series"), F.col(n).alias("x")) for n in counts))).alias("s")).select("hour", "s.*")
    # a scrape at each hour's end of counters that begin at zero each day, and one of zero when they begin
    day = Window.partitionBy("series", F.to_date("hour")).orderBy("hour")
    scrapes = series.select("series", F.timestamp_seconds(F.unix_timestamp("hour") + STEP_S - 1).alias("at"), F.sum("x").over(day).alias("value"))
    zero = series.select("series", F.date_trunc("day", "hour").alias("at"), F.lit(0.0).alias("value")).distinct()
    rates = staged(L.rates(scrapes.unionByName(zero), "value", "at", WIDTH_S, STEP_S, "series").withColumn("total", F.round(F.col("rate") * WIDTH_S)), "rates")
    wide = rates.groupBy("at").pivot("series", list(counts)).agg(F.first("total")).filter("n > 0").fillna(0.0)
    buckets = wide.select("at", F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(BOUNDS)), F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("n")))).alias("x")).select("at", "x.*")
    p95 = L.histogram_quantile(0.95, buckets, "le", "n", "at").withColumnRenamed("quantile", "p95")
    share = lambda c: F.col(c) / F.col("n")
    rules = {"errors": (share("errors"), share("errors") > MOST_ERRORS), "latency": (F.col("p95"), F.col("p95") > MOST_LATENCY), "low repeats": (share("repeats"), share("repeats") < LOW_REPEATS), "high repeats": (share("repeats"), share("repeats") > HIGH_REPEATS)}
    states = wide.join(p95, "at").select("at", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), v.alias("value"), on.alias("active")) for n, (v, on) in rules.items()))).alias("x")).select("at", "x.*")
    fired = L.firing(states, "at", F.col("active"), STEP_S, FOR_S, "rule")
    return fired.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("step"), "rule", F.round("value", 6).alias("value"), "active", "firing")


baselines = Strategies()


@baselines.register("perplexity", "perplexity", cost=0.0005)
def _by_perplexity(p: Column) -> Column:
    return C.normalised_perplexity(p)


@baselines.register("suspicion", "D_hat", "coh_star", "r", "perplexity", cost=0.0001)
def _by_suspicion(d: Column, coh: Column, r: Column, p: Column) -> Column:
    return C.suspicion(d, coh, r, p)


@baselines.register("nonconformity", "D_hat", "coh_star", "r", cost=0.0001)
def _by_nonconformity(d: Column, coh: Column, r: Column) -> Column:
    return C.nonconformity(d, coh, r)


@baselines.register("normality", "D_hat", "coh_star", "r", cost=0.0001)
def _by_normality(d: Column, coh: Column, r: Column) -> Column:
    return C.normality(d, coh, r)


@baselines.register("risk", "D_hat", "coh_star", "r", "budget", cost=0.0002)
def _by_risk(d: Column, coh: Column, r: Column, budget: Column) -> Column:
    return _risk({"D_hat": d, "coh_star": coh, "r": r, "budget": budget})


#: For each region a configuration: strategy, threshold, margin, whether low scores are good.
_CONFIGURED = (("perplexity", 0.8, 0.1, True), ("suspicion", 0.5, 0.1, True), ("nonconformity", 0.3, 0.05, True), ("normality", 0.7, 0.1, False), ("risk", 0.3, 0.1, True))
_BASE_SQL = {
    "perplexity": "least(1.0, greatest(0.0, ln(perplexity) / ln(100)))",
    "suspicion": f"0.25 * (1 - least(1.0, greatest(0.0, d_hat / 3.5))) + 0.25 * abs(coh_star - 0.7) + 0.25 * (1 - r) + 0.25 * least(1.0, greatest(0.0, ln(perplexity) / ln(100)))",
    "nonconformity": "0.4 * (2.5 - d_hat) / 2.5 + 0.3 * (1 - coh_star) + 0.3 * (1 - r)",
    "normality": "normality",
    "risk": "risk",
}
_COSTS = {"perplexity": 0.0005, "risk": 0.0002}


def _configured_sql(k: int) -> str:
    name, t, margin, low = _CONFIGURED[k]
    score = _BASE_SQL[name]
    accept, escalate = (f"{score} <= {t}", f"{score} <= {t} * (1 + {margin})") if low else (f"{score} >= {t}", f"{score} >= {t} - {margin}")
    return f"SELECT (SELECT r_name FROM region WHERE r_regionkey = {k}) AS config, '{name}' AS strategy, {score} AS score, CASE WHEN {accept} THEN 'ACCEPT' WHEN {escalate} THEN 'ESCALATE' ELSE 'REJECT' END AS decision, {_COSTS.get(name, 0.0001)}::DOUBLE AS cost FROM g"


_PL = lambda x, lo, hi, over: f"CASE WHEN {x} < {lo} THEN greatest(0.0, {x} / {lo}) WHEN {x} <= {hi} THEN 1.0 ELSE greatest(0.0, 1 - ({x} - {hi}) / {over}) END"
_TOTAL = "(d_hat + coh_star + r + budget)"
_ENTROPY_SQL = " + ".join(f"CASE WHEN {v} > 0 THEN -({v} / {_TOTAL}) * ln({v} / {_TOTAL}) ELSE 0.0 END" for v in ("d_hat", "coh_star", "r", "budget"))


@query(f"""WITH g AS (SELECT *, least(1.0, greatest(0.0, 0.35 * {_PL('d_hat', 1.5, 2.5, 0.5)} + 0.25 * {_PL('coh_star', 0.3, 0.6, 0.4)} + 0.40 * {_PL('r', 0.4, 0.7, 0.3)})) AS normality,
    1.0 / (1.0 + exp(-(-0.5 + 0.3 * d_hat - 0.5 * coh_star - 0.4 * r - 0.6 * budget + 0.2 * ({_ENTROPY_SQL})))) AS risk FROM ({SIGNALS_SQL})), a AS ({' UNION ALL '.join(map(_configured_sql, range(5)))})
  SELECT config, strategy, count(*) AS n, count(*) FILTER (WHERE decision = 'ACCEPT') AS accepted, count(*) FILTER (WHERE decision = 'ESCALATE') AS escalated, round(avg(score), 6) AS mean_score, round(sum(cost), 6) AS cost FROM a GROUP BY 1, 2""")
def registered_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered baseline over all documents in one pass, as the regions' configurations deal them."""
    rules = spark.createDataFrame([(k, *c) for k, c in enumerate(_CONFIGURED)], "k int, strategy string, threshold double, margin double, inverted boolean")
    configured = table(spark, sf_dir, "region").join(rules, F.col("r_regionkey") == F.col("k")).select(F.col("r_name").alias("config"), "strategy", "threshold", "margin", "inverted")
    out = baselines.run(signals(spark, sf_dir).select("D_hat", "coh_star", "r", "budget", "perplexity"), configured)
    of = lambda d: F.count_if(F.col("decision") == d)
    return out.groupBy("config", "strategy").agg(F.count(F.lit(1)).alias("n"), of("ACCEPT").alias("accepted"), of("ESCALATE").alias("escalated"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.sum("cost"), 6).alias("cost"))


#: Policies to be simulated: change of the threshold, and the margin below it.
POLICIES = {"as is": (0.0, 0.1), "lenient": (-0.1, 0.1), "strict": (0.1, 0.1), "wide": (0.0, 0.2)}
_POLICY_SQL = " UNION ALL ".join(f"SELECT '{n}' AS policy, method, truth, CASE WHEN score >= t + ({d}) THEN 'ACCEPT' WHEN score >= t + ({d}) - {m} THEN 'ESCALATE' ELSE 'REJECT' END AS decision FROM s" for n, (d, m) in POLICIES.items())


@query(f"""WITH s AS (SELECT method, score, truth, CASE method {' '.join(f"WHEN '{m}' THEN {t}::DOUBLE" for m, t in THRESHOLDS.items())} END AS t FROM ({METHODS_SQL})), p AS ({_POLICY_SQL}),
  g AS (SELECT policy, method, avg((decision = 'ESCALATE')::INT) AS escalation, 1 - avg((decision = 'ACCEPT' AND NOT truth)::INT) AS containment, avg(CASE WHEN decision = 'ESCALATE' THEN 0.005 ELSE 0.001 END)::DOUBLE AS cost FROM p GROUP BY 1, 2),
  d AS (SELECT g.policy, g.method, round(g.escalation, 9) AS escalation, round(g.containment, 9) AS containment, round((g.containment - b.containment) / b.containment * 100, 6) AS containment_delta, round((g.cost - b.cost) / b.cost * 100, 6) AS cost_delta FROM g JOIN g b ON b.method = g.method AND b.policy = 'as is')
  SELECT *, CASE WHEN containment < 0.98 THEN 'high' WHEN cost_delta > 10 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN containment < 0.98 OR cost_delta > 10 THEN 'reject' ELSE 'approve' END AS recommendation FROM d""")
def policy_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past decisions replayed under other policies: escalation, containment and cost against the policy in force, the risk and what is advised."""
    t = F.element_at(F.create_map(*(F.lit(x) for kv in THRESHOLDS.items() for x in kv)), F.col("method"))
    under = F.array(*(F.struct(F.lit(n).alias("policy"), E.decide(F.col("score"), t + d, m).alias("decision")) for n, (d, m) in POLICIES.items()))
    played = method_rows(spark, sf_dir).select("method", "truth", F.explode(under).alias("x")).select("method", "truth", "x.*")
    yes, late = F.col("decision") == "ACCEPT", F.col("decision") == "ESCALATE"
    cost = F.avg(F.when(late, 0.005).otherwise(0.001))
    per = staged(played.groupBy("policy", "method").agg(F.avg(late.cast("int")).alias("e"), (1 - F.avg((yes & ~F.col("truth")).cast("int"))).alias("c"), cost.alias("k")), "policies")
    base = per.filter("policy = 'as is'").select("method", F.col("c").alias("c0"), F.col("k").alias("k0"))
    change = lambda a, b: F.round((F.col(a) - F.col(b)) / F.col(b) * 100, 6)
    out = per.join(base, "method").select("policy", "method", F.round("e", 9).alias("escalation"), F.round("c", 9).alias("containment"), change("c", "c0").alias("containment_delta"), change("k", "k0").alias("cost_delta"))
    breached = F.col("containment") < 0.98
    return out.select("*", F.when(breached, "high").when(F.col("cost_delta") > 10, "medium").otherwise("low").alias("risk"), F.when(breached | (F.col("cost_delta") > 10), "reject").otherwise("approve").alias("recommendation"))
