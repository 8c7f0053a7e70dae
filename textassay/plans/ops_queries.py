"""Operations over events, orders and their dimensions: dedup, quotas, shards, costs, forecasts, alerts and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import joins as J
from ..operators import operations as O
from ..operators.ranks import quantiles
from .registry import Registry, table

query = Registry()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_write_wins(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH RECURSIVE r AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY 1, 2 UNION ALL
  SELECT r.user_id, r.event_type, (SELECT min(ts) FROM events e WHERE e.user_id = r.user_id AND e.event_type = r.event_type AND e.ts >= r.t + INTERVAL 3 DAY) FROM r WHERE r.t IS NOT NULL)
  SELECT user_id, event_type, count(t) AS accepted, epoch_us(max(t)) AS last_us FROM r GROUP BY 1, 2""")
def ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes accepted when the last accepted one of their key is three days old."""
    taken = O.first_write_with_ttl(_events(spark, sf_dir), ["user_id", "event_type"], "ts", 3 * 86400)
    return taken.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("accepted"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE k <= 3) AS admitted, count(*) FILTER (WHERE k > 3) AS denied
  FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM events) GROUP BY 1""")
def tenant_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.within_quota(_events(spark, sf_dir), "user_id", "ts", ["ts", "event_id"], 3)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("denied"))


_HASH = "('0x' || substr(sha256({0}), 1, 8))::BIGINT"
_RING = f"SELECT 'shard-' || s AS shard, {_HASH.format(chr(39) + 'shard-' + chr(39) + ' || s || ' + chr(39) + '#' + chr(39) + ' || v')} AS place FROM (SELECT unnest(range(8)) AS s), (SELECT unnest(range(16)) AS v)"
_ASSIGNED = f"""SELECT k.user_id, coalesce((SELECT arg_min(shard, place) FROM ring WHERE place >= k.h), (SELECT arg_min(shard, place) FROM ring)) AS shard FROM (SELECT user_id, {_HASH.format("user_id::VARCHAR")} AS h FROM (SELECT DISTINCT user_id FROM events)) k"""


def _ring(spark: SparkSession) -> DataFrame:
    nodes = spark.range(8).select(F.concat(F.lit("shard-"), F.col("id")).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("v"))
    return nodes.select("shard", O.ring_hash(F.concat_ws("#", "shard", "v")).alias("at"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("h", O.ring_hash(F.col("user_id").cast("string")))
    return J.next_on_ring(users, "h", _ring(spark), "at", "shard").select("user_id", "shard")


@query(f"WITH ring AS ({_RING}) {_ASSIGNED}")
def ring_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every user: the next of 128 ring positions, wrapping round."""
    return _assigned(spark, sf_dir)


@query(f"WITH ring AS ({_RING}), a AS ({_ASSIGNED}) SELECT shard, count(*) AS users, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM a GROUP BY 1")
def shard_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _assigned(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("users"))
    total = counts.agg(F.sum("users").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("shard", "users", F.round(F.col("users") / F.col("total"), 9).alias("share"))  # total is one row


@query("SELECT doc_id, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT % 100)::INT AS bucket, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT % 100 < 20 AS in_test FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A/B bucket and the deterministic 20 per cent split."""
    b = O.bucket_of(F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", b.alias("bucket"), (b < 20).alias("in_test"))


_COST = "(value * 0.00002 + length(props) * 0.000001 + (json_extract_string(props, '$.k'))::INT * 0.00009 + CASE WHEN event_type = 'purchase' THEN 0.001 ELSE 0.0 END)"


def _cost(p: O.Prices = O.Prices()):
    k = F.get_json_object("props", "$.k").cast("int")
    return F.col("value") * p.compute + F.length("props") * p.storage + k * p.network + F.when(F.col("event_type") == "purchase", p.anchor).otherwise(0.0)


@query(f"""SELECT user_id, day, n, round(cost, 6) AS cost, CASE WHEN round(cost, 6) / 0.02 >= 1.0 THEN 'deny' WHEN round(cost, 6) / 0.02 >= 0.9 THEN 'throttle' WHEN round(cost, 6) / 0.02 >= 0.7 THEN 'degrade' ELSE 'allow' END AS action
  FROM (SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS n, sum({_COST}) AS cost FROM events GROUP BY 1, 2)""")
def tenant_daily_cost_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(_cost()), 6).alias("cost"))
    return per.select("user_id", "day", "n", "cost", O.budget_action(F.col("cost"), F.lit(0.02)).alias("action"))


@query(f"SELECT user_id, event_type, count(*) AS n, round(sum({_COST}), 6) AS cost FROM events GROUP BY ROLLUP (user_id, event_type)")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by user and kind, by user, and in all."""
    return _events(spark, sf_dir).rollup("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(_cost()), 6).alias("cost"))


@query("""SELECT b.o_orderstatus AS service, round(billed, 2) AS billed, round(coalesce(tracked, 0), 2) AS tracked, round(share, 6) AS share, CASE WHEN share <= 0.03 THEN 'reconciled' WHEN share <= 0.05 THEN 'warning' ELSE 'discrepancy' END AS status
  FROM (SELECT *, abs(billed - coalesce(tracked, 0)) / billed AS share FROM (SELECT o_orderstatus, sum(o_totalprice) AS billed FROM orders GROUP BY 1) b0
    LEFT JOIN (SELECT o_orderstatus AS s, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS tracked FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) t ON s = o_orderstatus) b""")
def billing_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billed order prices against the sum of their lines, by status."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    billed = orders.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("billed"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    per_order = lines.groupBy("l_orderkey").agg(F.sum(price).alias("p"))
    tracked = per_order.join(orders.select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.sum("p").alias("tracked"))
    both = billed.join(tracked, "o_orderstatus", "left").withColumn("tracked", F.coalesce("tracked", F.lit(0.0)))
    share = F.abs(F.col("billed") - F.col("tracked")) / F.col("billed")
    return both.select(F.col("o_orderstatus").alias("service"), F.round("billed", 2).alias("billed"), F.round("tracked", 2).alias("tracked"), F.round(share, 6).alias("share"), O.reconcile_status(share).alias("status"))


@query("SELECT o_orderkey AS entry FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without an acknowledgement: orders none of whose lines was settled."""
    acks = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(acks, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("entry"))


@query("""WITH c AS (SELECT r_name, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
  d AS (SELECT a.r_name AS region_a, b.r_name AS region_b, abs(a.n - b.n) / ((a.n + b.n) / 2) AS d FROM c a JOIN c b ON a.r_name < b.r_name)
  SELECT region_a, region_b, round(d, 9) AS divergence, CASE WHEN d > 0.5 THEN 'manual' WHEN d > 0.2 THEN 'replay' WHEN d > 0.05 THEN 'monitor' ELSE 'none' END AS action FROM d""")
def region_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-count divergence of all region pairs and the action proposed."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    a, b = c.select(F.col("r_name").alias("region_a"), F.col("n").alias("x")), c.select(F.col("r_name").alias("region_b"), F.col("n").alias("y"))
    d = O.divergence(F.col("x"), F.col("y"))
    return a.join(b, F.col("region_a") < F.col("region_b")).select("region_a", "region_b", F.round(d, 9).alias("divergence"), O.divergence_action(d).alias("action"))  # a region is one row


@query("""SELECT tier, count(*) AS users, sum(n)::BIGINT AS events FROM (SELECT user_id, count(*) AS n, CASE WHEN age < 3600 THEN 'hot' WHEN age < 604800 THEN 'warm' ELSE 'cold' END AS tier
  FROM (SELECT user_id, event_type, ts, epoch(TIMESTAMP '2024-02-01' - max(ts) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id)) AS age FROM events) GROUP BY user_id, age) GROUP BY 1""")
def tier_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by tier, from the age of their last purchase as of 2024-02-01."""
    per = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"))
    age = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros("last")) / 1e6
    return per.groupBy(O.tier_of(age).alias("tier")).agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"))


@query("SELECT user_id, count(*) AS hits FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1 HAVING count(*) >= 5 ORDER BY hits DESC, user_id LIMIT 20")
def promotion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 users most active in the last week: a top-k report."""
    recent = _events(spark, sf_dir).filter(F.col("ts") >= F.lit("2024-01-24").cast("timestamp")).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    return recent.filter("hits >= 5").orderBy(F.desc("hits"), "user_id").limit(20)


_DAYS = "SELECT event_type, ts::DATE AS day, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


@query(f"""SELECT event_type, (d)::INT AS day, round(level, 6) AS level, round(greatest(0.0, level * (1 - 0.196)), 6) AS low, round(level * 1.196, 6) AS high
  FROM (SELECT event_type, list_reduce(list(total ORDER BY day), lambda a, v: 0.3 * v + 0.7 * a) AS level FROM ({_DAYS}) GROUP BY 1), (SELECT unnest(range(1, 8)) AS d)""")
def cost_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's flat forecast of daily values from exponential smoothing."""
    daily = _events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("d")).agg(F.round(F.sum("value"), 6).alias("total"))
    out = O.flat_forecast(O.exponential_level(daily, "d", "total", 0.3, "event_type"), 7)
    return out.select("event_type", "day", *(F.round(c, 6).alias(c) for c in ("level", "low", "high")))


@query("""WITH w AS (SELECT epoch_us(s) AS start_us, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM (SELECT event_type, unnest(list_transform(range(6), lambda i: time_bucket(INTERVAL 1 HOUR, ts) - to_hours(i))) AS s FROM events) GROUP BY 1),
  f AS (SELECT *, sum((errors > 0.25 * n)::INT) OVER (ORDER BY start_us ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM w) SELECT start_us, n, errors FROM f WHERE run = 3""")
def error_rate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows sliding by an hour whose error share stayed over 25 per cent for three windows."""
    rates = O.sliding_rates(_events(spark, sf_dir), "ts", "6 hours", "1 hour", F.col("event_type") == "error").withColumn("one", F.lit(1))
    firing = O.for_duration(rates, F.col("hits") > 0.25 * F.col("n"), "start", 3, "one")
    return firing.select(F.unix_micros("start").alias("start_us"), "n", F.col("hits").alias("errors"))


@query("""SELECT ts::DATE::VARCHAR AS day, count(*) AS n, round(count(*) FILTER (WHERE event_type <> 'error')::DOUBLE / count(*), 6) AS containment, round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*), 6) AS escalation_rate,
  round(quantile_cont(value, 0.95), 6) AS p95, quantile_cont(value, 0.95) < 200 AND count(*) FILTER (WHERE event_type = 'error') < 0.25 * count(*) AS slo_met FROM events GROUP BY 1""")
def kpi_slo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if(F.col("event_type") == "error")
    n, day = F.count(F.lit(1)), F.to_date("ts").cast("string").alias("day")
    rows = _events(spark, sf_dir).select(day, "value", "event_type")
    per = rows.groupBy("day").agg(n.alias("n"), F.round((n - bad) / n, 6).alias("containment"), F.round(bad / n, 6).alias("escalation_rate"), (bad < 0.25 * n).alias("few"))
    both = per.join(quantiles(rows, "value", {"q": 0.95}, "day"), "day")
    return both.select("day", "n", "containment", "escalation_rate", F.round("q", 6).alias("p95"), ((F.col("q") < 200) & F.col("few")).alias("slo_met"))


@query("SELECT quality, count(*) AS n, sum(copies)::BIGINT AS weighted FROM (SELECT l.quality, CASE WHEN l.quality = r.quality AND r.n::DOUBLE / m.n < 0.4 THEN m.n // r.n ELSE 1 END AS copies FROM labels l, (SELECT quality, count(*) AS n FROM labels GROUP BY 1 ORDER BY 2 LIMIT 1) r, (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) m) GROUP BY 1")
def minority_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.oversample(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality")
    return rows.groupBy("quality").agg(F.count_if(F.col("copy") == 1).alias("n"), F.count(F.lit(1)).alias("weighted"))


_ANCHORS = ", ".join(f"('{n}', {c}::DOUBLE, {m}, {r}::DOUBLE)" for n, c, m, r in O.ANCHORS)


@query(f"SELECT strategy, round(CASE WHEN cost <= 30 AND minutes <= 60 THEN (1 / (1 + cost) + 1 / (1 + minutes / 60.0::DOUBLE)) / 2 * reliability ELSE 0.0 END, 9) AS score FROM (VALUES {_ANCHORS}) v(strategy, cost, minutes, reliability)")
def anchoring_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced score of the anchoring strategies under limits of cost and delay."""
    rows = spark.createDataFrame(list(O.ANCHORS), "strategy string, cost double, minutes int, reliability double")
    return O.best_anchor(rows, "balanced", 30.0, 60.0).select("strategy", F.round("score", 9).alias("score"))


_ENTRY = "sha256(event_id || '|' || event_type || '|' || user_id)"


@query(f"""WITH RECURSIVE e AS (SELECT ts::DATE::VARCHAR AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS k, {_ENTRY} AS h FROM events),
  c AS (SELECT day, 0::BIGINT AS k, repeat('0', 64) AS root FROM (SELECT DISTINCT day FROM e) UNION ALL SELECT c.day, e.k, sha256(unhex(c.root) || unhex(e.h)) FROM c JOIN e ON e.day = c.day AND e.k = c.k + 1)
  SELECT day, max(k) AS entries, arg_max(root, k) AS root FROM c GROUP BY 1""")
def audit_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of each day's chain of event hashes."""
    rows = _events(spark, sf_dir).select(F.to_date("ts").cast("string").alias("day"), "event_id", F.sha2(F.concat_ws("|", "event_id", "event_type", "user_id"), 256).alias("h"))
    return A.hash_chain(rows, "h", ["event_id"], "day")


@query(f"""WITH RECURSIVE l AS (SELECT user_id, 0 AS level, list({_ENTRY} ORDER BY event_id) AS hs FROM events GROUP BY 1
  UNION ALL SELECT user_id, level + 1, list_transform(range(1, (len(hs) + 1) // 2 + 1), lambda i: sha256(hs[2 * i - 1] || hs[least(2 * i, len(hs))])) FROM l WHERE len(hs) > 1)
  SELECT user_id, len(arg_min(hs, level))::INT AS leaves, arg_max(hs, level)[1] AS root FROM l GROUP BY 1""")
def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle root of each user's event hashes, in order."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", F.sha2(F.concat_ws("|", "event_id", "event_type", "user_id"), 256).alias("h"))
    tree = A.merkle_tree(rows, "h", ["event_id"], "user_id")
    return A.merkle_roots_of(tree, "user_id").select("user_id", F.col("leaves").cast("int").alias("leaves"), "root")


@query(f"""WITH RECURSIVE l AS (SELECT user_id, 0 AS level, list({_ENTRY} ORDER BY event_id) AS hs FROM events GROUP BY 1
  UNION ALL SELECT user_id, level + 1, list_transform(range(1, (len(hs) + 1) // 2 + 1), lambda i: sha256(hs[2 * i - 1] || hs[least(2 * i, len(hs))])) FROM l WHERE len(hs) > 1),
  leaves AS (SELECT user_id, unnest(range(len(hs))) AS i, len(hs) AS n FROM l WHERE level = 0),
  paths AS (SELECT user_id, i, coalesce(string_agg(hs[least(xor(i >> level, 1), len(hs) - 1) + 1], '' ORDER BY level) FILTER (WHERE len(hs) > 1), '') AS path FROM leaves JOIN l USING (user_id) GROUP BY 1, 2)
  SELECT user_id, i AS leaf, sha256(path) AS proof_sha256, true AS valid, false AS forged_valid FROM paths""")
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's proof in its user's tree; whether it leads to the root, and whether that of a changed event does."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", F.sha2(F.concat_ws("|", "event_id", "event_type", "user_id"), 256).alias("h"))
    tree = A.merkle_tree(rows, "h", ["event_id"], "user_id")
    proofs = A.merkle_proofs(tree, "user_id")
    leads = lambda leaf: A.proved_root(leaf, F.col("index"), F.col("proof")) == F.col("root")
    return proofs.select("user_id", F.col("index").alias("leaf"), F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), leads(F.col("hash")).alias("valid"), leads(F.sha2("hash", 256)).alias("forged_valid"))


@query("SELECT r_regionkey, sha256(string_agg(sha256(n_name), '' ORDER BY n_nationkey)) AS batch_root FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def audit_batch_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", F.sha2("n_name", 256).alias("root"))
    return A.batch_root(rows, "root", "n_nationkey", "r_regionkey")


@query("""SELECT p_partkey, sha256('{"name":"' || replace(replace(p_name, '\\', '\\\\'), '"', '\\"') || '","price":' || printf('%.9f', round(p_retailprice, 9)) || ',"size":' || p_size || '}') AS digest FROM part""")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each part's canonical record: sorted keys, nine decimals."""
    record = A.canonical_json({"price": A.json_number(F.col("p_retailprice")), "name": A.json_text(F.col("p_name")), "size": F.col("p_size").cast("string")})
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(record, 256).alias("digest"))


@query("""WITH c AS (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2), k AS (SELECT label, list(round(m, 6) ORDER BY d) AS c FROM c GROUP BY 1),
  s AS (SELECT vec_id, k.label, list_distance(embedding::DOUBLE[], c) AS dist FROM embeddings, k) SELECT vec_id, arg_min(label, dist) AS label, round(min(dist), 6) AS distance FROM s GROUP BY 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest label mean of every vector."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c"))
    points = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return J.nearest_centroid(points, "vec_id", "v", centroids, "label", "c").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("SELECT o_orderpriority AS priority, count(*) AS waiting, round(max(epoch(TIMESTAMP '2025-01-01' - o_orderdate)) / 86400, 6) AS oldest_days, round(quantile_cont(epoch(TIMESTAMP '2025-01-01' - o_orderdate), 0.95) / 86400, 6) AS p95_days FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def audit_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.unix_micros(F.lit("2025-01-01").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 1e6
    waiting = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").withColumn("age", age)
    rows = waiting.select(F.col("o_orderpriority").alias("priority"), (F.col("age") / 86400).alias("days"))
    per = rows.groupBy("priority").agg(F.count(F.lit(1)).alias("waiting"), F.round(F.max("days"), 6).alias("oldest_days"))
    return per.join(quantiles(rows, "days", {"q": 0.95}, "priority").select("priority", F.round("q", 6).alias("p95_days")), "priority")
