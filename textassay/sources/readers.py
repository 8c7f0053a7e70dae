"""Sources: benchmark files, baselines, logs, billing exports. Schemas are given, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = ["id", "prompt", "response", "ground_truth", "source", "category"]


def _sample(df: DataFrame, **columns) -> DataFrame:
    return df.select(*(columns[c].alias(c) for c in SAMPLE))


def truthful_qa(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their best answer as a true response."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    key = F.concat(F.lit("truthfulqa_"), F.substring(F.sha2("Question", 256), 1, 12))
    return _sample(df, id=key, prompt=F.col("Question"), response=F.col("Best Answer"), ground_truth=F.lit(True), source=F.lit("truthfulqa"), category=F.col("Category"))


def fever(spark: SparkSession, path: str) -> DataFrame:
    """Claims, true where they are supported; malformed lines are dropped."""
    df = spark.read.schema("id string, claim string, label string, evidence string").json(path, mode="DROPMALFORMED").filter("claim IS NOT NULL")
    return _sample(df, id=F.col("id"), prompt=F.col("claim"), response=F.col("claim"), ground_truth=F.col("label") == "SUPPORTS", source=F.lit("fever"), category=F.col("label"))


def halu_eval(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON arrays, united; true where not marked as hallucinated. Missing files are skipped."""
    schema = "question string, answer string, right_answer string, hallucination string, knowledge_type string"
    found = [spark.read.schema(schema).json(p, multiLine=True) for p in paths if _exists(spark, p)]
    df = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    key = F.concat(F.lit("halueval_"), F.substring(F.sha2(F.concat_ws("|", "question", "answer"), 256), 1, 12))
    return _sample(df, id=key, prompt=F.col("question"), response=F.col("answer"), ground_truth=~ground_truth(F.col("hallucination")), source=F.lit("halueval"), category=F.col("knowledge_type"))


def hallu_lens(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("id string, task string, prompt string, response string, hallucination_type string, hallucinated boolean, category string").json(path, mode="DROPMALFORMED")
    return _sample(df, id=F.col("id"), prompt=F.col("prompt"), response=F.col("response"), ground_truth=~F.col("hallucinated"), source=F.lit("hallulens"), category=F.col("category"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ground_truth(value) -> Column:
    """A label's truth: a word for yes, or a number over one half."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "yes", "1", "correct", "supports", "factual"), True).when(low.isin("false", "no", "0", "incorrect", "refutes", "hallucination"), False).otherwise(F.coalesce(low.try_cast("double") > 0.5, F.lit(False)))


def all_benchmarks(spark: SparkSession, folder: str, limits: dict[str, int] | None = None) -> DataFrame:
    """Every benchmark that is there, united, with at most so many rows of those that `limits` names. A folder without any is refused."""
    known = {"truthfulqa.csv": truthful_qa, "fever.jsonl": fever, "halueval.json": lambda s, p: halu_eval(s, [p]), "hallulens.jsonl": hallu_lens}
    found = [read(spark, f"{folder}/{name}") for name, read in known.items() if _exists(spark, f"{folder}/{name}")]
    if not found:
        raise ValueError(f"no benchmark in {folder}")
    return capped(reduce(DataFrame.unionByName, found), limits or {})


def point_csv(spark: SparkSession, path: str) -> DataFrame:
    """Points of timestamp, x, y, z with `row`, their canonical line: the time at nine decimals, the numbers as they are written."""
    raw = spark.read.csv(path, header=True)
    number = {c: F.col(c).try_cast("double").alias(c) for c in ("timestamp", "x", "y", "z")}
    line = F.concat_ws(",", F.format_string("%.9f", number["timestamp"]), "x", "y", "z")
    return raw.select(*number.values(), line.alias("row")).dropna(subset=["timestamp", "x", "y", "z"])


def capped(samples: DataFrame, per_source: dict[str, int]) -> DataFrame:
    """At most so many rows of each source, by a hash of the id; other sources are kept whole."""
    w = Window.partitionBy("source").orderBy(F.sha2("id", 256), "id")
    limit = F.create_map(*(x for k, v in per_source.items() for x in (F.lit(k), F.lit(v)))) if per_source else F.create_map().cast("map<string,int>")
    ranked = samples.withColumn("__k", F.row_number().over(w)).withColumn("__most", F.try_element_at(limit, F.col("source")))
    return ranked.filter("__most IS NULL OR __k <= __most").drop("__k", "__most")


def evenly_spaced(samples: DataFrame, total: int, order: str = "id") -> DataFrame:
    """About total rows, each source in proportion, evenly spaced in its order."""
    counts = samples.groupBy("source").agg(F.count(F.lit(1)).alias("__n"))
    every = counts.agg(F.sum("__n").alias("__all"))
    w = Window.partitionBy("source").orderBy(order)
    take = F.least(F.col("__n"), F.greatest(F.lit(1), F.round(F.col("__n") * total / F.col("__all")))).cast("bigint")
    ranked = samples.withColumn("__i", F.row_number().over(w) - 1).join(counts, "source").crossJoin(F.broadcast(every)).withColumn("__t", take)
    starts = F.floor(F.col("__i") * F.col("__t") / F.col("__n"))
    before = F.floor((F.col("__i") - 1) * F.col("__t") / F.col("__n"))
    return ranked.filter((F.col("__i") == 0) | (starts != before)).drop("__i", "__n", "__all", "__t")


def json_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object in each file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def complete_samples(signals: DataFrame, baselines: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Rows present in all three, by id."""
    return signals.join(baselines, key).join(labels, key)


def wal(spark: SparkSession, path: str) -> DataFrame:
    """Replay of a write-ahead log of `time|length|body` lines; malformed lines are skipped."""
    p = r"^([^|]+)\|([0-9]+)\|(.*)$"
    lines = spark.read.text(path).select(*(F.regexp_extract("value", p, k).alias(n) for k, n in ((1, "ts"), (2, "length"), (3, "body"))))
    return lines.select(F.col("ts").try_cast("timestamp").alias("ts"), F.col("length").try_cast("int").alias("length"), "body").filter("ts IS NOT NULL AND length = octet_length(body)")


def outbox(entries: DataFrame, acks: DataFrame) -> DataFrame:
    """entries(seq, ...) with acked, by separate acknowledgement rows."""
    return entries.join(acks.select("seq").distinct().withColumn("__a", F.lit(True)), "seq", "left").withColumn("acked", F.coalesce("__a", F.lit(False))).drop("__a")


def compacted(entries: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Outbox rows without those acknowledged and older than days."""
    old = F.col("ts") < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return entries.filter(~(F.col("acked") & old))


def aws_cost_report(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.select(F.col("lineItem/ProductCode").alias("service"), F.col("lineItem/UnblendedCost").try_cast("double").alias("cost"), F.col("lineItem/UsageStartDate").try_cast("timestamp").alias("ts")).filter("cost IS NOT NULL")


def gcp_billing(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a billing export in JSON lines."""
    df = spark.read.schema("service struct<description: string>, sku struct<description: string>, cost double, usage_start_time string").json(path, mode="DROPMALFORMED")
    return df.select(F.col("service.description").alias("service"), "cost", F.col("usage_start_time").try_cast("timestamp").alias("ts")).filter("cost IS NOT NULL")


def azure_costs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a cost export in CSV."""
    df = spark.read.csv(path, header=True)
    return df.select(F.col("ServiceName").alias("service"), F.col("Cost").try_cast("double").alias("cost"), F.col("UsageDate").try_cast("timestamp").alias("ts")).filter("cost IS NOT NULL")


def between_exclusive(rows: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows after start and before end, both excluded."""
    t = F.col(ts).cast("timestamp")
    return rows.filter((t > F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))
