"""Logs and sliding calibration over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import segments
from ..staging import shared_dir, staged
from ..streaming import calibration
from .registry import Registry, table

query = Registry()


@query("SELECT event_type, count(*) AS entries, count(DISTINCT event_id) AS different, round(sum(value), 4) AS total, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def segment_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a segmented log by a stream's writer, and replayed from it by a stream that resumes by segment."""
    segments.register(spark)
    home = f"{shared_dir(spark)}/textassay/log-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct("event_id", "event_type", "value")).cast("binary")
    e.select(F.col("ts").cast("timestamp").alias("ts"), body.alias("body")).write.format("segments").mode("append").option("segmentBytes", 1 << 20).save(f"{home}/log")
    for _ in range(2):  # the second run finds nothing new
        q = spark.readStream.format("segments").load(f"{home}/log").writeStream.format("parquet").option("path", f"{home}/replayed").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    seen = spark.read.schema(segments.SCHEMA).parquet(f"{home}/replayed").select(F.from_json(F.col("body").cast("string"), "event_id bigint, event_type string, value double").alias("x")).select("x.*")
    return seen.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("event_id").alias("different"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


_NEWEST = 200


@query(f"""WITH l AS (SELECT *, max(ts) OVER (PARTITION BY event_type) AS last FROM events WHERE value IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM l WHERE last - ts <= INTERVAL 30 DAY)
  SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.9), 6) AS quantile FROM y WHERE k <= {_NEWEST} GROUP BY 1""")
def sliding_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated threshold of each kind of event over its newest values within 30 days."""
    out = calibration.sliding_calibration(table(spark, sf_dir, "events"), "value", "ts", "event_id", 0.1, "event_type", newest=_NEWEST)
    return out.select("event_type", "n", F.round("quantile", 6).alias("quantile"))


def stream_of_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the stream, batch by batch: what each key has after the last."""
    calibration.with_state_store(spark)
    home = f"{shared_dir(spark)}/textassay/calibration-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartitionByRange(6, "ts").sortWithinPartitions("ts").write.parquet(f"{home}/in")
    given = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{home}/in")
    out = calibration.stateful_calibration(given, "event_type", "value", "ts", "event_id", 0.1, newest=_NEWEST)
    written = lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{home}/out/run={k}")
    q = out.writeStream.outputMode("update").foreachBatch(written).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    states = spark.read.schema("key string, n bigint, quantile double, batch long").parquet(f"{home}/out")
    return staged(states.groupBy("key").agg(F.max_by(F.struct("n", "quantile"), "batch").alias("x")).select(F.col("key").alias("event_type"), "x.n", F.round("x.quantile", 6).alias("quantile")), "calibration")
