"""Signals computed in Arrow batches; checked by rows only, and by unit tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as S
from ..operators import audit as A
from .registry import Registry, table

query = Registry()


@query()
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zlib ratio of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", S.zlib_ratio("text").alias("r"))


@query()
def vector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence, quantised compressibility and PCA dimension of windows of 256 vectors of a label; no window outgrows a task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        x = np.stack(frame["embedding"].to_numpy()).astype(float)
        coh, _ = S.coherence(x)
        return pd.DataFrame([(frame["label"].iloc[0], frame["part"].iloc[0], len(x), coh, S.quantised_ratio(x), S.pca_dimension(x))], columns=["label", "part", "n", "coh_star", "r", "pca95"])

    rows = table(spark, sf_dir, "embeddings").withColumn("part", F.floor(F.col("vec_id") / 2560))
    return rows.groupBy("label", "part").applyInPandas(run, "label int, part bigint, n bigint, coh_star double, r double, pca95 bigint")


@query()
def signed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed digest of each part's canonical record, and its check."""
    key = spark.conf.get("spark.textassay.signingKey", "test-key").encode()  # set your own
    record = A.canonical_json({"name": A.json_text(F.col("p_name")), "price": A.json_number(F.col("p_retailprice"))})
    signed = table(spark, sf_dir, "part").select("p_partkey", record.alias("record")).withColumn("signature", S.hmac_sign(F.col("record"), key))
    return signed.select("p_partkey", "signature", S.hmac_verify(F.col("record"), key, F.col("signature")).alias("valid"))


ARMS = ("fast", "balanced", "thorough", "escalate")


@query("""SELECT arm, count(*) AS pulls, round(avg(reward), 6) AS mean_reward, round(avg(reward) + sqrt(2 * ln((SELECT count(*) FROM events)) / count(*)), 6) AS ucb FROM (SELECT ['fast', 'balanced', 'thorough', 'escalate'][user_id % 4 + 1] AS arm,
  greatest(0.0, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END - CASE WHEN value > 120 THEN (value - 120) / 1000 ELSE 0.0 END) AS reward FROM events) GROUP BY 1""")
def bandit_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulls, mean reward and upper confidence bound of each arm."""
    e = table(spark, sf_dir, "events")
    arm = F.element_at(F.array(*map(F.lit, ARMS)), (F.col("user_id") % 4 + 1).cast("int"))
    reward = F.greatest(F.lit(0.0), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0) - F.when(F.col("value") > 120, (F.col("value") - 120) / 1000).otherwise(0.0))
    per = e.groupBy(arm.alias("arm")).agg(F.count(F.lit(1)).alias("pulls"), F.avg(reward).alias("mean"))
    total = per.agg(F.sum("pulls").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("arm", "pulls", F.round("mean", 6).alias("mean_reward"), F.round(F.col("mean") + F.sqrt(2 * F.log("total") / F.col("pulls")), 6).alias("ucb"))  # total is one row


@query()
def thompson_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded draw from each arm's Beta posterior."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["draw"] = [float(np.random.default_rng(int(a * 1000 + b)).beta(a, b)) for a, b in zip(f["alpha"], f["beta"])]
            yield f[["arm", "alpha", "beta", "draw"]]

    e = table(spark, sf_dir, "events")
    arm = F.element_at(F.array(*map(F.lit, ARMS)), (F.col("user_id") % 4 + 1).cast("int"))
    per = e.groupBy(arm.alias("arm")).agg((F.count_if(F.col("event_type") != "error") + 1.0).alias("alpha"), (F.count_if(F.col("event_type") == "error") + 1.0).alias("beta"))
    return per.mapInPandas(run, "arm string, alpha double, beta double, draw double")
