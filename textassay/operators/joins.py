"""Joins beyond equality: shared shingles, ranges, nearest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def shingle_overlap(left: DataFrame, left_id: str, right: DataFrame, right_id: str, size: int = 3, text_col: str = "text") -> DataFrame:
    """Pairs that share word shingles, their number and Jaccard similarity.

    The smaller side's shingles are an inverted index; documents reach it by an equality join on the shingle, so
    only pairs with something in common are made; a posting carries its text's number of shingles.
    """

    def posted(df: DataFrame, i: str, name: str) -> DataFrame:
        own = df.select(F.col(i).alias(name), F.array_distinct(T.shingles(T.tokens(F.col(text_col)), size)).alias("all"))
        # explode_outer: under explode Spark infers a filter that makes all shingles twice more; its nulls join with nothing
        return own.select(name, F.size("all").alias(f"n_{name}"), F.explode_outer("all").alias("s"))

    met = posted(left, left_id, "l").join(posted(right, right_id, "r"), "s")
    sized = met.groupBy("l", "r", "n_l", "n_r").agg(F.count(F.lit(1)).alias("common"))
    jaccard = F.col("common") / (F.col("n_l") + F.col("n_r") - F.col("common"))
    return sized.select(F.col("l").alias(left_id), F.col("r").alias(right_id), "common", F.round(jaccard, 9).alias("jaccard"))


def nearest_centroid(points: DataFrame, id_col: str, vector_col: str, centroids: DataFrame, key_col: str, centroid_col: str, max_centroids: int = 4096) -> DataFrame:
    """Each point's nearest centroid by Euclidean distance. Centroids are parameters of a model; more than max_centroids are refused."""
    if centroids.limit(max_centroids + 1).count() > max_centroids:
        raise ValueError(f"more than {max_centroids} centroids")
    table = F.broadcast(centroids.agg(F.sort_array(F.collect_list(F.struct(F.col(key_col).alias("k"), F.col(centroid_col).alias("c")))).alias("all")))
    apart = lambda c: F.sqrt(F.aggregate(F.zip_with(F.col(vector_col), c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    best = F.array_min(F.transform(F.col("all"), lambda e: F.struct(apart(e["c"]).alias("d"), e["k"].alias("k"))))
    return points.crossJoin(table).select(F.col(id_col), best["k"].alias(key_col), best["d"].alias("distance"))  # the table is one row


def next_on_ring(keys: DataFrame, hash_col: str, ring: DataFrame, at_col: str, owner_col: str, max_nodes: int = 1 << 16) -> DataFrame:
    """keys with the owner of the first ring position at or after the hash, wrapping round. A ring over max_nodes is refused."""
    if ring.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"more than {max_nodes} ring positions")
    from pyspark.sql import Window

    w = Window.orderBy(at_col)
    spans = ring.select(F.col(at_col).alias("upto"), F.col(owner_col), F.lag(at_col).over(w).alias("after"))  # at most max_nodes rows
    first = spans.filter("after IS NULL")
    last = ring.agg(F.max(at_col).alias("after"))
    spans = spans.fillna(-1, ["after"]).unionByName(first.drop("after").crossJoin(last).withColumn("upto", F.lit(1 << 62)))
    return keys.join(F.broadcast(spans), (keys[hash_col] > spans["after"]) & (keys[hash_col] <= spans["upto"])).drop("after", "upto")
