"""Connected components by neighbour minima and pointer jumping, staged each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node reachable.

    A round lowers each node's root to the smallest root among its neighbours and then to its root's own root, so
    long chains close in a logarithmic number of rounds. Every join reads staged tables on plain exchanges, which
    adaptive execution splits where one root is hot; nothing is collected.
    """
    both = stage(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    roots = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "cc-roots")
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lowered = stage(roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low")), "cc-low")
        up = lowered.select(F.col("node").alias("low"), F.col("low").alias("above"))
        jumped = stage(lowered.join(up, "low").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "cc-roots")
        done = jumped.filter("moved").isEmpty()
        unstage(roots, lowered)
        roots = jumped.select("node", "root")
        roots._staged_at = jumped._staged_at
        if done:
            unstage(both)
            return roots
