"""Proofs are made where the leaves' blocks are."""

import hashlib

from pyspark.sql import functions as F

from textassay.operators import audit as A


def test_a_proof_is_not_moved(spark):
    """Rows are multiplied after the leaves were gathered and not before; roots come with the proofs."""
    h = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    df = spark.createDataFrame([(i % 2, i, h(i)) for i in range(60)] + [(7, i, h(i)) for i in range(2100)], "g long, i long, h string")
    tree = A.merkle_tree(df, "h", ["i"], "g")
    proofs = A.merkle_proofs(tree, "g")
    plan = proofs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate ") == 1 and plan.index("Generate ") < plan.index("Aggregate ")  # the plan's end comes first
    roots = {r.g: r.root for r in A.merkle_roots_of(tree, "g").collect()}
    found = proofs.withColumn("led", A.proved_root(F.col("hash"), F.col("index"), F.col("proof"))).collect()
    assert len(found) == 2160 and all(r.root == r.led == roots[r.g] for r in found)
