"""Ranks, running sums, quantiles, folds and trees over groups that lie in many ranges, against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from textassay.operators import audit as A
from textassay.operators import decisions as D
from textassay.operators import operations as O
from textassay.operators import ranks as R
from textassay.operators.folds import Chain, Digest, ordered_fold


def sample(spark, n=3000, seed=1):
    """A group with two thirds of the rows, a null group, null values."""
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot", "hot", "hot", "hot", "b", None]), rnd.choice([None, *map(float, range(200))]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double, i long").repartition(5)


def test_running(spark):
    rows, df = sample(spark)
    found = R.running(df.withColumn("one", F.lit(1)), ["v", "i"], ["one", "i"], "g").collect()
    groups = defaultdict(list)
    for g, v, i in rows:
        groups[g].append(((v is not None, v), i))
    want = set()
    for g, x in groups.items():
        total, ids = 0, sum(i for _, i in x)
        for k, (_, i) in enumerate(sorted(x)):
            want.add((g, i, k, len(x), total, ids))
            total += i
    assert {(r.g, r.i, r.before_one, r.all_one, r.before_i, r.all_i) for r in found} == want
    assert R.running(df.limit(0).withColumn("one", F.lit(1)), "v", ["one"], "g").count() == 0


def test_quantiles(spark):
    rows, df = sample(spark)
    shares = {"low": 0.0, "q": 0.37, "mid": 0.5, "top": 1.0}
    for r in R.quantiles(df, "v", shares, "g").collect():
        own = [v for g, v, _ in rows if g == r.g and v is not None]
        assert np.allclose([r[k] for k in shares], np.quantile(own, list(shares.values())))
    assert R.quantiles(df, "v", shares).count() == 1


def test_sliding(spark):
    rows, df = sample(spark)
    dealt, w = R.sliding(df, "i", 9, "g", block=25)
    found = {r.i: (r.n, r.s) for r in dealt.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("s", F.sum("i").over(w)).filter("own").collect()}
    seen = defaultdict(list)
    for g, _, i in rows:
        seen[g].append(i)
        assert found[i] == (len(seen[g][-10:]), sum(seen[g][-10:]))
    assert len(found) == len(rows)


def test_ewma(spark):
    rows, df = sample(spark)
    for r in D.ewma(df.filter("v IS NOT NULL"), "v", ["i"], 0.3, "g").collect():
        own = [v for g, v, _ in rows if g == r.g and v is not None]
        mean = own[0]
        for v in own[1:]:
            mean = 0.3 * v + 0.7 * mean
        assert r.n == len(own) and abs(r.ewma - mean) < 1e-9


def test_thirds_keep_nulls(spark):
    rows = [(None,), (None,), *((k,) for k in range(9))]
    found = D.contiguous_thirds(spark.createDataFrame(rows, "x int"), "x").groupBy("third").count().orderBy("third").collect()
    assert sum(r["count"] for r in found) == 11 and [r.third for r in found] == [0, 1, 2]
    assert D.contiguous_thirds(spark.createDataFrame([], "x int"), "x").count() == 0


def test_expiring_writes(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", "b", None]), rnd.randint(0, 5000)) for _ in range(1500)] + [("one", 5), ("one", 5)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    for ttl in (7, 400, 10_000):
        want = set()
        for k in {k for k, _ in rows}:
            last = None
            for s in sorted(s for x, s in rows if x == k):
                if last is None or s >= last + ttl:
                    last = s
                    want.add((k, s))
        found = [(r.k, int(r.ts.timestamp())) for r in O.first_write_with_ttl(df, ["k"], "ts", ttl).collect()]
        assert len(found) == len(want) and {s for _, s in found} == {s for _, s in want} and {k for k, _ in found} == {k for k, _ in want}


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([hashlib.sha256((x[k] + x[min(k + 1, len(x) - 1)]).encode()).hexdigest() for k in range(0, len(x), 2)])
    return levels


def test_trees_and_proofs(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 1024, "e": 1025, "f": 2600, None: 7}
    h = lambda g, i: hashlib.sha256(f"{g}{i}".encode()).hexdigest()
    df = spark.createDataFrame([(g, i, h(g, i)) for g, n in sizes.items() for i in range(n)], "g string, i long, h string").repartition(4)
    tree = A.merkle_tree(df, "h", ["i"], "g")
    want = {(g, lv, k, x) for g, n in sizes.items() for lv, level in enumerate(plain_levels([h(g, i) for i in range(n)])) for k, x in enumerate(level)}
    got = [(r.g, r.level, r["index"], r.hash) for r in tree.collect()]
    assert len(got) == len(want) and set(got) == want
    roots = {r.g: r.root for r in A.merkle_roots_of(tree, "g").collect()}
    proofs = A.merkle_proofs(tree, "g").withColumn("root", A.proved_root(F.col("hash"), F.col("index"), F.col("proof"))).withColumn("forged", A.proved_root(F.sha2("hash", 256), F.col("index"), F.col("proof"))).collect()
    assert len(proofs) == sum(sizes.values())
    assert all(r.root == roots[r.g] and r.forged != r.root for r in proofs)
    assert {len(r.proof) for r in proofs if r.g == "f"} == {12} and {len(r.proof) for r in proofs if r.g == "a"} == {0}
    some = A.merkle_proofs(tree, "g", of=F.col("index") == 2).collect()
    assert sorted(str(r.g) for r in some) == ["None", "c", "d", "e", "f"]
    assert A.merkle_tree(df.limit(0), "h", ["i"], "g").count() == 0


def test_ordered_folds(spark):
    rows = [("hot" if i % 3 else None, i, f"payload {i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, i long, p string").withColumn("p", F.col("p").cast("binary")).repartition(6)
    for kind in (Digest, Chain):
        found = {r.g: (r.entries, r.value) for r in ordered_fold(df, "p", ["i"], kind, "g", piece_bytes=500).collect()}
        for g in ("hot", None):
            state = kind()
            own = [p for x, _, p in rows if x == g]
            for p in own:
                state.add(p.encode())
            assert found[g] == (len(own), state.value())
        assert ordered_fold(df.limit(0), "p", ["i"], kind, "g").count() == 0
    assert ordered_fold(df, "p", ["i"], Digest).head().entries == 4000
