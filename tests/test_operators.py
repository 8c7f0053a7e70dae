"""Operators, sources, sinks and streams on small fixtures."""

import hashlib
import json

from pyspark.sql import functions as F

from textassay.operators import audit as A
from textassay.operators import decisions as D
from textassay.operators import evaluation as E
from textassay.operators import operations as O
from textassay.sources import readers as R
from textassay.sources import writers as W
from textassay.streaming import pipelines as P

EVENTS = "/root/testdata/sf0.001"


def test_first_write_with_ttl(spark):
    rows = spark.createDataFrame([("a", f"2024-01-{d:02d}") for d in (1, 2, 4, 5, 8)], "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    found = [r.ts.day for r in O.first_write_with_ttl(rows, ["k"], "ts", 3 * 86400).orderBy("ts").collect()]
    assert found == [1, 4, 8]


def merkle(leaves):
    if not leaves:
        return "0" * 64
    while len(leaves) > 1:
        leaves = [hashlib.sha256((leaves[k] + leaves[min(k + 1, len(leaves) - 1)]).encode()).hexdigest() for k in range(0, len(leaves), 2)]
    return leaves[0]


def test_merkle_and_chain(spark):
    for n in (0, 1, 2, 3, 5, 8, 9, 33):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        df = spark.createDataFrame([(leaves,)], "l array<string>")
        assert df.select(A.merkle_root(F.col("l"))).head()[0] == merkle(leaves)
    root = bytes(32)
    rows = [(i, hashlib.sha256(bytes([i])).hexdigest()) for i in range(4)]
    for _, h in rows:
        root = hashlib.sha256(root + bytes.fromhex(h)).digest()
    found = A.hash_chain(spark.createDataFrame(rows, "i int, h string").withColumn("s", F.lit(1)), "h", ["i"], "s").head()
    assert found.entries == 4 and found.root == root.hex()


def test_thresholds_and_areas(spark):
    rows = spark.createDataFrame([("m", s / 10, s >= 5, "ACCEPT") for s in range(10)], "method string, score double, truth boolean, decision string")
    assert E.areas(rows, "method").head().auroc == 1.0
    best = E.best_f1(rows, "method").head()
    assert (best.threshold, best.f1) == (0.5, 1.0)
    q = D.conformal_quantiles(rows.select("method", "score"), "score", 0.1, "method").head()
    assert q.q_ceiling == 0.9 and abs(q.q_interpolated - 0.89) < 1e-9 and abs(q.q_linear - 0.81) < 1e-9
    assert spark.range(1).select(E.erfc(F.lit(1.3859))).head()[0] == __import__("pytest").approx(0.05, abs=1e-4)


def test_contiguous_thirds(spark):
    found = D.contiguous_thirds(spark.range(11).repartition(4), "id").groupBy("third").agg(F.min("id"), F.count(F.lit(1))).orderBy("third").collect()
    assert [tuple(r) for r in found] == [(0, 0, 3), (1, 3, 3), (2, 6, 5)]


def test_sources(spark, tmp_path):
    (tmp_path / "qa.csv").write_text('Type,Category,Question,Best Answer,Correct Answers,Incorrect Answers\nA,C,"Is it, so?","Yes ""it"" is",x,y\n')
    (tmp_path / "f.jsonl").write_text('{"id":"1","claim":"c","label":"SUPPORTS"}\nbroken\n{"id":"2","claim":"d","label":"REFUTES"}\n')
    (tmp_path / "h.json").write_text(json.dumps([{"question": "q", "answer": "a", "hallucination": "yes"}, {"question": "r", "answer": "b", "hallucination": "no"}]))
    (tmp_path / "l.jsonl").write_text('{"id":"1","prompt":"p","response":"r","hallucinated":true,"category":"c"}\n')
    base = f"file://{tmp_path}"
    every = R.truthful_qa(spark, f"{base}/qa.csv").unionByName(R.fever(spark, f"{base}/f.jsonl")).unionByName(R.halu_eval(spark, [f"{base}/h.json", f"{base}/none.json"])).unionByName(R.hallu_lens(spark, f"{base}/l.jsonl"))
    assert sorted((r.source, r.ground_truth) for r in every.collect()) == [("fever", False), ("fever", True), ("hallulens", False), ("halueval", False), ("halueval", True), ("truthfulqa", True)]
    assert R.capped(every, {"fever": 1}).filter("source = 'fever'").count() == 1 and R.capped(every, {}).count() == 6
    assert R.evenly_spaced(spark.range(100).select(F.col("id"), F.lit("s").alias("source")), 10).count() == 10
    (tmp_path / "wal.log").write_text("2024-01-01 00:00:00|5|hello\nbad line\n2024-01-01 00:00:01|9|short\n")
    assert [r.body for r in R.wal(spark, f"{base}/wal.log").collect()] == ["hello"]


def test_outbox_and_sinks(spark, tmp_path):
    entries = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-02-01")], "seq int, d string").select("seq", F.col("d").cast("timestamp").alias("ts"))
    box = R.outbox(entries, spark.createDataFrame([(1,), (1,), (3,)], "seq int"))
    assert sorted(r.seq for r in R.compacted(box, "2024-02-02").collect()) == [2, 3]
    W.append_audit(entries, f"file://{tmp_path}/audit")
    W.append_audit(entries, f"file://{tmp_path}/audit")
    assert spark.read.parquet(f"file://{tmp_path}/audit").count() == 6
    W.dead_letters(entries.withColumn("why", F.when(F.col("seq") == 2, "bad")), "why", f"file://{tmp_path}/good", f"file://{tmp_path}/bad")
    assert spark.read.parquet(f"file://{tmp_path}/good").count() == 2
    assert W.markdown(entries.select("seq")).splitlines()[0] == "| seq |"


def _copies(spark, tmp_path):
    """Events in two files, the second repeating some of the first."""
    e = spark.read.parquet(f"{EVENTS}/events.parquet")
    e.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    e.filter("event_id % 10 = 0").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return e


def test_streams_match_batches(spark, tmp_path):
    e = _copies(spark, tmp_path)
    stream = P.read_events(spark, f"file://{tmp_path}/in", 1)
    P.run_once(P.first_writes(stream, horizon="60 days"), f"file://{tmp_path}/c1", "firsts")
    assert spark.table("firsts").count() == e.filter("value >= 0").count() == spark.table("firsts").select("event_id").distinct().count()
    P.run_once(P.daily_totals(stream, "60 days"), f"file://{tmp_path}/c2", "daily", "complete")
    assert spark.table("daily").agg(F.sum("n")).head()[0] == spark.read.parquet(f"file://{tmp_path}/in").count()
    P.run_once(P.sessions(stream), f"file://{tmp_path}/c3", "sess")
    assert spark.table("sess").count() > 0
    P.run_once(P.sliding_errors(stream, "6 hours", "1 hour"), f"file://{tmp_path}/c6", "errs")
    assert spark.table("errs").count() > 0


def test_stateful_streams(spark, tmp_path):
    e = _copies(spark, tmp_path)
    stream = P.read_events(spark, f"file://{tmp_path}/in", 10).filter("event_id % 10 != 0")
    P.run_once(P.stateful_ewma(stream), f"file://{tmp_path}/c4", "means", "update", limit_s=300)
    batch = D.ewma(e.filter("event_id % 10 != 0").select("user_id", "ts", "event_id", "value"), "value", ["ts", "event_id"], 0.3, "user_id")
    assert {r.user_id: round(r.ewma, 6) for r in spark.table("means").collect()} == {r.user_id: round(r.ewma, 6) for r in batch.collect()}
    P.run_once(P.stateful_quota(stream, 3), f"file://{tmp_path}/c5", "quota", limit_s=300)
    assert spark.table("quota").filter("admitted").count() < spark.table("quota").count() == e.filter("event_id % 10 != 0").count()


def test_routed_sink_writes_once(spark, tmp_path):
    sink = P.routed_sink(f"file://{tmp_path}/ok", f"file://{tmp_path}/no", F.col("id") < 5)
    for _ in range(2):
        sink(spark.range(8), 0)
    assert spark.read.parquet(f"file://{tmp_path}/ok").count() == 5


def test_more_sources(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "fever.jsonl").write_text("".join(f'{{"id":"{k}","claim":"c","label":"SUPPORTS"}}\n' for k in range(5)))
    (tmp_path / "hallulens.jsonl").write_text('{"id":"1","prompt":"p","response":"r","hallucinated":true,"category":"c"}\n')
    assert sorted(r.source for r in R.all_benchmarks(spark, base, {"fever": 2}).collect()) == ["fever", "fever", "hallulens"]
    with __import__("pytest").raises(ValueError):
        R.all_benchmarks(spark, f"{base}/none")
    (tmp_path / "p.csv").write_text("timestamp,x,y,z\n1.5,0.10,2,3\nbad,1,2,3\n")
    assert [tuple(r) for r in R.point_csv(spark, f"{base}/p.csv").collect()] == [(1.5, 0.1, 2.0, 3.0, "1.500000000,0.10,2,3")]
    (tmp_path / "g.json").write_text('{"service":{"description":"s"},"cost":1.5,"usage_start_time":"2024-01-01T00:00:00Z"}\n{"service":null}\n')
    (tmp_path / "a.csv").write_text("ServiceName,ResourceGroup,Cost,UsageDate,Currency\nvm,g,2.5,2024-01-02,USD\nvm,g,x,2024-01-02,USD\n")
    assert [(r.service, r.cost, r.ts.day) for r in R.gcp_billing(spark, f"{base}/g.json").unionByName(R.azure_costs(spark, f"{base}/a.csv")).collect()] == [("s", 1.5, 1), ("vm", 2.5, 2)]
    words = spark.createDataFrame([("Factual",), (" yes",), ("0.7",), ("hallucination",), ("0.5",), (None,), ("odd",)], "w string")
    assert [r.t for r in words.select(R.ground_truth(F.col("w")).alias("t")).collect()] == [True, True, True, False, False, False, False]


def test_strategies(spark):
    from textassay.operators.strategies import Strategies

    own = Strategies()
    own.register("double", "x", cost=0.5)(lambda x: 2 * x)
    own.register("sum", "x", "y")(lambda x, y: x + y)
    rows = spark.createDataFrame([(1, 0.2, 0.1), (2, 0.4, 0.5)], "id int, x double, y double")
    table = lambda c: spark.createDataFrame(c, "config string, strategy string, threshold double, margin double, inverted boolean")
    found = {(r.id, r.config): (round(r.score, 9), r.decision, r.cost) for r in own.run(rows, table([("a", "double", 0.5, 0.1, False), ("b", "double", 0.5, 0.1, True), ("c", "sum", 0.35, 0.1, False)])).collect()}
    assert found == {(1, "a"): (0.4, "ESCALATE", 0.5), (2, "a"): (0.8, "ACCEPT", 0.5), (1, "b"): (0.4, "ACCEPT", 0.5), (2, "b"): (0.8, "REJECT", 0.5), (1, "c"): (0.3, "ESCALATE", 0.0), (2, "c"): (0.9, "ACCEPT", 0.0)}
    assert own.run(rows, table([])).count() == 0
    for bad in ([("a", "none", 0.5, 0.1, False)],):
        with __import__("pytest").raises(ValueError):
            own.run(rows, table(bad))
    with __import__("pytest").raises(ValueError):
        own.register("sum", "x")
        own.register("sum", "x")(lambda x: x)
