"""The segmented log and sliding calibration: replay once, torn tails, rotation, restarts, equality with the batch form."""

import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from textassay.plans import log_queries
from textassay.sources import segments as S
from textassay.streaming import calibration as C

NOW = datetime(2024, 1, 2, tzinfo=UTC)


def entries(spark, lo, hi):
    return spark.range(lo, hi).repartition(3).select(F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("line\n|5|"), F.col("id").cast("string")).cast("binary").alias("body"))


def test_records():
    good = S.encoded(NOW, b"a\n|b") + S.encoded(NOW, b"")
    assert [(b, ts) for _, ts, b, _ in S.parsed(good)] == [(b"a\n|b", NOW), (b"", NOW)]
    broken = b"no record\n" + S.encoded(NOW, b"x") + b"2024-01-02T00:00:00+00:00|2|abc\n" + S.encoded(NOW, b"y") + b"|\n"
    assert [b for _, ts, b, _ in S.parsed(broken) if ts] == [b"x", b"y"]
    torn = S.encoded(NOW, b"x") + S.encoded(NOW, b"later")[:-3]
    assert [end for *_, end in S.parsed(torn)] == [len(S.encoded(NOW, b"x"))]
    assert list(S.parsed(b"")) == []


def test_log(spark, tmp_path):
    S.register(spark)
    log = f"{tmp_path}/log"

    def drained():
        q = spark.readStream.format("segments").load(log).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        out = spark.read.parquet(f"{tmp_path}/out")
        return out.count(), out.select(F.count_distinct("body")).head()[0]

    entries(spark, 0, 3000).write.format("segments").mode("append").option("segmentBytes", 20_000).save(log)
    names = S.segments(log)
    assert len(names) > 6 and not (tmp_path / "log" / "_staging").exists() or not list((tmp_path / "log" / "_staging").iterdir())
    back = spark.read.format("segments").load(log)
    assert back.count() == 3000 and back.select(F.count_distinct("segment")).head()[0] == len(names)
    assert sorted(bytes(r.body) for r in back.collect()) == sorted(f"line\n|5|{i}".encode() for i in range(3000))
    assert drained() == (3000, 3000) and drained() == (3000, 3000)
    entries(spark, 3000, 3100).write.format("segments").mode("append").save(log)
    last = tmp_path / "log" / S.segments(log)[-1]
    tail = S.encoded(NOW, b"torn")
    with last.open("ab") as f:
        f.write(tail[:-3])
    assert drained() == (3100, 3100)
    with last.open("ab") as f:
        f.write(tail[-3:])
    assert drained() == (3101, 3101) and spark.read.format("segments").load(log).count() == 3101
    assert spark.read.format("segments").load(f"{tmp_path}/absent").count() == 0


def test_stream_into_log(spark, tmp_path):
    """A stream's batch written twice replaces itself."""
    S.register(spark)
    entries(spark, 0, 50).write.parquet(f"{tmp_path}/in")
    given = spark.readStream.schema("ts timestamp, body binary").parquet(f"{tmp_path}/in")
    for k in range(2):  # the second run starts anew and writes batch 0 again
        q = given.writeStream.format("segments").option("path", f"{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/ck{k}").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    assert spark.read.format("segments").load(f"{tmp_path}/log").count() == 50


def test_calibration_by_stream_and_batch(spark, tmp_path):
    C.with_state_store(spark)
    rnd, rows = random.Random(1), []
    shaped = lambda x: spark.createDataFrame(x, "k string, s long, id long, score double").select("k", F.timestamp_seconds("s").alias("ts"), "id", "score")
    for b in range(3):
        new = [(rnd.choice("aab"), b * 12 * 86400 + rnd.randint(0, 20 * 86400), k + 1000 * b, rnd.random()) for k in range(60)]
        rows += new
        shaped(new).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        given, got = spark.readStream.schema("k string, ts timestamp, id long, score double").parquet(f"{tmp_path}/in"), []
        q = C.stateful_calibration(given, "k", "score", "ts", "id", 0.1, newest=25, late="60 days").writeStream.outputMode("update").foreachBatch(lambda d, i, got=got: got.extend(map(tuple, d.collect()))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        want = {}
        for key in "ab":
            own = sorted((s, i, v) for k, s, i, v in rows if k == key)
            own = [v for s, _, v in own if own[-1][0] - s <= 30 * 86400][-25:]
            want[key] = (len(own), sorted(own))
        batch = {r.k: (r.n, r.quantile) for r in C.sliding_calibration(shaped(rows), "score", "ts", "id", 0.1, "k", newest=25).collect()}
        latest = {k: (n, v) for k, n, v in got}
        for key, (n, own) in want.items():
            place = 0.9 * (n - 1)
            q90 = own[int(place)] + (place - int(place)) * (own[min(int(place) + 1, n - 1)] - own[int(place)])
            assert batch[key][0] == n and abs(batch[key][1] - q90) < 1e-9
            assert latest[key][0] == n and abs(latest[key][1] - q90) < 1e-9
    assert C.sliding_calibration(shaped(rows).limit(0), "score", "ts", "id", 0.1, "k").count() == 0


def test_stream_of_events(spark):
    sf = "/root/testdata/sf0.001"
    found = [sorted(map(tuple, f(spark, sf).collect())) for f in (log_queries.sliding_calibration, log_queries.stream_of_calibration)]
    assert found[0] == found[1]
