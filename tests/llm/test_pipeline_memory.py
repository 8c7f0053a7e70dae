"""What a pipeline's stages hold at a time is bounded, and no row depends on the bounds."""

import tracemalloc

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
from textassay.llm import near_copies as N
from textassay.llm import packing, quality
from textassay.llm.common import small_batches, stage

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_within_keep_the_smaller_bound(spark):
    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    before = spark.conf.get(KEY, None)
    texts = spark.range(64, numPartitions=1).selectExpr("repeat(cast(id % 10 as string), 100000) AS text")
    with small_batches(spark, P.BATCH_BYTES):
        sizes = [r.n for r in stage(texts.mapInArrow(held, "n bigint"), "test-sizes").collect()]
    assert len(sizes) >= 6 and max(sizes) < 2 * P.BATCH_BYTES and sum(sizes) >= 6_400_000
    assert spark.conf.get(KEY, None) == before
    whole = [r.n for r in stage(texts.mapInArrow(held, "n bigint"), "test-sizes").collect()]
    assert len(whole) < len(sizes)


def test_fewer_words_kept_give_the_same_pieces(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{k * i % 97} Zürich{k}" for k in range(200))) for i in range(12)] + [(12, None)], "doc_id long, text string")
    few = packing.pieces(docs, most_words=8).drop("rid").collect()
    assert sorted(few) == sorted(packing.pieces(docs).drop("rid").collect()) and len(few) >= 13


def test_pipeline_stages_pass_their_bounds(spark, monkeypatch):
    seen = {}

    def told(docs, **more):
        seen.update(more, bound=int(spark.conf.get(KEY)))
        return docs

    monkeypatch.setattr(P, "pack_documents", told)
    monkeypatch.setattr(P, "drop_near_copies", told)
    docs = spark.range(1)
    P.packing(spark, docs, "")
    assert seen == {"most_words": P.MOST_WORDS, "bound": P.BATCH_BYTES} and P.MOST_WORDS < packing.MOST_WORDS
    P.near_dedup(spark, docs, "")
    assert seen["bound"] == P.BATCH_BYTES


def test_forest_of_full_blocks_is_bounded():
    """Two full blocks of sets that share most shingles: one forest of all, in little more than its matrix of places."""
    rng = np.random.default_rng(5)
    common = rng.integers(-(1 << 62), 1 << 62, 60)
    sets = [np.unique(np.append(common, rng.integers(-(1 << 62), 1 << 62, 2))) for _ in range(2 * N.BLOCK_SETS)]
    rows = [(1, 0, 1, k, None, len(s), N.signature(s)) for k, s in enumerate(sets)]
    schema = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("node", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("sig", pa.binary())])
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    tracemalloc.start()
    try:
        found = N._forest(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == len(sets) - 1
    assert peak < 80 << 20, peak


def test_field_is_fitted_by_any_kind_of_id(spark):
    texts = ["a plain line of good words here", "!!! ||| $$$ 000"]
    for kind in ("long", "int", "string"):
        docs = spark.range(8).selectExpr(f"cast(id as {kind}) AS id", f"encode(if(id % 2 = 0, '{texts[0]}', '{texts[1]}'), 'UTF-8') AS text")
        labels = spark.range(8).selectExpr(f"cast(id as {kind}) AS id", "cast(id % 2 = 0 as int) AS label")
        good, bad = quality.fit_field(docs, labels).scores([x.encode() for x in texts])
        assert good > 0.5 > bad
