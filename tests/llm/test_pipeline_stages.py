"""Stages whose whole rows pass through Python are written in small batches before a caller sees them."""

import corpus_pipeline as P
from textassay.llm.common import is_staged

DOCS = "doc_id long, text string, lang string, source string"


def test_whole_rows_are_staged(spark, tmp_path):
    texts = ["a plain line of good words here", "!!! ||| $$$ 000", None, ""]
    docs = spark.createDataFrame([(i, texts[i % 4], "en", None if i % 3 else "s") for i in range(40)], DOCS)
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(20) if i % 4 < 2], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    good = P.quality(spark, docs, str(tmp_path))
    assert is_staged(good) and good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert {0, 4, 36} <= set(kept) and 1 not in kept and all(kept[i] == texts[i % 4] for i in kept)
    mixed = P.mixing(spark, docs, str(tmp_path))
    assert is_staged(mixed) and mixed.columns == docs.columns
    assert all(r.text == texts[r.doc_id % 4] for r in mixed.collect()) and mixed.count()
