"""Near copies met by the index of fingerprints."""

from pyspark.sql import functions as F

from textassay.llm import near_copies as N
from textassay.llm import simhash as S


def test_near_copies_are_met_by_their_fingerprints(spark, monkeypatch):
    """With nothing posted for the prefix filter, the index alone links what is two bits apart and verified."""
    text = " ".join(f"word{i}" for i in range(4000))
    rows = [(5, text), (6, text + " end"), (7, "quite different words here and now"), (8, f"{text} {text}"), (9, "short")]
    monkeypatch.setattr(N, "_postings", lambda texts, size, often: spark.createDataFrame([], "key long, node long, n int, pos int"))
    kept = S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7, 9]


def test_fingerprints_link_nothing_below_the_similarity(spark):
    """Sets brought together by one fingerprint are told apart by their shingles."""
    rows = [(i, f"t{i} " + " ".join(f"{i}x{k}" for k in range(20))) for i in range(6)]
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("text", F.encode("text", "UTF-8"))
    prints = N._nodes(texts, 5).withColumn("least", F.col("id")).withColumn("fp", F.lit(7).cast("long")).drop("id").localCheckpoint()
    assert N._printed(prints, 64).count() == 5
    assert N.similar_links(texts, prints).count() == 0
