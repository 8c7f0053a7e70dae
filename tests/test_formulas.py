"""Hand-computed cases of the named formulas."""

import math

import pytest
from pyspark.sql import functions as F

from textassay.functions import combined as C
from textassay.plans import model_queries as M

L = F.lit


def value(spark, c):
    return spark.range(1).select(c.alias("x")).head().x


def test_perplexity_normalisers(spark):
    for p, log, inv, clip in ((1.0, 0.0, 0.0, 0.0), (10.0, 0.5, 0.9, 9 / 19), (100.0, 1.0, 0.99, 1.0), (0.5, 0.0, -1.0, 0.0), (1e6, 1.0, 1 - 1e-6, 1.0)):
        assert [value(spark, C.normalised_perplexity(L(p), how)) for how in ("log", "inv", "clip")] == pytest.approx([log, inv, clip])


def test_named_scores(spark):
    d, coh, r, p = L(1.75), L(0.9), L(0.4), L(10.0)
    assert value(spark, C.suspicion(d, coh, r, p)) == pytest.approx(0.25 * (0.5 + 0.2 + 0.6 + 0.5))
    assert value(spark, C.suspicion(d, coh, r, p, "factuality")) == pytest.approx(0.15 * 0.5 + 0.1 * 0.2 + 0.1 * 0.6 + 0.65 * 0.5)
    assert value(spark, C.suspicion(d, coh, r, p, "degeneracy")) == pytest.approx(0.15 * 0.5 + 0.15 * 0.2 + 0.6 * 0.6 + 0.1 * 0.5)
    assert value(spark, C.calibrated_anomaly(d, coh, r)) == pytest.approx(0.35 * 0.5 + 0.4 * (1 - 0.9 / 1.05) + 0.25 * 0.25 / 0.65)
    assert value(spark, C.nonconformity(d, coh, r)) == pytest.approx(0.4 * 0.3 + 0.3 * 0.1 + 0.3 * 0.6)
    assert value(spark, C.hallucination(d, coh, r)) == pytest.approx(0.5 * (1 - 1.75 / 3) + 0.3 * 0.1 + 0.2 * 0.6)
    assert value(spark, C.normality(d, coh, r)) == pytest.approx(0.35 + 0.25 * 0.25 + 0.4)
    assert value(spark, C.normality(L(2.75), L(0.15), L(0.85))) == pytest.approx(0.35 * 0.5 + 0.25 * 0.5 + 0.4 * 0.5)


def test_sentences_and_outliers(spark, tmp_path):
    texts = {
        1: "He came. then left. It was late! OK.",  # no break before a small letter
        2: "one two three one two three one two three one two three",
        3: "short text",
        4: "Same here. Same here. Same here. Same here. Something else entirely.",
        5: " ".join(f"word{i}" for i in range(30)),
        6: None,
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.sentences, r.longest) for r in M.sentences(spark, str(tmp_path)).collect()}
    assert found[1] == (2, len("He came. then left.")) and found[3] == (1, 10) and found[6][0] is None
    classes = {r.doc_id: (r.points, r["class"]) for r in M.outlier_classes(spark, str(tmp_path)).collect()}
    assert classes == {1: (2, "likely repetition"), 2: (3, "likely repetition"), 3: (0, "too short"), 4: (4, "likely repetition"), 5: (0, "review")}


def test_gates(spark, tmp_path):
    rows = [(0, "view", 10.0)] * 100 + [(1, "view", 300.0)] * 100 + [(2, "view", 10.0)] * 90 + [(2, "error", 200.0)] * 10
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.version: (r.p95, r.failed, r.action) for r in M.canary_gates(spark, str(tmp_path)).collect()}
    assert found == {0: (10.0, 0, "continue"), 1: (300.0, 1, "pause"), 2: (pytest.approx(200.0), 3, "rollback")}
    against = {r.version: (r.risk, r.recommendation) for r in M.canary_against_control(spark, str(tmp_path)).collect()}
    assert against == {1: ("high", "reject"), 2: ("high", "reject")}


def test_learning_rate():
    assert M.LEARNING_RATE == 0.1 and math.isclose(sum(v[3] for v in M.STUMPS), 0.1)
