"""Column functions on hand-computed cases."""

import hashlib
import hmac
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textassay.functions import pcs as P
from textassay.functions import pii
from textassay.functions import signals as S
from textassay.functions import text as T


def value(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items()), F.lit(1).alias("__one"))
    return row.select(column).head()[0]


def arr(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


def test_tokens_and_shingles(spark):
    assert value(spark, T.tokens(F.lit("The quick, BROWN-fox 42 ünï"))) == ["the", "quick", "brown", "fox", "42", "ünï"]
    assert value(spark, T.tokens(F.lit("The boxes are running slowly"), True, True)) == ["box", "runn", "slow"]
    assert value(spark, T.shingles(arr("the", "quick", "brown", "fox"))) == ["the quick", "quick brown", "brown fox"]
    assert value(spark, T.shingles(arr("hello"))) == ["hello"] and value(spark, T.shingles(F.array().cast("array<string>"))) == []


@pytest.mark.parametrize("a, b, plain, multi", [("x y", "x y", 1, 1), ("x", "y", 0, 0), ("hello world foo", "hello world bar", 0.5, 0.5), ("", "", 1, 1), ("x", "", 0, 0), ("x", "x x", 1, 2)])
def test_jaccard(spark, a, b, plain, multi):
    x, y = arr(*a.split()), arr(*b.split())
    assert value(spark, T.shingle_jaccard(x, y)) == plain
    assert value(spark, T.shingle_jaccard(x, y, multiset=True)) == multi


def test_scorers(spark):
    assert value(spark, T.entailment(F.lit("a b c"), F.lit("a b c"))) == 1.0
    assert value(spark, T.entailment(F.lit(""), F.lit("a"))) == 0.0
    assert value(spark, T.judged_factuality(F.lit("According to me, maybe"))) == pytest.approx(0.5)
    assert value(spark, T.specificity(F.lit("In 1969 Neil landed maybe"))) == pytest.approx(1 / 5)  # "maybe" also holds "may"
    assert value(spark, T.repetition(F.lit("cat cat dog of of"))) == pytest.approx(1 / 3)
    assert value(spark, T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(math.sqrt(0.5))
    assert value(spark, T.pooled(F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0))))) == [2.0, 4.0]


def test_pii(spark):
    text = F.lit("me@corp.io x@example.com 555-123-4567 123-45-6789 1234 5678 9012 3456 10.0.0.1 127.0.0.1")
    assert value(spark, pii.found(text, "email")) == ["me@corp.io"] and value(spark, pii.found(text, "ip_address")) == ["10.0.0.1"]
    assert [d.type for d in value(spark, pii.detections(text))] == ["email", "ssn", "credit_card", "phone"]
    assert value(spark, pii.redact(F.lit("write me@corp.io"))) == "write [REDACTED_EMAIL]"
    mail = F.lit("write me@corp.io")
    shown = {m: value(spark, pii.applied(mail, pii.PiiPolicy(m))) for m in ("detect", "block", "redact")}
    assert [(r.text, r.blocked, len(r.detections)) for r in shown.values()] == [("write me@corp.io", False, 1), (None, True, 1), ("write [REDACTED_EMAIL]", False, 1)]
    assert value(spark, pii.applied(F.lit("nothing"), pii.PiiPolicy("block"))).text == "nothing"
    assert [value(spark, pii.confidence("email", F.lit(v))) for v in ("a@b.io", "a@b@c.io", "a@b")] == [0.9, 0.6, 0.6]
    assert [value(spark, pii.confidence("phone", F.lit(v))) for v in ("555-1", "(555) 1", "5551")] == [0.85, 0.85, 0.7]


D = {(3, 5, 9): 0.79248125, (3, 5, 9, 17, 31): 0.866733469, (3, 6, 12, 24): 1.0, (10, 15, 20, 25): 0.440642698, (10, 10, 10, 10): 0.0}


@pytest.mark.parametrize("counts, expected", D.items())
def test_dimension(spark, counts, expected):
    scales = F.array(*(F.lit(2 ** (k + 1)) for k in range(len(counts))))
    assert value(spark, P.dhat(scales, F.array(*map(F.lit, counts)))) == pytest.approx(expected, abs=1e-9)


def test_dimension_cases(spark):
    scales = F.array(F.lit(2), F.lit(4), F.lit(8))
    assert value(spark, P.dhat(scales, P.counts_of(scales, F.create_map(F.lit("2"), F.lit(3), F.lit("4"), F.lit(5))))) is None
    assert value(spark, P.dhat(scales, F.array(F.lit(3), F.lit(0), F.lit(2)))) is None
    five = F.array(*(F.lit(2**k) for k in range(1, 6)))
    assert value(spark, P.dhat(five, F.array(*map(F.lit, (3, 5, 9, 17, 31))), "avg")) == pytest.approx(0.857365188, abs=1e-9)


@pytest.mark.parametrize("d, coh, expected", [(1.3, 0.75, "sticky"), (2.7, 0.5, "non_sticky"), (2.0, 0.6, "mixed")])
def test_regime(spark, d, coh, expected):
    assert value(spark, P.regime(F.lit(d), F.lit(coh))) == expected


def test_verdict(spark):
    row = dict(merkle_root="abc123", epoch=1, D_hat=0.79, coh_star=0.75, r=0.5, regime="sticky", budget=0.35)
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items()), F.array(*map(F.lit, (2, 4, 8))).alias("scales"), F.array(*map(F.lit, (3, 5, 9))).alias("counts"))
    df = df.withColumn("recomputed_d", P.dhat(F.col("scales"), F.col("counts")))
    v = df.select(P.verdict().alias("v")).head().v
    assert v.accepted and v.escalated and v.reason == "budget deviation" and v.recomputed_budget == 0.4
    assert not df.withColumn("D_hat", F.lit(1.5)).select(P.verdict().alias("v")).head().v.accepted
    assert df.select(P.sanity()).head()[0] == "merkle root"
    assert value(spark, P.budget(F.lit(3.0), F.lit(1.0), F.lit(0.1))) == pytest.approx(0.97)


@pytest.mark.parametrize("risk, low, high, expected", [(0.05, 0.04, 0.06, "low_risk_narrow_ci"), (0.15, 0.1, 0.2, "high_risk"), (0.05, 0.0, 0.10, "wide_confidence_interval"), (0.10, 0.1, 0.11, "high_risk")])
def test_route(spark, risk, low, high, expected):
    assert value(spark, P.route(F.lit(risk), F.lit(high) - F.lit(low))) == expected
    assert value(spark, P.route(F.lit(risk), F.lit(0.0), enabled=False)) == "risk_routing_disabled"


def test_signals(spark):
    texts = ["", "a" * 1000, "random 8271 words"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.zlib_ratio("t")).collect()]
    assert found == [1.0] + [round(min(1.0, len(zlib.compress(t.encode(), 6)) / len(t)), 9) for t in texts[1:]]
    x = np.zeros((50, 4))
    assert S.coherence(x)[0] == 1.0 and S.pca_dimension(np.outer(np.arange(20.0), np.ones(4))) == 1 and 0 < S.quantised_ratio(np.random.default_rng(0).normal(size=(200, 16))) <= 1
    sig = spark.createDataFrame([("p",)], "t string").select(S.hmac_sign(F.col("t"), b"k")).head()[0]
    assert sig == hmac.new(b"k", hashlib.sha256(b"p").digest(), hashlib.sha256).hexdigest()
    p = spark.createDataFrame([(3.841458820694124,)], "x double").select(S.chi2_p_value("x")).head()[0]
    assert p == pytest.approx(0.05, abs=1e-9)


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_overlap_is_bounded_and_symmetric(spark, a, b):
    x, y = value(spark, T.overlap(F.lit(a), F.lit(b))), value(spark, T.overlap(F.lit(b), F.lit(a)))
    assert 0 <= x <= 1 and x == y and value(spark, T.overlap(F.lit(a), F.lit(a))) == 1


def test_vector_signals_by_hand():
    """Coherence by histograms, codes by plain loops, PCA by eigenvalues of the covariance."""
    import zlib

    import numpy as np

    from textassay.functions import signals as S

    x = np.random.default_rng(7).normal(size=(60, 16)) * np.linspace(0.2, 3, 16)
    best = 0
    for v in np.random.default_rng(0).standard_normal((100, 16)):
        p = x @ (v / np.sqrt((v * v).sum()))
        best = max(best, np.histogram(p, bins=20)[0].max())
    assert S.coherence(x)[0] == round(best / 60, 9)
    codes = np.zeros((60, 8), np.uint8)
    for j in range(8):
        part = x[:, 2 * j : 2 * j + 2]
        centres = [part[int(k)] for k in np.linspace(0, 59, 16)]
        for _ in range(10):
            near = [min(range(16), key=lambda c: ((p - centres[c]) ** 2).sum()) for p in part]
            centres = [np.mean([p for p, n in zip(part, near) if n == c], axis=0) if c in near else centres[c] for c in range(16)]
        codes[:, j] = [min(range(16), key=lambda c: ((p - centres[c]) ** 2).sum()) for p in part]
    raw = codes.tobytes()
    assert S.quantised_ratio(x) == round(min(1.0, len(zlib.compress(raw, 6)) / len(raw)), 9)
    e = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert S.pca_dimension(x) == next(k for k in range(1, 17) if e[:k].sum() / e.sum() >= 0.95)
    assert S.pca_dimension(np.ones((5, 3))) == 1 and S.coherence(np.ones((5, 3)))[0] == 1.0 and S.quantised_ratio(np.zeros((0, 16))) == 1.0
