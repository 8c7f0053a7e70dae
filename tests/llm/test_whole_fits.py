"""Topics fitted on all rows."""

import math
import random
from collections import Counter

import pytest

from textassay.llm import mixing as M
from textassay.llm import topics as T

DOCS = "doc_id long, text string, lang string, source string"


def test_topics_know_words_that_a_sample_misses(spark):
    """Five of 4000 texts hold a word of their own: enough for a topic, whichever rows a sample would draw."""
    rnd = random.Random(8)
    themes = [[f"{a}{i}" for i in range(20)] for a in ("sea", "law")]
    rows = [(i, " ".join(rnd.choices(themes[i % 2], k=12)), "en", "s") for i in range(4000)] + [(9000 + i, "rareword", "en", "s") for i in range(5)]
    found = {r.doc_id: r.topic for r in M.mixture(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    rare = {found[9000 + i] for i in range(5)}
    assert len(rare) == 1 and rare != {"none"} and "none" not in found.values()


@pytest.mark.parametrize("vocabulary", [8192, 40])
def test_vocabulary_counts_every_row(spark, monkeypatch, vocabulary):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(150)] + ["É", "x" * 70, "x" * 69 + "y"]
    texts = [" ".join(rnd.choices(words, weights=[1 / (1 + i) for i in range(150)] + [0.1] * 3, k=rnd.randint(0, 30))) for _ in range(1500)] + [None]
    monkeypatch.setattr(T, "FLUSH", 50)
    told = T.fit_vocabulary(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4).select(M._utf8("text").alias("text")), vocabulary=vocabulary)
    counts = Counter(w for t in texts for w in {*(t or "").encode().lower().split()})
    kept = sorted(((T._short(w), n) for w, n in counts.items() if 5 <= n <= len(texts) // 2), key=lambda x: (-x[1], x[0]))[:vocabulary]
    assert list(told.at) == [w for w, _ in kept] and len(kept) > 30
    assert all(abs(told.idf[i] - math.log(len(texts) / n)) < 1e-12 for i, (_, n) in enumerate(kept))
    assert told.numbers([b"x" * 70, b"none"]) == (told.at[T._short(b"x" * 70)].to_bytes(2, "little") if T._short(b"x" * 70) in told.at else b"")


def test_a_sweep_sums_every_vector(spark):
    import numpy as np

    rnd = np.random.default_rng(2)
    idf, centre = rnd.random(30) + 0.1, rnd.random((3, 30))
    rows = [np.sort(rnd.choice(30, rnd.integers(0, 12), replace=False)).astype("<u2") for _ in range(400)]
    df = spark.createDataFrame([(bytearray(r.tobytes()),) for r in rows], "numbers binary").repartition(5)
    sums, likeness = T._sweep(df, idf, centre)
    want, total = np.zeros((3, 30)), 0.0
    for r in (r for r in rows if len(r)):
        x = np.zeros(30)
        x[r] = idf[r]
        x /= np.linalg.norm(x)
        want[(centre @ x).argmax()] += x
        total += (centre @ x).max()
    assert np.abs(sums / T.UNIT - want).max() < 1e-3 and abs(likeness / T.UNIT - total) < 1e-2
    again, _ = T._sweep(df.repartition(2), idf, centre)
    assert (again == sums).all()
