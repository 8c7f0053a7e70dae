"""Weights, resampling, attributions, versions and rates against plain Python."""

import random
from datetime import UTC, datetime, timedelta
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from textassay.operators import models as M
from textassay.operators import timeline as L


def auc(scores, truth):
    pos, neg = [s for s, t in zip(scores, truth) if t], [s for s, t in zip(scores, truth) if not t]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_weights(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    truth = x @ [0.6, 0.4, 0.0] + 0.2 * rng.random(400) > 0.65
    df = spark.createDataFrame([(*map(float, r), bool(t)) for r, t in zip(x, truth)] + [(None, 0.5, 0.5, True), (0.5, 0.5, 0.5, None)], "a double, b double, c double, truth boolean").repartition(3)
    found = M.optimise_weights(df, ["a", "b", "c"], starts=[(0.2, 0.2, 0.6)])
    best, area = found["best"]
    assert abs(sum(best) - 1) < 1e-6 and min(best) >= 0
    for w, a in found.values():
        assert a == pytest.approx(auc(x @ w, truth), abs=1e-6) and area >= a
    assert area > found["equal"][1] + 0.02 and best[2] < 0.15
    subsets = {r.subset: r.auroc for r in M.subset_areas(df.dropna(), ["a", "b", "c"], {"one": ["a"], "two": ["a", "b"]}).collect()}
    assert subsets == {"one": pytest.approx(auc(x[:, 0], truth), abs=1e-6), "two": pytest.approx(auc(x[:, 0] + x[:, 1], truth), abs=1e-6)}


def test_resampled_means(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["g", "g", None]), i, rnd.choice([None, rnd.random()]), rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, u double, v double").repartition(4)
    found = {r.g: r for r in M.resampled_means(df, "i", ["u", "v"], 20, "g").collect()}
    for g in ("g", None):
        own = [(i, u, v) for x, i, u, v in rows if x == g]
        w = M.poisson_draws([str(i) for i, _, _ in own], 20)
        assert found[g].n == sum(u is not None for _, u, _ in own)
        assert np.allclose(found[g].draws_v, (w * np.array([v for *_, v in own])[:, None]).sum(0) / w.sum(0))
        there = [k for k, (_, u, _) in enumerate(own) if u is not None]
        assert np.allclose(found[g].draws_u, (w[there] * np.array([own[k][1] for k in there])[:, None]).sum(0) / w[there].sum(0))
        assert found[g].mean_v == pytest.approx(np.mean([v for *_, v in own]))
    draws = M.poisson_draws([str(i) for i in range(20_000)], 16)
    assert abs(draws.mean() - 1) < 0.01 and abs(draws.var() - 1) < 0.02 and abs(np.corrcoef(draws[:, 0], draws[:, 9])[0, 1]) < 0.03
    one = M.resampled_means(df, "i", ["v"], 40).select(M.interval(F.col("draws_v")).alias("i"), M.variance(F.col("draws_v")).alias("s"), "draws_v").head()
    d = sorted(one.draws_v)
    assert (one.i.low, one.i.high) == (d[1], d[39]) and one.s == pytest.approx(np.var(d))


def shapley(f, x, base):
    n, out = len(x), []
    at = lambda s: f([x[i] if i in s else base[i] for i in range(n)])
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (at({*s, i}) - at({*s})) for k in range(n) for s in combinations(rest, k)))
    return out


def test_attributions(spark):
    plain = lambda v: v[0] * v[1] + 2 * v[2] - max(v[3], v[0])
    model = lambda v: v["a"] * v["b"] + 2 * v["c"] - F.greatest(v["d"], v["a"])
    rows = [[float(x) for x in r] for r in np.random.default_rng(1).normal(size=(20, 4)).round(3)]
    base = [0.1, 0.2, 0.3, 0.4]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a double, b double, c double, d double")
    values, means = {n: F.col(n) for n in "abcd"}, {n: F.lit(b) for n, b in zip("abcd", base)}
    for r in df.select("i", M.attributions(model, values, means, F.col("i")).alias("x")).collect():
        want = shapley(plain, rows[r.i], base)
        assert [e.value for e in sorted(r.x, key=lambda e: e.feature)] == pytest.approx(want)
        assert [abs(e.value) for e in r.x] == sorted((abs(w) for w in want), reverse=True) or np.allclose([abs(e.value) for e in r.x], sorted(map(abs, want), reverse=True))
    drawn = df.select("i", M.attributions(model, values, means, F.col("i"), samples=400, exact_up_to=3).alias("x")).collect()
    for r in drawn:
        want = shapley(plain, rows[r.i], base)
        assert sum(e.value for e in r.x) == pytest.approx(plain(rows[r.i]) - plain(base))
        assert [e.value for e in sorted(r.x, key=lambda e: e.feature)] == pytest.approx(want, abs=0.35)
    again = df.select("i", M.attributions(model, values, means, F.col("i"), samples=400, exact_up_to=3).alias("x")).collect()
    assert drawn == again


DAY = datetime(2024, 1, 1, tzinfo=UTC)
at = lambda m: DAY + timedelta(minutes=m)


def test_versions(spark):
    log = [("m", 0, 1, "register", "v0"), ("m", 1, 2, "revert", None), ("m", 2, 3, "activate", "v1"), ("m", 3, 4, "activate", "v2"), ("m", 4, 5, "revert", None), ("m", 5, 6, "revert", None), ("m", 6, 7, "revert", None), ("m", 7, 8, "activate", "v3"), ("m", 7, 9, "activate", "v4"), ("m", 8, 10, "retire", None), ("m", 9, 11, "revert", None), (None, 2, 1, "activate", "w")]
    df = spark.createDataFrame([(m, at(t), i, a, v) for m, t, i, a, v in log], "model string, ts timestamp, id long, action string, version string").repartition(3)
    active, previous, want = {}, {}, {}
    for m, _t, i, a, v in log:
        now, before = active.get(m), previous.get(m)
        if a == "activate":
            active[m], previous[m] = v, now
        elif a == "retire":
            active[m], previous[m] = None, now
        elif a == "revert":
            active[m], previous[m] = before, now
        want[m, i] = (active.get(m), previous.get(m))
    found = L.active_versions(df, "ts", "id", "model")
    assert {(r.model, r.id): (r.active, r.previous) for r in found.collect()} == want
    rows = [("m", t / 2, k) for k, t in enumerate(range(-2, 24))] + [(None, 1.0, 100), (None, 2.0, 101), ("none", 3.0, 102)]
    asked = spark.createDataFrame([(m, at(t), k) for m, t, k in rows], "model string, ts timestamp, k long").repartition(4)
    placed = {r.k: r.active for r in L.in_force(asked, "ts", found.select("model", "ts", "id", "active"), "ts", ["id", "active"], "model").collect()}
    assert len(placed) == len(rows)
    for m, t, k in rows:
        past = [want[m, i][0] for x, s, i, _, _ in log if x == m and s <= t]
        assert placed[k] == (past[-1] if past else None)


def test_rates_and_histograms(spark):
    counter = [0, 5, 9, 2, 2, 8]  # falls once: 2 since it began anew
    df = spark.createDataFrame([("s", at(k), float(v)) for k, v in enumerate(counter)] + [(None, at(0), 3.0), (None, at(1), 4.0)], "series string, ts timestamp, value double")
    steps = {(r.series, r.ts.replace(tzinfo=UTC)): r.increase for r in L.increases(df, "value", "ts", "series").collect()}
    assert [steps["s", at(k)] for k in range(6)] == [0, 5, 4, 2, 0, 6] and steps[None, at(1)] == 1
    rates = {r.at.replace(tzinfo=UTC): r.rate for r in L.rates(df.filter("series = 's'"), "value", "ts", 180, 60, "series").collect()}
    assert rates[at(3)] == pytest.approx((0 + 5 + 4) / 180) and rates[at(6)] == pytest.approx((2 + 0 + 6) / 180)
    inf = float("inf")
    cases = {"mid": [(1.0, 2), (2.0, 6), (inf, 8)], "low": [(1.0, 8), (2.0, 8), (inf, 8)], "over": [(1.0, 0), (2.0, 1), (inf, 8)], "none": [(1.0, 0), (inf, 0)]}
    hist = spark.createDataFrame([(g, le, n) for g, b in cases.items() for le, n in b], "g string, le double, n long")
    found = {r.g: r.quantile for r in L.histogram_quantile(0.5, hist, "le", "n", "g").collect()}
    assert found == {"mid": 1.5, "low": 0.5, "over": 2.0, "none": None}


def test_firing(spark):
    on = [1, 1, 1, 0, 1, 1, None, 1, 1, 1, 1]
    rows = [("r", at(k), x) for k, x in enumerate(on) if k != 9]  # a step is missing
    df = spark.createDataFrame(rows, "rule string, at timestamp, x int")
    found = [r.firing for r in L.firing(df, "at", F.col("x") == 1, 60, 120, "rule").orderBy("at").collect()]
    assert found == [False, False, True, False, False, False, False, False, False, False]
