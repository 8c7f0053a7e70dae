"""Exact and near deduplication against brute force, with every defined case."""

import hashlib
import random
from collections import defaultdict

import pytest

from textassay.llm import exact_dedup as X
from textassay.llm import simhash as S

SCHEMA = "doc_id long, text string, id string, fp long, digit string, kept boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", True) for i, t in rows], SCHEMA).repartition(3)


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i, max(ids, default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a" * 600), (2, "a" * 600), (3, "a" * 600 + "b"), (4, None), (5, ""), (6, "short"), (7, "short"), (8, "é" * 300), (9, "é" * 300), (None, "short"), (None, "alone"), (10, "x" * 300_000), (11, "x" * 300_000 + "y"), (12, "x" * 300_000)]


@pytest.mark.parametrize("width, growth", [(1, 2), (256, 16)])
def test_exact_groups(spark, width, growth):
    rows = ROWS if width > 1 else [r for r in ROWS if len(r[1] or "") < 1000]
    found = X.exact_dedup(frame(spark, rows), first_width=width, growth=growth).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == exact_expected(rows)
    for r in found:
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_repeated_rows_keep_one(spark):
    rows = [(1, "same"), (1, "same"), (1, "same"), (1, "other"), (0, "same")]
    found = X.exact_dedup(frame(spark, rows)).collect()
    assert sum(r.kept for r in found if r.group_size == 4) == 1
    kept = X.drop_exact_copies(frame(spark, rows))
    assert sorted(r.text for r in kept.collect()) == ["other", "same"]
    assert kept.columns == frame(spark, rows).columns


def test_exact_random_prefixes(spark):
    rnd = random.Random(3)
    base = "".join(rnd.choice("ab") for _ in range(2000))
    rows = [(i, base[: rnd.choice([0, 5, 255, 256, 257, 1999, 2000])] + rnd.choice(["", "q"])) for i in range(300)]
    found = X.exact_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == exact_expected(rows)


def test_empty_tables(spark):
    assert X.exact_dedup(frame(spark, [])).count() == 0
    assert X.drop_exact_copies(frame(spark, [])).count() == 0
    assert S.near_classes(frame(spark, [])).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def roots_by_brute_force(values):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = sorted(parent)
    for k, a in enumerate(values):
        for b in values[:k]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("dense", [64, 2, 0])
def test_links_have_the_components_of_all_pairs(spark, dense):
    """Crowded fingerprints: chains, a dense ball, the sign bit; with every way of handling dense lists."""
    rnd = random.Random(dense)
    values = set()
    for _ in range(6):
        v = rnd.getrandbits(64)
        for _ in range(12):
            values.add(signed(v))
            for bit in rnd.sample(range(64), rnd.choice([1, 2, 3])):
                v ^= 1 << bit
    hub = rnd.getrandbits(64)
    for i in range(10):
        values |= {signed(hub ^ (1 << i)), signed(hub ^ (1 << i) ^ (1 << (63 - i)))}
    values |= {0, signed(1 << 63), -1}
    links = S.links(spark.createDataFrame([(v,) for v in values], "fp long"), dense)
    for r in links.collect():
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2
    expected = roots_by_brute_force(values)
    found = {r.node: r.root for r in S.connected_components(links).collect()}
    assert {v: found.get(v, v) for v in values} == expected


def test_fingerprint_cases(spark):
    from xxhash import xxh64_intdigest

    assert S.simhash(b"") == 0 and S.simhash(b" \t\n") == 0
    assert S.simhash(b"One TWO") == signed(xxh64_intdigest(b"one two", 42))
    assert S.simhash("É a".encode()) == signed(xxh64_intdigest("É a".encode(), 42))
    rnd = __import__("random").Random(6)
    texts = [rnd.choice(["", "É ", "\u00a0x\t"]) + " ".join(rnd.choices(["a", "B", "cé", "\x1c", "D\u3000e", "f\x0bg"], k=k)) for k in [*range(12), 70, 300]] + ["w1 w2 w3 w4 " * 30_000]
    for t in texts:
        words = __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert S.simhash(t.encode()) == signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))


def test_near_classes_cases(spark):
    text = " ".join(f"word{i}" for i in range(4000))
    rows = [(5, text), (6, text + " end"), (7, None), (8, ""), (9, "  "), (None, text), (9, "  "), (10, "quite different words here")]
    found = sorted(((r.doc_id, r.component_id) for r in S.near_classes(frame(spark, rows)).collect()), key=repr)
    assert found == sorted([(5, 5), (6, 5), (7, 7), (8, 7), (9, 7), (9, 7), (None, 5), (10, 10)], key=repr)
    kept = S.drop_near_copies(frame(spark, [r for r in rows if r[0] is not None]))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7, 10] and kept.columns == frame(spark, rows).columns


def jaccard_kept(rows, size=5):
    """The ids that brute force keeps: the smallest of every component of pairs of similarity 0.8."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if (not x and not y) or 9 * len(x & y) >= 4 * (len(x) + len(y)) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("dense", [2, 64])
def test_drop_near_copies_reaches_a_similarity_of_0_8(spark, dense, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for length in (1, 4, 5, 6, 9, 14, 30, 80, 150, 300):
        for _ in range(4):
            base = rng.choices(vocabulary, k=length)
            texts += [base, base[: max(1, length * 8 // 10)], base + ["end"], *(edited(rng, base, k) for k in (1, 2, 3, 5))]
    crowd, line = rng.choices(vocabulary, k=120), rng.choices(vocabulary, k=9)
    texts += [edited(rng, crowd, rng.randrange(5)) for _ in range(60)] + [line + rng.choices(vocabulary, k=rng.randrange(1, 60)) for _ in range(60)]
    rows = list(enumerate((" ".join(t) for t in texts), 1)) + [(900, None), (901, " ")]
    monkeypatch.setattr("textassay.llm.near_copies.BLOCK_SETS", 16)
    kept = S.drop_near_copies(frame(spark, rows), dense=dense)
    assert sorted(r.doc_id for r in kept.collect()) == jaccard_kept(rows)
