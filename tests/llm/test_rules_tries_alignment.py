"""Quality rules, the prefix trie and tokenizer alignment against plain versions and hand-made cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate
from zlib import crc32

import pytest

from textassay.llm import alignment as A
from textassay.llm import cascade as C
from textassay.llm import prefix_trie as P

CLASH = "doc_id long, text string, id string, kept string, n_words string, links string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "y", "z", "q") for i, t in rows], CLASH).repartition(parts)


# --- quality rules


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def random_text(rnd):
    words = ["a", "b", "the", "x\xa0y", "é", "|", "##", "THE", "no!", "…", "-", "*"]
    return "".join(rnd.choice(words) + rnd.choice([" ", " ", "\n", "\t", "  ", "\r\n", "\x1c", " "]) for _ in range(rnd.randint(0, 120)))


def test_measures_and_verdicts(spark):
    rnd = random.Random(5)
    good = " ".join(f"w{chr(97 + i % 26)}rd{chr(97 + i // 26)}en" for i in range(80))
    rows = [(i, random_text(rnd)) for i in range(300)] + [(400, None), (400, ""), (None, "a b c"), (401, good), (401, good), (402, good.upper()), (403, good.replace(" ", " | ")), (404, "ab " * 300_000), (405, "\n".join(["...", good, "x..."]))]
    found = C.filtered(table(spark, rows)).collect()
    want = []
    for i, t in rows:
        n = plain_measures(t or "")
        base = n[0] < 50 or 100 * n[4] > 50 * n[0]
        m = C.Measured(t or "")
        want.append((i, *n, base, not base and not any(r.rejects(m) for r in C.RULES)))
    assert sorted((tuple(r)[:8] for r in found), key=repr) == sorted(want, key=repr)
    kept = {r.doc_id: r.kept for r in found}
    assert kept[401] and not kept[402] and not kept[403] and not kept[404] and not kept[405]
    assert {r.doc_id: r.failed for r in found if r.doc_id in (402, 405)} == {402: "capitals", 405: "cut_lines"}
    assert C.filtered(table(spark, rows).limit(0)).count() == 0


def test_order_of_rules(spark):
    """Rejections per second among documents left; a rule that only repeats another goes behind it."""
    assert C.ordered({0b001: 10, 0b011: 80, 0b100: 5, 0: 100}, [1.0, 1.0, 1.0]) == [0, 2, 1]
    assert C.ordered({0b01: 10, 0b10: 20}, [1.0, 10.0]) == [0, 1]
    assert C.ordered({}, [3.0, 1.0]) == [1, 0]
    calls = spark.sparkContext.accumulator(0)

    def dear(m):
        calls.add(1)
        return False

    good = " ".join(f"w{chr(97 + i % 26)}rd{chr(97 + i // 26)}en" for i in range(80))
    docs = table(spark, [(i, good if i % 4 else good + " ###" * 60) for i in range(400)])
    rules = (C.Rule("dear", dear), C.RULES[1])
    out = C.filtered(docs, rules=rules, order=[1, 0]).collect()
    assert sum(r.kept for r in out) == 300 and {r.rules_run for r in out} == {1, 2} and calls.value == 300
    verdicts = {order: sorted((r.doc_id, r.kept) for r in C.filtered(docs, rules=rules, order=order).collect()) for order in ((0, 1), (1, 0))}
    assert len({str(v) for v in verdicts.values()}) == 1
    sets, seconds = C.estimate(docs, C.RULES, sample_rows=10)
    assert sum(sets.values()) == 30 and len(seconds) == len(C.RULES)


def test_windows_of_many_different_words():
    words = [str(i).encode() for i in range((1 << 21) + 5)] + [b"1", b"2", b"3"]
    assert C.repeated_words(words) == 6


# --- prefix trie


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append(((turn is not None, turn), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c in own:
        h = crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = []
    for k, m in members.items():
        below = [n for n in members if n[: len(k)] == k]
        out.append((
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(n) == len(k) + 1 for n in below), sum(not any(o[: len(n)] == n and len(o) > len(n) for o in members) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn int, role string, text string, digest string, depth int"


def trie(spark, rows):
    return sorted((tuple(r) for r in P.prefix_trie(spark.createDataFrame([(*r, "x", 7) for r in rows], TURNS).repartition(3)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, monkeypatch, seed):
    monkeypatch.setattr(P, "PIECE", 3)  # runs in the test's process are not bounded by it, the workers' is the default
    rnd = random.Random(seed)
    ids = [*range(0, 40), *range(100, 130), *range(205, 230), 10**12]
    rows = []
    for c in ids:
        for turn in rnd.sample([None, 0, 1, 2, 3, 4, 5, 6], rnd.randint(1, 8)):
            rows.append((c, turn, rnd.choice(["user", "user", None]), rnd.choice(["a", "a", "é😀", "", None])))
    rows += rnd.choices(rows, k=10) + [(None, 1, "user", "a")]  # repeated rows are turns too
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_cases(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "a")]) == []
    turnless = next(c for c in range(101, 200) if crc32(str(c).encode()) % 6 > 0)
    only = trie(spark, [(turnless, 0, "user", "a")])
    assert only == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    long = [(0, k, "user", "x" * (k % 3)) for k in range(700)]
    assert len(trie(spark, long)) == 701
    assert trie(spark, long[:40]) == plain_trie(long[:40])


def test_id_hashes_over_ranges_and_pieces(spark):
    """Groups that cross ranges or exceed a piece hash as a whole."""
    sizes = {b"a": 200_000, b"b": 1, b"c": 70_000, b"d": 3}
    rows = spark.range(270_004).selectExpr("id", "CASE WHEN id < 200000 THEN 'a' WHEN id < 200001 THEN 'b' WHEN id < 270001 THEN 'c' ELSE 'd' END AS k")
    found = {bytes(r.digest): r.sha256 for r in P.id_hashes(rows.selectExpr("CAST(k AS BINARY) AS digest", "id AS conv_id").repartition(5)).collect()}
    start = 0
    for k, n in sizes.items():
        assert found[k] == hashlib.sha256(",".join(map(str, range(start, start + n))).encode()).hexdigest()
        start += n
    assert len(found) == 4


# --- alignment


@pytest.fixture(scope="module")
def plain_alignment():
    import os

    import public_tokenizers
    import sentencepiece

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names, letter = {i: k for k, i in a.get_vocab().items()}, A.byte_letters()

    def run(texts):
        parts, times = [], Counter()
        for t in texts:
            ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
            ib = b.encode(t) if t else []
            ba = [bytes(letter[c] for c in names[i]) for i in ia]
            bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if not t or not b"".join(ba) == b"".join(bb) == (" " + t).encode():
                parts.append(([], [], [], []))
                continue
            ea, eb = list(accumulate(map(len, ba))), list(accumulate(map(len, bb)))
            cuts = sorted(set(ea) & set(eb))
            groups, x, y = [], 0, 0
            for cut in cuts:
                to = x + next(k for k, e in enumerate(ea[x : x + 5000]) if e == cut) + 1, y + next(k for k, e in enumerate(eb[y : y + 5000]) if e == cut) + 1
                groups.append((ia[x : to[0]], ib[y : to[1]]))
                x, y = to
            ends = {}
            for i, e in zip(ia, ea):
                ends.setdefault(e, []).append(i)
            links = [(i, j) for j, e in zip(ib, eb) for i in ends.get(e, ())]
            parts.append((ia, ib, groups, links))
            times.update(links)
        most = defaultdict(int)
        for (_, y), n in times.items():
            most[y] = max(most[y], n)
        return [
            (len(ia), len(ib), len(g), len(ln), sum(times[x] == most[x[1]] for x in ln), sum(times[x] for x in ln), hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g).encode()).hexdigest() if g else "")
            for ia, ib, g, ln in parts
        ]

    return run


ODD = ["a", "é", " ", "  ", "\n", "\t", "\xa0", "　", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "'s", "don't", "１２", "½", "ﬁ", "\x00", "\x1c", "\x85", "😀", "​", "﻿", "word", "The", "...", "!!", "\r\n", "İ", "한국", "ß", "12345", "___", "a b", "  x "]


def test_alignment(spark, plain_alignment, monkeypatch):
    rnd = random.Random(11)
    rows = [(i, "".join(rnd.choices(ODD, k=rnd.randint(1, 12)))) for i in range(400)]
    rows += [(500, None), (500, ""), (None, "The end"), (501, "The end"), (501, "The end"), (502, "x" * 300 + " " + "ab " * 50), (503, " "), (504, "\n")]
    found = A.align_tokenizers(table(spark, rows))
    got = sorted((tuple(r) for r in found.select("doc_id", *A.COUNTS, "n_best", "count_sum", "groups_sha256").collect()), key=repr)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, plain_alignment([t or "" for _, t in rows]))), key=repr)
    assert any(r[1] == 0 for r in got if r[0] not in (500,)) and sum(r[1] > 0 for r in got) > 100
    assert A.align_tokenizers(table(spark, rows).limit(0)).count() == 0


def test_alignment_of_whole_documents(plain_alignment):
    """Tokens by unit are the tokenizers' own on real and on very long texts, and pairs cover every link."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    texts.append(" ".join(texts[:40]))
    own = A.aligner(*A.default_tokenizers())
    numbers, digests, links = own.align(texts)
    want = plain_alignment(texts)
    assert [(*map(int, x), d) for *x, d in zip(*numbers, digests)] == [(*w[:4], w[6]) for w in want]
    assert all((own.pairs.codes[x] // own.pairs.n_b < len(own.a.bytes)).all() for x in links)
