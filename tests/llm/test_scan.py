"""Secret scans, quality, HTML text and fingerprints: reference results, held-out accuracy, defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from textassay.llm import chunks as K
from textassay.llm import html_text as H
from textassay.llm import quality as Q
from textassay.llm import secrets as Z


def spans_by_regex(text):
    out = []
    for rank, rule in enumerate(Z.BASE + Z.ADDED):
        pattern = {"hex": r"[0-9a-f]+"}.get(rule.kind, rule.pattern)
        for m in re.finditer(pattern, text, re.ASCII | (re.I if rule.any_case else 0)):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


SECRETS = [
    "password = hunter22", "PassWd:'abcdef'", "API_KEY=abc", "apikey: abcdefg", "token=12345", "token = \"x=y==z\"", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "deadbeef" * 3, "deadbeef" * 2 + "0123456",
    "https://me:pw@host/", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890-x", "AIza" + "b" * 35, "ſecret=aaaaaa", "Key", "passwörd=aaaaaa", "secret secret=secret=secret",
]


def test_secret_spans(spark):
    rnd = random.Random(1)
    rows = [(i, "é ".join(rnd.choices(SECRETS + ["plain", "ümlaut", "\n"], k=rnd.randint(0, 8)))) for i in range(200)] + [(300, None), (301, ""), (None, "token=abcdef"), (301, "x" * 500_000 + " token=abcdefg")]
    df = spark.createDataFrame([(i, t, [1], "k") for i, t in rows], "doc_id long, text string, spans array<int>, kind string").repartition(3)
    found = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in Z.secret_spans(df, block_bytes=2000).collect()), key=repr)
    assert found == sorted(((i, spans_by_regex(t or "")) for i, t in rows), key=repr)
    assert Z.secret_spans(df.limit(0)).count() == 0


def test_trigram_queries_are_sound():
    assert Z.trigram_query(r"[0-9a-f]{24,}") is True
    assert Z.trigram_query(r"ab|cdef") is True
    assert Z.trigram_query(r"x*abcd?") == b"abc"
    assert Z.trigram_query(r"AKIA[A-Z]+") == ("and", (b"aki", b"kia"))
    index = Z.BlockIndex([Z.trigram_query(r.pattern) for r in Z.BASE + Z.ADDED])
    texts = [s.encode() for s in SECRETS]
    index.load(texts)
    for rule in Z.BASE + Z.ADDED:
        may = index.candidates(Z.trigram_query(rule.pattern))
        for k, t in enumerate(SECRETS):
            assert may[k] or not rule.regex.search(t)


def brute_marginals(emit, between):
    n = len(emit)
    total, good = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(emit[i] for i in range(n) if y[i]) + sum(between[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward_matches_enumeration():
    rnd = np.random.default_rng(0)
    counts = np.array([1, 5, 3, 8, 2])
    emit, between = rnd.normal(size=counts.sum()), rnd.normal(size=(2, 2))
    marginal, expected = Q.forward_backward(emit, counts, between)
    at = 0
    for n in counts:
        assert np.allclose(marginal[at : at + n], brute_marginals(emit[at : at + n], between))
        at += n
    assert np.isclose(expected.sum(), (counts - 1).sum())


def test_quality_scores():
    """A document's score is the mean of its lines' marginals, each line weighing its bytes and its line feed."""
    texts = [b"One good line of words.\nAnd another one\n!!! ### $$$\n\nmore words here", b"", b"alone", b"\n\n", "é ü\nword | word |".encode()]
    x, _, counts = Q.line_features(texts)
    rng = np.random.default_rng(5)
    z = Q.with_neighbours(x, counts)
    field = Q.LineField(rng.normal(size=z.shape[1]), rng.uniform(0.5, 2, z.shape[1]), rng.normal(size=z.shape[1]), rng.normal(size=(2, 2)))
    at = 0
    for text, score in zip(texts, field.scores(texts), strict=True):
        lines = text.split(b"\n")
        emit = []
        for k in range(len(lines)):
            near = [x[at + j] if 0 <= j < len(lines) else np.zeros(x.shape[1]) for j in (k, k - 1, k + 1)]
            row = np.concatenate([*near, [k == 0, k == len(lines) - 1, 1]])
            emit.append(sum((row - field.mean) / field.scale * field.weights))
        marginals, weights = brute_marginals(np.array(emit), field.between), [len(x) + 1 for x in lines]
        assert score == pytest.approx(sum(m * w for m, w in zip(marginals, weights)) / sum(weights), abs=1e-5)
        at += len(lines)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = Q.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = found[found.quality == 1].score.to_numpy(), found[found.quality == 0].score.to_numpy()
    assert ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()) > 0.97
    assert (found.predicted == found.quality).mean() > 0.95


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, "a", 0.1), (2, "", "b", 0.2), (3, "x\n" * 30_000, "c", 0.3), (None, "ok", "d", 0.4)], "doc_id long, text string, row string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = Q.keep_good(docs, none)
    assert kept.count() == 4 and kept.columns == docs.columns
    marks = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (9, 1)], "doc_id long, quality int")
    assert Q.keep_good(docs, marks).count() <= 4
    assert Q.keep_good(docs.limit(0), marks).count() == 0
    odd = docs.withColumn("a column, with `signs`: int", docs.score)
    assert Q.keep_good(odd, marks).columns == odd.columns
    utf8 = docs.select(docs.doc_id.alias("id"), docs.text.cast("binary").alias("text")).fillna({"id": 1}).filter("text is not null")
    assert Q.fit_field(utf8, spark.createDataFrame([(3, 1)], "id long, label int"), fit_doc_lines=100) is None  # 30,001 lines
    texts = [b"", b"a\n\nb", b"!" * 100_000]
    x, lengths, counts = Q.line_features(texts)
    assert counts.tolist() == [1, 3, 1] and lengths.tolist() == [0, 1, 0, 1, 100_000] and np.isfinite(x).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><!-- hidden -->
<header><p>The site of the day and of the night, with all that is in it for you.</p></header><nav><ul><li><a href="/">Home of the best</a></li></ul></nav>
<div class="cookie-notice">We use the cookies and you have to agree to all of it.</div><article><h1>Title</h1><p>The first &amp; <b>bold</b> words of the text, and
 more   of it.<br>Ti.</p><p>Short.</p><form>Name of the user <input></form><aside>See also the other one</aside><p>Café &#233; &lt;tag&gt;</p>
<div id="comments"><p>I liked the text and the way it is written for us.</p></div></article><footer>&copy; all of the rights</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE) == "Title The first & bold words of the text, and more of it. Ti. Short. Café é <tag>"
    assert H.main_text("") == "" and H.main_text("<p>") == ""
    assert H.main_text("<article><p>cut off in the middle of the wor") == "cut off in the middle of the wor"
    assert H.main_text("<article><p>one two<p>three <a hre") == "one two three"
    assert H.main_text('<article><p title="a>b">x</p><p>5 < 6 and a<b</p></article>').startswith("x 5 < 6")


def test_links_end_and_names_mislead():
    prose = "The first part of the text is about the sea and the way that it has been for all of the people."
    assert H.main_text(f"<article><p>{prose} <a href=x>more</p><p>{prose}</p></article>") == f"{prose} more {prose}"
    assert H.main_text(f"<article><p><a name=top>{prose}<p>{prose}</article>") == f"{prose} {prose}"
    assert H.main_text(f"<body><p><a href=y>one<p>{prose}</p><p>{prose}</p></body>").endswith(f"{prose} {prose}")
    page = f"<nav><a href=/>Home</a></nav><div class='{{}}'><p>{prose}</p><p>{prose}</p><p>{prose}</p></div><footer>all of it</footer>"
    for name in ("discussion", "left side content", "article-body"):
        assert H.main_text(page.format(name)) == f"{prose} {prose} {prose}"
    both = f"<div><p>{prose}</p></div><div class=comments><p>{prose}</p><p>{prose}</p><p>{prose}</p></div>"
    assert H.main_text(both) == prose
    assert H.main_text("<a href=z><h3>Other</h3><p>One of the other texts that the site has for you to read now.</p></a>") == ""


def test_forms_layout_and_adverts():
    prose = "The first part of the text is about the sea and the way that it has been for all of the people of the town, and why it is so."
    body = f"<p>{prose}</p><p>{prose}</p><p>{prose}</p>"
    text = f"{prose} {prose} {prose}"
    frame = "<nav>All of the pages of this site and what they are about</nav>", "<footer>All of the rights are with the owner of this site</footer>"
    assert H.main_text(f"<form id=aspnet>{frame[0]}<div>{body}</div>{frame[1]}</form>") == text
    assert H.main_text(f"<form id=aspnet>{frame[0]}<article>{body}</article>{frame[1]}</form>") == text
    assert H.main_text(f"<div>{body}</div><form><label>Your name and the mail that we have to write to for you</label><p>{prose}</p></form>") == text
    advert = "<div>Buy the best of the shoes for you and your family, with this offer that you will not see again at the store.</div>"
    assert H.main_text(f"{advert}<article>{body}</article>{advert}") == text
    note = "<p>This is the short note of the site that is here for you, and it is not what the page is about.</p>"
    assert text in H.main_text(f"<div class='left side'>{body}</div>{note}")
    assert H.main_text(f"<div>{body}</div><div class=sidebar><p>{prose}</p></div>") == text
    assert H.main_text(f"<div><p>{prose}</p></div><div class='comments side'>{body}</div>") == prose
    assert H.main_text(f"<div><p>{prose}</p></div><div class=ads>{body}</div>") == prose


def test_gold_pages(spark):
    """Pages of the tables: every paragraph of their article, in order, and nothing of the frame."""
    import html as plain

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for p in pages:
        inner = re.search(r"<article.*?>(.*?)</article>", p.html, re.S) or re.search(r"<main.*?>(.*?)</main>", p.html, re.S)
        if inner:
            inner = re.sub(r"(?s)<(script|style|aside|nav|form|footer)\b.*?</\1>|<!--.*?-->", " ", inner[1])
            inner = re.sub(r"(?s)<div[^>]*class=['\"]?(?:ad|ads|comments?)\b.*?</div>", " ", inner)
            inner = re.sub(r"</?(?:p|div|h[1-6]|ul|ol|li|br|section|blockquote|table|tr|td|th|pre|figure|figcaption)\b[^>]*>", " ", inner)
            assert H.main_text(p.html) == " ".join(plain.unescape(re.sub(r"<[^>]*>", "", inner)).split())


def test_pages_cases(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", PAGE, "t"), (3, "u", "<div>" * 5000 + "deep", "t"), (4, "u", '<a b="' * 3000, "t")], "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in H.extract_text(df).collect()}
    assert found[1] == found[2] == "" and found[None].startswith("Title") and len(found) == 5
    assert H.extract_text(df.limit(0)).count() == 0


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        yield i, t[: len(t) - n] + after[:n], after


@pytest.mark.parametrize("ranges", [1, 7])
def test_fingerprints(spark, ranges):
    rnd = random.Random(2)
    rows = [(i * 3, " ".join(rnd.choice(["ab", "céd", "efg"]) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(0, 300)))) for i in range(80)] + [(500, None), (501, ""), (502, "é" * 5000), (503, rnd.choice("ab") * 3)]
    df = spark.createDataFrame([(i, t, "p", True) for i, t in rows], "doc_id long, text string, part string, head boolean").repartition(3)
    found = {r.doc_id: r for r in K.fingerprint_with_next(df, ranges=ranges, block=5).collect()}
    assert len(found) == len(rows)
    for i, text, after in edited(rows):
        own = next(t or "" for j, t in rows if j == i)
        a, b, c = K.chunk_all([own.encode()])[0], K.chunk_all([text.encode()])[0], K.chunk_all([after.encode()])[0]
        r = found[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (a.fingerprint(), b.fingerprint())
        assert r.near_edited == K.containment(a, b) and r.near_next == K.containment(a, c)
    assert K.fingerprint_with_next(df.limit(0)).count() == 0


def test_fingerprint_order_cases(spark):
    rows = [(None, "first of all"), (2, "b" * 40), (2, "a" * 40), (3, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted(r.edited_sha256 for r in K.fingerprint_with_next(df, ranges=3).collect())
    assert found == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t, _ in edited(rows))
    one = K.fingerprint_with_next(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def plain_chunks(data):
    """Chunks byte by byte: a gear hash of the last 16 bytes; strict zeros before the normal size, loose ones after it."""
    words, x, mask = [], 0, (1 << 64) - 1
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        words.append((z ^ (z >> 31)) >> 32)
    out, start = [], 0
    while start < len(data):
        end = start
        while True:
            end += 1
            size = end - start
            if end == len(data) or size == K.LARGEST:
                break
            if size < K.WINDOW:
                continue
            h = 0
            for b in data[max(0, end - 16) : end]:
                h = ((h << 1) + words[b]) & 0xFFFFFFFF
            if h >> 25 == 0 if size < K.NORMAL else h >> 29 == 0:
                break
        out.append(data[start:end])
        start = end
    return out


def test_chunks_byte_by_byte():
    from xxhash import xxh64_intdigest

    rnd = random.Random(8)
    texts = [bytes(rnd.choices(b"abcdefgh \n", k=n)) for n in (0, 1, 15, 16, 17, 31, 32, 33, 254, 255, 256, 3000)] + ["é漢".encode() * 700, b"a" * 2000, bytes(range(256)) * 6]
    for text, found in zip(texts, K.chunk_all(texts), strict=True):
        want = plain_chunks(text)
        assert [b - a for a, b in zip([0, *found.ends], found.ends)] == list(map(len, want))
        assert found.fingerprint() == "".join(sorted({f"{xxh64_intdigest(c) >> 16:012x}{len(c):02x}" for c in want}))


def test_fingerprints_need_numbers(spark):
    with pytest.raises(TypeError):
        K.fingerprint_with_next(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_chunks_cover_and_shift():
    rnd = random.Random(4)
    data = bytes(rnd.randrange(97, 123) for _ in range(20_000))
    a, b = K.chunk_all([data, b"inserted" + data])
    assert a.ends[-1] == len(data) and sum(n for _, n in a.parts) == len(data)
    assert K.containment(a, b) > 0.95 and K.containment(a, a) == 1.0
