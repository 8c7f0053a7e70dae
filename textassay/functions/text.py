"""Text scorers as Column expressions: tokens, shingles, similarities and heuristic quality scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with")
#: Uncertainty markers.
HEDGES = ("maybe", "perhaps", "possibly", "might", "could", "may", "uncertain")
#: Markers that raise and lower a judged factuality.
FACT_MARKERS = ("according to", "research shows", "studies indicate", "evidence suggests")
DOUBT_MARKERS = ("i think", "maybe", "possibly", "unsure")
#: Suffixes tried in this order.
SUFFIXES = ("ing", "ed", "ly", "es", "s")


def let(value: Column, body) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """White-space words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def stem(token: Column) -> Column:
    """The token without the first suffix that leaves two bytes or more; tokens under four bytes stay."""
    out = token
    for suffix in reversed(SUFFIXES):
        cut = token.endswith(suffix) & (F.octet_length(token) - len(suffix) >= 2)
        out = F.when(cut, F.regexp_replace(token, suffix + "$", "")).otherwise(out)
    return F.when(F.octet_length(token) < 4, token).otherwise(out)


def tokens(text: Column, stop_words: bool = False, stemming: bool = False) -> Column:
    """Lower-case runs of letters and numbers, stemmed and freed of stop words if asked."""
    out = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    if stemming:
        out = F.transform(out, stem)
    if stop_words:
        out = F.filter(out, lambda t: ~t.isin(*STOP_WORDS))
    return out


def shingles(items: Column, size: int = 2) -> Column:
    """Runs of size items joined by spaces; fewer items make one shingle, none makes none."""


    def made(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) >= size, runs).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(items, made)


def _ratio(over: Column, under: Column, empty: float = 0.0) -> Column:
    return F.when(under > 0, over.cast("double") / under).otherwise(F.lit(empty))


def set_jaccard(a: Column, b: Column) -> Column:
    """Distinct common over distinct all; zero if both are empty."""
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def shingle_jaccard(a: Column, b: Column, multiset: bool = False) -> Column:
    """Two empties are equal, one empty is unlike; multiset counts the second side's repeats, so it can pass one."""


    def of(p: Column) -> Column:
        x, y = p["a"], p["b"]
        common = F.size(F.filter(y, lambda s: F.array_contains(x, s))) if multiset else F.size(F.array_intersect(x, y))
        one_empty = (F.size(x) == 0) | (F.size(y) == 0)
        return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when(one_empty, 0.0).otherwise(common.cast("double") / F.size(F.array_union(x, y)))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def overlap(a: Column, b: Column, size: int = 2) -> Column:
    return shingle_jaccard(shingles(tokens(a), size), shingles(tokens(b), size))


def char_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != ""))


def entailment(premise: Column, hypothesis: Column) -> Column:
    """Word overlap, less for hypotheses over 1.5 times the premise's bytes, more for contained ones; at most one."""
    lp, lh = F.lower(premise), F.lower(hypothesis)
    ratio = F.octet_length(hypothesis).cast("double") / F.octet_length(premise)
    score = set_jaccard(words(lp), words(lh)) * F.when(ratio > 1.5, 1.0 / ratio).otherwise(1.0) + F.when(F.contains(lp, lh), 0.2).otherwise(0.0)
    return F.when((premise == "") | (hypothesis == ""), 0.0).otherwise(F.least(F.lit(1.0), score))


def faithfulness(context: Column, response: Column) -> Column:
    return set_jaccard(words(context), words(response))


def lexical_diversity(text: Column) -> Column:
    return let(words(F.lower(text)), lambda t: _ratio(F.size(F.array_distinct(t)), F.size(t)))


def sentence_repetition(text: Column) -> Column:
    """Share of sentences that repeat another."""
    s = F.filter(F.transform(F.split(text, r"[.!?]+"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return let(s, lambda x: _ratio(F.size(x) - F.size(F.array_distinct(x)), F.size(x)))


def occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def specificity(text: Column) -> Column:
    w = words(text)
    hedges = reduce(Column.__add__, (occurrences(F.lower(text), h) for h in HEDGES))
    marks = F.size(F.filter(w, lambda x: x.rlike("^[0-9]"))) + F.size(F.filter(w, lambda x: x.rlike("^[A-Z].")))
    return F.when(F.size(w) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (marks - hedges) / F.size(w))))


def factual_density(text: Column) -> Column:
    n = F.size(words(text))
    sentences = occurrences(text, ".") + 1
    return F.when(n == 0, 0.0).otherwise(1.0 / (1.0 + F.log(n / sentences + 1) / 5.0))


def repetition(text: Column) -> Column:
    """Share of words over two bytes that repeat another; zero for fewer than two words."""
    w = words(F.lower(text))
    long = F.filter(w, lambda x: F.octet_length(x) > 2)
    return F.when(F.size(w) < 2, 0.0).otherwise(_ratio(F.size(long) - F.size(F.array_distinct(long)), F.size(long)))


def consistency(text: Column) -> Column:
    mix = specificity(text) * 0.5 + factual_density(text) * 0.3 + (1.0 - repetition(text)) * 0.2
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mix))


def judged_factuality(text: Column) -> Column:
    low = F.lower(text)
    score = reduce(Column.__add__, (F.when(F.contains(low, F.lit(m)), s).otherwise(0.0) for ms, s in ((FACT_MARKERS, 0.1), (DOUBT_MARKERS, -0.1)) for m in ms), F.lit(0.5))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def phrase_repetition(text: Column, size: int = 3) -> Column:
    """Share of n-grams that repeat another."""
    g = shingles(words(F.lower(text)), size)
    return let(F.struct(g.alias("g"), F.size(words(text)).alias("n")), lambda x: F.when(x["n"] < size, 0.0).otherwise(_ratio(F.size(x["g"]) - F.size(F.array_distinct(x["g"])), F.size(x["g"]))))


def length_factor(text: Column) -> Column:
    return F.greatest(F.lit(1.0), 1.0 + F.log(F.octet_length(text) / 100.0))


def pooled(vectors: Column, how: str = "mean") -> Column:
    """One vector of an array of token vectors: their mean, the first, or the last."""
    if how == "cls":
        return F.element_at(vectors, 1)
    if how == "last":
        return F.element_at(vectors, -1)
    zero = F.transform(F.element_at(vectors, 1), lambda x: x * 0)
    total = F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(norm(a) * norm(b) > 0, dot / (norm(a) * norm(b))).otherwise(0.0)
