"""Quality rules as a short-circuit cascade.

A document is dropped by the first rule that rejects it, and later rules never look at it, so the order of the rules
decides what the work costs and never what is kept. The order is estimated: each task runs every rule on the first few
documents of its split (`sample_rows` and `sample_bytes`, so no split is read whole) and reports, for each set of rules
that reject a document together, how many such documents it met, and each rule's seconds. From these few rows, whatever
the size of the table, rules are dealt greedily: next comes the rule that rejects most per second among the documents
which the rules before it leave.

Measures that the contract asks of every document are taken once and shared: rules over them are all but free. Rules
that need more (letters, case, line ends) take it when they are asked.

Defined results: a null text is an empty text, of no words; rows repeating an id are measured each on its own; a text
of any length is measured whole (words are numbered, so a long text needs some 100 bytes a word); an empty table gives
an empty result; extra columns, whatever their names, are ignored. White space is U+0020 and U+0009 to U+000D only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import repeat
from time import perf_counter
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
BULLETS, CUT = ("-", "*", "•"), ("...", "…")
LEAST_WORDS, MOST_REPEATED = 50, 50


@cache
def _classes() -> np.ndarray:
    """For each code point: 2 for a letter, 1 more for an upper-case one."""
    kinds = map(category, map(chr, range(0x110000)))
    return np.fromiter(((k[0] == "L") * 2 + (k == "Lu") for k in kinds), np.uint8, 0x110000)


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    pairs = ids[:-1] * n + ids[1:]
    if n >= 1 << 21:  # three numbers need more than 63 bits: pairs are numbered anew
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    at = np.zeros(len(words) + 1, np.int64)
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    at[starts] += 1
    at[starts + 3] -= 1
    return int(np.count_nonzero(np.cumsum(at)[:-1]))


class Measured:
    """What is known of a text: the contract's measures at once, all else when a rule asks."""

    def __init__(self, text: str):
        self.text = text
        words = text.encode().split()  # bytes split at these six characters and no others
        self.n_words = len(words)
        self.word_chars = len(text) - sum(map(text.count, SPACE))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        self.n_repeat_words = repeated_words(words)
        self.n_dup_lines = self.line_chars = self.dup_line_chars = 0  # of lines with a word
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                self.n_dup_lines += 1
                self.dup_line_chars += len(line)
            elif line.strip(SPACE):
                seen.add(line)
            else:
                continue
            self.line_chars += len(line)

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words

    @cached_property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.text.encode("utf-32-le"), np.uint32)

    @cached_property
    def classes(self) -> np.ndarray:
        return _classes()[self.codes]

    @cached_property
    def letterless(self) -> int:
        """Words without a letter."""
        inside = np.append((self.codes != 32) & ((self.codes < 9) | (self.codes > 13)), False)
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        letters = np.append(0, np.cumsum(self.classes >= 2))[np.append(0, ends + 1)]
        return int(np.count_nonzero(np.diff(letters) == 0))

    @cached_property
    def worded_lines(self) -> list[str]:
        return [x for line in self.text.split("\n") if (x := line.strip(SPACE))]


@dataclass(frozen=True)
class Rule:
    """A rule's name and what it rejects."""

    name: str
    rejects: Callable[[Measured], bool]


RULES = (
    Rule("word_length", lambda m: not 3 * m.n_words <= m.word_chars <= 10 * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: 10 * m.dup_line_chars > 3 * m.line_chars),
    Rule("exclaimed", lambda m: 10 * (m.text.count("!") + m.text.count("?")) > 3 * m.n_words),
    Rule("without_letters", lambda m: 5 * m.letterless > m.n_words),
    Rule("capitals", lambda m: 2 * np.count_nonzero(m.classes == 3) > np.count_nonzero(m.classes)),
    Rule("bullets", lambda m: 10 * sum(map(str.startswith, m.worded_lines, repeat(BULLETS))) > 9 * len(m.worded_lines)),
    Rule("cut_lines", lambda m: 10 * sum(map(str.endswith, m.worded_lines, repeat(CUT))) > 3 * len(m.worded_lines)),
)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[str]:
    for batch in batches:
        yield from (t or "" for t in batch.column(column).to_pylist())


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = 64, sample_bytes: int = 4 << 20) -> tuple[dict[int, int], list[float]]:
    """How many sampled documents each set of rules (a bit for each) rejects, and each rule's seconds on the sample."""
    if len(rules) > 16:
        raise ValueError("estimates are kept for each set of rules: at most 16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _classes()  # made once a worker, so no rule is billed for it
        seconds, sets, size = [0.0] * len(rules), Counter(), 0
        for k, text in enumerate(_texts(batches, 0)):
            size += len(text)
            m, bits = Measured(text), 0
            if not m.base_failed:
                for i, rule in enumerate(rules):
                    began = perf_counter()
                    bits |= bool(rule.rejects(m)) << i
                    seconds[i] += perf_counter() - began
                sets[bits] += 1
            if k + 1 >= sample_rows or size >= sample_bytes:
                break
        rows = [("set", s, float(n)) for s, n in sets.items()] + [("rule", i, x) for i, x in enumerate(seconds)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.float64()))], ["kind", "which", "amount"])

    found = docs.select(text_col).mapInArrow(run, "kind string, which int, amount double").groupBy("kind", "which").agg(F.sum("amount").alias("amount")).collect()  # a row for each rule and set of rules
    sets = {r.which: int(r.amount) for r in found if r.kind == "set"}
    seconds = {r.which: r.amount for r in found if r.kind == "rule"}
    return sets, [seconds.get(i, 0.0) for i in range(len(rules))]


def ordered(sets: dict[int, int], seconds: Sequence[float]) -> list[int]:
    """Places of rules, greedily by documents rejected per second among those left; of equals the first listed."""
    left, out = set(range(len(seconds))), []
    while left:
        rejected = {i: sum(n for s, n in sets.items() if s >> i & 1) for i in left}
        best = max(sorted(left), key=lambda i: rejected[i] / max(seconds[i], 1e-9)) if any(rejected.values()) else min(sorted(left), key=lambda i: seconds[i])
        out.append(best)
        left.remove(best)
        sets = {s: n for s, n in sets.items() if not s >> best & 1}
    return out


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, order: Sequence[int] | None = None) -> DataFrame:
    """Measures and verdict of every row. `failed` is the rule that dropped it and `rules_run` how many rules looked at
    it; both follow the estimated order, `kept` does not."""
    if order is None:
        order = ordered(*estimate(docs, rules, text_col))
    cascade = [rules[i] for i in order]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts([batch], 1):
                m = Measured(text)
                base, failed, ran = m.base_failed, None, 0
                if not base:
                    for rule in cascade:
                        ran += 1
                        if rule.rejects(m):
                            failed = rule.name
                            break
                rows.append((*(getattr(m, n) for n in NAMES), base, not base and failed is None, failed, ran))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string(), pa.int32()]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", *NAMES, "base_failed", "kept", "failed", "rules_run"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, {', '.join(f'{n} bigint' for n in NAMES)}, base_failed boolean, kept boolean, failed string, rules_run int")
    return out.withColumnRenamed("id", id_col)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over every document, without what depends on measured seconds."""
    return filtered(documents(spark, sf_dir, "doc_id", "text")).drop("failed", "rules_run")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
tokens AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
windows AS (SELECT r, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM tokens WINDOW p AS (PARTITION BY r ORDER BY i)),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM windows WHERE w3 IS NOT NULL),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM counted WHERE n > 1) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
worded AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) > 1 AS again, trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS x FROM lines),
per_line AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup, sum(length(line)) AS chars, sum(length(line)) FILTER (WHERE again) AS dup_chars, count(*) FILTER (WHERE x[1] IN ('-', '*', '•')) AS bullets,
  count(*) FILTER (WHERE x LIKE '%...' OR x LIKE '%…') AS cut FROM worded WHERE x <> '' GROUP BY r),
m AS (SELECT r, doc_id, t, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
f AS (SELECT m.*, coalesce(l.dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, coalesce(l.chars, 0) AS line_chars, coalesce(l.dup_chars, 0) AS dup_chars, coalesce(l.bullets, 0) AS bullets, coalesce(l.cut, 0) AS cut
  FROM m LEFT JOIN repeated p USING (r) LEFT JOIN per_line l USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 10 * n_symbols <= n_words AND 10 * dup_chars <= 3 * line_chars
  AND 10 * length(regexp_replace(t, '[^!?]', '', 'g')) <= 3 * n_words
  AND 5 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) <= n_words
  AND 2 * length(regexp_replace(t, '\P{Lu}', '', 'g')) <= length(regexp_replace(t, '\P{L}', '', 'g'))
  AND 10 * bullets <= 9 * n_lines AND 10 * cut <= 3 * n_lines AS kept
FROM v
"""
