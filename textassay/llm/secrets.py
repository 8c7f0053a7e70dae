"""Secret scans through a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over byte trigrams that every match must contain (with
ASCII letters folded). Documents are taken in blocks of bounded bytes; a block's inverted index posts, for each
trigram that some rule asks for, the documents holding it. A rule's postings are intersected and united as its query
says, and only candidate documents are verified by the regular expression. A rule with no mandatory trigram scans
every document of the block. Blocks are independent tasks, so a lost executor costs its blocks alone, and no index
outgrows its block.

Offsets count code points and ends are exclusive. Defined results: a null text is an empty text; texts without
secrets give an empty list; repeated rows get equal rows; an empty table gives an empty result; extra columns are
ignored; null ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


@dataclass(frozen=True)
class Rule:
    """kind, its regular expression, and where only some matches count: the group to measure and its least length."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    @property
    def regex(self) -> re.Pattern:
        return _compiled(self.pattern, self.any_case)


@lru_cache(maxsize=None)
def _compiled(pattern: str, any_case: bool) -> re.Pattern:
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if any_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^/\s:@]{1,128}:[^/\s:@]{1,128}@"),
)

#: A query is True (any document), a trigram, or ("and"|"or", queries).
Query = bool | bytes | tuple


def _join(op: str, parts: list[Query]) -> Query:
    if op == "and":
        parts = [p for p in dict.fromkeys(parts) if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    if any(p is True for p in parts):
        return True
    asks = {p: frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts}
    parts = [p for p in asks if not any(asks[q] < asks[p] for q in asks)]  # a stricter alternative adds nothing
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_words(words: set[str]) -> Query:
    """What a text holding one of words must contain."""
    raw = [w.encode() for w in sorted(words)]
    if not raw or min(map(len, raw)) < 3:
        return True
    return _join("or", [_join("and", [w[i : i + 3] for i in range(len(w) - 2)]) for w in raw])


MOST_WORDS = 64


def _words(op, arg) -> set[str] | None:
    """All strings, folded, that a part can match, if they are few."""
    if op is C.LITERAL:
        c = chr(arg)
        return {c.lower() if c.isascii() else c}
    if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
        return set().union(*(_words(o, a) for o, a in arg))
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        return None if any(x is None for x in each) else set().union(*each)
    if op is C.MAX_REPEAT and arg[1] == 1 and (inner := _sequence(arg[2])) is not None:
        return inner | {""} if arg[0] == 0 else inner
    return None


def _sequence(parts) -> set[str] | None:
    words = {""}
    for op, arg in parts:
        more = _words(op, arg)
        if more is None or len(words) * len(more) > MOST_WORDS:
            return None
        words = {a + b for a in words for b in more}
    return words


def _query(parts) -> Query:
    found, words = [], {""}
    for op, arg in parts:
        more = _words(op, arg)
        if more is not None and len(words) * len(more) <= MOST_WORDS:
            words = {a + b for a in words for b in more}
            continue
        found.append(_of_words(words))
        words = more if more is not None else {""}
        if more is not None:
            continue
        if op is C.SUBPATTERN:
            found.append(_query(arg[-1]))
        elif op is C.BRANCH:
            found.append(_join("or", [_query(x) for x in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            found.append(_query(arg[2]))
    return _join("and", [*found, _of_words(words)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression; True if it has no mandatory trigram."""
    return _query(_parser.parse(pattern))


def _trigrams(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1])) if isinstance(query, tuple) else set()


class BlockIndex:
    """Postings, in a block of texts, of the trigrams that some query asks for."""

    def __init__(self, queries: list[Query]):
        self.at = {t: k for k, t in enumerate(sorted(set().union(*map(_trigrams, queries))))}
        self.table = np.zeros(1 << 24, dtype=np.uint8)
        if len(self.at) > 254:
            raise ValueError("rules ask for more than 254 trigrams")
        for t, k in self.at.items():
            self.table[int.from_bytes(t, "big")] = k + 1

    def load(self, texts: list[bytes]) -> None:
        self.n = len(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        codes = np.frombuffer(b"\0".join([*texts, b""]).lower(), dtype=np.uint8).astype(np.uint32)
        self.postings = np.zeros((len(self.at), self.n), dtype=bool)
        if len(codes) < 3:
            return
        asked = self.table[(codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]]
        where = np.flatnonzero(asked)
        self.postings[asked[where] - 1, np.searchsorted(ends, where, side="right")] = True

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.ones(self.n, dtype=bool)
        if isinstance(query, bytes):
            return self.postings[self.at[query]]
        combine = np.logical_and if query[0] == "and" else np.logical_or
        return combine.reduce([self.candidates(q) for q in query[1]])


def _blocks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(id, spans) of every row; spans by start, then by the rules' order."""
    rank = {r.kind: k for k, r in enumerate(rules)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        index = BlockIndex(queries)
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch.column(1)]
            out: list[list[dict]] = [[] for _ in texts]
            for lo, hi in _blocks(texts, block_bytes):
                index.load(texts[lo:hi])
                decoded: dict[int, str] = {}
                for rule, query in zip(rules, queries):
                    find, group, least = rule.regex.finditer, rule.group, rule.least
                    for i in np.flatnonzero(index.candidates(query)):
                        if (text := decoded.get(i)) is None:
                            text = decoded[i] = texts[lo + i].decode()
                        for m in find(text):
                            if m.end(group) - m.start(group) >= least:
                                out[lo + i].append({"kind": rule.kind, "start": m.start(), "end": m.end()})
            for spans in out:
                spans.sort(key=lambda s: (s["start"], rank[s["kind"]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPAN_TYPE)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in BASE]))
    return secret_spans(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id",
        *(F.size(F.filter(spans, _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )
