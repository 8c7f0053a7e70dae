"""Alignment of two tokenizers' tokens by the bytes they cover.

A batch of documents is one run of bytes: token lengths, added up over the whole batch, give every token's end, A's ends
and B's ends are counted once by offset, and where both counts are positive is a cut. Sums up to each document's first
and last byte give its groups, links and tokens. Nothing runs document by document but the tokenizers and the digest of
the groups.

Tokens that end together link, and of two such tokens one covers a suffix of the other's bytes. So what pairs can ever
link is known from the two vocabularies alone (`Pairs`: at most one pair for each suffix of each token, some hundred
thousand), whatever the corpus: counts are dense arrays of that size, added up in every task, summed over tasks by pair,
and the table of all counts may be broadcast. Links are staged once, as compressed pair numbers, so texts are tokenized
once.

Where a space stands between two other characters neither tokenizer's tokens cross its front (A splits there first; no
piece of B has a space after another character), so what stands between two such places is tokenized once for each
different string, up to `KEPT` of them at a time. A's vocabulary must list its merges in the order of its ids and is then
run by rank; both are checked when it is loaded.

Defined results: a null or empty text, and one whose tokens' joined bytes are not a space and the text, has no tokens: its
counts are zero and its digest is empty; tokens of no bytes are refused; rows repeating an id are aligned each on its own;
equal counts all are the highest; texts of any length are whole, in a batch of their own if long; an empty table gives an
empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage, unstage
from .packed import pack, unpack

KEPT, LONGEST_KEPT, BLOCK = 1 << 18, 64, 1 << 20
UNSAFE = regex.compile(r"[\s\x1c-\x1f](?: |$)|▁")
SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f▁])(?= [^\s\x1c-\x1f▁])")
#: The split that byte-level vocabularies of this kind are trained with (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokens:
    """A byte-level BPE vocabulary: ids of a text, bytes of an id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        letter, model, special = byte_letters(), read["model"], {t["content"] for t in read["added_tokens"]}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            self.bytes[i] = token.encode() if token in special else bytes(map(letter.__getitem__, token))
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if read["normalizer"] or model["type"] != "BPE" or [model["vocab"][m] for m in merges] != [*range(256, 256 + len(merges))]:
            raise ValueError(f"{path}: not a byte-level vocabulary whose ids follow its merges")
        ranks = {b: i for i, b in enumerate(self.bytes[: 256 + len(merges)])}
        self.ids = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class PieceTokens:
    """A piece vocabulary with byte fallback, which adds a space itself: ids of a text, bytes of an id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = lambda text: model.encode(text, num_threads=1)
        pieces = list(map(model.id_to_piece, range(model.get_piece_size())))
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path}: pieces that hold a space after another character are not supported")


class Pairs:
    """All pairs of an A and a B token of which one is a suffix of the other, numbered by (A, B)."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.n_b = len(b)
        codes: set[int] = set()
        for one, other, code in ((a, b, lambda i, j: i * len(b) + j), (b, a, lambda i, j: j * len(b) + i)):
            at: dict[bytes, list[int]] = {}
            for j, token in enumerate(other):
                at.setdefault(token, []).append(j)
            for i, token in enumerate(one):
                for start in range(len(token)):
                    codes.update(code(i, j) for j in at.get(token[start:], ()))
        self.codes = np.array(sorted(codes), np.int64)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, a.astype(np.int64) * self.n_b + b).astype(np.uint32)

    @cached_property
    def b_of(self) -> np.ndarray:
        return self.codes % self.n_b


class Aligner:
    """Both tokenizers, their tables, and the batch alignment."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.lengths = [np.array(list(map(len, t.bytes)), np.int64) for t in (self.a, self.b)]
        if min(map(np.min, self.lengths)) < 1:
            raise ValueError("tokens of no bytes are not supported")
        most = max(map(len, self.lengths))
        digits = [str(i).encode() for i in range(most)]
        self.width = np.array(list(map(len, digits)), np.int64)
        wide = int(self.width.max())
        self.digits = np.frombuffer(b"".join(d.ljust(wide + 1) for d in digits), np.uint8).reshape(most, wide + 1)
        self.kept = lru_cache(KEPT)(self.unit)

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.a.bytes, self.b.bytes)

    def unit(self, text: str) -> tuple[bytes, bytes, bool]:
        """Ids of A and B of a string that begins with a space, as 32-bit words, and whether both give its bytes."""
        a, b = self.a.ids(text), self.b.ids(text[1:])
        data = text.encode()
        ok = b"".join([self.a.bytes[i] for i in a]) == data == b"".join([self.b.bytes[i] for i in b])
        return array("I", a).tobytes(), array("I", b).tobytes(), ok

    def tokens(self, text: str) -> tuple[bytes, bytes]:
        """Ids of A and B of a space and the text; none where the text is empty or its bytes are not given back."""
        if not text:
            return b"", b""
        if "▁" in text:  # B reads it as a space
            return b"", b""
        units = SAFE.split(" " + text) if UNSAFE.search(" " + text) else [" " + u for u in text.split(" ")]
        found = [self.kept(u) if len(u) <= LONGEST_KEPT else self.unit(u) for u in units]
        if not all([f[2] for f in found]):
            return b"", b""
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def align(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], list[np.ndarray]]:
        """Of each text: numbers of A tokens, B tokens, groups and links, the digest of its groups, its links' pairs."""
        found = list(map(self.tokens, texts))
        ids = [np.frombuffer(b"".join([f[k] for f in found]), np.uint32) for k in (0, 1)]
        firsts = [np.cumsum([0] + [len(f[k]) // 4 for f in found]) for k in (0, 1)]  # tokens before each text
        ends = [np.cumsum(self.lengths[k][ids[k]]) for k in (0, 1)]
        edges = np.append(0, ends[0])[firsts[0]]  # bytes before each text
        total = int(edges[-1])
        counts = [np.bincount(e, minlength=total + 1) for e in ends]
        cut = (counts[0] > 0) & (counts[1] > 0)
        groups_to = np.cumsum(cut)  # cuts at offsets up to each
        groups = np.diff(groups_to[edges])
        closing = [cut[e] for e in ends]  # tokens that end a group
        links = self.pairs.numbers(ids[0][closing[0]], ids[1][closing[1]])
        split = np.append(0, np.cumsum(groups))
        of_each = [links[i:j] for i, j in zip(split, split[1:])]
        n = [np.diff(f) for f in firsts]
        return [n[0], n[1], groups, groups], self.digests(ids, ends, closing, groups_to, firsts), of_each

    def digests(self, ids: list[np.ndarray], ends: list[np.ndarray], closing: list[np.ndarray], groups_to: np.ndarray, firsts: list[np.ndarray]) -> list[str]:
        """SHA-256 of each text's groups. All tokens are written side by side, A's of a group before B's."""
        n_a, n_b = map(len, ids)
        if not n_a:
            return [""] * (len(firsts[0]) - 1)
        group = [groups_to[e] - c for e, c in zip(ends, closing)]  # the group of each token, from 0
        last = [np.append(np.flatnonzero(c), -1) for c in closing]  # each group's last token
        place = [np.arange(n_a) + np.append(-1, last[1][:-1])[group[0]] + 1, np.arange(n_b) + last[0][group[1]] + 1]
        token, mark = np.empty(n_a + n_b, np.int64), np.empty(n_a + n_b, np.uint8)
        for k, end in ((0, b"|"), (1, b";")):
            token[place[k]] = ids[k]
            mark[place[k]] = np.where(closing[k], end[0], ord(","))
        width = self.width[token]
        rows = self.digits[token]
        rows[np.arange(len(token)), width] = mark
        written = rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes()
        at = np.append(0, np.cumsum(width + 1))[firsts[0] + firsts[1]]
        return [hashlib.sha256(written[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at.tolist(), at[1:].tolist())]


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker."""
    return Aligner(a_path, b_path)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, tokenizers: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and packed links of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*tokenizers)
        gc.freeze()
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum([0] + [len(t) if t else 0 for t in texts.to_pylist()])
            start = 0
            while start < len(texts):  # blocks of about BLOCK characters
                stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + BLOCK, side="right")) - 1)
                numbers, digests, links = own.align([t or "" for t in texts.slice(start, stop - start).to_pylist()])
                columns = [pa.array(x, pa.int64()) for x in numbers] + [pa.array(digests, pa.string()), pa.array([pack(x) for x in links], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *columns], ["id", *COUNTS, "groups_sha256", "links"])
                start = stop

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, groups_sha256 string, links binary")


def pair_counts(links: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, n) over all packed links: a dense array in each task, then sums by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            if found := [unpack(x, np.uint32) for x in batch.column(0).to_pylist()]:
                total += np.bincount(np.concatenate(found), minlength=n_pairs)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["pair", "n"])

    return links.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, tokenizers: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups and links of every row, with how common its links are in all rows."""
    paths = tokenizers or default_tokenizers()
    spark = docs.sparkSession
    pairs = aligner(*paths).pairs
    rows = stage(aligned(docs, paths, id_col, text_col), "alignment")
    counts = stage(pair_counts(rows.select("links"), len(pairs.codes)), "alignment-counts")
    table = np.zeros(len(pairs.codes), np.int64)
    for batch in counts.toArrow().to_batches():  # no more rows than the vocabularies have pairs
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    unstage(counts)
    most = np.zeros(pairs.n_b, np.int64)
    np.maximum.at(most, pairs.b_of, table)
    sent = spark.sparkContext.broadcast((table, table == most[pairs.b_of]))  # of the size of the pairs, by the vocabularies
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = sent.value
        for batch in batches:
            found = [unpack(x, np.uint32) for x in batch.column(6).to_pylist()]
            columns = [pa.array([int(np.count_nonzero(best[x])) for x in found], pa.int64()), pa.array([int(n[x].sum()) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *columns, batch.column(5)], ["id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    out = rows.mapInArrow(run, f"id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, n_best bigint, count_sum bigint, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir, "doc_id", "text"))
