"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are its own shares of character classes, its words' repetition
and its length, and the same of the lines before and after it; transitions tie neighbouring labels. A document's
score is the mean of its lines' forward-backward marginals of "good", weighted by length.

The field is fitted on a bounded sample of labelled documents (`fit_docs` documents and `fit_lines` lines at most, by
a hash of the id; documents of over `fit_doc_lines` lines are scored but not fitted on), each line taking its document's label; features are computed where the documents are and only the
sample's numbers reach the driver. Scoring reads every document once, without a shuffle.

Defined results: a null or empty text is one empty line; without a usable label every score is 0.5; labels that are
null, conflicting or neither 0 nor 1 are not used; a very long text is scored whole; repeated rows and ties get equal
scores; an empty table gives an empty result;
extra columns are ignored by `score_quality` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import documents, stage, unstage, whole_row

#: Character classes by byte; a line's share of each is a feature.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#$%&*+<=>@[]^_`{}~\\/", b"\"'()-:;?", b".,", b" \t", bytes(range(128, 256)))
OWN = len(CLASSES) + 7


def _class_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    for k, members in enumerate(CLASSES):
        table[list(members)] = k + 1
    return table


TABLE = _class_table()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, their byte lengths, number of lines of each text)."""
    lines, counts = [], np.empty(len(texts), dtype=np.int64)
    rest = []
    for k, text in enumerate(texts):
        own = text.split(b"\n")
        counts[k] = len(own)
        lines += own
        seen: dict[bytes, int] = {}
        for x in own:
            seen[x] = seen.get(x, 0) + 1
        for x in own:
            words = x.split()
            n = len(words) or 1
            rest.append((len(words), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, seen[x] > 1 and len(words) > 0))
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    x = np.zeros((len(lines), OWN), dtype=np.float32)
    if not len(lines):
        return x, lengths, counts
    starts = np.cumsum(lengths + 1) - lengths - 1
    kinds = TABLE[np.frombuffer(b"\n".join([*lines, b""]), dtype=np.uint8)]
    size = np.maximum(lengths, 1)
    for k in range(len(CLASSES)):
        x[:, k] = np.add.reduceat((kinds == k + 1), starts, dtype=np.int32) / size
    words = np.array(rest, dtype=np.float32)
    at = len(CLASSES)
    x[:, at] = np.log1p(lengths) / 5
    x[:, at + 1] = np.minimum(lengths / np.maximum(words[:, 0], 1) / 10, 5)
    x[:, at + 2 : at + 5] = words[:, 1:]
    x[:, at + 5] = (1 - words[:, 1]) * np.minimum(words[:, 0] / 20, 1)
    x[:, at + 6] = lengths == 0
    return x, lengths, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it, zero beyond a document's ends."""
    n, own = x.shape
    out = np.zeros((n, 3 * own + 3), dtype=np.float32)
    out[:, :own] = x
    ends = np.cumsum(counts)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[ends - counts], last[ends - 1] = True, True
    out[1:, own : 2 * own] = x[:-1]
    out[first, own : 2 * own] = 0
    out[:-1, 2 * own : 3 * own] = x[1:]
    out[last, 2 * own : 3 * own] = 0
    out[:, -3], out[:, -2], out[:, -1] = first, last, 1
    return out


def forward_backward(emit: np.ndarray, counts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" for every line and expected transitions (2 x 2), for all chains at once.

    emit: score of "good" against "bad" of each line; between[i, j]: score of label j after label i.
    """
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than t
    forward = np.zeros((len(emit), 2))
    backward = np.zeros((len(emit), 2))
    before = None
    for t in range(longest):
        at = start[: active[t]] + t
        if t == 0:
            now = np.zeros((len(at), 2))
        else:
            step = before[: len(at), :, None] + between
            now = np.logaddexp(step[:, 0], step[:, 1])
        now[:, 1] += emit[at]
        now -= now.max(axis=1, keepdims=True)
        forward[at] = before = now
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        after = backward[at + 1].copy()
        after[:, 1] += emit[at + 1]
        step = between + after[:, None, :]
        now = np.logaddexp(step[..., 0], step[..., 1])
        pair = forward[at][:, :, None] + step
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[at] = now - now.max(axis=1, keepdims=True)
    both = forward + backward
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), expected


class LineField:
    """The fitted field: weights of the scaled features and transition scores."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, between: np.ndarray):
        self.mean, self.scale, self.weights, self.between = mean, scale, weights, between

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 200, penalty: float = 1e-3, rate: float = 0.1) -> LineField:
        """Penalised likelihood of the line labels (a document's label on each of its lines), by Adam on all lines."""
        mean, scale = x.mean(axis=0), x.std(axis=0)
        mean[-1], scale[scale < 1e-6] = 0, 1
        z = ((x - mean) / scale).astype(np.float64)
        y = np.repeat(labels, counts).astype(np.float64)
        first = np.zeros(len(y), bool)
        first[np.cumsum(counts) - counts] = True
        same = np.flatnonzero(~first)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[same - 1].astype(int), y[same].astype(int)), 1)
        params = np.zeros(z.shape[1] + 4)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for k in range(1, rounds + 1):
            marginal, expected = forward_backward(z @ params[:-4], counts, params[-4:].reshape(2, 2))
            slope = np.concatenate([z.T @ (y - marginal), (seen - expected).ravel()]) / len(y) - penalty * params
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            params = params + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return cls(mean, scale, params[:-4], params[-4:].reshape(2, 2))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, lengths, counts = line_features(texts)
        emit = (with_neighbours(x, counts) - self.mean) / self.scale @ self.weights
        good, _ = forward_backward(emit, counts, self.between)
        weight = lengths + 1.0
        starts = np.cumsum(counts) - counts
        return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0.0, 1.0)


def _blocks(column: pa.Array, most: int) -> Iterator[list[bytes]]:
    block, size = [], 0
    for x in column:
        text = x.as_buffer().to_pybytes()
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def _utf8(text_col: str) -> Column:
    return F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")


def fit_field(docs: DataFrame, labels: DataFrame, fit_docs: int = 2000, fit_lines: int = 100_000, fit_doc_lines: int = 10_000) -> LineField | None:
    """A field fitted on the labelled documents of docs(id, text); labels(id, label). None if there is no usable label.

    The sample is bounded: fit_docs documents and fit_lines lines in all, none of more than fit_doc_lines lines.
    """
    usable = labels.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    sample = usable.select("id", "label").orderBy(F.xxhash64("id"), "id").limit(fit_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rows = [], []
            for text in (x.as_buffer().to_pybytes() for x in batch.column(1)):
                n = text.count(b"\n") + 1
                sizes.append(n)
                rows.append(line_features([text])[0].tobytes() if n <= fit_doc_lines else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], ["id", "label", "n", "x"])

    kind = docs.schema["id"].dataType
    schema = StructType([StructField("id", kind), *StructType.fromDDL("label int, n bigint, x binary")])
    drawn = docs.join(F.broadcast(sample), "id").select("id", "text", F.col("label").cast("int").alias("label"))  # the sample is fit_docs rows at most
    found = stage(drawn.mapInArrow(run, schema).withColumn("h", F.xxhash64("x")), "quality-features")
    chosen, total = [], 0
    for r in found.filter(F.col("n") <= fit_doc_lines).select("id", "n", "h").distinct().orderBy("id", "h").limit(fit_docs).collect():
        if total + r["n"] <= fit_lines:
            chosen.append((r["id"], r["h"]))
            total += r["n"]
    if not chosen:
        return None
    ids, prints = zip(*chosen)
    told = pa.table({"id": pa.array(ids), "h": pa.array(prints, pa.int64())})  # as Arrow, which needs no Python worker to read it
    picked = docs.sparkSession.createDataFrame(told, StructType([StructField("id", kind), *StructType.fromDDL("h bigint")]))
    rows = found.join(F.broadcast(picked), ["id", "h"]).dropDuplicates(["id", "h"]).collect()  # fit_lines lines at most
    unstage(found)
    rows.sort(key=lambda r: (r["id"], r["h"]))
    counts = np.array([r["n"] for r in rows])
    x = np.concatenate([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, OWN) for r in rows])
    return LineField.fit(with_neighbours(x, counts), counts, np.array([r["label"] for r in rows]))


def score_quality(rows: DataFrame, field: LineField | None, schema: StructType | str, text_at: int, block_bytes: int = 4 << 20, within: int | None = None) -> DataFrame:
    """rows with a last column `score`; the column at text_at holds UTF-8 bytes and is left out of the result, or it is a
    struct that stays and has the text as its field `within`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at) if within is None else pc.fill_null(pc.struct_field(batch.column(text_at), [within]), "")
            scores = [field.scores(b) for b in _blocks(texts, block_bytes)] if field else [np.full(batch.num_rows, 0.5)]
            rest = [i for i in range(batch.num_columns) if i != text_at or within is not None]
            columns = [batch.column(i) for i in rest] + [pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[i] for i in rest] + ["score"])

    return rows.mapInArrow(run, schema)


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, held_out: Column | None) -> LineField | None:
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    if held_out is not None:
        marks = marks.filter(~held_out)
    return fit_field(docs.select(F.col(id_col).alias("id"), _utf8(text_col).alias("text")), marks)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, block_bytes: int = 1 << 20) -> DataFrame:
    """The rows of docs that score threshold or more, with docs' columns. A worker takes some 20 times block_bytes for features."""
    field = _training(docs, labels, id_col, text_col, None)
    rows = docs.select(whole_row(docs))
    scored = score_quality(rows, field, StructType([rows.schema["row"], *StructType.fromDDL("score double")]), 0, block_bytes, docs.columns.index(text_col))
    return scored.filter(F.col("score") >= threshold).select("row.*")


def _third(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 3 == 1


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    field = _training(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", F.coalesce(_third(F.col("id")), F.lit(True)))
    rows = docs.select("doc_id", _utf8("text").alias("text"))
    scored = score_quality(rows, field, "doc_id bigint, score double", 1)
    return scored.select("doc_id", F.coalesce(_third(F.col("doc_id")), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
