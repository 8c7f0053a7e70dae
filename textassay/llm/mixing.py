"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells by source, language and topic (`topics.py`, fitted on all texts); a cell's weight is its tokens. A
sweep scales the cells of each margin in turn so that the margin's weights meet their targets, until all margins
agree within the tolerance or the sweeps run out; `margins_met` says which (a table with empty cells may not be able to
reach every target; the last margin is then met exactly). A cell's factor over the corpus is its calibrated weight by
token; documents are sampled with probability min(1, k x factor), k such that the expected tokens are the share asked
for, and a sampled document's weight, factor over probability, keeps weighted margins at their targets where a
probability was capped. Sampling draws from a hash of the id and text, so a repeated run or a lost executor draws the
same documents.

Targets are given by margin as {value: share}; values of the table without a target get none of the weight, and a
target for a value that no row has is refused with a ValueError. A margin without targets is tempered, its shares being
in proportion to its tokens to the power `temper`.

Cells, not documents, are iterated on. They are counted map-side first, so a source with a third of all rows is a few
partial rows; all sweeps then run in one task over the cells alone. More than `most_cells` cells (source x language x
topic) are refused with a ValueError.

Defined results: null sources, languages and texts are the empty string; a document without words has weight one
token; repeated rows are drawn alike; ties have equal probabilities; very long texts are read whole and are one row of
many tokens; an empty table gives an empty result, whatever the targets; extra columns are ignored by `mixture` and kept by
`sample_mixture`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import documents, small_side, stage, unstage, whole_row
from .topics import Topics, fit_topics, fit_vocabulary, with_numbers

MARGINS = ("source", "lang", "topic")
Targets = dict[str, dict[str, float]]


def _utf8(text_col: str) -> Column:
    return F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")


def _cell_columns(source_col: str, lang_col: str) -> list[Column]:
    return [F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")]


def with_topic(numbered: DataFrame, topics: Topics) -> DataFrame:
    """numbered with topic in place of its last column, the numbers of the text's words."""
    keep = numbered.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array(topics.of(batch.column(len(keep)).to_pylist()), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in keep] + ["topic"])

    return numbered.mapInArrow(run, StructType([*keep, StructField("topic", StringType())]))


def _row_topics(rows: DataFrame, text_at: int, topics: Topics) -> DataFrame:
    """rows with topic as a last column; their first column is a struct whose field at text_at is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.struct_field(batch.column(0), [text_at]), "")
            found = topics.of([topics.vocabulary.numbers(x.as_buffer().to_pybytes().lower().split()) for x in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "topic"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("topic", StringType())]))


def rake(cells: pd.DataFrame, targets: Targets | None = None, temper: float = 0.5, sweeps: int = 1000, tolerance: float = 1e-6) -> tuple[np.ndarray, bool]:
    """Factors of cells(source, lang, topic, tokens), and whether every margin met its target within the tolerance."""
    tokens = cells["tokens"].to_numpy(np.float64)
    total, factor, margins = tokens.sum(), np.ones(len(cells)), []
    for m in MARGINS:
        values, at = np.unique(cells[m].to_numpy(str), return_inverse=True)
        wanted = (targets or {}).get(m)
        aim = np.array([float(wanted.get(v, 0.0)) for v in values]) if wanted is not None else np.bincount(at, weights=tokens, minlength=len(values)) ** temper
        if not aim.sum() > 0:
            raise ValueError(f"the targets of {m} give no weight to any value of the table")
        margins.append((at, aim / aim.sum() * total))
    for _ in range(sweeps):
        off = 0.0
        for at, aim in margins:
            have = np.bincount(at, weights=tokens * factor, minlength=len(aim))
            by = np.divide(aim, have, out=np.ones_like(aim), where=have > 0)
            off = max(off, float(np.abs(aim - have).max()) / total)
            factor = factor * by[at]
        if off <= tolerance:
            return factor, True
    return factor, False


def calibrated(factor: np.ndarray, tokens: np.ndarray, share: float) -> np.ndarray:
    """min(1, k x factor), with k such that the expected tokens are the share of all (or all that have a factor)."""
    order = np.argsort(-factor, kind="stable")
    f, t = factor[order], tokens[order].astype(np.float64)
    aim = share * t.sum()
    capped = np.cumsum(t) - t
    rest = np.cumsum((t * f)[::-1])[::-1]
    fits = np.flatnonzero(((aim - capped) * f <= rest) & (f > 0))  # with the first so many cells capped, the others in proportion
    if not len(fits):
        return np.where(factor > 0, 1.0, 0.0)
    return np.minimum(1.0, max(0.0, aim - capped[fits[0]]) / rest[fits[0]] * factor)


CALIBRATED = "source string, lang string, topic string, factor double, probability double, margins_met boolean"


def calibrated_cells(keyed: DataFrame, share: float, targets: Targets | None = None, temper: float = 0.5, most_cells: int = 2_000_000) -> DataFrame:
    """Factor and probability of every cell of keyed(source, lang, topic, n_tokens)."""
    cells = stage(keyed.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    if (n := cells.count()) > most_cells:
        raise ValueError(f"{n} cells of source, language and topic; at most {most_cells} can be raked")
    for m, wanted in (targets or {}).items() if n else ():
        have = {r[0] for r in cells.filter(F.col(m).isin(*map(str, wanted))).select(m).distinct().collect()}  # no more than the targets
        if absent := sorted(set(map(str, wanted)) - have):
            raise ValueError(f"no row has the targets {absent} of {m}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        frame = pd.concat(frames).sort_values(list(MARGINS), ignore_index=True)
        frame["factor"], met = rake(frame, targets, temper)
        frame["probability"] = calibrated(frame["factor"].to_numpy(), frame["tokens"].to_numpy(), share)
        frame["margins_met"] = met
        yield frame[[*MARGINS, "factor", "probability", "margins_met"]]

    return stage(cells.coalesce(1).mapInPandas(run, CALIBRATED), "mix-calibrated")


def _numbered(rows: DataFrame, topics: Topics | None) -> tuple[DataFrame, Topics]:
    """rows, staged, with n_tokens and the words' numbers in place of their last column, the text; topics, fitted on all rows if not given."""
    vocabulary = topics.vocabulary if topics else fit_vocabulary(rows.select("text"))
    numbered = stage(with_numbers(rows, vocabulary), "mix-numbers")
    return numbered, topics or fit_topics(numbered, vocabulary)


def _drawn(id_col: str, text_col: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), 11) / F.lit(float(1 << 53))


def mixture(
    docs: DataFrame, share: float = 0.6, targets: Targets | None = None, temper: float = 0.5, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topics: Topics | None = None,
) -> DataFrame:
    """Every row's id, cell, n_tokens, factor, probability, margins_met, whether it is sampled, and its weight if it is."""
    rows = docs.select(F.col(id_col).alias("__id"), *_cell_columns(source_col, lang_col), _drawn(id_col, text_col, seed).alias("u"), _utf8(text_col).alias("text"))
    numbered, topics = _numbered(rows, topics)
    keyed = stage(with_topic(numbered, topics), "mix-keys")
    unstage(numbered)
    cells = calibrated_cells(keyed, share, targets, temper)
    found = keyed.join(small_side(cells, 256), list(MARGINS), "left")
    sampled = F.col("u") < F.col("probability")
    return found.select(
        F.col("__id").alias(id_col), *MARGINS, "n_tokens", "factor", "probability", "margins_met", sampled.alias("sampled"),
        F.when(sampled, F.col("factor") / F.col("probability")).alias("weight"),
    )


def sample_mixture(
    docs: DataFrame, share: float = 0.6, targets: Targets | None = None, temper: float = 0.5, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topics: Topics | None = None,
) -> DataFrame:
    """The sampled rows of docs, with docs' columns. Reads the texts for the vocabulary, the cells and the rows, and stages none."""
    cell = _cell_columns(source_col, lang_col)
    numbered, topics = _numbered(docs.select(*cell, _utf8(text_col).alias("text")), topics)
    cells = calibrated_cells(with_topic(numbered, topics), share, targets, temper)
    unstage(numbered)
    most = cells.agg(F.max("probability")).head()[0] or 0.0  # rows drawn above it are in no sample, whatever their topic
    drawn = docs.select(whole_row(docs), *cell, _drawn(id_col, text_col, seed).alias("u")).filter(F.col("u") < most)
    rows = _row_topics(drawn, docs.columns.index(text_col), topics)
    return rows.join(small_side(cells, 256), list(MARGINS)).filter("u < probability").select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))
