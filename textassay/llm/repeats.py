"""Removal of long repeats: every byte covered by a string of `span` bytes that also starts earlier.

The windows of `span` bytes of all texts, suffixes cut at that length, are named and compared across the corpus by
sampled induction. Names of 8-byte strings are doubled recursively to names of 16, 32, 64 and `span` bytes. A window's
sample is the smallest name of its 32-byte strings; equal windows have equal samples, and neighbouring windows mostly
share theirs, so the windows of a text fall into ranges of one sample each. First only ranges are compared, a
thirtieth of all windows: a sample found once induces that none of its windows repeats; ranges of equal context
(their common bytes) are decided by the first of them; only where a sample has several contexts, or repeats within
one, are the first holders' windows compared one by one. That last comparison is exact for all windows it is given,
so the range step saves work and never decides against it.

Documents are taken in blocks. A block keeps its first holder of each range or window and asks hash buckets, in
sorted and compressed lists, whether another block's comes earlier; a passage in a third of all documents is one entry
for each block. Blocks stay in a table bucketed by block; only answers travel. Strings are told apart by 64-bit names
of their bytes.

README says why the method named for this operator, external induced sorting of all suffixes, was left for this one.

Defined results: a null text is an empty text; texts under `span` bytes lose nothing; documents are ordered by id, null ids
first, rows repeating an id by their place in the input; very long texts are cut into overlapping slices; ids must be integers; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shuffle_width, small_batches, stage, unstage
from .packed import dealt, mixed, pack, unpack

U = np.uint64
SAMPLE = 32
SLICE = 1 << 20
MANY = 8
ENTRIES = 1 << 20


def _double(names: np.ndarray, step: int) -> np.ndarray:
    """Names of strings made of two named ones, the second beginning step bytes later."""
    return mixed(names[:-step] * U(0x9FB21C651E98DF25) + names[step:])


def window_names(data: bytes, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all 32-byte strings and of all strings of span bytes (64 to 128)."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - 7
    x = raw[:n].astype(U)
    for j in range(1, 8):
        x |= raw[j : n + j].astype(U) << U(8 * j)
    h32 = _double(_double(mixed(x), 8), 16)
    return h32, _double(_double(h32, 32), span - 64)


def _least(names: np.ndarray, width: int) -> np.ndarray:
    out, k = names, 1
    while 2 * k <= width:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(names) - width + 1], out[width - k :]) if k < width else out


def _slice_ranges(data: bytes, starts: np.ndarray, lens: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Ranges of the windows of texts lying in data: sample, context, first window, number of windows, and if it repeats; also all window names."""
    h32, names = window_names(data, span)
    width = span - SAMPLE + 1
    least = _least(h32, width)
    live = np.zeros(len(names) + 1, np.int8)
    live[starts] += 1
    live[starts + lens - span + 1] -= 1
    live = np.cumsum(live[:-1], dtype=np.int8).astype(bool)
    change = np.empty(len(names), bool)
    change[0], change[1:] = True, least[1:] != least[:-1]
    change[starts] = True
    first = np.flatnonzero(change & live)
    bounds = np.append(np.flatnonzero(change | ~live), len(names))
    count = bounds[np.searchsorted(bounds, first, side="right")] - first
    last = first + count - 1
    # samples standing twice in a range's bytes
    pad = np.zeros(width - 1, U)
    above = ~_least(~np.concatenate([pad, least, pad]), width)  # the largest of the least names over each 32-byte string
    where = np.flatnonzero(h32 == above)
    lo, hi = np.searchsorted(where, first), np.searchsorted(where, last + width)
    each = np.repeat(np.arange(len(first)), hi - lo)
    at = where[np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    sample = least[first]
    twice = np.bincount(each[h32[at] == sample[each]], minlength=len(first)) > 1
    context = mixed(names[first] * U(3) + mixed(names[last]) + count.astype(U))
    for r in np.flatnonzero(twice | (count > span)):
        own = names[first[r] : last[r] + 1]
        context[r] = mixed(own + np.arange(len(own), dtype=U) * U(0x9E3779B97F4A7C15)).sum(dtype=U)
    return sample, context, first, count, twice | (count > span), names


BLOCKS = "block bigint, docs bigint, size bigint, lens binary, text binary"


def _read_blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, str]:
    """One row per block of docs(id, key, text), its documents by key, in a table bucketed by block; and the table's name."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, seq
            held.sort(key=lambda r: r[0])  # stable: rows of one key stay in place
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(r[2] for r in held))
            row = [(part << 24) + seq], [len(held)], [size], [pack(np.array([len(r[2]) for r in held], np.uint64))], [data]
            types = [pa.int64()] * 3 + [pa.binary()] * 2
            out = [pa.array(v, t) for v, t in zip(row, types)]
            out += [pa.array([[r[0] for r in held]], pa.list_(pa.int64())), pa.array([[r[1] for r in held]], pa.list_(id_type))]
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays(out, ["block", "docs", "size", "lens", "text", "keys", "ids"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_buffer().to_pybytes()
                held.append((key, i, data))
                size += len(data)
                if size >= block_bytes:
                    yield close()
        if held:
            yield close()

    name = f"textassay_blocks_{uuid.uuid4().hex}"
    found = docs.mapInArrow(run, f"{BLOCKS}, keys array<bigint>, ids array<{kind}>")
    with small_batches(docs.sparkSession):
        found.write.format("parquet").bucketBy(shuffle_width(docs.sparkSession), "block").sortBy("block").saveAsTable(name)
    return docs.sparkSession.table(name), name


class Block:
    """A block's texts and the ranges of their windows; positions count bytes from the block's start."""

    def __init__(self, row: dict, span: int, piece: int = SLICE):
        self.span, self.piece = span, piece
        self.data = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, row["size"])) if row["size"] else b""
        self.lens = unpack(row["lens"], np.uint64).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.keys = np.array(row["keys"], np.int64)

    def find_ranges(self) -> Block:
        """Name all windows, cut them into ranges and sort these into classes."""
        parts = list(self._slices())
        gathered = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((U, U, np.int64, np.int64, bool))]
        self.sample, self.context, self.first, self.count, self.twice = gathered
        self._classes()
        return self

    def ranges(self, buckets: int) -> dict:
        """What later stages need of the ranges, packed: about eight bytes a range."""
        asks = self.sample[self.head[self.asked]]
        return {
            "first": pack(np.diff(self.first, prepend=0)), "count": pack(self.count.astype(np.uint32)), "at": pack(self.at.astype(np.uint32)), "head": pack(self.head.astype(np.uint32)),
            "asked": pack(self.asked.astype(np.uint32)), "crowded": pack(self.crowded.astype(np.uint8)), "to": pack((asks % U(buckets)).astype(np.uint32)),
        }

    def take_ranges(self, row: dict) -> Block:
        """The ranges as `ranges` packed them."""
        number = lambda name: unpack(row[name], np.uint32).astype(np.int64)
        self.first, self.count, self.at, self.head, self.asked = np.cumsum(unpack(row["first"], np.int64)), number("count"), number("at"), number("head"), number("asked")
        self.crowded, self.to = unpack(row["crowded"], np.uint8).astype(bool), number("to").astype(U)
        return self

    def _pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of whole texts of about a slice, and slices of longer texts: start in the block, and starts and lengths from there."""
        starts, lens, base, size = [], [], None, 0
        for s, n in zip(self.starts.tolist(), self.lens.tolist()):
            if n < self.span:
                continue
            if n > self.piece:
                for a in range(0, n - self.span + 1, self.piece):
                    yield s + a, np.array([0]), np.array([min(self.piece + self.span - 1, n - a)])
                continue
            if base is not None and s + n - base > self.piece:
                yield base, np.array(starts), np.array(lens)
                base = None
            if base is None:
                starts, lens, base = [], [], s
            starts.append(s - base)
            lens.append(n)
        if base is not None:
            yield base, np.array(starts), np.array(lens)

    def _slices(self) -> Iterator[tuple[np.ndarray, ...]]:
        for base, starts, lens in self._pieces():
            sample, context, first, count, twice, _ = _slice_ranges(self.data[base : base + int(starts[-1] + lens[-1])], starts, lens, self.span)
            yield sample, context, first + base, count, twice

    def _classes(self) -> None:
        """Ranges of one sample and context are a class; `head` is each class's first range, in sample order, `at` each range's class."""
        order = np.lexsort((self.first, self.context, self.sample))
        s, c = self.sample[order], self.context[order]
        new = np.ones(len(order), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        self.head = order[new]
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.cumsum(new) - 1
        samples = self.sample[self.head]
        again = np.ones(len(samples), bool)
        again[1:] = samples[1:] != samples[:-1]
        group = np.cumsum(again) - 1
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        crowded = size[group] > MANY if len(group) else np.zeros(0, bool)
        self.asked = np.flatnonzero(~crowded | again)  # a crowded sample asks once and opens all its classes
        self.crowded = crowded
        self.group = group

    def key_of(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = np.searchsorted(self.starts, positions, side="right") - 1
        # empty texts share their start with the next one, and hold no position
        return self.keys[doc], positions - self.starts[doc]

    def ask_ranges(self) -> tuple[np.ndarray, list[np.ndarray]]:
        heads = self.head[self.asked]
        key, pos = self.key_of(self.first[heads])
        flag = self.twice[heads].astype(np.uint8) | (self.crowded[self.asked].astype(np.uint8) << 1)
        return self.sample[heads], [self.context[heads], key.view(U), pos.astype(np.uint32), flag]

    def hear_ranges(self, bits: np.ndarray) -> None:
        """bits of the classes asked: 1 if first, 2 if open."""
        lead = np.zeros(len(self.head), bool)
        opened = np.zeros(len(self.head), bool)
        lead[self.asked] = bits & 1 > 0
        opened[self.asked] = bits & 2 > 0
        lead[self.crowded] = opened[self.crowded] = True
        first = np.zeros(len(self.first), bool)
        first[self.head] = lead
        self.gone = ~first
        self.open = np.flatnonzero(first & opened[self.at])
        self._open_windows()

    def _open_windows(self) -> None:
        """Positions and names of open windows; of equal ones only the first is asked about."""
        wanted = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(wanted, self.first[self.open], 1)
        np.add.at(wanted, self.first[self.open] + self.count[self.open], -1)
        wanted = np.cumsum(wanted[:-1]) > 0
        names, places = [], []
        for base, starts, lens in self._pieces():
            end = base + int(starts[-1] + lens[-1])
            own = np.flatnonzero(wanted[base : end - self.span + 1])
            if not len(own):
                continue
            if len(own) * 40 < end - base:
                view = np.frombuffer(self.data, np.uint8)
                grid = view[(own + base)[:, None] + np.arange(self.span)[None, :]]
                names.append(_names_of(grid))
            else:
                names.append(window_names(self.data[base:end], self.span)[1][own])
            places.append(own + base)
        self.names = np.concatenate(names) if names else np.zeros(0, U)
        self.places = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.lexsort((self.places, self.names))
        s = self.names[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        self.window_head = order[new]

    def ask_windows(self) -> tuple[np.ndarray, list[np.ndarray]]:
        key, pos = self.key_of(self.places[self.window_head])
        return self.names[self.window_head], [key.view(U), pos.astype(np.uint32)]

    def removed(self, bits: np.ndarray) -> np.ndarray:
        """Which bytes go; bits of the windows asked: 1 if first."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, self.first[self.gone], 1)
        np.add.at(edge, self.first[self.gone] + self.count[self.gone] - 1 + self.span, -1)
        stays = np.zeros(len(self.places), bool)
        stays[self.window_head] = bits & 1 > 0
        repeated = self.places[~stays]
        np.add.at(edge, repeated, 1)
        np.add.at(edge, repeated + self.span, -1)
        return np.cumsum(edge[:-1]) > 0


def _names_of(grid: np.ndarray) -> np.ndarray:
    """Names of the rows of a byte matrix, as window_names gives them."""
    rows = np.ascontiguousarray(grid)
    n, span = rows.shape

    def of(at: int, length: int) -> np.ndarray:
        if length == 8:
            return mixed(np.ascontiguousarray(rows[:, at : at + 8]).view("<u8").ravel().astype(U))
        half = length // 2
        return mixed(of(at, half) * U(0x9FB21C651E98DF25) + of(at + half, half))

    return mixed(of(0, 64) * U(0x9FB21C651E98DF25) + of(span - 64, 64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


ASK = "bucket int, block bigint, n bigint, data array<binary>"
#: What is kept of a block's ranges.
RANGES = ("first", "count", "at", "head", "asked", "crowded", "to")
ASKS = pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.list_(pa.binary()))]))
ANSWER = "bucket int, block bigint, bits binary"


def _send(row: dict, hashes: np.ndarray, others: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    order, at = dealt(hashes, buckets)
    for b in range(buckets):
        own = order[at[b] : at[b + 1]]
        if len(own):
            data = [pack(np.diff(hashes[own], prepend=U(0))), *(pack(x[own]) for x in others)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([data], pa.list_(pa.binary()))], ["bucket", "block", "n", "data"]
            )


def _received(frame: pd.DataFrame, kinds: list) -> tuple[pd.DataFrame, np.ndarray, list[np.ndarray]]:
    frame = frame.sort_values("block")
    hashes = np.concatenate([np.cumsum(unpack(d[0], U), dtype=U) for d in frame["data"]])
    return frame, hashes, [np.concatenate([unpack(d[k + 1], t) for d in frame["data"]]) for k, t in enumerate(kinds)]


def _sent_back(frame: pd.DataFrame, bits: np.ndarray) -> pd.DataFrame:
    edges = np.cumsum([0, *frame["n"]])
    rows = [(frame["bucket"].iloc[0], block, pack(bits[lo:hi])) for block, lo, hi in zip(frame["block"], edges, edges[1:])]
    return pd.DataFrame(rows, columns=["bucket", "block", "bits"])


def _decide_ranges(frame: pd.DataFrame) -> pd.DataFrame:
    frame, sample, (context, key, pos, flag) = _received(frame, [U, U, np.uint32, np.uint8])
    order = np.lexsort((pos, key.view(np.int64), context, sample))
    s, c, f = sample[order], context[order], flag[order]
    group = np.ones(len(s), bool)
    group[1:] = s[1:] != s[:-1]
    lead = group.copy()
    lead[1:] |= c[1:] != c[:-1]
    of = np.cumsum(group) - 1
    several = np.bincount(of, weights=lead) > 1
    several |= np.bincount(of, weights=f & 2) > 0
    opened = several[of] | (f & 1 > 0)
    bits = np.empty(len(s), np.uint8)
    bits[order] = lead | (opened.astype(np.uint8) << 1)
    return _sent_back(frame, bits)


def _decide_windows(frame: pd.DataFrame) -> pd.DataFrame:
    frame, names, (key, pos) = _received(frame, [U, np.uint32])
    order = np.lexsort((pos, key.view(np.int64), names))
    s = names[order]
    bits = np.empty(len(s), np.uint8)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    bits[order] = new
    return _sent_back(frame, bits)


def _heard(parts: list | None, hashes: np.ndarray, buckets: int) -> np.ndarray:
    order, at = dealt(hashes, buckets)
    bits = np.zeros(len(hashes), np.uint8)
    for p in parts or []:
        bits[order[at[p["bucket"]] : at[p["bucket"] + 1]]] = unpack(p["bits"], np.uint8)
    return bits


def _by_block(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 100, block_bytes: int = 8 << 20, slice_bytes: int = SLICE, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the remaining bytes as `kept`. The result is staged, and the tables it was made of are dropped."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    blocks, name = _read_blocks(docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text")), block_bytes)
    size = blocks.agg(F.sum("size")).head()[0] or 0
    buckets = max(1, -(-int(size) // (32 * ENTRIES)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row, span, slice_bytes).find_ranges()
            sent = [{n: batch.column(n)[0].as_py() for n in ("bucket", "n", "data")} for batch in _send(row, *block.ask_ranges(), buckets)]
            packed = block.ranges(buckets)
            columns = [pa.array([row["block"]], pa.int64()), *(pa.array([packed[n]], pa.binary()) for n in RANGES), pa.array([sent], ASKS)]
            yield pa.RecordBatch.from_arrays(columns, ["block", *RANGES, "asks"])

    found_ranges = f"block bigint, {', '.join(f'{n} binary' for n in RANGES)}, asks array<struct<bucket: int, n: bigint, data: array<binary>>>"
    cut = stage(blocks.select("block", "size", "lens", "text", "keys").mapInArrow(find, found_ranges), "repeat-cut")
    asked = cut.select("block", F.explode("asks").alias("a")).select("a.bucket", "block", "a.n", "a.data")
    ranges = stage(asked.repartition(width, "bucket").groupBy("bucket").applyInPandas(_decide_ranges, ANSWER), "repeat-ranges")
    known = blocks.join(cut.drop("asks"), "block").join(_by_block(ranges, "r"), "block", "left")

    def heard(row: dict) -> Block:
        block = Block(row, span, slice_bytes).take_ranges(row)
        block.hear_ranges(_heard(row["r"], block.to, buckets))
        return block

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from _send(row, *heard(row).ask_windows(), buckets)

    asked = known.select("block", "size", "lens", "text", "keys", *RANGES, "r").mapInArrow(ask_windows, ASK)
    windows = stage(asked.repartition(width, "bucket").groupBy("bucket").applyInPandas(_decide_windows, ANSWER), "repeat-windows")
    known = known.join(_by_block(windows, "w"), "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        types = [None, pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
        for batch in batches:
            types[0] = batch.schema.field("ids").type.value_type
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                block = heard(row)
                gone = block.removed(_heard(row["w"], block.names[block.window_head], buckets))
                raw, out = np.frombuffer(block.data, np.uint8), []
                for i, s, n in zip(row["ids"], block.starts.tolist(), block.lens.tolist()):
                    own = gone[s : s + n]
                    removed = int(own.sum())
                    kept = block.data[s : s + n] if not removed else raw[s : s + n][~own].tobytes()
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed else 0
                    out.append((i, n, removed, spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
                for lo in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 4096]), types)], names)

    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    found = stage(known.select("block", "size", "lens", "text", "keys", "ids", *RANGES, "r", "w").mapInArrow(finish, schema), "repeat-found")
    spark.sql(f"DROP TABLE {name}")
    unstage(cut, ranges, windows)
    return found.withColumnRenamed("id", id_col)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
