"""Ordered folds whose state is carried along a group, and never the group itself.

A digest or a chain over a group's rows is sequential, but ordering and encoding the rows is not. Rows are dealt to
sorted ranges of (group, order), whatever the groups' sizes, and each range joins neighbours of one group into pieces of
about a megabyte; then one sorted pass over a group's pieces carries the state. Nothing is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

PIECE_BYTES = 1 << 20


class Digest:
    """SHA-256 over the payloads, one after the other."""

    def __init__(self) -> None:
        self.state = hashlib.sha256()

    def add(self, payload: bytes) -> None:
        self.state.update(payload)

    def value(self) -> str:
        return self.state.hexdigest()


class Chain:
    """sha256(root || payload) over raw bytes, from 32 zero bytes."""

    def __init__(self) -> None:
        self.root = bytes(32)

    def add(self, payload: bytes) -> None:
        self.root = hashlib.sha256(self.root + payload).digest()

    def value(self) -> str:
        return self.root.hex()


def ordered_fold(rows: DataFrame, payload: str, order: Sequence[str], fold: type[Digest] | type[Chain], *by: str, name: str = "value", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(by, entries, name): the fold of each group's binary payloads in order. Rows equal in order are taken by payload,
    null payloads are passed over; a group of null keys is a group."""
    given = rows.filter(F.col(payload).isNotNull())
    keys = given.select(*by).schema
    kinds = list(to_arrow_schema(keys))
    key_ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in keys]
    width = len(by)
    spread = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))

    def batch_of(out: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, seq, part = None, [], 0, 0, 0
        types, names = [f.type for f in kinds] + [pa.int32(), pa.int64(), pa.list_(pa.binary())], [*by, "__part", "__seq", "__piece"]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *k, at, data in zip(*columns):
                if held and (k != key or size >= piece_bytes):
                    yield batch_of([(*key, part, seq, held)], types, names)
                    held, size, seq = [], 0, seq + 1
                key, part = k, at
                held.append(data)
                size += len(data)
        if held:
            yield batch_of([(*key, part, seq, held)], types, names)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n = None, None, 0
        types, names = [f.type for f in kinds] + [pa.int64(), pa.string()], [*by, "entries", name]
        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for *k, piece in zip(*columns):
                if state is None or k != key:
                    if state is not None:
                        done.append((*key, n, state.value()))
                    key, state, n = k, fold(), 0
                for data in piece:
                    state.add(data)
                n += len(piece)
            if done:
                yield batch_of(done, types, names)
        if state is not None:
            yield batch_of([(*key, n, state.value())], types, names)

    dealt = given.repartitionByRange(spread, *by, *order, payload).sortWithinPartitions(*by, *order, payload)
    pieces = dealt.select(*by, F.spark_partition_id().alias("__part"), payload).mapInArrow(join, ", ".join([*key_ddl, "__part int", "__seq bigint", "__piece array<binary>"]))
    dealt = (pieces.repartition(spread, *by) if by else pieces.coalesce(1)).sortWithinPartitions(*by, "__part", "__seq")
    return dealt.select(*by, "__piece").mapInArrow(carry, ", ".join([*key_ddl, "entries bigint", f"`{name}` string"]))
