"""A segmented write-ahead log as a Spark data source: batch and stream readers, and writers that rotate.

A log is a folder of segments whose names ascend. A segment is `time|length|body` records, each ended by a line feed; the
length is the body's in bytes, so bodies may hold line feeds. `spark.read.format("segments").load(folder)` replays all of
it, a task for each segment; `spark.readStream` resumes behind the last record it has seen, by segment and byte, and
replays each record once. A record still being written at the end (a torn tail) is left for later, a malformed one is
passed over to the next line.

Writing starts a new segment whenever one reaches `segmentBytes` (64 MB). Tasks write under names of their own, and only
the commit moves segments to their places, so readers see nothing of a failed or repeated task. A stream's batch always gets the
same names: written again after a failure, it replaces itself. One job at a time may append to a folder. Folders are
opened by pyarrow's file systems (local, s3, gs, hdfs), on the executors as on the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "segment string, at bigint, ts timestamp, body binary"
SEGMENT_BYTES = 64 << 20
STAGING = "_staging"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}")


def segments(path: str) -> list[str]:
    files, root = opened(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(x.base_name for x in found if x.is_file and x.base_name.endswith(".wal"))


def encoded(ts: datetime, body: bytes) -> bytes:
    return f"{ts.astimezone(UTC).isoformat()}|{len(body)}|".encode() + body + b"\n"


def parsed(data: bytes, start: int = 0) -> Iterator[tuple[int, datetime | None, bytes, int]]:
    """(at, ts, body, end) of each record of data from start on; the last end is where a torn tail begins. A malformed line
    has no ts."""
    at = start
    while at < len(data):
        line = data.find(b"\n", at)
        head = data[at : data.find(b"|", data.find(b"|", at) + 1)].split(b"|") if data.count(b"|", at, at + 64) >= 2 else []
        try:
            ts, length = datetime.fromisoformat(head[0].decode()), int(head[1])
            body = at + len(head[0]) + len(head[1]) + 2
            if length < 0 or ts.tzinfo is None:
                raise ValueError
        except (ValueError, IndexError):
            if line < 0:
                return
            yield at, None, b"", line + 1
            at = line + 1
            continue
        end = body + length + 1
        if end > len(data):
            return
        if data[end - 1 : end] != b"\n":  # the length is wrong
            if line < 0:
                return
            yield at, None, b"", line + 1
            at = line + 1
            continue
        yield at, ts, data[body : end - 1], end
        at = end


def _bytes(path: str, segment: str) -> bytes:
    files, root = opened(path)
    with files.open_input_file(f"{root}/{segment}") as f:
        return f.readall()


@dataclass
class Span(InputPartition):
    """Bytes of a segment, to its last whole record if `end` is not given."""

    segment: str
    start: int = 0
    end: int | None = None


def _read(path: str, span: Span | None) -> Iterator[pa.RecordBatch]:
    if span is None:  # Spark asks once where there is no partition
        return
    data = _bytes(path, span.segment)
    rows: list[tuple] = []
    for at, ts, body, end in parsed(data[: span.end] if span.end is not None else data, span.start):
        if ts is not None:
            rows.append((span.segment, at, ts, body))
        if len(rows) == 4096:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["segment", "at", "ts", "body"])


class Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Span]:
        return [Span(s) for s in segments(self.path)]

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class Stream(DataSourceStreamReader):
    """Offsets are (segment, at): all records of earlier segments, and those of this one before the byte `at`."""

    def __init__(self, path: str):
        self.path = path
        self.tail = ("", 0)

    def initialOffset(self) -> dict:
        return {"segment": "", "at": 0}

    def latestOffset(self) -> dict:
        found = segments(self.path)
        if not found:
            return self.initialOffset()
        last, at = found[-1], self.tail[1] if self.tail[0] == found[-1] else 0
        for *_, end in parsed(_bytes(self.path, last), at):
            at = end
        self.tail = (last, at)
        return {"segment": last, "at": at}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = []
        for s in segments(self.path):
            if start["segment"] <= s <= end["segment"]:
                lo, hi = start["at"] if s == start["segment"] else 0, end["at"] if s == end["segment"] else None
                if hi is None or lo < hi:
                    spans.append(Span(s, lo, hi))
        return spans

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    task: int
    folder: str
    files: list[str]


class _Segments:
    """What both writers share: staged segments of a task, moved to their places at the commit."""

    def __init__(self, path: str, segment_bytes: int):
        self.path, self.segment_bytes = path, segment_bytes

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        files, root = opened(self.path)
        folder = f"{STAGING}/{uuid.uuid4().hex}"
        files.create_dir(f"{root}/{folder}")
        task, written, out, size = TaskContext.get().partitionId(), [], None, 0
        for row in iterator:
            if out is None:
                written.append(uuid.uuid4().hex)
                out, size = files.open_output_stream(f"{root}/{folder}/{written[-1]}"), 0
            record = encoded(row["ts"], bytes(row["body"]))
            out.write(record)
            size += len(record)
            if size >= self.segment_bytes:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(task, folder, written)

    def publish(self, messages: list[Written | None], epoch: int) -> None:
        files, root = opened(self.path)
        for old in segments(self.path):
            if old.startswith(f"{epoch:012d}-"):
                files.delete_file(f"{root}/{old}")
        for m in filter(None, messages):
            for k, name in enumerate(m.files):
                files.move(f"{root}/{m.folder}/{name}", f"{root}/{epoch:012d}-{m.task:06d}-{k:06d}.wal")
        self.discard(messages)

    def discard(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        for m in filter(None, messages):
            files.delete_dir(f"{root}/{m.folder}")


class BatchWriter(_Segments, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        last = segments(self.path)[-1:]
        self.publish(messages, int(last[0].split("-")[0]) + 1 if last else 0)

    def abort(self, messages: list[Written | None]) -> None:
        self.discard(messages)


class StreamWriter(_Segments, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.discard(messages)


class SegmentLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Stream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return BatchWriter(self.options["path"], int(self.options.get("segmentBytes", SEGMENT_BYTES)))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return StreamWriter(self.options["path"], int(self.options.get("segmentBytes", SEGMENT_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format `segments` known to the session."""
    spark.dataSource.register(SegmentLog)
