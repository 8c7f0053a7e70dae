"""What the corpus operators share: staged tables in the shared checkpoint folder, and document access."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows times their widest row stay below this.
BROADCAST_BYTES = 8 << 20

#: Rows go to Python workers in batches of about so many bytes; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
_BOUND: ContextVar[int] = ContextVar("batch_bytes", default=BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local master gets a folder of its own
    (there driver and executors are one process); a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textassay-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Bound the batches that plans started within send to Python by bytes as well as by rows.

    A batch is held by the JVM, twice while it is sent, and by the worker, so its size and not its rows must be bounded.
    A smaller bound holds for the stages written within, too.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    outer = _BOUND.set(min(most, _BOUND.get()))
    spark.conf.set(key, _BOUND.get())
    try:
        yield
    finally:
        _BOUND.reset(outer)
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage, so work done so far survives lost executors, and lets the next plan see real sizes.
    """
    path = f"{shared_dir(df.sparkSession)}/textassay/{label}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def is_staged(df: DataFrame) -> bool:
    return hasattr(df, "_staged_at")


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_staged_at", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of plans that have ended deleted now.

    Spark deletes them when the driver's JVM collects those plans, which a driver with room to spare may put off for
    hours while the executors' disks fill.
    """
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def whole_row(df: DataFrame) -> Column:
    """All of df's columns, whatever their names, as a struct `row`."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row")


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows, counted, fit the limit; else marked as the hash side of a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df.hint("shuffle_hash")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
