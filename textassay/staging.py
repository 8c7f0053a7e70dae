"""Tables written between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textassay-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: its rows, and what depends on how they were dealt, are then fixed
    whatever executors are lost, and later steps don't repeat earlier ones."""
    path = f"{shared_dir(df.sparkSession)}/textassay/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
