"""Sinks: append-only audit segments, cold storage, first-failing rows, delimited and tabular reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_audit(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append entries, each with the digest of its columns, in folders by day."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    rows.withColumn("entry_hash", digest).withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def cold_store(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("compression", "gzip").json(path)


def dead_letters(rows: DataFrame, failed: str, good_path: str, bad_path: str) -> None:
    """Rows whose `failed` column is null to one place, the others to another."""
    rows.filter(F.col(failed).isNull()).drop(failed).write.mode("append").parquet(good_path)
    rows.filter(F.col(failed).isNotNull()).write.mode("append").json(bad_path)


def csv_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report table; more than most rows are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found])
