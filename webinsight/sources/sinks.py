"""Idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def overwrite_dates(df: DataFrame, path: str, date: str = "log_date") -> None:
    """Replace exactly the date partitions that df holds; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
