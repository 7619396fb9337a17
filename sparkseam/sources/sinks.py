"""Sinks: partitioned NDJSON archive and quarantine of bad rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def archive(df: DataFrame, path: str, *by: str) -> None:
    """NDJSON files below path, partitioned, appended."""
    df.write.mode("append").partitionBy(*by).json(path)


def split_bad(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; a null condition is bad."""
    return df.where(~bad), df.where(bad | bad.isNull())
