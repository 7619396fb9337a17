"""Sources: Parquet tables and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table of the folder, by Spark's reader, so that any store it knows will do."""
    return spark.read.parquet(f"{path}/{name}.parquet")


def with_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """df with exactly the columns of the schema: missing ones null, others dropped."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()))


def recordset(df: DataFrame, column: str, fields: str) -> DataFrame:
    """A row for each element of a JSON array of objects with the declared fields; null and broken documents give none."""
    return df.withColumn("_r", F.explode(F.from_json(column, f"array<struct<{fields}>>"))).select(*[c for c in df.columns if c != column], "_r.*")


def json_number(c: Column, key: str) -> Column:
    return F.get_json_object(c, f"$.{key}").try_cast("bigint")


def staged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records that a fetch job left as NDJSON files below path (sinks.archive()'s too); rows that are no JSON go to _bad."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
