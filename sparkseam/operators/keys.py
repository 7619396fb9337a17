"""Keyed merges: first wins, insert-ignore, upserts, audits, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseam.functions import text as X


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by `order`, which must be total. Pre-aggregates before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, key: Column, by: str) -> DataFrame:
    """(first, n): for each key the smallest `by` and the number of rows; null keys are no duplicates of each other."""
    grouped = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.min(by).alias("first"), F.count("*").alias("n")).select("first", "n")
    return grouped.unionByName(df.where(key.isNull()).select(F.col(by).alias("first"), F.lit(1).cast("long").alias("n")))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Incoming rows that are new: the first of each key that existing doesn't have; rows with null keys all stay."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    new = latest(incoming.where(whole), keys, *order).join(existing.select(*keys).distinct(), keys, "left_anti").select(incoming.columns)
    return new.unionByName(incoming.where(~whole))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], value: str, sticky: str | None = None) -> DataFrame:
    """existing with incoming's values; incoming wins, but a value equal to `sticky` stays. One row per key on each side."""
    old, new = existing.select(*keys, F.col(value).alias("_old")), incoming.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_in"))
    merged = F.when(F.col("_in").isNull(), F.col("_old"))
    if sticky is not None:
        merged = merged.when(F.col("_old") == sticky, F.col("_old"))
    return old.join(new, keys, "full_outer").select(*keys, merged.otherwise(F.col("_new")).alias(value))


def duplicates(df: DataFrame, *key: Column) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def md5_sample(df: DataFrame, id_: str, rate: float) -> DataFrame:
    """The rows whose id's MD5 falls below the rate: the same rows every time."""
    return df.where(X.md5_percent(F.col(id_)) < rate * 100)
