"""Reports: patterns, lanes, run summaries, latencies, revenue and churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patterns(matches: DataFrame, top: int = 3, least: int = 2) -> DataFrame:
    """(label, n): labels of at least two distinct matches, most first; spellings that differ in case only are one label.

    matches: (id, label). The label shown is that of the smallest id.
    """
    g = matches.where("label <> ''").groupBy(F.lower("label").alias("k")).agg(F.min_by("label", "id").alias("label"), F.countDistinct("id").alias("n"))
    return g.where(F.col("n") >= least).orderBy(F.col("n").desc(), "label").limit(top).select("label", "n")


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(keys, p50, p95): the sorted value at place int(n * p / 100) - 1, the first at least; not interpolated."""
    lists = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    run = lists.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    pick = [F.min(F.when(F.col("upto") >= F.greatest(F.floor(F.col("n") * p / 100), F.lit(1)), F.col(value))).alias(f"p{p}") for p in percents]
    return run.groupBy(*keys).agg(*pick)


def revenue(charges: DataFrame, disputes: DataFrame, preaggregated: bool) -> DataFrame:
    """(day, gross, refunded, disputed, net) from charges (id, ts, amount, refunded) and disputes (charge, amount), in decimals.

    Without preaggregation a charge counts once per dispute, as a plain left join has it; with it, once.
    """
    d = disputes.groupBy("charge").agg(F.sum("amount").alias("d")) if preaggregated else disputes.select("charge", F.col("amount").alias("d"))
    j = charges.join(d, charges["id"] == d["charge"], "left").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    g = j.agg(F.sum("amount").alias("gross"), F.sum("refunded").alias("refunded"), F.coalesce(F.sum("d"), F.lit(0)).alias("disputed"))
    net = F.expr("gross - refunded - disputed").alias("net")
    return g.select("day", "gross", "refunded", "disputed", net).select("day", *(F.round(c, 2).cast("double").alias(c) for c in ("gross", "refunded", "disputed", "net")))


def churn(df: DataFrame, ts: str, status: str, canceled: list[str], counted: list[str]) -> DataFrame:
    """(month, canceled, total, churn_rate_pct): rate in per cent of the counted states, null without any."""
    g = df.groupBy(F.date_trunc("month", ts).cast("timestamp_ntz").alias("month")).agg(F.count_if(F.col(status).isin(canceled)).alias("canceled"), F.count_if(F.col(status).isin(counted)).alias("total"))
    return g.withColumn("churn_rate_pct", F.round(F.when(F.col("total") > 0, F.lit(100.0) * F.col("canceled") / F.col("total")), 2))
