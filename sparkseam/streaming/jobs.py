"""Structured Streaming wrappers: they add a source, a checkpoint and a sink to batch logic."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(spark: SparkSession, table: DataFrame, logic: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """logic over a stream of the table's files, until all are used; the last state of the result as a table.

    The stream's checkpoint and result lie in the shared folder named by spark.checkpoint.dir; where that is unset, in a
    temporary one if Spark runs in one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    files = table.inputFiles()
    folder = files[0].rsplit("/", 1)[0]
    glob = files[0].rsplit("/", 1)[1] if len(files) == 1 else "*.parquet"
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", glob).parquet(folder)
    out = logic(stream)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/result")

    q = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/result")


def first_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id): the first event of each key, as an idempotent ingest keeps it."""
    return run_available(spark, events, lambda s: s.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")), "complete")


def window_totals(spark: SparkSession, events: DataFrame, width: str = "1 day") -> DataFrame:
    """(user_id, window_start, n): events per user and tumbling window."""

    def totals(s: DataFrame) -> DataFrame:
        w = F.window(F.col("ts").cast("timestamp"), width)
        return s.groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")

    return run_available(spark, events, totals, "complete")


def distinct_within(spark: SparkSession, events: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """The keys of events, once each within the delay: state is dropped when the watermark has passed it."""
    return run_available(spark, events, lambda s: s.select(*keys, F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(keys).select(*keys), "append")


def fan_out(spark: SparkSession, posts: DataFrame, profiles: DataFrame, on: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each new post with every profile that shares its values of `on`, of which keep() leaves the matches: a stream-static join."""
    return run_available(spark, posts, lambda s: keep(s.join(profiles, on)), "append")
