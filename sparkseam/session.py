"""Session settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "sparkseam", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; later of two equal map keys wins. Keywords override, with _ for dots."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
