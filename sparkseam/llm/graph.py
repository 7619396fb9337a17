"""Connected components of an edge table, by alternating star contraction over Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseam.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge of (a, b) longs; component is the smallest node it can reach.

    Edges of a node with itself or null ends tell nothing and are left out. Each round a large star moves all larger
    neighbours of a node to its smallest one, and a small star the smaller ones; minima are pre-aggregated and
    the joins back are Spark's, so that a hub's edges are split by adaptive skew handling. Rounds are written to the
    shared folder. Raises if they don't settle.
    """
    ends = edges.where(F.col("a") != F.col("b"))
    e = written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _mark(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = written(small.where("u != v").distinct())
        was, seen = seen, _mark(e)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
