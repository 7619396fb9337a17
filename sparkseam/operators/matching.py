"""Similarity and text matching between a query set and all posts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseam.functions import text as X

#: Query vectors and posts of a block; two blocks meet at once.
BLOCK, POSTS = 512, 2048


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, block, ids, data) of (id, embedding): vectors of one dimension, about so many a row, as little-endian bytes."""
    fit = vectors.where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select("id", F.col("embedding").cast("array<double>").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in zip(*kept.pop(dim), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([data.astype("<f8").tobytes()])], ["dim", "ids", "data"])

        for b in batches:
            e = b.column("embedding")
            dims, ids, flat = e.value_lengths().to_numpy(), b.column("id").to_numpy(), e.flatten().to_numpy()
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), rows):
                    some = at[i : i + rows]
                    kept.setdefault(dim, []).append((ids[some], flat[starts[some, None] + np.arange(dim)]))
                    if sum(len(x) for x, _ in kept[dim]) >= rows:
                        yield row(dim)
        for dim in list(kept):
            yield row(dim)

    return fit.mapInArrow(pack, "dim int, ids binary, data binary")


def recall_topk(profiles: DataFrame, posts: DataFrame, k: int = 50, floor: float = 0.15) -> DataFrame:
    """(profile_id, post_id, score, rank): for each profile its k posts of highest cosine, at least floor; ties by id.

    Both sides: (id, embedding). Each block of queries meets each block of posts in a row of its own and keeps its best k per
    profile, so that what is read grows with the pairs of blocks, not of vectors. The pairs are dealt to as many tasks as
    there are shuffle partitions. Vectors of another dimension don't match, zero vectors have cosine 0, null or non-finite
    ones are left out.
    """
    tasks = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = _blocks(profiles, BLOCK).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part"))
    p = _blocks(posts, POSTS).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(tasks)).cast("int"))
    pairs = p.join(q, ["dim", "part"])

    def unit(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        i = np.frombuffer(ids, "<i8")
        m = np.frombuffer(data, "<f8").reshape(len(i), -1)
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return i, np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                value = lambda c: b.column(c)[r].as_py()  # noqa: B023, E731
                (ids, x), (q_ids, y) = unit(value("ids"), value("data")), unit(value("q_ids"), value("q_data"))
                m = y @ x.T
                at, hit = np.nonzero(m >= floor)
                scores = m[at, hit]
                order = np.lexsort([ids[hit], -np.round(scores, 12), at])
                at, hit, scores = at[order], hit[order], scores[order]
                first = np.arange(len(at)) - np.searchsorted(at, at) < k
                if first.any():
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[first]]), pa.array(ids[hit[first]]), pa.array(scores[first])], ["profile_id", "post_id", "score"])

    found = pairs.mapInArrow(best, "profile_id long, post_id long, score double")
    w = Window.partitionBy("profile_id").orderBy(F.round("score", 12).desc(), "post_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def rejections(posts: DataFrame) -> DataFrame:
    """(reason, n) of the posts that the cheap filter drops."""
    return posts.select(X.cheap_filter_reason(F.col("text")).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def overlaps(queries: DataFrame, posts: DataFrame, fraction: float, stop_words: list[str] = X.DISCOVERY_STOP_WORDS) -> DataFrame:
    """(query_id, post_id, overlap): posts that share enough tokens with a query.

    Queries and posts: (id, text). An inverted join on tokens: pairs without a common token are never made. Tokens are
    counted per pair after a partial aggregation.
    """
    q = queries.select(F.col("id").alias("query_id"), X.tokens(F.col("text"), stop_words).alias("t")).where(F.size("t") > 0)
    q = q.select("query_id", X.required_share(F.size("t"), fraction).alias("need"), F.explode("t").alias("token"))
    p = posts.select(F.col("id").alias("post_id"), F.explode(X.tokens(F.col("text"), stop_words)).alias("token"))
    return p.join(q, "token").groupBy("query_id", "post_id", "need").agg(F.count("*").alias("overlap")).where("overlap >= need").select("query_id", "post_id", "overlap")


def plausible(queries: DataFrame, posts: DataFrame, fraction: float = 0.15) -> DataFrame:
    """(query_id, post_id, overlap) of overlaps() whose post reads like a buyer's; a query's tokens decide, not its phrase."""
    fit = posts.where(X.has_buyer_context(F.col("text"))).select(F.col("id").alias("post_id"))
    return overlaps(queries, posts, fraction).join(fit, "post_id", "left_semi").select("query_id", "post_id", "overlap")


def exact_evidence(queries: DataFrame, posts: DataFrame, before: int = 500, after: int = 800, cap: int = 2000) -> DataFrame:
    """(query_id, post_id, at, excerpt): posts whose text holds the query's compact phrase, and the words around it.

    Pairs are found over the longest inner word of the phrase, which a text with the phrase holds as a whole token;
    phrases of fewer than three words have no inner word and are compared with every post.
    """
    q = queries.select(F.col("id").alias("query_id"), F.lower(X.compact_term(F.col("text"))).alias("phrase")).where("phrase <> ''")
    words = F.split("phrase", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    q = q.withColumn("word", F.get(F.sort_array(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), F.lit(0))["w"])
    p = posts.select(F.col("id").alias("post_id"), X.normalize_space(F.col("text")).alias("text"))
    keyed = p.withColumn("word", F.explode(F.array_distinct(F.split(F.lower("text"), " "))))
    long = keyed.join(q.where("word IS NOT NULL"), "word")
    short = p.join(q.where("word IS NULL").drop("word"), F.contains(F.lower("text"), F.col("phrase")))
    cols = ["query_id", "post_id", "phrase", "text"]
    hit = long.select(*cols).unionByName(short.select(*cols)).withColumn("at", F.instr(F.lower("text"), F.col("phrase")) - 1).where("at >= 0")
    left = F.greatest(F.lit(0), F.col("at") - before)
    excerpt = F.trim(F.substring(F.col("text"), left + 1, F.col("at") + F.length("phrase") + after - left))
    return hit.select("query_id", "post_id", F.col("at").cast("long").alias("at"), F.substring(excerpt, 1, cap).alias("excerpt"))
