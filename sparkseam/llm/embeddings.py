"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseam.llm import linking
from sparkseam.llm.common import written
from sparkseam.llm.graph import components

COSINE = 0.9
#: Share of the pairs at exactly the threshold that the tables bring together; closer pairs are found more surely.
RECALL = 0.98
SEED = 20


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors: unlike vectors then share a bucket about once in two."""
    bits = min(60, max(6, round(math.log2(max(n, 2))) + 1))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def keys(v: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A key for each vector and table. The hyperplanes depend on the dimension and the plan only."""
    planes = np.random.default_rng([SEED, v.shape[1], bits]).standard_normal((v.shape[1], tables * bits))
    signs = (v @ planes > 0).reshape(len(v), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision, of a column of lists of one length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    v = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Per row: vec_id, n_links (other vectors with a cosine of at least `cosine`), component_id, kept.

    Equal vectors are one node with a weight, so a large group of copies is never paired up. A pair is counted in the
    first table whose keys agree. Null, empty or zero vectors and those with null or non-finite components link with
    nothing; nor do vectors of different lengths. vec_id is the key: rows without it are returned with no component.
    """
    e, v = F.col("embedding").cast("array<double>"), vectors.select("vec_id", "embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(e, lambda x: x != 0)
    fit = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    nodes = written(fit.groupBy(e.alias("embedding")).agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")).select("node", "weight", F.size("embedding").alias("dim"), "embedding"))
    bits, tables = plan(nodes.count(), cosine, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                rows = b.filter(pa.array(dims == d))
                k = keys(matrix(rows.column("embedding")), bits, tables)
                n = np.repeat(rows.column("node").to_numpy(), tables)
                t = np.tile(np.arange(tables, dtype=np.int32), len(k)) + np.int32(int(d) * tables)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(t), pa.array(k.ravel())], ["node", "t", "key"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in linking.chunks(batches, 10_000):
            dims = chunk["dim"].to_numpy()
            for d in np.unique(dims):
                t = chunk.filter(pa.array(dims == d))
                x, node, weight, table = matrix(t["embedding"]), t["node"].to_numpy(), t["weight"].to_numpy(), t["t"].to_numpy() - int(d) * tables
                i, j = linking.pairs(t, lambda a, b, x=x: (x[a] * x[b]).sum(1) >= cosine, lambda a, b, x=x: x[a] @ x[b].T >= cosine)
                low, rows = linking.lowest(t.num_rows, i, j), np.unique(np.concatenate([i, j]))
                k = keys(x[rows], bits, tables)
                first = np.empty(len(i), bool)
                for at in range(0, len(i), 20_000):
                    a, b = np.searchsorted(rows, i[at : at + 20_000]), np.searchsorted(rows, j[at : at + 20_000])
                    first[at : at + 20_000] = (k[a] == k[b]).argmax(1) == table[i[at : at + 20_000]]
                links = np.bincount(i[first], weight[j[first]], t.num_rows) + np.bincount(j[first], weight[i[first]], t.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[low[rows]]), pa.array(links[rows].astype(np.int64))], ["a", "b", "links"])

    keyed = nodes.select("node", "dim", "embedding").mapInArrow(hashed, "node long, t int, key long")
    found = written(linking.blocks(written(keyed), nodes).mapInArrow(linked, "a long, b long, links long"))
    comps = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    per = nodes.join(counts, "node", "left").join(comps, "node", "left")
    per = per.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    joined = v.select("vec_id", e.alias("embedding")).join(per, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id, vec_id <= coalesce(c.low, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
