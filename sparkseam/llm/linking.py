"""Links within the buckets of locality-sensitive hash tables: blocks of bounded size, no pairs emitted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block: a larger bucket is dealt into blocks, and each two blocks meet in a group of their own.
BLOCK = 1024
#: Buckets up to this size are compared by shifting whole columns.
SMALL = 24
GROUP = ["t", "key", "lo", "hi"]


def blocks(keyed: DataFrame, payload: DataFrame) -> DataFrame:
    """Rows (t, key, lo, hi, mine, node, *payload), sorted by group in their partition.

    keyed: (node, t, key), payload: (node, ...). Buckets of one node are left out. A bucket of n nodes becomes
    ceil(n / BLOCK) blocks; group (lo, hi) holds two of them, (i, i) the i-th alone.
    """
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    k = F.ceil(F.col("n") / BLOCK)
    dealt = keyed.join(sizes, ["t", "key"]).select("t", "key", "node", F.pmod(F.xxhash64("node"), k).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), (k - 1).cast("int"))).alias("other"))
    wide = dealt.join(payload, "node").select("t", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", *payload.columns)
    return wide.repartition(*GROUP).sortWithinPartitions(*GROUP, "node")


def chunks(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, of about `least` rows each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= least:
            t = pa.Table.from_batches(held)
            starts = group_starts(t)
            if len(starts) > 1:
                yield t.slice(0, starts[-1])
                held = t.slice(starts[-1]).to_batches()
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def group_starts(t: pa.Table) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in GROUP:
        v = t[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def pairs(t: pa.Table, match: Callable[[np.ndarray, np.ndarray], np.ndarray], cross: Callable[[slice | np.ndarray, slice | np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the rows that match within a group; in groups of two blocks only across them.

    match(i, j): of row numbers, elementwise; cross(a, b): a matrix of all rows a against all rows b.
    """
    starts = group_starts(t)
    ends = np.append(starts[1:], t.num_rows)
    sizes = ends - starts
    two = t["lo"].to_numpy()[starts] != t["hi"].to_numpy()[starts]
    left, right = [], []
    easy = (sizes <= SMALL) & ~two
    size_of = np.repeat(np.where(easy, sizes, 0), sizes)
    place = np.arange(t.num_rows) - np.repeat(starts, sizes)
    for d in range(1, SMALL):
        i = np.flatnonzero(place + d < size_of)
        if not len(i):
            break
        i = i[match(i, i + d)]
        left.append(i)
        right.append(i + d)
    mine, lo = t["mine"].to_numpy(), t["lo"].to_numpy()
    for g in np.flatnonzero(~easy):
        rows = np.arange(starts[g], ends[g])
        if two[g]:
            own = mine[rows] == lo[rows]
            a, b = rows[own], rows[~own]
            x, y = np.nonzero(cross(a, b))
        else:
            a = b = rows
            x, y = np.nonzero(np.triu(cross(a, b), 1))
        left.append(a[x])
        right.append(b[y])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the lowest row that it reaches over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        was = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if (was == label).all():
            break
    return label
