"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

Each of the 64 bit places gets a code of radius + 1 bits. Table v, for each v of 1 .. 2^(radius + 1) - 1, keeps the
places whose code has an odd number of bits in common with v. The codes of `radius` differing places can't span all
radius + 1 dimensions, so some v is orthogonal to them all: that table's key has none of the differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseam.llm import linking
from sparkseam.llm.common import giving_back, written
from sparkseam.llm.graph import components

RADIUS = 3
SHINGLE = 3
SEED = 42


def masks(radius: int = RADIUS) -> list[int]:
    """The covering bit masks as signed 64-bit numbers."""
    top = 2 ** (radius + 1) - 1
    codes = [1 + place % top for place in range(64)]
    out = [sum(1 << place for place, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, top + 1)]
    return [m - 2**64 if m >= 2**63 else m for m in out]


def fingerprint(text: str | None) -> int:
    """64 bits, each set in over half of the XXH64 of the text's shingles; no words: 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    joined = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in joined], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(x) for x in b.column("text").to_pylist()], "<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f)], ["doc_id", "fp"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in linking.chunks(batches):
        f, node = t["fp"].to_numpy(), t["node"].to_numpy()
        i, j = linking.pairs(t, lambda a, b: np.bitwise_count((f[a] ^ f[b]).view("<u8")) <= RADIUS, lambda a, b: np.bitwise_count((f[a][:, None] ^ f[b][None, :]).view("<u8")) <= RADIUS)
        low = linking.lowest(t.num_rows, i, j)
        k = np.flatnonzero(low != np.arange(t.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(node[low[k]])], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    Equal fingerprints are one node, so copies cost nothing after the first stage. Null and empty texts have
    fingerprint zero and link like any other. Repeated rows each get a row. A row without doc_id gets the component of
    its fingerprint. Extra columns are ignored. The result is exact; large buckets are compared in blocks.
    """
    fps = written(docs.select("doc_id", "text").mapInArrow(lambda it: giving_back(_fingerprints(it)), "doc_id long, fp long"))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks()])).alias("t", "key")
    known = nodes.where("node IS NOT NULL")
    groups = linking.blocks(known.select("node", keys), known.select("node", "fp"))
    comps = components(groups.mapInArrow(lambda it: giving_back(_links(it)), "a long, b long"))
    placed = nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(placed, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
