"""Removal of byte strings that an earlier document holds, by merging Burrows-Wheeler transforms of shards.

A string of LENGTH bytes is looked for through its anchor, the first of its KMER-byte strings of lowest hash: equal
strings have equal anchors. Neighbouring windows of one anchor are one stretch of text. Stretches are dealt out by their
anchor's hash; of equal ones the first document's alone goes on. Where an anchor has several different stretches, their
texts are fetched, dealt into shards, and the shards' transforms are merged: an interleaving of the shards is
refined by two more characters a round, until equal windows of LENGTH bytes lie side by side, and common prefixes of
neighbours give the repeated intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseam.llm.common import give_back, giving_back, hold_memory, written

LENGTH = 50
KMER = 20
#: Bytes of text dealt out at once, and bytes of a shard of stretches.
PIECE, SHARD = 1 << 19, 1 << 17
#: Bytes of text hashed at once: few, so that the steps between stay in the processor's caches.
NEAR = 1 << 15
#: Closes a stretch: never a byte of UTF-8.
END = 255
#: Characters by which a shard's suffixes are compared at once: a 64-bit number's.
HEAD = 8
#: Bytes of text whose stretches make a bucket, on average.
BUCKET = 4 << 20
#: Merged spans up to which they are broadcast.
MOST_SPANS, MOST_DOCS = 3_000_000, 400_000

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)]))
    return [p[:n] for p in _POWERS]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _over(f: np.ufunc, a: np.ndarray, n: int) -> np.ndarray:
    """f over each n neighbours of a."""
    k = 1
    while 2 * k <= n:
        a = f(a[:-k], a[k:])
        k *= 2
    return f(a[: len(a) - (n - k)], a[n - k :]) if n > k else a


def stretches(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: for each stretch its start in raw, length, anchor's hash, own hash."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
    a = np.frombuffer(raw, np.uint8)
    if len(a) < LENGTH:
        return none
    power, shrink = _powers(len(a) + 1)
    run = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:-1], out=run[1:])
    near = LENGTH - KMER + 1
    h = _mixed((run[KMER:] - run[:-KMER]) * shrink[: len(a) - KMER + 1])
    low = _over(np.minimum, h, near)
    pad = np.zeros(near - 1, np.uint64)
    at = np.flatnonzero(h == _over(np.maximum, np.concatenate([pad, low, pad]), near))  # lowest of some window
    inside = np.ones(len(low), bool)  # windows within one text
    for e in np.cumsum(sizes)[:-1]:
        inside[max(0, e - LENGTH + 1) : e] = False
    w = np.flatnonzero(inside)
    if not len(w):
        return none
    low_at = np.zeros(len(h), np.int64)
    low_at[at] = 1
    j = (np.cumsum(low_at) - low_at)[w]  # the first at or after the window's start
    wanted, found = low[w], h[at]
    wrong = np.flatnonzero(found[j] != wanted)
    while len(wrong):
        j[wrong] += 1
        wrong = wrong[found[j[wrong]] != wanted[wrong]]
    begin = np.flatnonzero(np.concatenate([[True], (j[1:] != j[:-1]) | (w[1:] != w[:-1] + 1)]))
    start, anchor = w[begin], at[j[begin]]
    n = w[np.append(begin[1:], len(w)) - 1] - start + LENGTH
    own = _mixed((run[start + n] - run[start]) * shrink[start] + (anchor - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + n.astype(np.uint64))
    return start, n, h[anchor], own


def _stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """stretches() of texts laid end to end, worked out for a few at once."""
    sizes = np.array([len(t) for t in texts])
    run = (np.cumsum(sizes) - sizes) // NEAR
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(texts)]])
    got, at = [], 0
    for a, e in zip(cuts[:-1], cuts[1:], strict=True):
        start, *rest = stretches(b"".join(texts[a:e]), sizes[a:e])
        got.append((start + at, *rest))
        at += int(sizes[a:e].sum())
    return tuple(map(np.concatenate, zip(*got, strict=True)))


def _pieces(docs: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Runs of (doc, row, offset, bytes) of about PIECE bytes; long texts are cut so that each window is in one part."""
    held, size = [], 0
    for doc, row, raw in docs:
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            held.append((doc, row, at, raw[at : at + PIECE + LENGTH - 1]))
            size += len(held[-1][3])
            if size >= PIECE or len(held) == 65_000:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for doc, row, text in zip(b.column("doc").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
        yield doc, row, (text or "").encode("utf-8", "surrogatepass")


STRETCHES = "bucket int, docs array<bigint>, rows array<bigint>, offsets array<bigint>, anchor binary, own binary, part binary, start binary, n binary"


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in STRETCHES.split(", ")]
    for b in batches:
        hold_memory()
        for some in _pieces(_rows(b)):
            sizes = np.array([len(x[3]) for x in some])
            start, n, anchor, own = _stretches([x[3] for x in some])
            ends = np.cumsum(sizes)
            part = np.searchsorted(ends, start, "right")
            start = start - (ends - sizes)[part]
            bucket = (anchor >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.uint16 if buckets < 65536 else np.int64), kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            out = []
            for k in np.flatnonzero(np.diff(cuts)):
                o = order[cuts[k] : cuts[k + 1]]
                parts, index = np.unique(part[o], return_inverse=True)
                cols = [[some[p][c] for p in parts] for c in range(3)]
                out.append((int(k), *cols, anchor[o].tobytes(), own[o].tobytes(), index.astype(np.uint16).tobytes(), start[o].astype(np.uint32).tobytes(), n[o].astype(np.uint8).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 5], strict=True)], names)
        give_back()


SPANS = "bucket int, doc long, row long, start long, n int, ask boolean"


def _classified(t: pa.Table) -> pa.Table:
    """Spans that an earlier document's equal stretch repeats, and (ask) the first documents' stretches that are to be compared."""
    hold_memory()
    anchor, own, doc, row, start, n = [], [], [], [], [], []
    for r in range(t.num_rows):
        part = np.frombuffer(t["part"][r].as_buffer(), np.uint16)
        docs, rows, offsets = (np.array(t[c][r].values.to_numpy()) for c in ("docs", "rows", "offsets"))
        anchor.append(np.frombuffer(t["anchor"][r].as_buffer(), np.uint64))
        own.append(np.frombuffer(t["own"][r].as_buffer(), np.uint64))
        doc.append(docs[part])
        row.append(rows[part])
        start.append(offsets[part] + np.frombuffer(t["start"][r].as_buffer(), np.uint32))
        n.append(np.frombuffer(t["n"][r].as_buffer(), np.uint8))
    anchor, own, doc, row, start, n = map(np.concatenate, (anchor, own, doc, row, start, n))
    o = np.lexsort([doc, own, anchor])
    new_anchor = np.concatenate([[True], anchor[o][1:] != anchor[o][:-1]])
    new_own = new_anchor | np.concatenate([[True], own[o][1:] != own[o][:-1]])
    d = doc[o]
    groups, kinds = np.flatnonzero(new_anchor), np.flatnonzero(new_own)
    size = np.diff(np.append(groups, len(o)))
    several = np.repeat(np.minimum.reduceat(d, groups) != np.maximum.reduceat(d, groups), size)
    unlike = np.repeat(np.add.reduceat(new_own.astype(np.int64), groups) > 1, size)
    later = d != np.repeat(d[kinds], np.diff(np.append(kinds, len(o))))
    keep = several & (later | unlike)
    k = o[keep]
    cols = [pa.array(np.full(len(k), t["bucket"][0].as_py(), np.int32)), pa.array(doc[k]), pa.array(row[k]), pa.array(start[k].astype(np.int64)), pa.array(n[k].astype(np.int32)), pa.array(~later[keep])]
    give_back()
    return pa.table(cols, ["bucket", "doc", "row", "start", "n", "ask"])


def transform(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a shard's suffixes, the two characters before each, and each one's first HEAD characters as a number (0 after END).

    text: strings, each closed by END at `ends`.
    """
    n = len(text)
    last = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
    at = np.arange(n)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(HEAD):
        key = (key << np.uint64(8)) | np.where(at + k <= last, wide[k : k + n], 0).astype(np.uint64)
    head = key
    depth, longest = HEAD, int(np.diff(np.concatenate([[-1], ends])).max())
    # Equal suffixes stay in the text's order: a suffix's number is the key's last bits where there is room, else the sort is stable.
    bits = np.uint64(n.bit_length())
    room = n.bit_length() * 3 <= 64
    order = np.argsort(key, kind="stable" if longest <= HEAD else None)
    sorted_ = key[order]
    while True:
        rank = np.empty(n + 1, np.uint64)
        rank[n] = 0
        rank[order] = np.cumsum(np.concatenate([[1], sorted_[1:] != sorted_[:-1]])).astype(np.uint64)
        if depth >= longest or rank[order[-1]] == n:
            break
        key = (rank[:n] << bits) | rank[np.where(at + depth <= last, at + depth, n)]
        if room:
            sorted_ = np.sort(key << bits | at.astype(np.uint64))
            order = (sorted_ & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            sorted_ >>= bits
        else:
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
        depth *= 2
    before = np.roll(text, 2).astype(np.uint16) << np.uint16(8) | np.roll(text, 1)
    return order, before[order], head[order]


def merged(shards: list[np.ndarray], rounds: int = LENGTH, heads: list[np.ndarray] | None = None) -> np.ndarray:
    """Which shard each row of the merged transform is from. shards: their transforms, each with as many ENDs as strings.

    The interleaving begins with one shard after the other; a step sorts it, stably, by the characters of the shards'
    transforms, and then it is right for one character more. Rows of END itself stay in the shards' order. A round is two
    steps: it sorts by the two characters before. Rows that pass END on the way, (x, END), are in the shards' order in
    every round, and their places don't change. With heads, the shards' rows' first HEAD characters in order, the
    interleaving begins right for HEAD characters, by a merge of these runs.
    """
    kind = np.uint8 if len(shards) < 256 else np.uint16
    chars = np.concatenate(shards)
    z = np.repeat(np.arange(len(shards), dtype=kind), [len(s) for s in shards])
    order = np.argsort(chars, kind="stable")
    passing = np.flatnonzero(chars[order] & np.uint16(255) == END)
    passed, finish = z[order[passing]], z[chars >> np.uint16(8) == END]
    if heads and len(shards) > 1:
        z = z[np.argsort(np.concatenate(heads), kind="stable")]
        rounds -= HEAD
    b = np.empty(len(z), np.uint16)
    for _ in range(0, rounds, 2):
        b[np.argsort(z, kind="stable")] = chars
        new = z[np.argsort(b, kind="stable")]
        new[passing] = passed
        new[len(new) - len(finish) :] = finish
        if np.array_equal(new, z):
            break
        z = new
    return z


def repeated(strings: list[bytes], docs: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (string, start, length) of bytes in windows that a string of a smaller doc holds too."""
    size = np.array([len(s) for s in strings])
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    ends = np.cumsum(size + 1) - 1
    shard = (ends // SHARD).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(strings)]])
    orders, lasts, heads = [], [], []
    for a, e in zip(cuts[:-1], cuts[1:], strict=True):
        from_ = ends[a] - size[a]
        order, before, head = transform(text[from_ : ends[e - 1] + 1], ends[a:e] - from_)
        orders.append(order + from_)
        lasts.append(before)
        heads.append(head)
    z = merged(lasts, heads=heads)
    rows = np.empty(len(text), np.int64)
    rows[np.argsort(z, kind="stable")] = np.concatenate(orders)
    # Common prefixes of neighbours: whole windows in steps of eight bytes.
    of = np.repeat(np.arange(len(strings)), size + 1)
    rows = rows[ends[of[rows]] - rows >= LENGTH]
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    same = np.ones(max(0, len(rows) - 1), bool)
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        v = words[rows + k].copy().view(np.uint64).ravel()
        same &= v[1:] == v[:-1]
    if not len(rows):
        return []
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    own = docs[of[rows]]
    first = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, len(rows))))
    hit = np.sort(rows[own > first])
    if not len(hit):
        return []
    b = np.flatnonzero(np.concatenate([[True], hit[1:] > hit[:-1] + LENGTH]) | np.concatenate([[True], of[hit[1:]] != of[hit[:-1]]]))
    start, stop = hit[b], hit[np.append(b[1:], len(hit)) - 1] + LENGTH
    s = of[start]
    return list(zip(s.tolist(), (start - (ends[s] - size[s])).tolist(), (stop - start).tolist(), strict=True))


def _compared(t: pa.Table) -> pa.Table:
    hold_memory()
    doc, row, start = (t[c].to_numpy() for c in ("doc", "row", "start"))
    strings = t["bytes"].to_pylist()
    found = repeated(strings, doc)
    k = np.array([f[0] for f in found], np.int64)
    cols = [pa.array(doc[k]), pa.array(row[k]), pa.array(start[k] + np.array([f[1] for f in found], np.int64)), pa.array([f[2] for f in found], pa.int32())]
    give_back()
    return pa.table(cols, ["doc", "row", "start", "n"])


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's spans (start, n), merged where they touch."""
    for b in batches:
        starts, stops = [], []
        for spans in b.column("spans").to_pylist():
            s = np.array([(x["start"], x["start"] + x["n"]) for x in spans])
            s = s[np.argsort(s[:, 0])]
            far = np.maximum.accumulate(s[:, 1])
            new = np.flatnonzero(np.concatenate([[True], s[1:, 0] > far[:-1]]))
            starts.append(s[new, 0])
            stops.append(far[np.append(new[1:], len(s)) - 1])
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("row"), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))], ["doc", "row", "starts", "stops"])


def repeats(docs: DataFrame) -> DataFrame:
    """A row (d, starts, stops) for each row d of docs: byte spans of its text that an earlier document holds.

    Null texts are empty. Rows without a doc_id come after all others. Rows of one doc_id are one document: they don't
    take from each other. Of docs' columns only doc_id and text are looked at.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("d"), "text", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("row"))
    buckets = 1 + keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // BUCKET
    dealt = keyed.select("doc", "row", "text").mapInArrow(lambda it: _dealt(it, buckets), STRETCHES)
    spans = written(dealt.groupBy("bucket").applyInArrow(_classified, SPANS))

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [], [], [])
            for (doc, row, raw), asks in zip(_rows(b), b.column("asks").to_pylist(), strict=True):
                for a in asks:
                    for c, v in zip(out, (a["bucket"], doc, row, a["start"], raw[a["start"] : a["start"] + a["n"]]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "doc", "row", "start", "bytes"])

    asks = spans.where("ask").groupBy("doc", "row").agg(F.collect_list(F.struct("bucket", "start", "n")).alias("asks"))
    texts = keyed.select("doc", "row", "text").join(asks, ["doc", "row"]).mapInArrow(lambda it: giving_back(fetched(it)), "bucket int, doc long, row long, start long, bytes binary")
    compared = texts.groupBy("bucket").applyInArrow(_compared, "doc long, row long, start long, n int")
    every = spans.where("NOT ask").select("doc", "row", "start", "n").union(compared)
    by_doc = every.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans")).mapInArrow(lambda it: giving_back(_union(it)), "doc long, row long, starts array<bigint>, stops array<bigint>")
    by_doc = written(by_doc)
    size = by_doc.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    small = F.broadcast(by_doc) if size[0] <= MOST_DOCS and size[1] <= MOST_SPANS else by_doc
    return keyed.join(small, ["doc", "row"], "left").select("d", "starts", "stops")


def cut(raw: bytes, starts: list[int] | None, stops: list[int] | None) -> bytes:
    """raw without the spans."""
    if not starts:
        return raw
    return b"".join(raw[a:b] for a, b in zip([0, *stops], [*starts, len(raw)], strict=True))


def _cuts(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(b.column("d").field("text").to_pylist(), b.column("starts").to_pylist(), b.column("stops").to_pylist(), strict=True)


def removed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; see repeats()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, spans, sha = [], [], [], []
            for text, s, e in _cuts(b):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept = cut(raw, s, e)
                n.append(len(raw))
                gone.append(len(raw) - len(kept))
                spans.append(len(s or ()))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("d").field("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeats(docs.select("doc_id", "text")).mapInArrow(lambda it: giving_back(run(it)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeats cut out of text; a character that a span cuts through loses its other bytes too."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.column("d").flatten()
            cols[at] = pa.array([None if x is None else x if not s else cut(x.encode("utf-8", "surrogatepass"), s, e).decode("utf-8", "ignore") for x, s, e in _cuts(b)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return repeats(docs).mapInArrow(lambda it: giving_back(run(it)), docs.schema)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
l AS (SELECT doc_id, list_transform(range(0, length(h) // 2 - 49), lambda p: substr(h, 2 * p + 1, 100)) AS l FROM d),
w AS (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS s FROM l),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE f.low < w.doc_id),
b AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r),
g AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM b),
x AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS nth FROM x),
t AS (SELECT e.doc_id, count(*) AS n, sum(z - a) AS gone,
        string_agg((CASE WHEN nth = 1 THEN substr(h, 1, 2 * a) ELSE '' END) || (CASE WHEN next IS NULL THEN substr(h, 2 * z + 1) ELSE substr(h, 2 * z + 1, 2 * (next - z)) END), '' ORDER BY a) AS kept
      FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
