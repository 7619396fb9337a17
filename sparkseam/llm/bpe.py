"""Byte-level BPE: encoding and decoding by DuckDB's recursive queries in each partition.

A partition's distinct words become lists of token ids and of their pairs' ranks. A recursive query contracts, in each word, its
leftmost pair of minimum rank, and joins the two new neighbours with the merge table, until no pair has a rank. Ordered
aggregation of token-position rows, joined with the vocabulary, turns the ids back into bytes.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from sparkseam.llm.common import giving_back, worker_kept

RANKS = "byte_bpe_50k.tiktoken"
#: Words encoded by one query, strings that a task keeps, and rows and characters looked up at once.
WORDS_AT_ONCE, STRINGS_KEPT = 20_000, 400_000
ROWS_AT_ONCE, CHARS_AT_ONCE = 5000, 2_000_000
#: Bytes of kept strings and what they become, beyond which all are forgotten: long words.
BYTES_KEPT = 100_000_000
#: Longer words are encoded in blocks of so many bytes, of which each begins half a block after the one before.
LONG = 256
#: After letters alone, these are a word of their own.
CLOSERS = (".", ",")
#: What stands between two words' ids in decimal, and between their bytes.
GLUE = (b" ", b"")

# The classes of letters, numbers and white space among the first 256 code points.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_ANY = regex.compile(public_tokenizers.PATTERN)
_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?(?:[{_L}]+|[{_N}]+|[^{_S}{_L}{_N}]+)|[{_S}]+(?![^{_S}])|[{_S}]+")


def split(text: str) -> list[str]:
    """The words of public_tokenizers.PATTERN; texts within Latin-1 by an equal pattern of plain classes."""
    return (_LATIN if text.isascii() or max(text) < "Ā" else _ANY).findall(text)


class Kept:
    """What strings become by make(), kept in Arrow columns for the latest ones: beyond a bound, the half not asked for the longest goes."""

    def __init__(self, make: Callable[[pa.Array], list[pa.Array]], most: int) -> None:
        self.make, self.most, self.round = make, most, 0
        self.forget()

    def forget(self) -> None:
        none = pa.array([], pa.string())
        self.columns, self.asked = [none, *self.make(none)], np.empty(0, np.int32)

    def of(self, strings: pa.Array) -> list[pa.Array]:
        """The columns of make() for distinct strings."""
        self.round += 1
        at = pc.index_in(strings, value_set=self.columns[0]).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.asked) + np.arange(len(new))
            given = strings.take(pa.array(new))
            self.columns = [pa.concat_arrays(c) for c in zip(self.columns, [given, *self.make(given)], strict=True)]
            self.asked = np.append(self.asked, np.zeros(len(new), np.int32))
        self.asked[at] = self.round
        out = [c.take(pa.array(at)) for c in self.columns[1:]]
        if len(self.asked) > self.most:
            latest = np.sort(np.argsort(self.asked, kind="stable")[-(self.most // 2) :])
            self.columns, self.asked = [c.take(pa.array(latest)) for c in self.columns], self.asked[latest]
        if sum(c.nbytes for c in self.columns) > BYTES_KEPT:
            self.forget()
        return out


def stems(parts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """What is before a closer that follows letters alone, or the whole part; that closer or nothing; whether the former is letters alone.

    Arrow's letters are some of the pattern's.
    """
    before, at_end = pc.utf8_slice_codeunits(parts, 0, -1), [pc.ends_with(parts, c) for c in CLOSERS]
    closed = pc.and_(pc.utf8_is_alpha(before), pc.or_(*at_end))
    closer = pc.if_else(closed, pc.if_else(at_end[0], *CLOSERS), "")
    return pc.if_else(closed, before, parts), closer, pc.or_(closed, pc.utf8_is_alpha(parts))


def odd(parts: pa.Array) -> pa.Array:
    """Whether parts are empty or have white space at an end."""
    return pc.or_(pc.equal(parts, ""), pc.not_equal(parts, pc.utf8_trim_whitespace(parts)))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: No rank.
NONE = 2**31 - 1
#: Contracts the leftmost pair of the lowest rank of each word. ids begin with -1, which has no pair.
CONTRACT = f"""
WITH RECURSIVE s(wid, ids, ranks, best) AS (
  SELECT wid, ids, ranks, list_min(ranks) FROM begin
  UNION ALL
  SELECT wid, ids, ranks, list_min(ranks) FROM (
    SELECT c.wid, list_concat(c.ids[:c.i - 1], [c.best], c.ids[c.i + 2:]) AS ids,
      list_concat(c.ranks[:c.i - 2], [coalesce(l.rank, {NONE}), coalesce(g.rank, {NONE})], c.ranks[c.i + 2:]) AS ranks
    FROM (SELECT *, list_position(ranks, best) AS i FROM s WHERE best < {NONE}) c
    LEFT JOIN merges l ON l.a = c.ids[c.i - 1] AND l.b = c.best
    LEFT JOIN merges g ON g.a = c.best AND g.b = c.ids[c.i + 2])),
done AS MATERIALIZED (SELECT wid, ids[2:] AS ids FROM s WHERE best = {NONE})
SELECT done.wid AS wid, done.ids AS ids, d.back AS back
FROM done JOIN (
  SELECT t.wid, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS back
  FROM (SELECT wid, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM done) t JOIN vocabulary v ON v.id = t.id GROUP BY t.wid) d ON d.wid = done.wid
"""


class Encoder:
    """Words to ids and back, in a DuckDB of its own; keeps the words it has met, within a bound."""

    def __init__(self, path: str) -> None:
        ranks = load_ranks(path)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
        # In memory alone: words are dealt out so that a query stays far below the limit, and nothing is spilled to the worker's folder.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        self.put("merges", pa.table({"a": a, "b": b, "rank": r}))
        self.put("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.byte_id = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
        self.byte_pair = np.array([ranks.get(bytes([x, y]), NONE) for x in range(256) for y in range(256)], np.int32).reshape(256, 256)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.words = Kept(self.encode, STRINGS_KEPT)
        self.parts = Kept(self.between_spaces, STRINGS_KEPT)

    def put(self, name: str, t: pa.Table) -> None:
        self.db.register("given", t)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode(self, words: pa.Array) -> list[pa.Array]:
        """For each word its ids in decimal, joined by a space, and the bytes decoded from them."""
        words = words.cast(pa.binary())
        order = np.argsort(pc.binary_length(words).to_numpy(), kind="stable")
        words = words.take(pa.array(order))
        short = int(pc.sum(pc.less_equal(pc.binary_length(words), LONG), min_count=0).as_py())
        made = self.whole(words[:short])
        if short < len(words):
            long = [self.stitched(r) for r in words[short:].to_pylist()]
            made = [pa.concat_arrays([m, pa.array([x[k] for x in long], pa.binary())]) for k, m in enumerate(made)]
        back = pa.array(np.argsort(order))
        return [m.take(back) for m in made]

    def spelled(self, words: list[tuple[str, ...]]) -> list[pa.Array]:
        """As encode(), for sequences of words."""
        return self.joined(pa.array(list(chain.from_iterable(words)), pa.string()), np.cumsum([0, *map(len, words)]))

    def joined(self, words: pa.Array, offsets: np.ndarray) -> list[pa.Array]:
        coded, offsets = words.dictionary_encode(), pa.array(offsets, pa.int32())
        return [pc.binary_join(pa.ListArray.from_arrays(offsets, made.take(coded.indices)), glue) for made, glue in zip(self.words.of(coded.dictionary), GLUE, strict=True)]

    def between_spaces(self, parts: pa.Array) -> list[pa.Array]:
        """As encode(), for parts with a space before them or none; and whether they are else empty or have white space at an end."""
        bare = pc.if_else(pc.starts_with(parts, " "), pc.utf8_slice_codeunits(parts, 1), parts)
        _, closer, letters = stems(bare)
        closed, letters = pc.not_equal(closer, "").to_numpy(zero_copy_only=False), letters.to_numpy(zero_copy_only=False)
        # Letters are one word, and with a closer two.
        rest = [split(p) for p in parts.filter(pa.array(~letters)).to_pylist()]
        n = 1 + closed.astype(np.int64)
        n[~letters] = list(map(len, rest))
        offsets = np.concatenate([[0], np.cumsum(n)])
        words, at, of = pa.concat_arrays([parts, pc.utf8_slice_codeunits(parts, 0, -1), closer, pa.array(list(chain.from_iterable(rest)), pa.string())]), np.empty(offsets[-1], np.int64), np.arange(len(parts))
        at[offsets[:-1][letters]] = (of + len(parts) * closed)[letters]
        at[offsets[:-1][closed] + 1] = of[closed] + 2 * len(parts)
        at[np.repeat(~letters, n)] = 3 * len(parts) + np.arange(n[~letters].sum())
        return [*self.joined(words.take(pa.array(at)), offsets), odd(bare)]

    def whole(self, words: pa.Array) -> list[pa.Array]:
        """As encode(), for words in order of length, each by the query alone."""
        ends = np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)
        out, at = [[pa.array([], pa.binary())] for _ in range(2)], 0
        while at < len(words):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 8 * WORDS_AT_ONCE, "right"))
            to = min(max(to, at + 1), at + WORDS_AT_ONCE, len(words))
            for o, made in zip(out, self.run(words[at:to]), strict=True):
                o.append(made)
            at = to
        return [pa.concat_arrays(o) for o in out]

    def stitched(self, raw: bytes, block: int = LONG) -> tuple[bytes, bytes]:
        """A long word from overlapping blocks, each contracted like a word, joined at tokens that two neighbours share.

        A sequence of tokens is the encoding of its bytes if each two neighbours are the encoding of theirs: a merge over a
        boundary would need a pair that is merged before one of the two is complete, and such a pair shows in those two alone.
        Neighbours within a block's encoding pass, and at a token that both blocks have at the same place, the left neighbour
        is from one block and the right one from the other. Blocks without such a token (periodic text) are doubled.
        """
        begins = range(0, max(1, len(raw) - block // 2), block // 2)
        blocks = sorted({raw[b : b + block] for b in begins}, key=len)
        coded = dict(zip(blocks, zip(*(m.to_pylist() for m in self.whole(pa.array(blocks, pa.binary()))), strict=True), strict=True))
        ids: list[int] = []
        ends: list[int] = []
        back: list[bytes] = []
        for b in begins:
            i, decoded = coded[raw[b : b + block]]
            new = list(map(int, i.split()))
            to = (b + np.cumsum(self.size[new])).tolist()
            first = bisect.bisect_right(ends, b)
            shared = {pair: first + k for k, pair in enumerate(zip(ends[first:], ids[first:], strict=True))}
            k = next((k for k, pair in enumerate(zip(to, new, strict=True)) if k and pair in shared), None) if b else -1
            if k is None:
                return self.stitched(raw, 2 * block) if block < len(raw) else tuple(m[0].as_py() for m in self.whole(pa.array([raw], pa.binary())))
            if b:
                keep = shared[to[k], new[k]] + 1
                back[-1] = back[-1][: len(back[-1]) - (ends[-1] - to[k])]
                del ids[keep:], ends[keep:]
            back.append(decoded[to[k] - b if b else 0 :])
            ids += new[k + 1 :]
            ends += to[k + 1 :]
        return " ".join(map(str, ids)).encode(), b"".join(back)

    def run(self, words: pa.Array) -> list[pa.Array]:
        n = pc.binary_length(words).to_numpy().astype(np.int64)
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"")[0].as_buffer(), np.uint8)
        at = np.arange(len(data)) + np.repeat(np.arange(1, len(n) + 1), n)
        ids, ranks = np.full(len(data) + len(n), -1, np.int32), np.full(len(data) + len(n), NONE, np.int32)
        ids[at] = self.byte_id[data]
        ranks[at[:-1]] = self.byte_pair[data[:-1], data[1:]]
        ranks[at[np.cumsum(n) - 1]] = NONE
        offsets = pa.array(np.concatenate([[0], np.cumsum(n + 1)]), pa.int32())
        self.put("begin", pa.table({"wid": np.arange(len(n), dtype=np.int32), **{c: pa.ListArray.from_arrays(offsets, pa.array(x)) for c, x in (("ids", ids), ("ranks", ranks))}}))
        got = self.db.sql(CONTRACT).to_arrow_table().sort_by("wid").combine_chunks()
        lists, back = (got[c].chunk(0) for c in ("ids", "back"))
        return [pc.binary_join(pa.ListArray.from_arrays(lists.offsets, lists.values.cast(pa.string())), " ").cast(pa.binary()), back.cast(pa.binary())]

    def texts(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """For each text its ids in decimal, joined by a space, and the bytes decoded from them (binary arrays).

        A word never goes on over a space that follows another character than white space, so that a text in which no space has
        other white space beside it is the sequence of its parts between spaces, each with the space before it: distinct parts are
        split into words once. Other texts are split as a whole.
        """
        parts = pc.split_pattern(texts.fill_null(""), " ")
        coded, starts = parts.flatten().dictionary_encode(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        # All parts with their space, and each text's first one without.
        firsts = parts.flatten().take(pa.array(starts[:-1])).dictionary_encode()
        *made, apart = self.parts.of(pa.concat_arrays([pc.binary_join_element_wise(" ", coded.dictionary, ""), firsts.dictionary]))
        apart = apart.to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
        whole = np.logical_or.reduceat(apart, starts[:-1]) & (np.diff(starts) > 1) if len(texts) else apart
        index, use = coded.indices.to_numpy().copy(), np.ones(starts[-1], bool)
        index[starts[:-1]] = len(coded.dictionary) + firsts.indices.to_numpy()
        for k, at in enumerate(np.flatnonzero(whole)):
            index[starts[at]] = len(made[0]) + k
            use[starts[at] + 1 : starts[at + 1]] = False
        others = self.spelled([tuple(split(texts[k].as_py())) for k in np.flatnonzero(whole)])
        offsets, index = pa.array(np.concatenate([[0], np.cumsum(use)])[starts], pa.int32()), pa.array(index[use])
        out = [pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays(m).take(index)), glue) for *m, glue in zip(made, others, GLUE, strict=True)]
        return out[0], out[1]


@worker_kept
def encoder(path: str) -> Encoder:
    """The worker's Encoder: Spark's Python workers go on to further tasks, and then know the usual words."""
    return Encoder(path)


def encoded(docs: DataFrame, schema: str, columns: Callable[[pa.RecordBatch, pa.Array, pa.Array], list], path: str | None = None) -> DataFrame:
    """docs through the worker's Encoder; columns(batch, ids, decoded bytes) gives the arrays of `schema`."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, enc = [c.split()[0] for c in schema.split(", ")], encoder(path)
        for part in sliced(batches, ROWS_AT_ONCE, CHARS_AT_ONCE):
            yield pa.RecordBatch.from_arrays(columns(part, *enc.texts(part.column("text"))), names)

    return docs.mapInArrow(lambda it: giving_back(run(it), encoder), schema)


def sliced(batches: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches (with a column text) in runs of at most so many rows and, unless it is one row, bytes of text."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = min(max(to, at + 1), at + rows, b.num_rows)
            yield b.slice(at, to - at)
            at = to


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (of the decoded bytes).

    Null and empty texts have no tokens. Every row gives a row, repeats included; extra columns are ignored.
    """

    def columns(b: pa.RecordBatch, ids: pa.Array, back: pa.Array) -> list:
        n = [x.count(b" ") + bool(x) for x in ids.to_pylist()]
        sha = [pa.array([hashlib.sha256(x).hexdigest() for x in a.to_pylist()], pa.string()) for a in (ids, back)]
        return [b.column("doc_id"), pa.array(n, pa.int64()), *sha]

    return encoded(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns, path)


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, ids array<int>, decoded binary: the encoding itself."""

    def columns(b: pa.RecordBatch, ids: pa.Array, back: pa.Array) -> list:
        return [b.column("doc_id"), pa.array([list(map(int, i.split())) for i in ids.to_pylist()], pa.list_(pa.int32())), back]

    return encoded(docs.select("doc_id", "text"), "doc_id long, ids array<int>, decoded binary", columns, path)
