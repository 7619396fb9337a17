"""Token ids in wavelet matrices: one compressed file per shard that answers access, counting and occurrence queries.

A shard is a run of documents in ascending doc_id order, cut where it has enough tokens. Its file is a Parquet file of
one row: the documents' ids and starts, and for each of the matrix's bit-planes the packed bits and the number of ones
before every block of 512 bits.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseam.llm.bpe import CLOSERS, Kept, odd, split, stems
from sparkseam.llm.common import n_parts, shared_dir

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Parts of texts whose ids a worker keeps from task to task, and texts looked up at once.
PARTS_KEPT, AT_ONCE = 900_000, 5000
#: Parts that are handed to the library as one list.
PARTS_AT_ONCE = 500
BITS = 16
BLOCK = 512
#: A shard is closed with the document that brings it to so many tokens.
SHARD_TOKENS = 2_000_000


class WaveletMatrix:
    """A sequence of numbers below 2^BITS as bit-planes, highest bit first, each stably sorted by the bits before."""

    def __init__(self, n: int, planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.planes = n, [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @staticmethod
    def parts(a: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The planes and rank blocks of the numbers a; the last rank is the number of all ones."""
        planes, ranks = [], []
        for level in range(BITS):
            one = (a & np.uint16(1 << (BITS - 1 - level))) != 0
            packed = np.packbits(one)
            counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.uint32) if len(packed) else np.empty(0, np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32).tobytes())
            a = np.concatenate([a.take(np.flatnonzero(~one)), a.take(np.flatnonzero(one))])
        return planes, ranks

    def ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        rest = plane[block * BLOCK // 8 : (i + 7) // 8]
        n = int(self.ranks[level][block]) + int(np.bitwise_count(rest).sum())
        return n - int(plane[i // 8] & (0xFF >> i % 8)).bit_count() if i % 8 else n

    def access(self, i: int) -> int:
        """The number at place i."""
        out = 0
        for level in range(BITS):
            bit = int(self.planes[level][i // 8]) >> (7 - i % 8) & 1
            out, k = out << 1 | bit, self.ones(level, i)
            i = self.zeros[level] + k if bit else i - k
        return out

    def rank(self, value: int, i: int) -> int:
        """How often the value stands among the first i numbers."""
        low = 0
        for level in range(BITS):
            a, b = self.ones(level, low), self.ones(level, i)
            low, i = (self.zeros[level] + a, self.zeros[level] + b) if value >> (BITS - 1 - level) & 1 else (low - a, i - b)
        return i - low

    def select(self, value: int, k: int) -> int:
        """Where the value stands for the k-th time, from 0; -1 if it doesn't."""
        if k < 0 or k >= self.rank(value, self.n):
            return -1
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.rank(value, mid + 1) <= k else (low, mid)
        return low

    def all(self) -> np.ndarray:
        """The whole sequence, rebuilt from the last plane to the first."""
        out = np.zeros(self.n, np.uint16)
        for level in reversed(range(BITS)):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~one)] = out[: self.zeros[level]]
            up[np.flatnonzero(one)] = out[self.zeros[level] :] | np.uint16(1 << (BITS - 1 - level))
            out = up
        return out


class Tokens:
    """Texts to ids with the tokenizers library; the parts of texts between spaces that were met before are looked up.

    A token never goes on over a space that follows another character than white space. So a text in which no space has
    other white space beside it is the sequence of its parts, each with the space before it. Other texts, and
    those with a special token, are encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.opens = np.array([(self.lib.id_to_token(i) or "").startswith("Ġ") for i in range(self.lib.get_vocab_size())])
        # The same library for words that are already apart.
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.closers = pa.array([b"", *self.encode(list(CLOSERS))], pa.binary())
        self.stems = Kept(lambda parts: [self.after_space(parts)], PARTS_KEPT)
        self.later = Kept(self.closed, PARTS_KEPT)

    def encode(self, strings: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(strings), 10_000):
            out += [array("H", e.ids).tobytes() for e in self.lib.encode_batch_fast(strings[at : at + 10_000], add_special_tokens=False)]
        return out

    def after_space(self, parts: pa.Array) -> pa.Array:
        """The ids of each part with a space before it; many parts' words go as one list, cut at the tokens that open with a space."""
        letters = pc.utf8_is_alpha(parts)
        order = pa.array(np.concatenate([np.flatnonzero(x) for x in (letters, pc.invert(letters))]))
        words: list[list[str]] = [[w] for w in pc.binary_join_element_wise(" ", parts.filter(letters), "").to_pylist()]
        words += [split(" " + p) for p in parts.filter(pc.invert(letters)).to_pylist()]
        runs = [words[at : at + PARTS_AT_ONCE] for at in range(0, len(words), PARTS_AT_ONCE)]
        out = [pa.array([], pa.binary())]
        for run, coded in zip(runs, self.words.encode_batch_fast([list(chain.from_iterable(r)) for r in runs], is_pretokenized=True, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, np.uint16)
            cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids)).astype(np.int32)
            if len(cuts) == len(run) + 1:
                out.append(pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(2 * cuts), pa.py_buffer(ids)]))
            else:  # parts that begin with white space of their own
                out.append(pa.array(self.encode(["".join(w) for w in run]), pa.binary()))
        return pa.concat_arrays(out).take(pc.sort_indices(order))

    def closed(self, parts: pa.Array) -> list[pa.Array]:
        """As after_space(), closers apart; and whether the parts are empty or have white space at an end."""
        stem, closer, _ = stems(parts)
        stem, end = stem.dictionary_encode(), pc.index_in(closer, value_set=pa.array(["", *CLOSERS]))
        ids = self.stems.of(stem.dictionary)[0].take(stem.indices)
        return [pc.binary_join_element_wise(ids, self.closers.take(end), b""), odd(parts)]

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The 16-bit ids of each text, END_ID last."""
        end = array("H", [END_ID]).tobytes()
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        ids, apart = self.later.of(coded.dictionary)
        apart, starts = apart.to_numpy(zero_copy_only=False)[coded.indices.to_numpy()], parts.offsets.to_numpy() - parts.offsets[0].as_py()
        whole = np.logical_or.reduceat(apart, starts[:-1]) & (np.diff(starts) > 1) if len(texts) else apart
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        laid = ids.take(coded.indices)
        data, at = laid.buffers()[2].to_pybytes() if laid.buffers()[2] else b"", np.frombuffer(laid.buffers()[1], np.int32)[laid.offset :]
        first = self.encode(parts.flatten().take(pa.array(starts[:-1])).to_pylist())
        for k, all_ in enumerate(whole):
            if all_:
                yield self.encode([texts[k].as_py()])[0] + end
            else:
                yield first[k] + data[at[starts[k] + 1] : at[starts[k + 1]]] + end


@functools.cache
def tokens_of(path: str) -> Tokens:
    """The worker's Tokens: Spark's Python workers go on to further tasks, and then know the usual words."""
    return Tokens(path)


FILE = "shard long, doc_ids array<bigint>, sizes array<bigint>, n long, planes array<binary>, ranks array<binary>"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encodes all texts and writes the shard files to path, in ascending doc_id order.

    Documents are dealt out by ranges of doc_id, so that shard numbers ascend with doc_id; null and empty texts have the
    end id only. Null doc_ids come first; rows that share a doc_id keep their own entries.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or public_tokenizers.path(TOKENIZER)
    docs = docs.select("doc_id", "text")
    parts = 4 * n_parts(spark)
    bounds = np.unique(np.array(docs.select("doc_id").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts), float))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                some = b.slice(at, AT_ONCE)
                doc = some.column("doc_id")
                part = np.searchsorted(bounds, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
                ids = pa.array(list(tokens.texts(some.column("text").fill_null(""))), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc, ids], ["part", "doc_id", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, total, docs_, sizes, held = None, 0, 0, [], [], []

        def shard() -> pa.RecordBatch:
            a = np.frombuffer(b"".join(held), np.uint16)
            planes, ranks = WaveletMatrix.parts(a)
            row = {"shard": (part << 32) + nth, "doc_ids": docs_, "sizes": sizes, "n": len(a), "planes": planes, "ranks": ranks}
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))]))

        for b in batches:
            for p, doc, ids in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if docs_ and (p != part or total >= SHARD_TOKENS):
                    yield shard()
                    nth, total, docs_, sizes, held = (nth + 1 if p == part else 0), 0, [], [], []
                part = p
                docs_.append(doc)
                sizes.append(len(ids) // 2)
                total += sizes[-1]
                held.append(ids)
        if docs_:
            yield shard()

    rows = docs.mapInArrow(encode, "part int, doc_id long, ids binary").repartition("part").sortWithinPartitions("part", "doc_id", "ids")
    rows.mapInArrow(build, FILE).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document of the shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILE).parquet(path)
    # One row per shard of SHARD_TOKENS tokens: a few numbers, ordered in one task.
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("shard", "n").select("shard", before.alias("before"))
    out = "shard long, doc_id long, at long, n_tokens long, ids_crc32 long"

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                ids = WaveletMatrix(r["n"], r["planes"], r["ranks"]).all()
                ends = np.cumsum(r["sizes"])
                at = ends - r["sizes"]
                wide = memoryview(ids.astype("<u4"))
                crc = [zlib.crc32(wide[s:e]) for s, e in zip(at.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(at)), pa.array(r["doc_ids"], pa.int64()), pa.array(at, pa.int64()), pa.array(r["sizes"], pa.int64()), pa.array(crc, pa.int64())], _names(out))

    docs = files.mapInArrow(crcs, out)
    return docs.join(starts, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark, path: str, token: int) -> DataFrame:
    """(doc_id, count) of the documents that hold the token, by rank queries on the shard files."""
    out = "doc_id long, count long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                m, ends = WaveletMatrix(r["n"], r["planes"], r["ranks"]), [0, *np.cumsum(r["sizes"]).tolist()]
                if m.rank(token, m.n):
                    n = np.diff([m.rank(token, e) for e in ends])
                    hit = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([r["doc_ids"][h] for h in hit], pa.int64()), pa.array(n[hit], pa.int64())], _names(out))

    return spark.read.schema(FILE).parquet(path).mapInArrow(count, out)


def stored(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs' ids to shard files in the shared folder and reads them back: see write() and read()."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
