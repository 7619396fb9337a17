"""Language-model scores by logistic context mixing of bit predictors, and an add-one unigram baseline.

A text is a sequence of bytes (A-Z lower-cased) and an end symbol. Each symbol is written in the bits of a prefix code
that depends on the symbol before it. For every bit, predictors look up how often it was 1 in their context; their
log odds are combined by weights that a gate selects from how sure the predictors are, plus a part that is
refined online from block to block of the text. All pairs of a context and its next symbol are counted over all training
texts: chunks of texts send their distinct pairs, dealt by context, and get back the log odds along each pair's bits. A
text's own refinement starts anew, so that its score doesn't depend on its neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseam.llm.common import give_back, written

END = 256
SYMBOLS = 257
#: Slots of a predictor's table where one is kept in memory (tally(), contexts()): 2^SLOT_BITS. scored() keeps every context.
SLOT_BITS = 21
PREDICTORS = 3
#: A predictor's log odds count as surer beyond each of its cuts; a gate is a combination.
CUTS = ((0.7, 2.5), (1.5,), (0.5, 1.2, 2.5, 4.5))
GATES = 30
#: Bytes of text between two refinements of a text's weights, and the step.
BLOCK, RATE = 512, 0.02
#: Of so many training texts one, by the hash of doc_id, is what the weights are fitted to, with the counts of the others only.
TUNING_TEXTS = 16
CHUNK_BYTES = 6_000_000
#: Bytes of text whose pairs of one predictor meet in one task.
BUCKET_BYTES = 16_000_000
PIECE = 1 << 18
#: Characters whose pairs' keys are made at once: few, so that the steps between stay in the processor's caches.
KEYS_AT_ONCE = 100_000
#: Texts whose blocks are scored at once.
TEXTS_AT_ONCE = 120
#: Log odds are kept in steps of 1 / STEPS, within a signed byte.
STEPS = 16


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols, each text with its end, and the number of symbols of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    n = np.array([len(r) + 1 for r in raw], np.int64)
    s = np.frombuffer(b"".join([r + b"\xff" for r in raw]), np.uint8).astype(np.uint16)
    s[np.cumsum(n) - 1] = END
    return s, n


def befores(s: np.ndarray) -> np.ndarray:
    return np.concatenate([[END], s[:-1]]).astype(np.uint16)[: len(s)]


def prefix_code(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code (with a leading one) and length for each pair of a symbol and the one before: Huffman codes of their counts."""
    code, size = np.zeros(SYMBOLS * SYMBOLS, np.uint32), np.zeros(SYMBOLS * SYMBOLS, np.uint8)
    counts = pairs.reshape(SYMBOLS, SYMBOLS).astype(float)
    usual = counts.sum(0) + 1
    for before in range(SYMBOLS):
        weight = counts[before] + usual / usual.sum() * max(1.0, 1e-4 * counts[before].sum()) + 1e-6 * max(1.0, counts[before].sum())
        heap: list = [(w, k, k) for k, w in enumerate(weight)]
        heapq.heapify(heap)
        nth = SYMBOLS
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], nth, (a[2], b[2])))
            nth += 1
        todo = [(heap[0][2], 1, 0)]
        while todo:
            node, bits, depth = todo.pop()
            if isinstance(node, tuple):
                todo += [(node[0], bits << 1, depth + 1), (node[1], bits << 1 | 1, depth + 1)]
            else:
                code[before * SYMBOLS + node], size[before * SYMBOLS + node] = bits, depth
    return code, size


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    if len(_POWERS[0]) < n:
        for k, b in enumerate((base, pow(base, -1, 2**64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)]))
    return [p[:n] for p in _POWERS]


def contexts(s: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """For each symbol a 32-bit hash of each predictor's context: four symbols, five symbols, the word so far."""
    wide = np.concatenate([np.zeros(5, np.uint32), s.astype(np.uint32) + np.uint32(1)])
    starts = np.cumsum(n) - n

    def back(k: int) -> np.ndarray:
        v = wide[5 - k : len(wide) - k].copy()
        for j in range(k):
            v[starts[n > j] + j] = 0
        return v

    three = (back(1) * np.uint32(0x9E3779B1)) ^ (back(2) * np.uint32(0x85EBCA77)) ^ (back(3) * np.uint32(0xC2B2AE3D))
    four = (three * np.uint32(0x27D4EB2F)) ^ (back(4) * np.uint32(0x165667B1))
    five = (four * np.uint32(0x2545F491)) ^ (back(5) * np.uint32(0xD3A2646D)) ^ np.uint32(0x5BD1E995)
    # The word so far: differences of a running polynomial, from the last white space on.
    power, shrink = _powers(len(s) + 1)
    run = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(wide[5:] * power[:-1], out=run[1:])
    begins = np.concatenate([[0], np.flatnonzero((s == 32) | ((s >= 9) & (s <= 13)) | (s == END)) + 1])
    begins = begins[begins < len(s)]
    long = np.diff(np.append(begins, len(s)))
    word = (run[:-1] - np.repeat(run[begins], long)) * np.repeat(shrink[begins], long)
    word *= np.uint64(0xC4CEB9FE1A85EC53)
    return [four, five, (word >> np.uint64(32)).astype(np.uint32)]


def pair_keys(s: np.ndarray, n: np.ndarray, taught: np.ndarray) -> list[np.ndarray]:
    """For each predictor a key of each symbol: 45 bits of the context, 9 of the symbol before, 9 of the symbol, 1 if taught.

    Contexts of four and five symbols are kept whole, that of the word so far as a hash.
    """
    wide = np.concatenate([np.zeros(5, np.uint64), s.astype(np.uint64) + np.uint64(1)])
    starts = np.cumsum(n) - n
    back = []
    for k in range(2, 6):
        back.append(wide[5 - k : len(wide) - k].copy())
        for j in range(k):
            back[-1][starts[n > j] + j] = 0
    four = back[0] | back[1] << np.uint64(9) | back[2] << np.uint64(18)
    power, shrink = _powers(len(s) + 1)
    run = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(wide[5:] * power[:-1], out=run[1:])
    begins = np.concatenate([[0], np.flatnonzero((s == 32) | ((s >= 9) & (s <= 13)) | (s == END)) + 1])
    begins = begins[begins < len(s)]
    long = np.diff(np.append(begins, len(s)))
    word = (run[:-1] - np.repeat(run[begins], long)) * np.repeat(shrink[begins], long)
    word ^= word >> np.uint64(32)
    before = befores(s).astype(np.uint64)
    before[starts] = END
    low = before << np.uint64(10) | s.astype(np.uint64) << np.uint64(1) | taught
    # An odd factor modulo 2^45 keeps different contexts apart and evens out the buckets.
    return [(c * np.uint64(0x9E3779B97F4A7C15)) << np.uint64(19) | low for c in (four, four | back[3] << np.uint64(27), word)]


def pairs_of(u: np.ndarray) -> np.ndarray:
    """Place in the prefix code's tables of pair keys without their last bit."""
    return ((u >> np.uint64(9)) & np.uint64(511)).astype(np.int64) * SYMBOLS + (u & np.uint64(511)).astype(np.int64)


def _all_keys(texts: pa.Array, learns: pa.Array) -> list[np.ndarray]:
    """pair_keys() of many texts, piece by piece."""
    got: list[list[np.ndarray]] = [[] for _ in range(PREDICTORS)]
    learn, at = np.array(learns.to_pylist(), np.uint64), 0
    for some in _groups(texts, KEYS_AT_ONCE):
        s, n = symbols(some)
        for c, key in zip(got, pair_keys(s, n, np.repeat(learn[at : at + len(some)], n)), strict=True):
            c.append(key)
        at += len(some)
    return [np.concatenate(c) for c in got]


def places(keys: list[np.ndarray], size: np.ndarray) -> list[np.ndarray]:
    """For each predictor and symbol, where in the chunk's table of its distinct pairs, in order, the symbol's bits begin."""
    out = []
    for k in range(PREDICTORS):
        key, keys[k] = keys[k] >> np.uint64(1), None
        met = pa.array(key).dictionary_encode()
        u = met.dictionary.to_numpy()
        order = np.argsort(u)
        ends = np.cumsum(size[pairs_of(u[order])], dtype=np.int64)
        begins = np.empty(len(u), np.int64 if ends[-1] >> 31 else np.int32)
        begins[order] = np.concatenate([[0], ends[:-1]])
        out.append(begins.take(met.indices.to_numpy()))
    return out


class Spelled:
    """A chunk's words, each with the white space or end after it: the distinct ones, and each occurrence's place, end and number."""

    def __init__(self, s: np.ndarray, n: np.ndarray) -> None:
        # A byte that UTF-8 doesn't have stands for a text's end.
        data = s.astype(np.uint8)
        data[np.cumsum(n) - 1] = 255
        self.ends = np.flatnonzero((data == 32) | (data - np.uint8(9) < 5) | (data == 255)) + 1
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.last = data[self.ends - 1] == 255
        words = pa.Array.from_buffers(pa.binary(), len(self.ends), [None, pa.py_buffer(np.append(self.begins, len(s)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        self.number, self.words = words.indices.to_numpy(), words.dictionary


def windows(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each symbol the last six of its text up to it, the latest lowest, in nine bits each; 0 for what is before the text."""
    out = np.empty(len(s), np.uint64)
    for a in range(0, len(s), KEYS_AT_ONCE):
        one = s[max(a - 5, 0) : a + KEYS_AT_ONCE].astype(np.uint64) + np.uint64(1)
        two = one.copy()
        two[1:] |= one[:-1] << np.uint64(9)
        six = two.copy()
        six[2:] |= two[:-2] << np.uint64(18)
        six[4:] |= two[:-4] << np.uint64(36)
        out[a : a + KEYS_AT_ONCE] = six[min(a, 5) :]
    starts = np.cumsum(n) - n
    for j in range(5):
        out[starts[n > j] + j] &= np.uint64((1 << 9 * (j + 1)) - 1)
    return out


def window_keys(w: np.ndarray) -> list[np.ndarray]:
    """The keys of windows for the predictors of four and five symbols."""
    before = (w >> np.uint64(9)) & np.uint64(511)
    before = np.where(before == 0, np.uint64(END), before - np.uint64(1))
    return [_key((w >> np.uint64(18)) & np.uint64((1 << bits) - 1), before, (w & np.uint64(511)) - np.uint64(1)) for bits in (27, 36)]


class WordKeys:
    """Keys for the predictor of the word so far: those of the distinct words' symbols, then those of words' first symbols.

    What is before a word differs by occurrence: `first` is each occurrence's first pair, `firsts` the distinct ones in the keys' order.
    """

    def __init__(self, s: np.ndarray, spelled: Spelled) -> None:
        begins, number = spelled.begins, spelled.number
        self.offsets = offsets = np.frombuffer(spelled.words.buffers()[1], np.int32)[: len(spelled.words) + 1].astype(np.int64)
        own = np.frombuffer(spelled.words.buffers()[2], np.uint8)[: offsets[-1]].astype(np.uint16)
        own[own == 255] = END
        before, some = s[begins - 1], np.empty(len(offsets) - 1, np.uint16)
        some[number] = before
        keys, a = [], 0
        while a < len(offsets) - 1:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + KEYS_AT_ONCE, "right")) - 1)
            part, begin = own[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            last = befores(part)
            last[begin[:-1]] = some[a:b]
            power, shrink = _powers(len(part) + 1)
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:-1], out=run[1:])
            long = np.diff(begin)
            word = (run[:-1] - np.repeat(run[begin[:-1]], long)) * np.repeat(shrink[begin[:-1]], long)
            word ^= word >> np.uint64(32)
            keys.append(_key(word, last, part))
            a = b
        self.first = before.astype(np.int64) * SYMBOLS + s[begins]
        self.firsts = np.flatnonzero(np.bincount(self.first, minlength=SYMBOLS * SYMBOLS))
        keys.append(_key(np.zeros(len(self.firsts), np.uint64), self.firsts // SYMBOLS, self.firsts % SYMBOLS))
        self.keys = np.concatenate(keys)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(counts[order], begin).astype(np.uint32)


def counted_pairs(s: np.ndarray, n: np.ndarray, spelled: Spelled, learns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each predictor the keys (as of pair_keys(), without the last bit) of all texts' distinct pairs, in order, and how often training texts hold them.

    Contexts of four symbols are counted by those of five, and words' by distinct words.
    """
    w = windows(s, n)
    w <<= np.uint64(1)
    w |= np.repeat(learns.astype(np.uint64), n)
    w.sort()
    taught = (w & np.uint64(1)).astype(np.uint32)
    w >>= np.uint64(1)
    begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    w, counts = w[begin], np.add.reduceat(taught, begin, dtype=np.int64)
    out = [_sums(k, counts) for k in window_keys(w)]
    k, learn = WordKeys(s, spelled), np.repeat(learns, np.diff(np.flatnonzero(spelled.last) + 1, prepend=0))
    each = np.repeat(np.bincount(spelled.number[learn], minlength=len(spelled.words)), np.diff(k.offsets))
    each[k.offsets[:-1]] = 0
    firsts = np.bincount(k.first[learn], minlength=SYMBOLS * SYMBOLS)[k.firsts]
    return [*out, _sums(k.keys, np.concatenate([each, firsts]))]


def placed(s: np.ndarray, n: np.ndarray, spelled: Spelled, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each predictor what places() gives, and the keys of its pairs in order."""
    met = pa.array(windows(s, n)).dictionary_encode()
    of = met.indices.to_numpy()
    four, five = window_keys(met.dictionary.to_numpy())
    (begin4, u4), (begin5, u5) = _begins(four, size), _begins(five, size)
    k = WordKeys(s, spelled)
    begin, u = _begins(k.keys, size)
    at = np.repeat((k.offsets.take(spelled.number) - spelled.begins).astype(np.int32), spelled.ends - spelled.begins)
    at += np.arange(len(s), dtype=np.int32)
    word, of_first = begin.take(at), np.zeros(SYMBOLS * SYMBOLS, begin.dtype)
    of_first[k.firsts] = begin[k.offsets[-1] :]
    word[spelled.begins] = of_first.take(k.first)
    return [(begin4.take(of), u4), (begin5.take(of), u5), (word, u)]


def _begins(keys: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys' bits begin in a table of the distinct ones in order, and these keys."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    u = keys[new]
    ends = np.cumsum(size[pairs_of(u)], dtype=np.int64)
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64 if ends[-1] >> 31 else np.int32)
    begins = np.empty(len(keys), first.dtype)
    begins[order] = first.take(np.cumsum(new) - 1)
    return begins, u


def _key(context: np.ndarray, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A pair's key as pair_keys() has it, without the last bit."""
    return (context * np.uint64(0x9E3779B97F4A7C15) << np.uint64(19) | before.astype(np.uint64) << np.uint64(10) | symbol.astype(np.uint64) << np.uint64(1)) >> np.uint64(1)


def against(odds: np.ndarray, u: np.ndarray, code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The log odds along the bits of pairs (in order), turned into those of the other value than the bit's own."""
    pair = pairs_of(u)
    sizes = size[pair].astype(np.int64)
    left = (np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(odds))).astype(np.uint32)
    one = np.repeat(code[pair], sizes) >> left & np.uint32(1)
    return np.where(one.view(np.int32).astype(bool), -odds, odds)


def packed(a: np.ndarray) -> bytes:
    """A numpy array, sorted if of 64 bits, in fewer bytes: differences, their bytes place by place, compressed."""
    a = np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.uint64 else a
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T))


def unpacked(raw, kind: type) -> np.ndarray:
    a = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1).T
    a = np.ascontiguousarray(a).view(kind).ravel()
    return np.cumsum(a, dtype=np.uint64) if a.dtype == np.uint64 else a


class Bits:
    """The bits of a run of symbols: which symbol each belongs to, its value, and its slot for each predictor."""

    def __init__(self, s: np.ndarray, n: np.ndarray, code: np.ndarray, size: np.ndarray, found: list[np.ndarray] | None = None) -> None:
        pair = befores(s).astype(np.int64) * SYMBOLS + s
        starts = np.cumsum(n) - n
        pair[starts] = END * SYMBOLS + s[starts].astype(np.int64)
        self.code, self.size, self.found = code[pair], size[pair].astype(np.int64), found is not None
        self.contexts = contexts(s, n) if found is None else found
        self.ends = np.cumsum(self.size)

    def piece(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the symbols a to b: symbol numbers from a, bits, slots."""
        size = self.size[a:b]
        of = np.repeat(np.arange(b - a), size)
        left = (np.repeat(self.ends[a:b] - (self.ends[a] - self.size[a]), size) - 1 - np.arange(len(of))).astype(np.uint32)
        word = self.code[a:b][of]
        bit = (word >> left) & np.uint32(1) == 1
        if self.found:
            depth = (size[of] - 1 - left).astype(np.int32)
            return of, bit, [c[a:b][of] + depth for c in self.contexts]
        node = (word >> left >> np.uint32(1)) * np.uint32(0x9E3779B1)
        slots = []
        for c in self.contexts:
            h = c[a:b][of] + node
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            slots.append(h >> np.uint32(32 - SLOT_BITS))
        return of, bit, slots

    def pieces(self, bits: int = PIECE) -> Iterator[tuple[int, int]]:
        a = 0
        while a < len(self.size):
            b = int(np.searchsorted(self.ends, self.ends[a] - self.size[a] + bits, "right"))
            yield a, (b := min(max(b, a + 1), len(self.size)))
            a = b


def gate(x: list[np.ndarray]) -> np.ndarray:
    """Which weights: how sure each predictor is, by its CUTS."""
    g = np.zeros(len(x[0]), np.int8)
    for v, cuts in zip(x, CUTS, strict=True):
        u = np.abs(v)
        g *= len(cuts) + 1
        for c in cuts:
            g += (u > int(c * STEPS)).view(np.int8)
    return g.astype(np.intp)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def tally(c: np.ndarray, bits: Bits) -> None:
    """Adds the bits to the counts c[predictor, 2 * slot + value of the bit]."""
    for a, e in bits.pieces():
        _, bit, slots = bits.piece(a, e)
        for k, x in enumerate(slots):
            np.add.at(c[k], (x << np.uint32(1)) + bit, np.uint32(1))


def log_odds(c: np.ndarray) -> np.ndarray:
    """Log odds of a 1 for each slot, in steps, of counts as in tally()."""
    c = c.reshape(-1, 2)
    return np.clip(np.rint(STEPS * np.log((c[:, 1] + 0.15) / (c[:, 0] + 0.15))), -127, 127).astype(np.int8)


class Mixer:
    """Prefix code, predictors' log odds and the gated weights; scores texts."""

    def __init__(self, code: np.ndarray, size: np.ndarray, odds: list[np.ndarray]) -> None:
        self.code, self.size, self.odds = code, size, odds
        self.weights = np.full((GATES, PREDICTORS), 0.4, np.float32)

    def inputs(self, slots: list[np.ndarray]) -> list[np.ndarray]:
        """Each predictor's log odds, in steps."""
        return [o.take(k, mode="clip") for o, k in zip(self.odds, slots, strict=True)]

    def seen(self, b: Bits) -> tuple[np.ndarray, np.ndarray]:
        """The kinds of bits, each predictor's log odds and the bit's value in one number, and how many there are of each."""
        got, n = [], []
        for a, e in b.pieces():
            _, bit, slots = b.piece(a, e)
            kind = bit.astype(np.uint32)
            for x in self.inputs(slots):
                kind = kind << np.uint32(8) | x.view(np.uint8)
            for c, v in zip((got, n), np.unique(kind, return_counts=True), strict=True):
                c.append(v)
        kinds, of = np.unique(np.concatenate(got), return_inverse=True)
        return kinds, np.bincount(of, np.concatenate(n), len(kinds)).astype(np.int64)

    def sums(self, kinds: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each gate the sums of a Newton step over kinds of bits: second derivatives, slopes, bits."""
        x = [((kinds >> np.uint32(8 * (PREDICTORS - 1 - k))) & np.uint32(255)).astype(np.uint8).view(np.int8) for k in range(PREDICTORS)]
        g, v = gate(x), np.stack(x, 1) / STEPS
        p = sigmoid(np.clip((v * self.weights[g]).sum(1), -20, 20))
        terms = [v[:, i] * v[:, j] * (p * (1 - p) * n) for i in range(PREDICTORS) for j in range(PREDICTORS)]
        terms += [v[:, i] * ((p - (kinds >> np.uint32(8 * PREDICTORS))) * n) for i in range(PREDICTORS)] + [n]
        return np.stack([np.bincount(g, c, GATES) for c in terms], 1)

    def step(self, sums: np.ndarray) -> float:
        """One Newton step of each gate's weights; the largest change."""
        most = 0.0
        for k, c in enumerate(sums):
            if c[-1] < 50:
                continue
            w = self.weights[k].astype(float)
            step = np.linalg.solve(c[: PREDICTORS**2].reshape(PREDICTORS, PREDICTORS) + np.eye(PREDICTORS), c[PREDICTORS**2 : -1] + 0.1 * (w - 0.4))
            step = np.clip(step, -0.5, 0.5)
            self.weights[k] = w - step
            most = max(most, float(np.abs(step).max()))
        return most

    def log10(self, texts: list[str | None], found: list[np.ndarray] | None = None) -> np.ndarray:
        """The log10 probability of each text: its bits' log odds mixed, weights refined after each block.

        found: for each predictor and symbol where its bits begin in tables made by against().
        """
        s, n = symbols(texts)
        total = np.zeros(len(n))
        if not len(s):
            return total
        b, ends = Bits(s, n, self.code, self.size, found), np.cumsum(n)
        own = np.zeros((len(n), PREDICTORS), np.float32)
        for r in range(int(-(-n.max() // BLOCK))):
            live = np.flatnonzero(n > r * BLOCK)
            first, last = ends[live] - n[live] + r * BLOCK, np.minimum(ends[live], ends[live] - n[live] + (r + 1) * BLOCK)
            for part in np.array_split(np.arange(len(live)), max(1, len(live) // TEXTS_AT_ONCE)):
                self._block(b, live[part], first[part], last[part], own, total)
        return total / np.log(10)

    def _block(self, b: Bits, live: np.ndarray, first: np.ndarray, last: np.ndarray, own: np.ndarray, total: np.ndarray) -> None:
        sizes = b.ends[last - 1] - b.ends[first] + b.size[first]
        steps = self._against(b, first, last)
        g = gate(steps)
        g += np.repeat(np.arange(len(live)) * GATES, sizes)
        x = [v * np.float32(1 / STEPS) for v in steps]
        z = np.zeros(len(g), np.float32)
        for k in range(PREDICTORS):
            w = (self.weights[:, k] + own[live, k, None]).ravel().take(g)
            w *= x[k]
            z += w
        np.clip(z, -12, 12, out=z)
        e = np.exp(z, out=z)
        more = e + np.float32(1)
        e /= more
        starts = np.cumsum(sizes) - sizes
        total[live] -= np.add.reduceat(np.log(more, out=more), starts, dtype=float)
        for k in range(PREDICTORS):
            x[k] *= e
            own[live, k] -= RATE * np.add.reduceat(x[k], starts) / np.sqrt(sizes).astype(np.float32)
        np.clip(own, -0.5, 0.5, out=own)

    def _against(self, b: Bits, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Each predictor's log odds, in steps, of the other value than the bit's own, for the bits of runs of symbols."""
        if not b.found:
            _, bit, slots = b_gather(b, first, last)
            return [np.where(bit, -v, v) for v in self.inputs(slots)]
        at = _runs(first, last)
        size = b.size.take(at)
        ends = np.cumsum(size)
        ends -= size
        bits, out = np.arange(ends[-1] + size[-1]), []
        for o, c in zip(self.odds, b.contexts, strict=True):
            place = np.repeat(c.take(at) - ends, size)
            place += bits
            out.append(o.take(place))
        return out


def _runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of several runs, one after the other."""
    n = last - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def b_gather(b: Bits, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bits.piece() of several runs of symbols at once."""
    at = _runs(first, last)
    some = object.__new__(Bits)
    some.code, some.size, some.found, some.contexts = b.code[at], b.size[at], b.found, [c[at] for c in b.contexts]
    some.ends = np.cumsum(some.size)
    return some.piece(0, len(at))


def learns(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def _groups(col: pa.Array, most: int = 2_000_000) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in col.to_pylist():
        held.append(t)
        size += len(t or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def fit_code(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix code of all training rows of docs (doc_id, text), of `total` bytes."""
    rows = docs.where(learns(F.col("doc_id")))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, total >> 29)

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for b in batches:
            for some in _groups(b.column("text")):
                s, _ = symbols(some)
                c += np.bincount(befores(s).astype(np.int64) * SYMBOLS + s, minlength=len(c))
        k = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c[k])], ["pair", "n"])

    pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    got = rows.select("text").coalesce(tasks).mapInArrow(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs[got["pair"].to_numpy()] = got["n"].to_numpy()
    return prefix_code(pairs)


def strings(a: pa.BinaryArray) -> list[bytes]:
    """As to_pylist(), which makes a scalar of each: cut out of the array's bytes."""
    at = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].tolist()
    data = (a.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [data[b:e] for b, e in zip(at, at[1:])]


class Words:
    """A chunk's distinct tokens by bucket, in order, and where each bucket begins (and the last ends).

    place, n: for all texts' tokens, one text after the other, their places among the distinct ones, and each text's number of tokens.
    """

    def __init__(self, texts: list[str | None], buckets: int, spelled: Spelled | None = None) -> None:
        spelled = spelled or Spelled(*symbols(texts))
        # The last of the strings is the end.
        met = pa.concat_arrays([pc.binary_slice(spelled.words, 0, -1), pa.array([b""], pa.binary())]).dictionary_encode()
        of, long = met.indices.to_numpy(), spelled.ends - spelled.begins
        counts = np.stack([long > 1, spelled.last], 1)
        self.n = np.diff((np.cumsum(counts[:, 0]) + np.cumsum(counts[:, 1]))[spelled.last], prepend=0)
        place = np.stack([of.take(spelled.number), np.full(len(long), of[-1])], 1)[counts]
        bucket = np.fromiter(map(xxhash.xxh64_intdigest, strings(met.dictionary)), np.uint64, len(met.dictionary)) % np.uint64(buckets)
        order = pc.sort_indices(met.dictionary).to_numpy()
        order = order[np.argsort(bucket[order], kind="stable")]
        self.sorted = met.dictionary.take(pa.array(order))
        self.cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        places_ = np.empty(len(order), np.int64)
        places_[order] = np.arange(len(order))
        self.place = places_.take(place)

    @property
    def words(self) -> list[bytes]:
        return self.sorted.to_pylist()

    def counts(self, learn: list[bool]) -> np.ndarray:
        """How often training texts hold each of the distinct tokens."""
        return np.bincount(self.place[np.repeat(np.array(learn, bool), self.n)], minlength=len(self.sorted)).astype(np.uint32)


def counted(t: pa.Table) -> pa.Table:
    """For chunks' tokens of one bucket the counts of all training texts, and a row with their sum and how many tokens have any."""
    press, compress = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    of = pa.array([w for x in t["keys"] for w in press.decompress(x.as_buffer()).split(b"\n")], pa.binary()).dictionary_encode()
    n = np.concatenate([unpacked(x.as_buffer(), np.uint32) for x in t["counts"]]).astype(np.int64)
    index = of.indices.to_numpy()
    total = np.zeros(len(of.dictionary), np.int64)
    np.add.at(total, index, n)
    sizes = [len(unpacked(x.as_buffer(), np.uint32)) for x in t["counts"]]
    found = [compress.compress(part.tobytes()) for part in np.split(total[index], np.cumsum(sizes)[:-1])]
    none = [None] * len(found)
    cols = [pa.array([*t["chunk"].to_pylist(), None], pa.int64()), pa.array([*t["id"].to_pylist(), None], pa.int64()), pa.array([*found, None], pa.binary()), pa.array([*none, None], pa.binary())]
    return pa.table([*cols, pa.array([*none, int(total.sum())], pa.int64()), pa.array([*none, int((total > 0).sum())], pa.int64())], ANSWERS)


ANSWERS = ["chunk", "id", "odds", "apart", "n", "v"]


def _nodes(u: np.ndarray, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For the bits of pairs (u, in order) the number of the context's node each is at: in order of code within contexts,
    pairs that pass the same node are neighbours at every depth."""
    context = np.cumsum(np.concatenate([[False], u[1:] >> np.uint64(9) != u[:-1] >> np.uint64(9)])).astype(np.uint64)
    # Codes as fractions, without their leading one.
    path = context << np.uint64(32) | (code.astype(np.uint64) << (np.uint64(32) - sizes.astype(np.uint64))) & np.uint64(2**32 - 1)
    of = np.argsort(path, kind="stable")
    path, size, first = path[of], sizes[of], (np.cumsum(sizes) - sizes)[of]
    out, depth, n = np.empty(int(sizes.sum()), np.int64), 0, 0
    while len(path):
        new = np.concatenate([[True], path[1:] >> np.uint64(32 - depth) != path[:-1] >> np.uint64(32 - depth)])
        node = np.cumsum(new)
        out[first + depth] = node + (n - 1)
        n += int(node[-1])
        depth += 1
        deeper = size > depth
        path, size, first = path[deeper], size[deeper], first[deeper]
    return out


def answered(t: pa.Table, code: np.ndarray, size: np.ndarray) -> pa.Table:
    """For chunks' pairs of one bucket (chunk, id, keys, counts) the log odds along their bits; for a tuning chunk also those
    without the counts of tuning chunks (apart). All pairs of a context are in one bucket."""
    keys = [unpacked(x.as_buffer(), np.uint64) for x in t["keys"]]
    chunk, n = t["chunk"].to_numpy(), np.array([len(k) for k in keys])
    counts = np.concatenate([unpacked(x.as_buffer(), np.uint32) for x in t["counts"]]).astype(np.int64)
    key = np.concatenate(keys)
    # Chunks' keys are in order, contexts nearly so: a stable sort merges such runs.
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    u, begin = key[order][new], np.flatnonzero(new)
    of_key = np.empty(len(key), np.int64)
    of_key[order] = np.cumsum(new) - 1
    pair = pairs_of(u)
    sizes = size[pair].astype(np.int64)
    ends = np.cumsum(sizes)
    # The nodes of a context's code that its pairs pass, and each pair's counts added at every one.
    of = np.repeat(np.arange(len(u)), sizes)
    left = (np.repeat(ends, sizes) - 1 - np.arange(len(of))).astype(np.uint32)
    node = _nodes(u, code[pair], sizes)
    value = 2 * node + (code[pair][of] >> left & np.uint32(1))

    def odds(c: np.ndarray) -> np.ndarray:
        c = np.add.reduceat(c[order], begin)
        return log_odds(np.bincount(value, c[of], 2 * int(node.max()) + 2))[node]

    tuning = chunk < 0
    every, some = odds(counts), odds(np.where(np.repeat(tuning, n), 0, counts)) if tuning.any() else None
    got, apart, at = [], [], 0
    for m, tune in zip(n, tuning, strict=True):
        k = of_key[at : at + m]
        at += m
        path = np.repeat(ends[k] - np.cumsum(sizes[k]), sizes[k]) + np.arange(sizes[k].sum())
        got.append(packed(every[path]))
        apart.append(packed(some[path]) if tune else None)
    give_back()
    none = pa.nulls(len(got), pa.int64())
    return pa.table([t["chunk"], t["id"], pa.array(got, pa.binary()), pa.array(apart, pa.binary()), none, none], ANSWERS)


def _tables(id_: pa.ChunkedArray, odds: pa.ChunkedArray, buckets: int) -> list[np.ndarray]:
    """Each predictor's table of a chunk from its buckets' answers."""
    ids, parts = id_.to_numpy(), odds.to_pylist()
    order = np.argsort(ids)
    return [np.concatenate([np.empty(0, np.int8), *(unpacked(parts[r], np.int8) for r in order if ids[r] // buckets == k)]) for k in range(PREDICTORS)]


def fit_weights(mixer: Mixer, met: DataFrame, rounds: int = 15) -> None:
    """Fits the weights of each gate to all bits of tuning texts (kinds, n), by Newton steps on sums that Spark adds up."""
    for _ in range(rounds):

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = np.zeros((GATES, PREDICTORS * (PREDICTORS + 1) + 1))
            for b in batches:
                for kinds, n in zip(b.column("kinds"), b.column("n"), strict=True):
                    c += mixer.sums(np.frombuffer(kinds.as_buffer(), np.uint32), np.frombuffer(n.as_buffer(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(c.size)), pa.array(c.ravel())], ["at", "v"])

        sums = np.zeros((GATES, PREDICTORS * (PREDICTORS + 1) + 1))
        got = met.mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        sums.ravel()[got["at"].to_numpy()] = got["v"].to_numpy()
        if mixer.step(sums) < 1e-3:
            break


def tokens(text: str | None) -> list[bytes]:
    """Words of the lower-cased text (ASCII white space separates them), and the end, which is the empty word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w.append(b"")
    return w


def scored(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; see fit_weights() and tokens().

    Null and empty texts have one token, the end. Rows without doc_id are learned from. Repeated rows count as often as
    they stand there. Texts are dealt into chunks by a hash, those that tune the weights into chunks of their own, below zero. A
    chunk's distinct tokens fetch their counts from the buckets, its distinct pairs their log odds.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    code, size = fit_code(docs, total)
    coded = spark.sparkContext.broadcast((code, size))
    chunks, tuning_chunks, buckets = 1 + total // CHUNK_BYTES, 1 + total // CHUNK_BYTES // TUNING_TEXTS, 1 + total // BUCKET_BYTES
    deal, tunes = F.xxhash64("doc_id", F.substring("text", 1, 200)), learns(F.col("doc_id")) & (F.pmod(F.xxhash64("doc_id"), F.lit(TUNING_TEXTS)) == 0)
    chunk = F.when(tunes, -1 - F.pmod(deal, F.lit(tuning_chunks))).otherwise(F.pmod(deal, F.lit(chunks)))
    dealt = docs.select("doc_id", "text", chunk.alias("chunk"), learns(F.col("doc_id")).alias("learns")).repartition("chunk")

    def pairs(t: pa.Table) -> pa.Table:
        """A chunk's distinct pairs and how often training texts hold them, by predictor and bucket (id)."""
        cols: tuple = ([], [], [])
        texts = t["text"].to_pylist()
        s, n_ = symbols(texts)
        spelled = Spelled(s, n_)
        for k, (u, c) in enumerate(counted_pairs(s, n_, spelled, t["learns"].to_numpy())):
            bucket = (u >> np.uint64(31)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(cuts)):
                for col, v in zip(cols, (k * buckets + int(b), packed(u[cuts[b] : cuts[b + 1]]), packed(c[cuts[b] : cuts[b + 1]])), strict=True):
                    col.append(v)
        w = Words(texts, buckets, spelled)
        cuts, n_ = w.cuts, w.counts(t["learns"].to_pylist())
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), w.sorted), b"\n")
        for b in np.flatnonzero(np.diff(cuts)):
            joined = zstandard.ZstdCompressor(level=1).compress(lines[b].as_buffer())
            for col, v in zip(cols, (PREDICTORS * buckets + int(b), joined, packed(n_[cuts[b] : cuts[b + 1]])), strict=True):
                col.append(v)
        give_back()
        return pa.table([pa.array([t["chunk"][0].as_py()] * len(cols[0]), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["chunk", "id", "keys", "counts"])

    asks = dealt.groupBy("chunk").applyInArrow(pairs, "chunk long, id long, keys binary, counts binary")
    reply = lambda t: counted(t) if t["id"][0].as_py() >= PREDICTORS * buckets else answered(t, *coded.value)
    answers = written(asks.groupBy("id").applyInArrow(reply, "chunk long, id long, odds binary, apart binary, n long, v long"))
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    answers = answers.where("chunk IS NOT NULL").drop("n", "v")

    def seen(docs_: pa.Table, given: pa.Table) -> pa.Table:
        texts = docs_["text"].combine_chunks()
        found, at = places(_all_keys(texts, docs_["learns"]), coded.value[1]), 0
        m, kinds, counts_ = Mixer(*coded.value, _tables(given["id"], given["apart"], buckets)), [], []
        for some in _groups(texts):
            s, n_ = symbols(some)
            k, c = m.seen(Bits(s, n_, *coded.value, [f[at : at + len(s)] for f in found]))
            at += len(s)
            kinds.append(k.tobytes())
            counts_.append(c.tobytes())
        del found, m
        give_back()
        return pa.table([pa.array(kinds, pa.binary()), pa.array(counts_, pa.binary())], ["kinds", "n"])

    fitted = Mixer(code, size, [])
    tuned = dealt.where("chunk < 0").groupBy("chunk").cogroup(answers.where(F.col("chunk") < 0).where(F.col("id") < PREDICTORS * buckets).groupBy("chunk")).applyInArrow(seen, "kinds binary, n binary")
    fit_weights(fitted, written(tuned))
    weights = fitted.weights

    def score(docs_: pa.Table, given: pa.Table) -> pa.Table:
        texts, learn = docs_["text"].to_pylist(), docs_["learns"].to_pylist()
        run = symbols(texts)
        spelled = Spelled(*run)
        table, press = given.filter(pc.greater_equal(given["id"], PREDICTORS * buckets)).sort_by("id"), zstandard.ZstdDecompressor()
        c = np.frombuffer(b"".join(press.decompress(x.as_buffer()) for x in table["odds"]), np.int64)
        w = Words(texts, buckets, spelled)
        counts_, away = w.n, np.log10(n + v + 1)
        known, base = [], []
        for got in np.split(np.log10(c + 1.0)[w.place], np.cumsum(counts_)[:-1]):
            known.append(int((got > 0).sum()))
            base.append(float(got.sum() - away * len(got)))
        del w
        final, at, found = [], 0, []
        m = Mixer(*coded.value, _tables(given["id"], given["odds"], buckets))
        m.weights = weights
        for k, (place, u) in enumerate(placed(*run, spelled, coded.value[1])):
            found.append(place)
            m.odds[k] = against(m.odds[k], u, *coded.value)
        del u, run, spelled
        for some in _groups(docs_["text"].combine_chunks()):
            long = int(symbols(some)[1].sum())
            final.append(m.log10(some, [f[at : at + long] for f in found]))
            at += long
        final = np.concatenate(final)
        del found, m, given
        give_back()
        cols = [docs_["doc_id"], pa.array([not x for x in learn]), pa.array(counts_, pa.int64()), pa.array(known, pa.int64()), pa.array([n] * len(texts), pa.int64()), pa.array(base), pa.array(final)]
        return pa.table(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.select("chunk", "id", "odds").groupBy("chunk")).applyInArrow(score, out)
