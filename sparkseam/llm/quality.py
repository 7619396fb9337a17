"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Indicators of byte n-grams (and of repeated words) are scaled by the log ratio of their class frequencies; a linear
hinge-loss model is fitted to the scaled vectors by dual coordinate descent, and its margin is mapped to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseam.llm.common import giving_back

BITS = 18
ORDERS = (1, 2, 3, 4)
#: At most so many labelled rows are learned from, those of the lowest hash of doc_id; all rows are scored.
MOST_ROWS = 6000
#: predicted is 1 from this score on.
CUT = 0.3
SEED = 4
#: Repeats of the preceding word in a row, and in all, that have an indicator of their own.
RUNS = (1, 2, 4, 8)


def features(text: str | None) -> np.ndarray:
    """The distinct feature numbers of a whole text, below 2^BITS; none for an empty one."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.zeros(1 << BITS, bool)
    code = np.zeros(len(raw), np.uint32)
    for order in ORDERS:
        if len(raw) < order:
            break
        code = code[: len(raw) - order + 1] * np.uint32(257) + raw[order - 1 :] + np.uint32(order)
        seen[(code * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    words = (text or "").split()
    same = np.fromiter(map(eq, words, words[1:]), bool, max(0, len(words) - 1))
    if same.any():
        ends = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        longest = (ends[1::2] - ends[::2]).max()
        seen[[k for k, n in enumerate(RUNS) if longest >= n]] = True
        seen[[len(RUNS) + k for k, n in enumerate(RUNS) if same.sum() * 4 * n >= len(words)]] = True
    return np.flatnonzero(seen).astype(np.int32)


def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """For each feature the log of its smoothed share in good rows over that in bad ones."""
    p, q = (1.0 + np.bincount(np.concatenate([r for r, g in zip(rows, good, strict=True) if g == k] or [np.empty(0, np.int64)]).astype(np.int64), minlength=1 << BITS) for k in (True, False))
    return np.log(p / (good.sum() + 2)) - np.log(q / ((~good).sum() + 2))


def descend(rows: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, c: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of the linear hinge-loss model: dual coordinate descent over rows in random order.

    x has the values of each row's features, rows of unit length; c bounds each row's dual variable; the last weight
    is the constant's.
    """
    w, alpha, order = np.zeros((1 << BITS) + 1), np.zeros(len(rows)), np.random.default_rng(SEED)
    for _ in range(rounds):
        moved = 0.0
        for k in order.permutation(len(rows)):
            r, v = rows[k], x[k]
            g = y[k] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[k] - g / 2, 0.0), c[k])
            if (d := (new - alpha[k]) * y[k]) != 0:
                w[r] += d * v
                w[-1] += d
                alpha[k] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w


class Model:
    """Fitted weights; margin() of feature rows and the probability it stands for."""

    def __init__(self, rows: list[np.ndarray], good: np.ndarray) -> None:
        fit = np.arange(len(rows)) % 4 > 0
        self.scale = log_ratios([r for r, f in zip(rows, fit, strict=True) if f], good[fit])
        values = [self.values(r) for r in rows]
        y = np.where(good, 1.0, -1.0)
        pick = np.flatnonzero(fit)
        share = np.array([max(1, (good[fit] == g).sum()) for g in (False, True)])
        c = len(pick) / 2 / share[good[fit].astype(int)]
        self.w = descend([rows[k] for k in pick], [values[k] for k in pick], y[fit], c)
        rest = np.flatnonzero(~fit)
        self.a, self.b = sigmoid_fit(np.array([self.margin(rows[k]) for k in rest]), good[rest])

    def values(self, row: np.ndarray) -> np.ndarray:
        v = self.scale[row]
        return v / (np.sqrt(v @ v) or 1.0)

    def margin(self, row: np.ndarray) -> float:
        return float(self.w[row] @ self.values(row) + self.w[-1])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(features(text)) + self.b, -30, 30))))


def sigmoid_fit(m: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels: Newton steps with smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, ab = np.stack([m, np.ones(len(m))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ z, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))) @ z.T + 1e-6 * np.eye(2), z @ (p - t))
        ab = ab - step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(ab[0]), 0.1), float(ab[1])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model | None:
    """A model of the labelled rows that are not held out; None if they don't have both classes.

    Null labels and labels without a text row are left out; features are made where the texts are, and only those of
    the bounded sample come to the driver.
    """
    known = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    some = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_rows)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(f, pa.list_(pa.int32()))], ["doc_id", "quality", "f"])

    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(lambda it: giving_back(make(it)), "doc_id long, quality int, f array<int>").toArrow()
    order = np.lexsort([got["quality"].to_numpy(), got["doc_id"].to_numpy()])
    rows, col = [], got["f"].combine_chunks()
    flat, ends = col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
    rows = [flat[ends[k] : ends[k + 1]] for k in order]
    good = got["quality"].to_numpy()[order] == 1
    return Model(rows, good) if good.any() and not good.all() else None


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (probability of quality 1), predicted (score >= 0.3).

    Null and empty texts have no features and get the model's constant. Without labels of both classes the score is 0.5.
    Rows that repeat are scored alike; rows without doc_id are scored and not held out; extra columns are ignored.
    """
    model = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) if model else 0.5 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(lambda it: giving_back(score(it)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the model of labels predicts to be of quality 1; see scored()."""
    model = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model is None or model.score(t) >= CUT for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(lambda it: giving_back(keep(it)), docs.schema)
