"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

A document's features are hashed n-grams of its words and of its words' shapes (runs of letters and of digits as one
sign each, other characters as they are, and how far back the same word stood last), each with its share of the text
as value, scaled.  The model is trained on a bounded sample of labelled rows in one task and sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import BASES, U64, Block, blocks, grams, mix
from .shared import lean, pieces

BUCKET_BITS = 18
#: At most so many labelled rows are used, those of least hash of doc_id; it does not grow with the input.
MAX_TRAIN = 8000
EPOCHS = 3
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 57, 97


def shape_hashes(b: Block) -> np.ndarray:
    """A hash of each word's shape: the signs of its characters, runs as one, and the distance to the same word before."""
    sign = _SHAPE[b.data]
    keep = np.ones(len(sign), bool)
    keep[1:] = sign[1:] != sign[:-1]
    keep[b.start] = True
    to = np.concatenate(([0], np.cumsum(keep)))
    small = Block.__new__(Block)
    small.data = sign[keep]
    h = b.word_hashes()
    text = np.repeat(np.arange(len(b)), b.counts)
    back = np.zeros(len(h), np.uint64)
    for k in range(32, 0, -1):
        same = (h[k:] == h[:-k]) & (text[k:] == text[:-k])
        back[k:][same] = 1 if k == 1 else 2 if k <= 8 else 3
    return mix(small.span_hashes(to[b.start], to[b.end]) + back * U64(BASES[1]))


def features(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of a block's features: by text, each bucket once."""
    words, shapes = b.word_hashes(lower=True), shape_hashes(b)
    text = np.repeat(np.arange(len(b)), b.counts)
    keys, owner = [], []
    for kind, (h, sizes) in enumerate(((words, (1, 2)), (shapes, (1, 2, 3)))):
        for n in sizes:
            if len(h) >= n:
                own = text[: len(h) - n + 1] == text[n - 1 :]
                keys.append((mix(grams(h, n) + U64(16 * kind + n)) >> U64(64 - BUCKET_BITS))[own])
                owner.append(text[: len(h) - n + 1][own])
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    code, count = np.unique((np.concatenate(owner) << BUCKET_BITS) | np.concatenate(keys).astype(np.int64), return_counts=True)
    at = code >> BUCKET_BITS
    return at, code & ((1 << BUCKET_BITS) - 1), np.sqrt(count / np.maximum(b.counts, 1)[at])


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with both penalties; the last coordinate is the constant."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def trained(rows: list[tuple[str | None, int]], epochs: int = EPOCHS) -> np.ndarray:
    size, data = 1 << BUCKET_BITS, []
    for a, z, b in blocks(pa.array([t for t, _ in rows], pa.large_string())):
        text, at, x = features(b)
        cut = np.searchsorted(text, np.arange(z - a + 1))
        data += [(np.append(at[cut[i] : cut[i + 1]], size), np.append(x[cut[i] : cut[i + 1]], 1.0), rows[a + i][1]) for i in range(z - a)]
    model, order = Ftrl(size), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            model.update(*data[i])
    return model.weights()


def held_out(doc_id: F.Column | str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def model_of(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, epochs: int = EPOCHS) -> np.ndarray:
    """The weights, at most 2**18 + 1, learnt from at most ``most`` labelled rows that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # ``most`` rows of two numbers: a bounded table.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # of rows that share a doc_id one text counts, that of least hash
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("quality").cast("int").alias("quality"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda r: (r[0], r[1] or ""))
        w = trained([(t, q) for _, t, q in got], epochs)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["at", "w"])

    out = np.zeros((1 << BUCKET_BITS) + 1)
    for r in lean(rows.repartition(1)).mapInArrow(fit, "at int, w double").toLocalIterator():
        out[r["at"]] = r["w"]
    return out


def scored(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A text without words, a null one too, has the constant's score; a very long one is read whole; of scores at the cut exactly the
    label is 1.  Without labels every score is 0.5.  Rows that repeat
    are rows of their own; a doc_id with two labels takes the lesser; a null doc_id is not held out and learns nothing;
    an empty table gives an empty one; other columns are not looked at."""
    weights = docs.sparkSession.sparkContext.broadcast(model_of(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for piece in pieces(batch, 1):
                for a, z, b in blocks(piece.column(1)):
                    text, at, x = features(b)
                    s = np.bincount(text, x * w[at], z - a) + w[-1]
                    yield pa.RecordBatch.from_arrays([piece.column(0).slice(a, z - a), pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], ["doc_id", "score"])

    found = lean(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
