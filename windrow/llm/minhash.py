"""One-permutation MinHash: one hash per shingle, bins, optimal densification, packed low-order bits.

The top bits of a shingle's hash name its bin, the rest is its value, and each bin keeps its least value.  An empty bin
takes over the value of the first filled bin among those that a fixed sequence of its own visits, so all bins count.
Of each value ``BITS`` low-order bits are kept; as different values agree in them by chance with probability
2**-BITS, likeness is corrected for that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, partitions, pieces
from .textblocks import BASES, U64, Block, blocks, grams, mix, whole

BINS, BITS, WIDTH = 256, 4, 5
#: Ranges of doc_id that each task works through.
PER_TASK = 8
_EMPTY = U64(2**64 - 1)


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each shingle of ``width`` words; a text of fewer words has one, of all of them."""
    h, n = block.word_hashes(), block.counts
    at, off = whole(block.first, width)
    text = np.repeat(np.arange(len(n)), np.diff(off))
    out = grams(h, width)[at]
    short = np.flatnonzero((n > 0) & (n < width))
    few = []
    for i in short.tolist():
        few.append(int(grams(h[block.first[i] : block.first[i + 1]], int(n[i]))[0]))
    return np.concatenate((out, np.array(few, U64))), np.concatenate((text, short))


def sketch(block: Block, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(low-order bits, n x bins; whether the text has a shingle) of a block's texts."""
    n, top = len(block), bins.bit_length() - 1
    h, text = shingles(block, width)
    least = np.full(n * bins, _EMPTY)
    np.minimum.at(least, text * bins + (h >> U64(64 - top)).astype(np.int64), (h << U64(top)) >> U64(top))
    least = least.reshape(n, bins)
    filled = least != _EMPTY
    some = filled.any(1)
    row, col = np.nonzero(~filled & some[:, None])
    out, t = least.copy(), 0
    while len(row):
        t += 1
        to = (mix(col.astype(U64) * U64(BASES[0]) + U64(t * BASES[2] % 2**64)) >> U64(64 - top)).astype(np.int64)
        hit = filled[row, to]
        out[row[hit], col[hit]] = least[row[hit], to[hit]]
        row, col = row[~hit], col[~hit]
    return np.where(some[:, None], out & U64((1 << bits) - 1), U64(0)).astype(np.uint8), some


def packed(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Hexadecimal of the packed bits; empty for a text without words."""
    flat = np.unpackbits(low[:, :, None], axis=2, bitorder="little", count=bits).reshape(len(low), -1)
    return [row.tobytes().hex() if ok else "" for row, ok in zip(np.packbits(flat, axis=1, bitorder="little"), some.tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated share of common shingles, without the agreement by chance; 1 for two texts without words, 0 for one such."""
    chance = 2.0**-bits
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def successors(docs: DataFrame) -> DataFrame:
    """(bucket, extra, doc_id, text), sorted within tasks: each row's successor in descending doc_id (null last; equal ones by
    text) is the next row.  A bucket ends with the next one's first row, marked extra; the last one with the first one's, so
    the order is a ring.

    The rows are dealt by ranges of doc_id in one shuffle, ``PER_TASK`` ranges a task so that tasks even out.  A doc_id, or a
    want of one, that many rows share gets as many ranges as its share, by the text's hash.  What the driver gets are the
    ranges' bounds and heads, two numbers each."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    n = partitions(spark)
    m = PER_TASK * n
    known, none = docs.where("doc_id is not null"), docs.where("doc_id is null")
    seen = docs.select(F.percentile_approx("doc_id", [i / m for i in range(1, m)], 10 * m).alias("c"), F.count("*").alias("all"), F.count("doc_id").alias("known")).first()
    bounds, times = np.unique(np.array(seen["c"] or [], np.int64), return_counts=True)
    nulls = math.ceil((seen["all"] - seen["known"]) * m / max(1, seen["all"]))
    # ranges before each bound: a bound met k > 1 times has k ranges of its own, and one behind it
    own = np.where(times > 1, times, 0)
    ahead = nulls + np.concatenate(([0], np.cumsum(1 + own)))
    split = nulls > 1 or bool((own > 0).any())
    tie = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 33).cast("int") if split else F.lit(0)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, ties: pd.Series) -> pd.Series:
        v, t = ids.to_numpy(np.int64), ties.to_numpy(np.int64)
        at = np.searchsorted(bounds, v, "right")
        many = np.concatenate(([0], own))[at]
        equal = (at > 0) & (many > 0) & (np.concatenate(([0], bounds))[at] == v)
        return pd.Series(ahead[at] - many + np.where(equal, t * many >> 31, many))

    dealt = known.select("*", tie.alias("tie")).select("*", bucket("doc_id", "tie").alias("bucket"))
    dealt = dealt.unionByName(none.select("*", tie.alias("tie")).select("*", F.expr(f"cast(tie * {nulls}L >> 31 as int)").alias("bucket")))
    heads = sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("head")).select("bucket", "head.doc_id", "head.tie").collect())[::-1]
    if not heads:
        return dealt.select("bucket", F.lit(False).alias("extra"), "doc_id", "text")
    ring = spark.createDataFrame([(b, h, t, heads[i - 1][0]) for i, (b, h, t) in enumerate(heads)], "bucket int, head long, head_tie int, before int")
    first = dealt.join(F.broadcast(ring), "bucket").where(F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")))  # a row a range
    extra = first.groupBy("before").agg(F.max(F.struct("doc_id", "tie", F.coalesce("text", F.lit("")).alias("text"))).alias("row")).select(F.col("before").alias("bucket"), F.lit(True).alias("extra"), "row.*")
    sent = dealt.select("bucket", F.lit(False).alias("extra"), "doc_id", "tie", "text").unionByName(extra)
    return sent.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), F.coalesce("text", F.lit("")).desc())


def compared(docs: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """For each row: its fingerprint, that of its edited text (the last half of its code points replaced by the next
    document's first as many, or all), and their likeness, and that to the next document.

    A null text counts as empty; a text without words has the empty fingerprint; a very long one is read whole.  Rows that
    repeat are rows of their own; of rows with one doc_id, or none, the order is by text; one row is its own successor, an
    empty table gives an empty one; other columns are not looked at."""

    def of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [sketch(b, width, bins, bits) for _, _, b in blocks(pa.array(texts, pa.large_string()))]
        return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for whole_batch in batches:
            for piece in pieces(whole_batch, 3):
                rows = pa.Table.from_batches([held, piece] if held is not None else [piece]).combine_chunks().to_batches()[0]
                held = rows.slice(len(rows) - 1)
                if len(rows) < 2:
                    continue
                buckets, extra = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                keep = np.array([not extra[i] and buckets[i] == buckets[i + 1] for i in range(len(rows) - 1)])
                if not keep.any():
                    continue
                texts = [x or "" for x in rows.column(3).to_pylist()]
                low, some = of(texts)
                own = np.flatnonzero(keep)
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own.tolist()]
                elow, esome = of(edited)
                prints = packed(low[own], some[own], bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(2).take(pa.array(own)), pa.array([len(texts[i]) for i in own.tolist()], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                        pa.array(prints), pa.array(packed(elow, esome, bits)), pa.array(likeness(low[own], elow, some[own], esome, bits)), pa.array(likeness(low[own], low[own + 1], some[own], some[own + 1], bits)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return lean(successors(docs).select("bucket", "extra", "doc_id", "text")).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
