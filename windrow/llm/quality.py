"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Each rule says "poor", "good" or nothing of a document.  A document's quality is a hidden class; each rule has, in
either class, a probability of each of its votes, and given the class the rules are taken as independent.  These
probabilities and the share of good documents are estimated from how often each combination of votes occurs in the whole
corpus.  There are at most 2 ** len(RULES) combinations, whatever the input, and only their counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, lean, pieces, settled
from .textblocks import SPACE, U64, Block, blocks, grams, mix, whole

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Each rule votes where its condition over the measures holds, and else abstains: True for good, False for poor.
RULES: dict[str, tuple[str, bool]] = {
    "symbols": ("10 * n_symbols > n_words", False),
    "shouting": ("10 * n_upper > 4 * n_letters and n_letters >= 20", False),
    "exclaims": ("5 * n_exclaims > n_words", False),
    "stutter": ("10 * n_stutter > n_words", False),
    "windows": ("10 * n_repeat_words > n_words", False),
    "lines": ("2 * n_dup_lines > n_lines", False),
    "word_length": ("word_chars > 15 * n_words or word_chars < 2 * n_words", False),
    "prose": ("20 * n_ends >= n_words and 2 * n_ends <= n_words and 5 * n_upper < n_letters and 20 * n_symbols < n_words", True),
}
_SYMBOL, _UPPER, _LETTER, _END = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_END[list(b".,;:?")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_exclaims", "n_stutter", "n_ends")


def per(first: np.ndarray, mask: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return c[first[1:]] - c[first[:-1]]


def repeated(key: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[:-1] | same[1:]
    return out


def measures(b: Block) -> dict[str, np.ndarray]:
    """The measures of each text of a block, as long integers."""
    data, n = b.data, len(b)
    solid = ~SPACE[data]
    h = b.word_hashes()
    text_of_word = np.repeat(np.arange(n), b.counts)
    at, off = whole(b.first, WINDOW)
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(off))
    again = repeated(mix(grams(h, WINDOW)[at] + mix(text + U64(1)))) if len(at) else np.zeros(0, bool)
    cover = np.zeros(len(h) + WINDOW + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + WINDOW, -1)
    # lines with a word: cut at \n and at the texts' bounds
    cuts = np.unique(np.concatenate((np.flatnonzero(data == 10), b.bounds)))
    line_of = np.searchsorted(cuts, b.start, "right")
    begin = np.flatnonzero(np.concatenate(([True], line_of[1:] != line_of[:-1]))) if len(h) else np.empty(0, np.int64)
    owner = text_of_word[begin]
    lo = np.maximum(cuts[line_of[begin] - 1], b.bounds[owner])
    lo = lo + ((data[lo] == 10) if len(lo) else 0)
    hi = cuts[np.minimum(line_of[begin], len(cuts) - 1)]
    line = mix(b.span_hashes(lo, hi) + mix(owner.astype(np.uint64) + U64(7)))
    earlier = np.ones(len(line), bool)
    earlier[np.unique(line, return_index=True)[1]] = False
    same = np.zeros(len(h), bool)
    for k in range(1, 9):
        same[k:] |= (h[k:] == h[:-k]) & (text_of_word[k:] == text_of_word[:-k])
    # in prose a word often recurs within a few words; only stretches of four such words count, or the very next one
    run = np.concatenate(([0], np.cumsum(same)))
    four = np.zeros(len(h) + 4, np.int64)
    if len(h) >= 4:
        four[: len(h) - 3] = run[4:] - run[:-4] == 4
    stutter = (four[: len(h)] > 0) | (np.roll(four, 1)[: len(h)] > 0) | (np.roll(four, 2)[: len(h)] > 0) | (np.roll(four, 3)[: len(h)] > 0)
    stutter[1:] |= (h[1:] == h[:-1]) & (text_of_word[1:] == text_of_word[:-1])
    last = data[b.end - 1] if len(h) else np.empty(0, np.uint8)
    return {
        "n_words": b.counts, "word_chars": b.sums(solid & ((data & 0xC0) != 0x80)), "n_symbols": b.sums(_SYMBOL[data]),
        "n_dup_lines": np.bincount(owner[earlier], minlength=n), "n_repeat_words": per(b.first, np.cumsum(cover)[: len(h)] > 0),
        "n_lines": np.bincount(owner, minlength=n), "n_letters": b.sums(_LETTER[data]), "n_upper": b.sums(_UPPER[data]),
        "n_exclaims": per(b.first, last == 33), "n_stutter": per(b.first, stutter), "n_ends": per(b.first, _END[last]),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each whole text, however long; a null text counts as empty, and rows that repeat are measured each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                for a, z, b in blocks(piece.column(1)):
                    m = measures(b)
                    yield pa.RecordBatch.from_arrays([piece.column(0).slice(a, z - a), *(pa.array(m[k], pa.int64()) for k in MEASURES)], ["doc_id", *MEASURES])

    return lean(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES))


def estimate(votes: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """(probability of a vote by class 0 poor, 1 good, and rule; share of good; posterior of good for each combination).

    votes: combinations x rules, whether the rule votes; good: whether its vote is "good".  It starts from each
    combination being poor where a rule says so.  Half a vote is added to each count, so no probability is 0 or 1."""
    q = np.where((votes & ~good).any(1), 0.1, 0.9)
    rate, share = np.zeros((2, votes.shape[1])), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        rate = (weight @ votes + 0.5) / (weight.sum(1, keepdims=True) + 1)
        share = float((weight[1].sum() + 0.5) / (counts.sum() + 1))
        logs = votes @ np.log(rate).T + (~votes) @ np.log(1 - rate).T + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        done = np.abs(new - q).max(initial=0) < 1e-9
        q = new
        if done:
            break
    return rate, share, q


def _voted(rows: DataFrame) -> DataFrame:
    """Adds base_failed and votes, one bit a rule, to a table of measures."""
    fails = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    bits = " + ".join(f"case when {rule} then {1 << i} else 0 end" for i, (rule, _) in enumerate(RULES.values()))
    return rows.withColumn("base_failed", F.expr(fails)).withColumn("votes", F.expr(f"cast(case when n_words = 0 then 0 else {bits} end as int)"))


def _posteriors(rows: DataFrame) -> dict[int, float]:
    """The posterior of each combination of votes that the rows have."""
    seen = rows.groupBy("votes").count().orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in seen], np.int64)
    votes = (patterns[:, None] >> np.arange(len(RULES))) & 1 == 1
    _, _, q = estimate(votes, np.array([r["count"] for r in seen], float), np.array([g for _, g in RULES.values()]))
    return dict(zip(patterns.tolist(), q.tolist(), strict=True))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, quality (posterior probability that the document is good) and kept.

    Texts without words, null ones too, fail the base; a very long one is measured whole; texts with one combination of votes tie and
    share one posterior.  Rows that repeat count each; an empty table gives an empty one;
    other columns are not looked at."""
    rows = settled(_voted(measured(docs)))
    q = _posteriors(rows)
    table = F.create_map(*(F.lit(x) for kv in q.items() for x in kv)) if q else F.lit(None).cast("map<int,double>")
    return rows.withColumn("quality", F.element_at(table, F.col("votes"))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("votes")


def filtered(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that are kept, with their columns, repeated rows and clashing names included; null and wordless texts go, very long
    ones are measured whole, an empty table gives an empty one.

    The corpus is measured once for the posteriors and once more to filter each row where it is, which moves no text."""
    good = [v for v, q in _posteriors(_voted(measured(docs))).items() if q >= threshold]

    def of(texts: pd.Series) -> pd.DataFrame:
        parts = [measures(b) for _, _, b in blocks(pa.array(texts, pa.large_string(), from_pandas=True))]
        return pd.DataFrame({k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in MEASURES}).astype("int64")

    [row, found] = free(docs, "row", "found")
    both = lean(docs).select(F.struct("*").alias(row), F.pandas_udf(of, ", ".join(f"{k} long" for k in MEASURES))("text").alias(found))
    return _voted(both.select(row, f"{found}.*")).where(~F.col("base_failed") & F.col("votes").isin(good)).select(f"{row}.*")
