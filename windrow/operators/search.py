"""Nearest neighbours, pair scores, ranking and forward statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.rolling import ahead, ordered
from .windows import total

WEIGHTS = {"price_path": 0.45, "candle_geometry": 0.20, "volume_liquidity": 0.20, "environment": 0.15}
HORIZONS = (1, 3, 5, 10)
PER_SYMBOL, OVERLAP_DAYS = 2, 2


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def nearest(rows: DataFrame, query: DataFrame, vector: str, key: str, k: int) -> DataFrame:
    """The k rows nearest to the one row of ``query``, ties by key; each task keeps its own k first."""
    one = query.select(F.col(vector).cast("array<double>").alias("__q")).limit(1)  # one row: a bounded broadcast
    return rows.crossJoin(F.broadcast(one)).withColumn("distance", euclid(F.col(vector).cast("array<double>"), F.col("__q"))).drop("__q").orderBy("distance", key).limit(k)


def standardised(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """The vectors with each dimension less its mean, over its population deviation (1 where that is 0)."""
    long = rows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    stats = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))  # a row a dimension
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("__st"))
    z = F.zip_with(F.col(vector).cast("array<double>"), F.col("__st"), lambda x, t: (x - t["m"]) / F.when(t["s"] < 1e-12, 1.0).otherwise(t["s"]))
    return rows.crossJoin(F.broadcast(packed)).withColumn(vector, z).drop("__st")


def overlap_days(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Calendar days that two periods share, both ends included."""
    return F.greatest(F.datediff(F.least(e1, e2), F.greatest(s1, s2)) + 1, F.lit(0))


def trimmed(a: Column) -> Column:
    """The array without its trailing zeros."""
    kept = F.aggregate(F.transform(a, lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0), lambda m, i: F.greatest(m, i))
    return F.slice(a, F.lit(1), kept)


def _pairs(kind: str):
    """Function of two Arrow columns of arrays, ``rmse`` or ``dtw``: a batch's arrays become matrices with a column a row, so each step is taken
    for all rows at once.  Both trim trailing zeros first; missing elements are 0.  All is nested, so that workers need no copy of this package."""

    def table(x: pa.ListArray, start: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions by rows, padded with zeros, and each row's length without trailing zeros."""
        ends = x.offsets.to_numpy()[start : start + rows + 1]
        values, size = pc.fill_null(x.values, 0.0).to_numpy(zero_copy_only=False), np.diff(ends)
        wide = np.arange(size.max())
        if (size == len(wide)).all():
            out = np.ascontiguousarray(values[ends[0] : ends[-1]].reshape(rows, len(wide)).T)
        else:
            out = np.zeros((len(wide), rows))
            out.T[wide < size[:, None]] = values[ends[0] : ends[-1]]
        kept = np.zeros(rows, np.int64)
        for i, x in enumerate(out, 1):
            kept[x != 0] = i
        return out, kept

    def rmse(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        both = np.zeros((2, max(len(a), len(b)), len(n)))
        both[0, : len(a)], both[1, : len(b)] = a, b
        squares = np.zeros(len(n))
        for x, y in zip(*both):
            squares += (x - y) * (x - y)
        return np.sqrt(squares / np.maximum(n, m))

    def dtw(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        band = np.maximum(np.abs(n - m), np.maximum(np.maximum(n, m) // 4, 2))
        reach, out = int(band.max()), np.full(len(n), np.inf)
        before = np.full((len(b) + 1, len(n)), np.inf)
        before[0] = 0.0
        for i in range(1, len(a) + 1):
            now = np.full_like(before, np.inf)
            for j in range(max(1, i - reach), min(len(b), i + reach) + 1):
                cost = np.abs(a[i - 1] - b[j - 1]) + np.fmin(np.fmin(before[j], now[j - 1]), before[j - 1])
                now[j] = np.where(abs(i - j) <= band, cost, np.inf)
            last = np.flatnonzero(n == i)
            out[last] = now[m[last], last]
            before = now
        return out / (n + m)

    score = {"rmse": rmse, "dtw": dtw}[kind]

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out, longest = np.empty(len(a)), max((np.diff(x.offsets.to_numpy()).max(initial=0) for x in (a, b)))
        step = max(1, 2**19 // max(1, int(longest)))  # some megabytes a matrix, however long the arrays
        for start in range(0, len(a), step):
            rows = min(step, len(a) - start)
            (x, n), (y, m) = table(a, start, rows), table(b, start, rows)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[start : start + rows] = np.where((n == 0) | (m == 0), np.inf, score(x, n, y, m))
        return pa.array(out, mask=~np.asarray(pc.and_(a.is_valid(), b.is_valid())))

    return run


def scored(pairs: DataFrame, keep: list[str], scores: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    """The columns kept and, by name, ``rmse`` or ``dtw`` of two arrays: as the functions of that name, but with no row held back in the JVM."""
    kinds = [(name, _pairs(kind)) for name, (kind, _, _) in scores.items()]
    sides = [x.cast("array<double>").alias(f"__{side}{name}") for name, (_, a, b) in scores.items() for side, x in (("a", a), ("b", b))]
    rows = pairs.select(*keep, *sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [score(b.column(f"__a{name}"), b.column(f"__b{name}")) for name, score in kinds]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *found], [*keep, *(name for name, _ in kinds)])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in keep), *(StructField(name, DoubleType()) for name, _ in kinds)]))


def rmse(a: Column, b: Column) -> Column:
    """Of two arrays without their trailing zeros, the shorter padded with zeros; infinite where one has no value."""
    return F.arrow_udf(_pairs("rmse"), DoubleType())(a.cast("array<double>"), b.cast("array<double>"))


def dtw_distance(a: Column, b: Column) -> Column:
    """Banded dynamic time warping of two arrays without their trailing zeros, by absolute costs, over the sum of their lengths; infinite for
    an empty side.  Two rows of the table of costs are kept."""
    return F.arrow_udf(_pairs("dtw"), DoubleType())(a.cast("array<double>"), b.cast("array<double>"))


def balanced(distances: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the finite distances; infinite if there is none."""
    use = {k: d for k, d in distances.items() if weights.get(k, 0) > 0}
    finite = {k: d < float("inf") for k, d in use.items()}
    top = reduce(lambda a, k: a + F.when(finite[k], weights[k] * use[k]).otherwise(0.0), use, F.lit(0.0))
    low = reduce(lambda a, k: a + F.when(finite[k], weights[k]).otherwise(0.0), use, F.lit(0.0))
    return F.when(low > 0, top / F.nullif(low, F.lit(0.0))).otherwise(float("inf"))


def similarity(distance: Column) -> Column:
    return F.when(distance < float("inf"), 1 / (1 + F.greatest(distance, F.lit(0.0)))).otherwise(0.0)


def forward(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """symbol, date, horizon, return_pct, mfe_pct, mdd_pct over the next rows; null where there are too few.

    All horizons come from one window pass; then they become rows."""
    entry = F.when(F.abs("close") < 1e-9, None).otherwise(F.col("close"))
    pct = lambda x: 100 * (x / entry - 1)
    one = lambda h: F.struct(
        F.lit(h).alias("horizon"), pct(F.lead("close", h).over(ordered())).alias("return_pct"),
        F.when(F.count("*").over(ahead(h)) == h, pct(F.max("high").over(ahead(h)))).alias("mfe_pct"), F.when(F.count("*").over(ahead(h)) == h, pct(F.min("low").over(ahead(h)))).alias("mdd_pct"),
    )
    return bars.select("symbol", "date", F.array(*map(one, horizons)).alias("h")).select("symbol", "date", F.explode("h").alias("h")).select("symbol", "date", "h.*")


def forward_summary(stats: DataFrame) -> DataFrame:
    """By horizon: how many have a return, its mean, the share above 0, mean best and worst move."""
    known = F.col("return_pct").isNotNull()
    return stats.groupBy("horizon").agg(F.count("return_pct").alias("n"), F.avg("return_pct").alias("mean_return"), F.avg(F.when(known, (F.col("return_pct") > 0).cast("double"))).alias("win_rate"), F.avg("mfe_pct").alias("mean_mfe"), F.avg("mdd_pct").alias("mean_mdd"))


def ranked(candidates: DataFrame, top_k: int, per_symbol: int = PER_SYMBOL, overlap: int = OVERLAP_DAYS) -> DataFrame:
    """Greedy choice by score (descending), distance, symbol and end_date: at most ``per_symbol`` windows of a symbol, none
    sharing more than ``overlap`` days with a chosen one of it; windows with forward data go first, others fill up.

    Both limits hold within a symbol, so symbols are chosen from one by one and the global order comes after."""
    fields = candidates.schema
    names = fields.names

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_late=~pdf["has_forward"]).sort_values(["_late", "score", "distance", "symbol", "end_date"], ascending=[True, False, True, True, True], kind="stable")
        taken: list[int] = []
        starts, ends = pd.to_datetime(pdf["start_date"]).to_numpy(), pd.to_datetime(pdf["end_date"]).to_numpy()
        for i in range(len(pdf)):
            if len(taken) == per_symbol:
                break
            shared = [(min(ends[i], ends[j]) - max(starts[i], starts[j])) / np.timedelta64(1, "D") + 1 for j in taken]
            if all(x <= overlap for x in shared):
                taken.append(i)
        return pdf.iloc[taken][names]

    chosen = candidates.groupBy("symbol").applyInPandas(choose, fields)
    return chosen.orderBy(F.col("has_forward").desc(), F.col("score").desc(), "distance", "symbol", "end_date").limit(top_k)


def blocked_nearest(rows: DataFrame, query: list[float], vector: str, key: str, k: int) -> DataFrame:
    """The k nearest by |a|^2 + |b|^2 - 2ab over blocks of vectors, each block's best k merged with those so far."""
    q = np.asarray(query, float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({key: pd.Series(dtype="int64"), "distance": pd.Series(dtype=float)})
        for pdf in frames:
            m = np.stack(pdf[vector].to_numpy()).astype(float) if len(pdf) else np.empty((0, len(q)))
            d = np.sqrt(np.maximum((m * m).sum(1) + q @ q - 2 * m @ q, 0))
            best = pd.concat([best, pd.DataFrame({key: pdf[key], "distance": d})]).sort_values(["distance", key], kind="stable").head(k)
        yield best

    return rows.select(key, vector).mapInPandas(run, f"{key} long, distance double").orderBy("distance", key).limit(k)


def best_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")
