"""Rolling columns over one ordered key.  Three conventions for the leading rows are kept apart by name.

``*_null``: nothing before the first row.  ``*_edge``: the window is padded with copies of the first value, in closed form:
at row t < n there are n - t of them.  All columns of one key share one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import clamp_den

KEY, TIME = "symbol", "date"


def ordered(key: str = KEY, time: str = TIME):
    return Window.partitionBy(key).orderBy(time)


def last(n: int, key: str = KEY, time: str = TIME):
    return ordered(key, time).rowsBetween(1 - n, 0)


def ahead(n: int, key: str = KEY, time: str = TIME):
    return ordered(key, time).rowsBetween(1, n)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag_null(x: Column | str, k: int = 1) -> Column:
    return F.lag(col(x), k).over(ordered())


def change_null(x: Column | str, k: int = 1) -> Column:
    """Change over k rows in per cent; null where there is no such row or it is 0."""
    return 100 * (col(x) / F.nullif(lag_null(x, k), F.lit(0.0)) - 1)


def head(x: Column | str) -> Column:
    return F.first(col(x)).over(ordered().rowsBetween(Window.unboundedPreceding, 0))


def lag_edge(x: Column | str, k: int = 1) -> Column:
    return F.coalesce(lag_null(x, k), head(x))


def change_edge(x: Column | str, k: int = 1) -> Column:
    before = lag_edge(x, k)
    return 100 * (col(x) - before) / clamp_den(before)


def _missing(n: int) -> Column:
    return F.lit(n) - F.least(F.row_number().over(ordered()), F.lit(n))


def sum_edge(x: Column | str, n: int) -> Column:
    return F.sum(col(x)).over(last(n)) + _missing(n) * head(x)


def mean_edge(x: Column | str, n: int) -> Column:
    return sum_edge(x, n) / n


def std_of(df: DataFrame, name: str, x: str, n: int) -> DataFrame:
    """Adds the padded population deviation of column x.

    The mean is a column first, as a window of a window is none; squares are of the values less the first one, which the
    padding consists of, so padding adds nothing."""
    df = df.withColumn("__h", head(x)).withColumn("__d", F.col(x) - F.col("__h"))
    s1, s2 = F.sum("__d").over(last(n)) / n, F.sum(F.col("__d") * F.col("__d")).over(last(n)) / n
    return df.withColumn(name, F.sqrt(F.greatest(s2 - s1 * s1, F.lit(0.0)))).drop("__h", "__d")


def zscore_of(df: DataFrame, name: str, x: str, n: int) -> DataFrame:
    df = std_of(df, "__s", x, n)
    return df.withColumn(name, (F.col(x) - mean_edge(x, n)) / clamp_den(F.col("__s"))).drop("__s")


def max_last(x: Column | str, n: int, least: int = 1) -> Column:
    return F.when(F.count(col(x)).over(last(n)) >= least, F.max(col(x)).over(last(n)))


def min_last(x: Column | str, n: int, least: int = 1) -> Column:
    return F.when(F.count(col(x)).over(last(n)) >= least, F.min(col(x)).over(last(n)))


def mean_last(x: Column | str, n: int, least: int = 1) -> Column:
    return F.when(F.count(col(x)).over(last(n)) >= least, F.avg(col(x)).over(last(n)))


def rank_edge(x: Column | str, n: int) -> Column:
    """Share of the padded window at or below the row's value."""
    values = F.collect_list(col(x)).over(last(n))
    below = F.size(F.filter(values, lambda v: v <= col(x)))
    return (below + _missing(n) * F.when(head(x) <= col(x), 1).otherwise(0)) / n


def streak_of(df: DataFrame, name: str, condition: Column, key: str = KEY, time: str = TIME) -> DataFrame:
    """Adds the number of rows in a row, up to this one, where the condition holds."""
    df = df.withColumn("__f", F.when(condition, 1).otherwise(0))
    df = df.withColumn("__g", F.sum(1 - F.col("__f")).over(ordered(key, time).rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "__g").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum("__f").over(run).cast("double")).drop("__f", "__g")


def rank_in_date(x: Column | str) -> Column:
    """Percentile rank within a date with the average of ties; 0.5 where the value is null."""
    day, same = Window.partitionBy(TIME), Window.partitionBy(TIME, col(x))
    rank = F.rank().over(day.orderBy(col(x).asc_nulls_last())) + (F.count("*").over(same) - 1) / 2.0
    return F.when(col(x).isNull(), 0.5).otherwise(rank / F.count(col(x)).over(day))
