"""Market and industry context, and factors joined on with their availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite0

#: Rows up to which a dimension is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has no more rows than that; the check counts at most that many and one."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def market(indexes: DataFrame) -> DataFrame:
    """date, market_return_mean, market_volatility_5, market_trend_5: the mean of the indexes' changes and its last five days."""
    day = indexes.groupBy("date").agg(F.avg("pct_change").alias("market_return_mean"))
    w = Window.orderBy("date").rowsBetween(-4, 0)  # one row a trading day
    return day.select("*", F.coalesce(F.stddev_samp("market_return_mean").over(w), F.lit(0.0)).alias("market_volatility_5"), F.avg("market_return_mean").over(w).alias("market_trend_5"))


def industry(bars: DataFrame) -> DataFrame:
    """Means of change, turnover and amplitude by date and industry, the number of members, and the five-day trend."""
    day = bars.groupBy("date", "industry").agg(
        F.avg("pct_change").alias("industry_return_mean"), F.avg("turnover").alias("industry_turnover_mean"), F.avg("amplitude").alias("industry_amplitude_mean"), F.count("*").alias("constituents"),
    )
    w = Window.partitionBy("industry").orderBy("date").rowsBetween(-4, 0)
    return day.withColumn("industry_return_trend_5", F.avg("industry_return_mean").over(w))


def with_context(bars: DataFrame, context: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    joined = bars.join(small(context.select(*on, *columns)), on, "left")
    return joined.fillna(0.0, columns)


def with_factor(base: DataFrame, factor: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Each factor column with nulls as 0, and whether it was there."""
    joined = base.join(factor.select(*on, *columns), on, "left")
    flags = [F.col(c).isNotNull().cast("double").alias(f"{c}_available") for c in columns]
    return joined.select(*[c for c in joined.columns if c not in columns], *[finite0(F.col(c)).alias(c) for c in columns], *flags)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.avg(f"{c}_available").alias(f"{c}_coverage") for c in columns), F.count("*").alias("n_rows"))
