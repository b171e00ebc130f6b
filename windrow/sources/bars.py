"""Bars from the test tables: the one place that knows where bars come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of a supplier's day of line items, so first and last are the same in every run.
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
#: The tables that bars and profiles are made of.
TABLES = ("lineitem", "supplier", "nation", "region")
PRICES = ("open", "high", "low", "close")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name, industry, region, listing_date, is_st: one row per supplier."""
    s, n, r = (read(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return (
        s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
        .select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), F.col("r_name").alias("region"),
                F.date_add(F.lit("1994-01-01").cast("date"), (F.col("s_suppkey") % 700).cast("int")).alias("listing_date"), F.col("s_name").rlike("[05]$").alias("is_st"))
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date and the columns of ORDER: a row a line item."""
    return read(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), *ORDER)


def daily(spark: SparkSession, sf_dir: str, by_symbol: bool = False) -> DataFrame:
    """symbol, date, open, high, low, close, volume, amount, turnover: a supplier's line items by day of shipping.

    ``by_symbol`` deals line items by symbol first: one shuffle and one sort then do for the days and for windows over a symbol's days."""
    rows = items(spark, sf_dir)
    return days(rows.repartition("symbol") if by_symbol else rows)


def days(rows: DataFrame) -> DataFrame:
    """Bars of ``items``."""
    rows = rows.withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("k", F.struct(*ORDER))
    return (
        rows.groupBy("symbol", "date")
        .agg(F.min_by("unit", "k").alias("open"), F.max(F.col("unit") * (1 + F.col("l_tax"))).alias("high"), F.min(F.col("unit") * (1 - F.col("l_discount"))).alias("low"),
             F.max_by("unit", "k").alias("close"), F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
        .withColumn("turnover", F.col("volume") * 0.1)
    )


def minutes(spark: SparkSession, sf_dir: str, every: str = "6 hours") -> DataFrame:
    """symbol, date, timestamp, open, high, low, close, volume, amount: a user's events by stretches of a day."""
    e = read(spark, sf_dir, "events")
    ticks = e.select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), F.col("ts").alias("timestamp"), F.col("ts").cast("date").alias("date"), F.col("event_id"),
        F.col("value").alias("price"), (1 + F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))).alias("size"),
    )
    hours = int(every.split()[0])
    slot = F.floor(F.hour("timestamp") / hours).cast("int")
    k = F.struct("timestamp", "event_id")
    return (
        ticks.groupBy("symbol", "date", slot.alias("slot"))
        .agg(F.min("timestamp").alias("timestamp"), F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"),
             F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("amount"))
    )


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index_symbol, date, close, pct_change: each region's mean close."""
    from ..functions.rolling import ordered

    b = daily(spark, sf_dir).join(profiles(spark, sf_dir).select("symbol", F.col("region").alias("index_symbol")), "symbol")
    day = b.groupBy("index_symbol", "date").agg(F.avg("close").alias("close"))
    before = F.lag("close").over(ordered("index_symbol"))
    return day.withColumn("pct_change", F.coalesce(100 * (F.col("close") / before - 1), F.lit(0.0)))
