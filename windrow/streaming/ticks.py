"""Ticks as a stream: bars by tumbling and sliding windows, sessions, late data, and upserts of what arrives.

Each function takes and gives a DataFrame, streaming or not, so a batch over the same rows must give the same result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalise import upsert


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream, ``files`` at a time; the pattern lets one file be a source."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)


def ticks(events: DataFrame, late: str = "1 hour") -> DataFrame:
    # event time needs an instant; the session's zone is UTC
    t = events.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
    return t.withWatermark("ts", late)


def bars(t: DataFrame, size: str = "6 hours", slide: str | None = None) -> DataFrame:
    k = F.struct("ts", "event_id")
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = t.groupBy(w.alias("w"), "symbol").agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.count("*").alias("n"))
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "n")


def sessions(t: DataFrame, gap: str = "12 hours") -> DataFrame:
    s = t.groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count("*").alias("n"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"))
    return s.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "cents")


def daily_factors(t: DataFrame) -> DataFrame:
    """By symbol and day: ticks, return and range in percent of the day's first price, and where in its range the day ended."""
    k = F.struct("ts", "event_id")
    day = t.groupBy(F.window("ts", "1 day").alias("w"), "symbol").agg(F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", k).alias("close"), F.count("*").alias("n"))
    rate = lambda x, of, otherwise: F.coalesce(x / F.nullif(of, F.lit(0.0)), F.lit(otherwise))
    return day.select(
        "symbol", F.col("w.start").cast("date").alias("date"), "n", rate(100 * (F.col("close") - F.col("open")), F.col("open"), 0.0).alias("day_return"),
        rate(100 * (F.col("high") - F.col("low")), F.col("open"), 0.0).alias("day_range"), rate(F.col("close") - F.col("low"), F.col("high") - F.col("low"), 0.5).alias("close_position"),
    )


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all machines share; a local session without one gets its own."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{own}/windrow-stream-{uuid.uuid4().hex}" if own else tempfile.mkdtemp(prefix="windrow-stream-")


def drained(stream: DataFrame) -> DataFrame:
    """The whole result of the stream, processed to its end: each batch's is written beside the one before, by the executors."""
    spark, path = stream.sparkSession, folder(stream.sparkSession)
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/table/v={epoch}")
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).start().awaitTermination()
    found = current(spark, f"{path}/table")
    return spark.createDataFrame([], stream.schema) if found is None else found


def appended(stream: DataFrame, path: str, marks: str) -> DataFrame:
    """All that the stream closes, appended to the Parquet table at ``path``; what has been read is remembered in ``marks``, so a later
    call goes on from there."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def upserting(path: str, keys: list[str]):
    """A function for foreachBatch: each batch's rows replace those of their keys in the table at ``path``.

    A new version is written beside the old one and then named as current, so readers never see half of one."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = current(spark, path)
        merged = batch if now is None else upsert(now, batch, keys)
        merged.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return run


def current(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    done = [str(x.getPath()) for x in fs.listStatus(where) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(done, key=lambda p: int(p.rpartition("=")[2]))) if done else None
