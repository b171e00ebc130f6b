"""Index manifests and their staleness, what maintenance has to do, and backfill bookkeeping."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def freshness(bars: DataFrame) -> DataFrame:
    return bars.agg(F.countDistinct("symbol").alias("cached_symbols"), F.max("date").alias("latest"))


def health(manifests: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds to (window_size, symbols, built_latest) whether an index covers fewer symbols or ends earlier than the bars."""
    now = freshness(bars)  # one row
    stale = ((F.col("symbols") > 0) & (F.col("symbols") < F.col("cached_symbols"))) | F.coalesce(F.col("built_latest") < F.col("latest"), F.lit(False))
    return manifests.crossJoin(F.broadcast(now)).select("window_size", "symbols", "built_latest", stale.alias("stale"))


def decision(wanted: DataFrame, checked: DataFrame, forced: bool = False, new_symbols: int = 0) -> DataFrame:
    """One row: why to rebuild, and which window sizes: forced, new symbols, missing (and stale), stale, or nothing."""
    all_ = wanted.join(checked, "window_size", "left").agg(
        F.array_sort(F.collect_list("window_size")).alias("wanted"), F.array_sort(F.collect_list(F.when(F.col("stale").isNull(), F.col("window_size")))).alias("missing"), F.array_sort(F.collect_list(F.when(F.col("stale"), F.col("window_size")))).alias("stale"),
    )
    reason = F.when(F.lit(forced), "forced").when(F.lit(new_symbols) > 0, "new_cached_symbols").when(F.size("missing") > 0, "missing_indexes").when(F.size("stale") > 0, "stale_indexes").otherwise("no_cache_change")
    sizes = F.when(F.lit(forced or new_symbols > 0), F.col("wanted")).when(F.size("missing") > 0, F.array_sort(F.array_union("missing", "stale"))).otherwise(F.col("stale"))
    return all_.select(reason.alias("reason"), sizes.alias("window_sizes"))


def backfill_status(attempts: DataFrame) -> DataFrame:
    """By run: how many symbols ended how, by their last attempt."""
    last = attempts.withColumn("r", F.row_number().over(Window.partitionBy("run", "symbol").orderBy(F.col("attempt").desc()))).where("r = 1")
    return last.groupBy("run").pivot("status", ["completed", "failed", "partial"]).count().fillna(0)


def retry(attempts: DataFrame, most: int = 3) -> DataFrame:
    """The symbols whose last attempt did not complete and that have attempts left."""
    by = attempts.groupBy("symbol").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempts"))
    return by.where((F.col("status") != "completed") & (F.col("attempts") < most)).select("symbol", "attempts")


def resumable(runs: DataFrame, frequency: str, symbols: list[str], start: str, end: str) -> DataFrame:
    """The latest run that did not end and asked for the same: frequency, symbols in any order, and days."""
    same = (F.col("frequency") == frequency) & (F.array_sort("symbols") == F.array(*map(F.lit, sorted(symbols)))) & F.col("start_date").eqNullSafe(F.lit(start).cast("date")) & F.col("end_date").eqNullSafe(F.lit(end).cast("date"))
    return runs.where(same & F.col("status").isin("running", "partial")).orderBy(F.col("started_at").desc(), F.col("run").desc()).limit(1)


def stale_runs(runs: DataFrame, attempts: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Runs that say they are running although their last attempt, or without one their start, lies more than so many minutes back;
    with no minutes none is stale."""
    last = attempts.groupBy("run").agg(F.max("attempted_at").alias("attempted_at"))
    seen = runs.where("status = 'running'").join(last, "run", "left").withColumn("last_activity", F.coalesce("attempted_at", "started_at"))
    return seen.where(F.lit(minutes > 0) & (now - F.col("last_activity") > F.expr(f"interval {max(minutes, 0)} minutes"))).select("run", "last_activity")


def input_snapshot(spark: SparkSession, paths: list[str]) -> dict[str, tuple[int, int]]:
    """Length and time of change of every file below the paths; names of files, so bounded by their number."""
    jvm, found = spark._jvm, {}
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(where):
            files = fs.listFiles(where, True)
            while files.hasNext():
                f = files.next()
                found[str(f.getPath())] = (f.getLen(), f.getModificationTime())
    return found


def snapshot_fingerprint(snapshot: dict[str, tuple[int, int]]) -> str:
    return hashlib.sha256("".join(f"{p}{n}{t}" for p, (n, t) in sorted(snapshot.items())).encode()).hexdigest()


def unchanged(spark: SparkSession, paths: list[str], before: dict[str, tuple[int, int]]) -> None:
    """Raises if an input was written while something was built from it."""
    if changed := sorted(set(before.items()) ^ set(input_snapshot(spark, paths).items())):
        raise RuntimeError(f"inputs changed during the build: {changed[0][0]}")


def latest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), time).alias("x")).select("x.*")
