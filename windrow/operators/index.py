"""Windows encoded once and stored, so that a search scans vectors instead of making them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.ticks import current
from . import catalog, windows

#: The columns of a stored window, in this order.
COLUMNS = ("symbol", "start_idx", "end_idx", "start_date", "end_date", "price_path", "candle_geometry", "volume_liquidity")


def build(bars: DataFrame, size: int, root: str, version: int, inputs: list[str] | None = None) -> DataFrame:
    """Writes the windows of ``size`` bars below ``root`` as a new version, and then its manifest, which alone makes it count: so readers
    see the version before until this one is whole.  Fails if files below ``inputs`` change meanwhile.  Gives the manifest."""
    spark, own = bars.sparkSession, f"{root}/window_size={size}"
    before = catalog.input_snapshot(spark, inputs or [])
    rows = windows.encoded(windows.sliding(bars, size)).select(*COLUMNS)
    # windows leave their sliding pass by symbol and day, so files hold few symbols each without another exchange
    rows.sortWithinPartitions("symbol", "end_date").write.mode("overwrite").parquet(path := f"{own}/windows/v={version}")
    catalog.unchanged(spark, inputs or [], before)
    found = measured(spark.read.parquet(path)).select(F.lit(size).alias("window_size"), F.lit(version).alias("version"), "*", F.lit(catalog.snapshot_fingerprint(before)).alias("fingerprint"))
    found.coalesce(1).write.mode("overwrite").parquet(f"{own}/manifests/v={version}")
    return current(spark, f"{own}/manifests")


def measured(rows: DataFrame) -> DataFrame:
    """One row: what a manifest states of stored windows."""
    dims = sum(F.size(c) for c in COLUMNS[5:]).cast("long")
    return rows.agg(F.count("*").alias("n_windows"), F.countDistinct("symbol").alias("symbols"), F.max("end_date").alias("built_latest"), F.min(dims).alias("least_dimensions"), F.max(dims).alias("dimensions"))


def load(spark: SparkSession, root: str, size: int, check: bool = True) -> DataFrame:
    """The stored windows of the latest whole version; with ``check`` counted and measured against their manifest first."""
    found = current(spark, f"{root}/window_size={size}/manifests")
    if found is None:
        raise FileNotFoundError(f"no index of windows of {size} bars below {root}")
    manifest = found.first()
    rows = spark.read.parquet(f"{root}/window_size={size}/windows/v={manifest['version']}")
    if tuple(rows.columns) != COLUMNS:
        raise ValueError(f"the index has columns {rows.columns}, not {list(COLUMNS)}")
    if check:
        now = measured(rows).first().asDict()
        if bad := [k for k, v in now.items() if manifest[k] != v] or (["dimensions"] if now["least_dimensions"] != now["dimensions"] else []):
            raise ValueError(f"the index differs from its manifest in {', '.join(bad)}")
    return rows
