"""Level-2 tables from CSV or Parquet: validated, typed, with optional columns null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalise import symbol

# The tables' columns.
_DEPTH = [f"{side}_{kind}_{i}" for i in range(1, 11) for side in ("bid", "ask") for kind in ("price", "volume")]
TABLES = {
    "orderbook": (["symbol", "timestamp", "bid_price_1", "bid_volume_1", "ask_price_1", "ask_volume_1"], [c for c in _DEPTH if not c.endswith("_1")]),
    "trades": (["symbol", "timestamp", "price", "volume", "amount", "side"], ["trade_id", "order_id", "buyer_order_id", "seller_order_id"]),
    "auction": (["symbol", "timestamp", "indicative_price", "matched_volume", "unmatched_volume"], ["side", "auction_phase", "amount"]),
}
_TEXT = {"symbol", "side", "trade_id", "order_id", "buyer_order_id", "seller_order_id", "auction_phase"}


def describe(table: str) -> dict[str, list[str]]:
    required, optional = TABLES[table]
    return {"required": list(required), "optional": list(optional)}


def validated(df: DataFrame, table: str) -> DataFrame:
    """The table's columns: symbols padded, timestamps parsed (rows without one go), numbers coerced; absent optional columns null."""
    required, optional = TABLES[table]
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{table} lacks {missing}")
    cast = lambda c: symbol(F.col(c).cast("string")) if c == "symbol" else F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz") if c == "timestamp" else F.col(c).cast("string") if c in _TEXT else F.expr(f"try_cast(`{c}` as double)")
    out = df.select(*((cast(c) if c in df.columns else F.lit(None).cast("string" if c in _TEXT else "double")).alias(c) for c in (*required, *optional)))
    return out.where("timestamp is not null").orderBy("symbol", "timestamp")


def load(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, dict]:
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    df = validated(raw, table)
    return df, {"table": table, "path": path, "columns": df.columns, "input_columns": raw.columns}
