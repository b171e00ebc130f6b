"""Tables written as versions, and small results as CSV, HTML and JSON."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.normalise import upsert
from ..streaming.ticks import current

#: Results that leave as files are reports; more rows than this are a table to be written by Spark.
REPORT_ROWS = 10_000


def write_bars(df: DataFrame, path: str) -> None:
    """Bars by frequency, and sorted within files so that a scan of few symbols or days skips most row groups."""
    df.repartitionByRange("symbol", "date").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy(*[c for c in ("frequency",) if c in df.columns]).parquet(path)


def scan(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of some symbols between two times, both included; the conditions reach the files."""
    df = spark.read.parquet(path)
    df = df.where(F.col("symbol").isin(symbols)) if symbols else df
    return between(df, start, end)


def between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows by timestamp, or by date where there is none.  A day alone means its first second as a start and its last as an end."""
    if "timestamp" not in df.columns:
        df = df.where(F.col("date") >= F.lit(start).cast("date")) if start else df
        return df.where(F.col("date") <= F.lit(end).cast("date")) if end else df
    at = lambda x, clock: F.lit(f"{x} {clock}" if len(x) == 10 else x).cast(df.schema["timestamp"].dataType)
    df = df.where(F.col("timestamp") >= at(start, "00:00:00")) if start else df
    return df.where(F.col("timestamp") <= at(end, "23:59:59")) if end else df


def relaxed(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """Tables of one layout read as ``schema``: whole numbers may stand for fractions, and narrow numbers for wide ones; columns that a
    table lacks are null, and any other difference is an error."""
    whole, frac = ("tinyint", "smallint", "int", "bigint"), ("float", "double")
    wider = {a: (*whole[i + 1 :], *frac) for i, a in enumerate(whole)} | {"float": ("double",)}
    out = None
    for path in paths:
        df = spark.read.parquet(path)
        have, cells = dict(df.dtypes), []
        for f in schema:
            kind, asked = have.get(f.name), f.dataType.simpleString()
            if kind not in (None, asked) and asked not in wider.get(kind, ()):
                raise ValueError(f"{path}: {f.name} is {kind}, not {asked}")
            cells.append((F.col(f"`{f.name}`") if kind else F.lit(None)).cast(f.dataType).alias(f.name))
        df = df.select(*cells)
        out = df if out is None else out.unionByName(df)
    return spark.createDataFrame([], schema) if out is None else out


def put(new: DataFrame, path: str, keys: list[str], version: int) -> DataFrame:
    """Upsert into the versioned table at ``path``; a version counts once it is complete."""
    old = current(new.sparkSession, path)
    (new if old is None else upsert(old, new, keys)).write.mode("overwrite").parquet(f"{path}/v={version}")
    return current(new.sparkSession, path)


def _rows(df: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.limit(REPORT_ROWS + 1).collect()]
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write the table with Spark")
    return rows


def to_csv(df: DataFrame, path: str) -> None:
    import csv

    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.DictWriter(f, df.columns)
        out.writeheader()
        out.writerows(_rows(df))


def to_html(df: DataFrame, path: str, title: str = "windrow") -> None:
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "".join("<tr>" + "".join(cell("td", r[c]) for c in df.columns) + "</tr>" for r in _rows(df))
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>", encoding="utf-8")


def to_json(df: DataFrame, path: str, **more: object) -> None:
    Path(path).write_text(json.dumps({"rows": _rows(df)} | more, default=str, ensure_ascii=False, indent=1), encoding="utf-8")
