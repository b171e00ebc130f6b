"""Cutting lineage in the cluster's shared folder, connected components, and reading a table."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is what grows with the cluster and the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table does not have."""
    have = {c.lower() for c in df.columns}
    return [next(n for n in (f"__{x}" + "_" * k for k in range(len(have) + 1)) if n.lower() not in have) for x in names]


def lean(df: DataFrame) -> DataFrame:
    """The rows, to be sent to Python in batches of few megabytes: texts are long, and ten thousand of them, the default, are
    held several times over by the JVM and the worker.  A session's own setting is left as it is."""
    for key, default, ours in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", str(64 << 20), str(8 << 20))):
        name, conf = f"spark.sql.execution.arrow.{key}", df.sparkSession.conf
        if (conf.get(name, None) or "").removesuffix("b") == default:
            conf.set(name, ours)
    return df


def pieces(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about ``most`` bytes of that column, so that what is made of them stays small."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part, a = np.cumsum(size) // most, 0
    for b in [*(np.flatnonzero(np.diff(part)) + 1), len(batch)]:
        if b > a:
            yield batch.slice(a, b - a)
        a = b


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset, a local session, as in tests, gets one of its own; a cluster has
    no folder that all machines are known to share, so there it is an error."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="windrow-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def settled(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and there after an executor is lost.  Gone with the session."""
    spark = df.sparkSession
    path = f"{folder(spark)}/windrow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    expire(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def expire(spark: SparkSession, path: str) -> None:
    """Delete this folder when the session ends."""
    _written.append((spark, path))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete the table of a ``settled`` result that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        with contextlib.suppress(Exception):
            delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1].rstrip("/").rsplit("/", 1)[-1] != path.rsplit("/", 1)[-1]]


@atexit.register
def discard() -> None:
    """Delete what ``settled`` has written."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            delete(spark, path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node reachable.

    Large-star and small-star in turn until nothing changes: each is an aggregate of minima and a join, so that no
    node's neighbours need to be in one place, and the number of edges never grows.
    """
    step = lambda e: settled(e.where("a <> b").distinct())
    links = step(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    last = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, links = links, step(small)
        release(before)
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
