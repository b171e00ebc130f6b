"""Mixing sources to target weights by systematic sampling.

Each document's expected copies, its source's target over its source's size, are summed up in order within the source;
one random offset per source is added, and the document is taken once per whole number that the sum crosses.  The order
is by size (in bands of a sixteenth of its power of two) and by hash within a band, so what is taken follows the
distribution of sizes.

The sum over a source, which may hold a third of all rows, is made in two steps: ranks within buckets of (source, band,
hash digits), and the buckets' own sums, of which there are at most some ten thousands per source however many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS, CAP, SEED = (1, 2, 3), 3, "windrow"
_WORD = r"[^\x20\x09-\x0D]+"
_BUCKET = ("__src", "__none", "__band", "__salt")


def _offset(seed: str) -> F.Column:
    """The random offset of a source, in 2**-20ths, so that sums of it with whole numbers are exact."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("__none").cast("string"), F.lit(":"), F.col("__src")).cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(__src, __none, source_size, target) of a table (__src, __none, n) of bucket sums: one row per source.

    These windows run over one row a source, in one task, in time that grows with the number of sources.  The share of each is the least of its cap and its weight times a level; the level is found where, by rising ratio of
    cap to weight, what the sources before leave reaches it."""
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("__none", "__src")) - 1) % len(weights) + 1).cast("int"))
    by_source = sized.groupBy("__src", "__none").agg(F.sum("__words").alias("source_size")).withColumn("__w", w)
    rise = Window.orderBy(F.col("source_size") * F.lit(cap) / F.col("__w"), "__none", "__src")
    levels = (
        by_source.withColumn("__ratio", F.col("source_size") * F.lit(cap) / F.col("__w"))
        .withColumn("__before", F.coalesce(F.sum(F.col("source_size") * cap).over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__left", F.sum("__w").over(Window.partitionBy()) - F.coalesce(F.sum("__w").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("__level", (F.col("__total") - F.col("__before")) / F.col("__left"))
    )
    level = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__none", "__src", "__level"))).over(Window.partitionBy())["__level"]
    return levels.withColumn("__at", level).select("__src", "__none", "source_size", F.least((F.col("source_size") * cap).cast("double"), F.col("__w") * F.col("__at")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Each row as ``__row``, with size, source_size, target and copies; select what is needed, explode by copies to mix.

    size is the number of words, 0 for a null or empty text; such rows are ranked like others and take no words; a very long
    text is counted whole.  Rows of one source, band and hash are ordered by doc_id, null first, and size.  A null
    source is a source of its own, after all others.  Rows that repeat are rows of their own; where all words count
    0, so do the targets; an empty table gives an empty one.  Columns of the input stay in ``__row``, so none can clash."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(_WORD)).cast("long")
    bits = F.greatest(F.length(F.bin("__words")) - 5, F.lit(0))
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.coalesce("source", F.lit("")).alias("__src"), F.col("source").isNull().cast("int").alias("__none"), size.alias("__words"), hashed.alias("__hash"), F.struct("*").alias("__row"),
    ).select("*", (bits * 32 + F.expr("shiftright(__words, cast(greatest(length(bin(__words)) - 5, 0) as int))")).cast("int").alias("__band"), F.substring("__hash", 1, 2).alias("__salt"))
    buckets = rows.groupBy(*_BUCKET).agg(F.count("*").alias("__n"), F.sum("__words").alias("__words"))
    before = F.sum("__n").over(Window.partitionBy("__src", "__none").orderBy("__band", "__salt").rowsBetween(Window.unboundedPreceding, -1))
    start = buckets.select(*_BUCKET, F.coalesce(before, F.lit(0)).alias("__start"))
    of = targets(buckets, weights, cap)
    plan = start.join(of, ["__src", "__none"]).select(*_BUCKET, "__start", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy(*_BUCKET).orderBy("__hash", "__row.doc_id", "__words"))
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    last = F.floor(F.col("__k") * rate + _offset(seed)) - F.floor((F.col("__k") - 1) * rate + _offset(seed))
    return (
        rows.withColumn("__rank", rank).join(plan, list(_BUCKET)).withColumn("__k", F.col("__start") + F.col("__rank"))
        .select("__row", F.col("__words").alias("size"), "source_size", "target", last.cast("long").alias("copies"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its own columns.  Null, empty and very long texts, repeated rows and
    empty tables are treated as ``mixed`` says."""
    taken = mixed(docs, weights, cap, seed).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
