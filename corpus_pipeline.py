"""A corpus pipeline of five stages, each over what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import bpe, lines, mixing, quality, simhash
from windrow.llm.shared import delete, expire, folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is poor, or that fail the base rules, go."""
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, but for one word at most, go; documents stay."""
    return lines.deduplicated(docs).drop("__lines")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least doc_id stays: shingles of five words, a similarity of 0.8 or more."""
    return simhash.keep_first(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated, so that sources meet their target weights."""
    return mixing.mix(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, and the SHA-256 of the text that they decode to."""
    import public_tokenizers

    found = bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Posteriors, fingerprints and merges are beyond SQL; tests/llm compares run() with a chain of brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; each stage's rows are written as Parquet in the shared folder and read again.  A stage's
    table goes when the next one has been written, the last one with the session."""
    import uuid

    docs, root = table(spark, sf_dir, "documents"), f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    expire(spark, root)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{root}/{k}")
        docs = spark.read.parquet(path)
        if k:
            delete(spark, f"{root}/{k - 1}")
    return docs
