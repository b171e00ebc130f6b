"""The queries op1 to op10 over the table ``documents``, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, lines, minhash, mixing, privacy, quality, secrets, simhash, substrings
from .shared import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("__row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.replaced(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.col("__found")[k].alias(f"n_{k}") for k in privacy.KINDS), "text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = secrets.scanned(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["base"])
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compared(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "__lines.n_lines", F.col("__lines.n_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_surrogates": op3_surrogates,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_classifier": op6_classifier,
    "op7_secrets": op7_secrets,
    "op8_minhash": op8_minhash,
    "op9_bpe": op9_bpe,
    "op10_line_dedup": op10_line_dedup,
}
