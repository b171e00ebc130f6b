"""Line deduplication over the whole corpus by a deletion-neighbourhood join, in words.

Two lines are alike where one word replaced, put in or left out makes them the same.  Every line that can have such a
partner emits its variants, each with one word deleted, as hashed keys.  Lines that share a variant made at the same
place differ in that word alone, so all of them link to the earliest; a line that equals another's variant links to
it.  So links number less than variants, and no pairs within a group are made.  Each link's edit distance is then
verified on the words, and of two linked lines the earlier stays.

Only a line that shares its first or its last half with another can have a partner (one edit leaves one of the halves as
it is); all others are left out beforehand by an aggregate over hashed halves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, release, settled

#: The edit bound is one word in lines of so many words, a third of them at most, and none in shorter ones, which go only
#: where they are equal: in a line of one word one edit makes it any other such line.
NEAR_WORDS = 3
#: The column that deduplicated() adds.
LINES = "__lines"
_SPACE = r"[\x20\x09\x0B-\x0D]+"


def _words(line: F.Column) -> F.Column:
    """The words of a line: the empty strings that white space at its ends leaves are dropped."""
    return F.filter(F.split(line, _SPACE), lambda w: w != "")


def _text() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _key() -> F.Column:
    return F.xxhash64("doc_id", _text())


def lines_of(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(at struct<doc_id, key, line>, n, h, halves) of each line with a word: its place, its words' number and hash, and the hashes of its halves."""
    cut = docs.select("doc_id", _key().alias("key"), F.posexplode(F.split(_text(), "\n")).alias("line", "s")).select("doc_id", "key", "line", _words(F.col("s")).alias("w"))
    n = F.size("w")
    half = lambda m: (F.xxhash64(F.lit(0), m, F.slice("w", 1, m)), F.xxhash64(F.lit(1), m, F.slice("w", n - m + 1, m)))
    long_, short = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    halves = F.when(n < near_words, F.array().cast("array<bigint>")).when(long_ == short, F.array(*half(long_))).otherwise(F.array(*half(long_), *half(short)))
    return cut.where(n > 0).select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "line").alias("at"), n.alias("n"), F.xxhash64("w", n).alias("h"), halves.alias("halves"))


def _links(wanted: DataFrame) -> DataFrame:
    """(h, other): links between lines of a table (h, first, w), each from the later line to the earlier one, verified."""
    words = wanted.select("h", "first", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    w = Window.partitionBy("h").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # the exclusive or of the places' hashes undoes itself: what stands after a word is all but what runs up to it
    parts = words.withColumn("here", F.xxhash64("i", "word")).withColumn("moved", F.xxhash64(F.col("i") - 1, "word"))
    runs = parts.withColumn("upto", F.bit_xor("here").over(w)).withColumn("shifted", F.bit_xor("moved").over(w)).withColumn("all", F.bit_xor("moved").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sums = runs.select(
        "h", "first", "n", "i", F.col("upto").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("all")).bitwiseXOR(F.col("shifted")).alias("variant"), F.when(F.col("i") == F.col("n") - 1, F.col("upto")).alias("full"),
    )
    sums = settled(sums)
    group = ["n", "i", "variant"]
    least = sums.groupBy(*group).agg(F.count("*").alias("c"), F.min(F.struct("first", "h")).alias("least")).where("c > 1").select(*group, F.col("least.h").alias("other"))
    replaced = sums.join(least, group).where("h <> other").select("h", "other", "i")
    whole = sums.where("full is not null").select(F.col("n").alias("n2"), F.col("full").alias("variant"), F.col("h").alias("other"), F.col("first").alias("first2"))
    shorter = sums.join(whole, (sums["n"] - 1 == whole["n2"]) & (sums["variant"] == whole["variant"])).select("h", "other", "i", (F.col("first") > F.col("first2")).alias("later"))
    found = replaced.select("h", "other", "i", F.lit(False).alias("shorter"), F.lit(True).alias("later")).unionByName(shorter.withColumn("shorter", F.lit(True)))
    a, b = wanted.select("h", F.col("w").alias("wa")), wanted.select(F.col("h").alias("other"), F.col("w").alias("wb"))
    differ = F.size(F.filter(F.zip_with("wa", "wb", lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
    left_out = F.filter("wa", lambda _, k: k != F.col("i")) == F.col("wb")
    sound = found.join(a, "h").join(b, "other").where(F.when(F.col("shorter"), left_out).otherwise((F.size("wa") == F.size("wb")) & (differ == 1)))
    out = settled(sound.select(F.when(F.col("later"), F.col("h")).otherwise(F.col("other")).alias("h"), F.when(F.col("later"), F.col("other")).otherwise(F.col("h")).alias("other")))
    release(sums)
    return out


def removed(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, key, gone array<int>), a table of its own: which lines of which document go.

    A line goes where an earlier line of the corpus, by doc_id (null last), text's hash and place, has the same words, or
    words one edit away; both are judged on the input, not on what is left."""
    rows = settled(lines_of(docs, near_words))
    distinct = settled(rows.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("halves").alias("halves")))
    halves = distinct.select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    wanted = halves.join(shared, "half", "left_semi").select("h").distinct().join(distinct.select("h", "first"), "h")
    # the words of one occurrence of each such line
    sought = wanted.select(F.col("first.doc_id").alias("d"), F.col("first.key").alias("k"), F.struct(F.col("first.line").alias("line"), "h").alias("x")).groupBy("k").agg(F.collect_list("x").alias("xs"))
    texts = docs.select("doc_id", _key().alias("k"), F.split(_text(), "\n").alias("s")).join(sought, "k").select(F.explode("xs").alias("x"), "s").select("x.h", _words(F.element_at("s", F.col("x.line") + 1)).alias("w"))
    wanted = settled(texts.dropDuplicates(["h"]).join(distinct.select("h", "first"), "h"))
    links = _links(wanted)
    near = links.select("h").distinct().withColumn("near", F.lit(True))
    marks = distinct.join(near, "h", "left").where("c > 1 or near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = rows.select("h", "at").join(marks, "h").where(F.col("near") | (F.col("at") != F.col("first")))
    out = settled(gone.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.key").alias("key")).agg(F.collect_set("at.line").alias("gone")))
    for used in (rows, distinct, wanted, links):  # before the texts are dealt out
        release(used)
    return out


def deduplicated(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """The rows with their lines' duplicates taken out of ``text`` and, where there is such a column, n_chars to match,
    and ``n_lines`` and ``n_gone`` as long integers in a struct ``__lines``.

    Lines are cut at \\n; those without words stay.  A very long line is compared whole, in time that grows with its length.
    Of equal lines in one document the first stays; of two equal documents the one of lesser doc_id.  A null text stays null and has no lines.  Rows equal in doc_id and text
    are one document, whose lines go or stay alike; rows with one doc_id and different texts are documents of
    their own.  An empty table gives an empty one; other columns stay as they are."""
    key, gone_, all_, new = free(docs, "key", "gone", "all", "new")
    gone = removed(docs.select("doc_id", "text"), near_words).select(F.col("key").alias(key), F.col("gone").alias(gone_))
    joined = docs.withColumn(key, _key()).join(gone, key, "left").withColumn(all_, F.split(_text(), "\n"))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(gone_)), lambda i: F.element_at(all_, i + 1)), "\n")
    text = F.when(F.col("text").isNull() | F.col(gone_).isNull(), F.col("text")).otherwise(left)
    out = joined.withColumn(new, text)
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(all_)).cast("long")
    own = [F.col(new).alias("text") if c == "text" else F.length(new).cast(t).alias(c) if c == "n_chars" and t in ("int", "bigint") else F.col(f"`{c}`") for c, t in docs.dtypes]
    return out.select(*own, F.struct(count.alias("n_lines"), F.when(F.col(gone_).isNull(), F.lit(0)).otherwise(F.size(gone_)).cast("long").alias("n_gone")).alias(LINES))
