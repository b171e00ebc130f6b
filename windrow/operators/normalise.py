"""Bars normalised, keys cleaned, rows merged and looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import lag_null, ordered

MAIN_BOARD = ("600", "601", "603", "605", "000", "001", "002", "003")
# Three-digit prefixes of exchanges; all other symbols are sz.
EXCHANGES = {
    "sh": "600 601 603 605 688 689 900 730 732 733 734 735 736".split(),
    "bj": "430 431 830 831 832 833 834 835 836 837 838 839 870 871 872 873 899 920".split(),
}
# Symbols that suggestions prefer, in this order.
PREFERRED = "000333 600036 600900 601166 300750 002594".split()


def bars(df: DataFrame) -> DataFrame:
    """Adds change, pct_change and amplitude; turnover, amount and volume default to 0; rows without prices go."""
    for c in ("volume", "amount", "turnover"):
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0))
    df = df.dropna(subset=["open", "high", "low", "close"])
    before = lag_null("close")
    rate = lambda x: F.coalesce(100 * x / F.nullif(before, F.lit(0.0)), F.lit(0.0))
    return df.select("*", F.coalesce(F.col("close") - before, F.lit(0.0)).alias("change"), rate(F.col("close") - before).alias("pct_change"), rate(F.col("high") - F.col("low")).alias("amplitude"))


def minutes(df: DataFrame, frequency: str) -> DataFrame:
    """Bars of minutes: the day of the timestamp as date, and change, pct_change and amplitude where the source lacks them; volume,
    amount and turnover default to 0; rows without a timestamp or prices go, after the row before them has been looked up."""
    own = Window.partitionBy("symbol").orderBy("timestamp")
    before = F.lag("close").over(own)
    rate = lambda x: 100 * x / F.nullif(before, F.lit(0.0))
    given = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    made = {"change": F.col("close") - before, "pct_change": rate(F.col("close") - before), "amplitude": rate(F.col("high") - F.col("low")), "volume": None, "amount": None, "turnover": None}
    cells = [F.coalesce(given(c), *([e] if e is not None else []), F.lit(0.0)).alias(c) for c, e in made.items()]
    rows = df.select("symbol", F.lit(frequency).alias("frequency"), "timestamp", F.col("timestamp").cast("date").alias("date"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), *cells)
    return rows.dropna(subset=["timestamp", "open", "high", "low", "close"])


def source_units(df: DataFrame, source: str) -> DataFrame:
    """Bars of a source in common units: ``sina`` gives turnover as a fraction, ``tencent`` calls volume amount."""
    if source == "sina" and "turnover" in df.columns:
        return df.withColumn("turnover", F.col("turnover").cast("double") * 100.0)
    if source == "tencent" and "amount" in df.columns:
        return df.drop("volume").withColumnRenamed("amount", "volume")
    return df


def is_st(name: Column) -> Column:
    """Whether a name marks special treatment or delisting."""
    return F.coalesce(name.rlike("ST|退"), F.lit(False))


def sample(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n rows, the same in every run and however the rows are dealt: those of least hash of the seed and the keys."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))
    return df.withColumn("__h", h).orderBy("__h", *keys).limit(n).drop("__h")


def anchors(df: DataFrame, n: int, seed: int, key: str = "symbol", time: str = "date") -> DataFrame:
    """Of n symbols, in an order shuffled by the seed, one day each, drawn by the seed from the symbol's days."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key), F.col(time).cast("string")).cast("binary"))
    one = df.groupBy(key).agg(F.min_by(time, F.struct(draw, F.col(time))).alias("anchor"))
    return sample(one, n, seed, [key])


def first_wins(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """By key, the distinct values in the order in which they first come."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value)))
    return df.groupBy(key).agg(F.array_distinct(F.transform(rows, lambda x: x[value])).alias(f"{value}s"))


def fingerprint(*columns: str) -> Column:
    """Sixteen digits of the SHA-256 of the columns as JSON, keys in natural order, nulls written out."""
    return F.left(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256), F.lit(16))


def symbol(raw: Column) -> Column:
    """Six digits: exchange prefixes go one after the other, then all but digits; padded, and the last six kept."""
    s = F.lower(F.trim(raw))
    for prefix in ("sh", "sz", "bj", "csi"):
        s = F.regexp_replace(s, f"^{prefix}", "")
    digits = F.regexp_replace(s, r"\D", "")
    return F.right(F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits), F.lit(6))


def exchange(code: Column) -> Column:
    head = F.left(code, F.lit(3))
    return F.when(head.isin(EXCHANGES["sh"]), "sh").when(head.isin(EXCHANGES["bj"]), "bj").otherwise("sz")


def main_board(code: Column) -> Column:
    return F.left(code, F.lit(3)).isin(*MAIN_BOARD)


def listing_days(listed: Column, as_of: Column) -> Column:
    return F.greatest(F.datediff(as_of, listed), F.lit(0))


def last_rows(df: DataFrame, n: int, key: str = "symbol", time: str = "date") -> DataFrame:
    """Each key's last n rows, ascending again when ordered."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc()))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def keep(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by the order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def merge_sources(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where both have a key the primary's row wins."""
    both = primary.withColumn("__p", F.lit(0)).unionByName(fallback.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return keep(both, keys, [F.col("__p")]).drop("__p")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by name, with columns that either lacks null; the later row of a key wins."""
    both = old.withColumn("__p", F.lit(0)).unionByName(new.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return keep(both, keys, [F.col("__p").desc()]).drop("__p")


def complete(df: DataFrame, least: int = 120) -> DataFrame:
    return df.groupBy("symbol").agg(F.count("*").alias("n_rows")).withColumn("is_complete", F.col("n_rows") >= max(least, 60))


def _asked(query: str) -> str:
    q = query.strip()
    return q.zfill(6) if q.isdigit() else q


def resolve(universe: DataFrame, query: str, cached: DataFrame | None = None) -> DataFrame:
    """(symbol, name, match_type): the one symbol that a query names, by its code, its name, or a part of a name that no other has;
    digits that name none stand for themselves.  Symbols are looked for among the ``cached`` ones, if the universe has any."""
    q = _asked(query)
    if not q:
        return universe.select("symbol", "name", F.lit("").alias("match_type")).limit(0)
    known = universe.select("symbol", F.coalesce("name", F.lit("")).alias("name"))
    if cached is not None:
        some = known.join(cached.select("symbol").distinct(), "symbol", "left_semi").withColumn("own", F.lit(True))
        known = known.join(some.select("symbol", "own"), "symbol", "left").withColumn("any", F.max("own").over(Window.partitionBy())).where("own or any is null")  # a row a symbol
    low = F.lower("name")
    kind = F.when(F.col("symbol") == q, "symbol").when(low == q.lower(), "name").when(low.contains(q.lower()), "name_partial")
    found = known.select("symbol", "name", kind.alias("match_type"), F.when(kind == "symbol", 0).when(kind == "name", 1).otherwise(2).alias("rank")).where("match_type is not null")
    same = F.count("*").over(Window.partitionBy("rank"))  # few rows match
    # a name that is equal is a part too, and several of them are none
    parts = found.where("rank > 0").agg(F.count("*").alias("n"))
    one = found.withColumn("same", same).crossJoin(F.broadcast(parts)).where((F.col("rank") == 0) | ((F.col("rank") == 1) & (F.col("same") == 1)) | ((F.col("rank") == 2) & (F.col("n") == 1)))
    best = one.orderBy("rank", "symbol").limit(1).select("symbol", F.nullif("name", F.lit("")).alias("name"), "match_type")
    if not q.isdigit():
        return best
    own = universe.sparkSession.range(1).select(F.lit(q).alias("symbol"), F.lit(None).cast("string").alias("name"), F.lit("symbol").alias("match_type"))
    return best.unionByName(own.join(best.select(F.lit(1).alias("x")), F.lit(True), "left_anti"))


def choices(universe: DataFrame, query: str, limit: int = 12, cached: DataFrame | None = None) -> DataFrame:
    """Suggestions: by how well the code matches, how well the name does, the preferred ones, then the code.  ``cached`` symbols
    that the universe lacks come without a name, and others are left out."""
    q = _asked(query)
    rows = universe.select("symbol", "name")
    if cached is not None:
        rows = cached.select("symbol").distinct().join(rows, "symbol", "left").select("symbol", "name")
    name = F.lower(F.coalesce("name", F.lit("")))
    code = F.when(F.col("symbol") == q, 0).when(F.col("symbol").startswith(q), 1).otherwise(2)
    named = F.when(name.startswith(q.lower()), 0).when(name.contains(q.lower()), 1).otherwise(2)
    liked = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("symbol")), F.lit(0)) - 1, F.lit(len(PREFERRED)))
    ranked = rows.select("symbol", "name", code.alias("symbol_rank"), named.alias("name_rank"), liked.cast("int").alias("preferred_rank"))
    return ranked.where(F.lit(q == "") | F.col("symbol").contains(q) | name.contains(q.lower())).orderBy(*(["symbol_rank", "name_rank"] if q else []), "preferred_rank", "symbol").limit(max(limit, 1))


def bounds(df: DataFrame, time: str = "date") -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"))


def positions(df: DataFrame) -> DataFrame:
    return df.withColumn("row_index", F.row_number().over(ordered()) - 1)
