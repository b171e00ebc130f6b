"""Scans, filters, normalisers, merges and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalise as N
from ..sources import bars as B
from .registry import query, rounded


@query("select * from bars")
def bars_daily(spark: SparkSession, d: str) -> DataFrame:
    return B.daily(spark, d)


@query("select symbol, date, close from bars where date between date '1996-01-01' and date '1996-12-31'")
def bars_time_range(spark: SparkSession, d: str) -> DataFrame:
    return B.daily(spark, d).where(F.col("date").between("1996-01-01", "1996-12-31")).select("symbol", "date", "close")


@query("select symbol, date, close from bars where symbol in ('000001', '000002', '000003')")
def bars_symbols_filter(spark: SparkSession, d: str) -> DataFrame:
    return B.daily(spark, d).where(F.col("symbol").isin("000001", "000002", "000003")).select("symbol", "date", "close")


@query("select symbol, date, round(change, 8) as change, round(pct_change, 6) as pct_change, round(amplitude, 6) as amplitude from norm")
def bars_normalized(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.bars(B.daily(spark, d)).select("symbol", "date", F.round("change", 8).alias("change"), "pct_change", "amplitude"), "change")


@query("""select raw, right(case when length(x) < 6 then lpad(x, 6, '0') else x end, 6) as symbol from
    (select raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^sh', ''), '^sz', ''), '^bj', ''), '^csi', ''), '\\D', '', 'g') as x
     from (select distinct ['SH', 'sz', 'bj', 'csi', ''][cast(s_suppkey % 5 as int) + 1] || cast(s_suppkey * 977 as varchar) || ['.XX', ' '][cast(s_suppkey % 2 as int) + 1] as raw from supplier))""")
def symbol_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    prefix = F.element_at(F.array(*map(F.lit, ("SH", "sz", "bj", "csi", ""))), (k % 5 + 1).cast("int"))
    raw = F.concat(prefix, (k * 977).cast("string"), F.element_at(F.array(F.lit(".XX"), F.lit(" ")), (k % 2 + 1).cast("int")))
    return B.read(spark, d, "supplier").select(raw.alias("raw")).distinct().select("raw", N.symbol(F.col("raw")).alias("symbol"))


@query("""select symbol, case when left(symbol, 3) in ('600', '601', '603', '605', '688', '689', '900', '730', '732', '733', '734', '735', '736') then 'sh'
    when left(symbol, 3) between '830' and '839' or left(symbol, 3) between '870' and '873' or left(symbol, 3) in ('430', '431', '899', '920') then 'bj' else 'sz' end as exchange
    from (select distinct lpad(cast(l_partkey * 7919 % 1000000 as varchar), 6, '0') as symbol from lineitem)""")
def exchange_infer(spark: SparkSession, d: str) -> DataFrame:
    code = F.lpad((F.col("l_partkey") * 7919 % 1000000).cast("string"), 6, "0")
    return B.read(spark, d, "lineitem").select(code.alias("symbol")).distinct().select("symbol", N.exchange(F.col("symbol")).alias("exchange"))


@query("select symbol, name from profiles where not coalesce(is_st, false)")
def st_exclude(spark: SparkSession, d: str) -> DataFrame:
    return B.profiles(spark, d).where(~F.coalesce("is_st", F.lit(False))).select("symbol", "name")


@query("select distinct symbol from bars where left(symbol, 3) in ('600', '601', '603', '605', '000', '001', '002', '003')")
def main_board(spark: SparkSession, d: str) -> DataFrame:
    return B.daily(spark, d).where(N.main_board(F.col("symbol"))).select("symbol").distinct()


@query("select symbol, cast(greatest(date_diff('day', listing_date, date '1995-06-30'), 0) as int) as listing_days from profiles")
def listing_days(spark: SparkSession, d: str) -> DataFrame:
    return B.profiles(spark, d).select("symbol", N.listing_days(F.col("listing_date"), F.lit("1995-06-30").cast("date")).alias("listing_days"))


@query("select symbol, max(date) as last_date, count(*) as n_rows from bars where date <= date '1998-06-30' group by symbol")
def asof_truncate(spark: SparkSession, d: str) -> DataFrame:
    return B.daily(spark, d).where(F.col("date") <= "1998-06-30").groupBy("symbol").agg(F.max("date").alias("last_date"), F.count("*").alias("n_rows"))


@query("select symbol, date, close from (select *, row_number() over (partition by symbol order by date desc) as r from bars) where r <= 5")
def last_n_bars(spark: SparkSession, d: str) -> DataFrame:
    return N.last_rows(B.daily(spark, d), 5).select("symbol", "date", "close")


_ODD = "select symbol, date, close from bars where day(date) % 2 = 1"


@query(f"""with a as ({_ODD}), b as (select symbol, date, close * 2 as close, volume from bars where month(date) <= 6)
    select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.date, b.date) as date, case when a.symbol is not null then a.close else b.close end as close,
    case when a.symbol is null then b.volume end as volume from a full join b on a.symbol = b.symbol and a.date = b.date""")
def source_merge(spark: SparkSession, d: str) -> DataFrame:
    bars = B.daily(spark, d)
    first = bars.where("day(date) % 2 = 1").select("symbol", "date", "close")
    second = bars.where("month(date) <= 6").select("symbol", "date", (F.col("close") * 2).alias("close"), "volume")
    return N.merge_sources(first, second, ["symbol", "date"])


@query("select symbol, count(*) as n_rows, count(*) >= 120 as is_complete from bars group by symbol")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return N.complete(B.daily(spark, d))


@query("""with b as (select symbol, date, close + 1 as close, volume from bars where date >= date '1998-01-01')
    select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.date, b.date) as date, coalesce(b.close, a.close) as close, case when b.symbol is not null then b.volume end as volume
    from (select symbol, date, close from bars where date < date '1999-01-01') a full join b on a.symbol = b.symbol and a.date = b.date""")
def upsert_keep_last(spark: SparkSession, d: str) -> DataFrame:
    bars = B.daily(spark, d)
    old = bars.where(F.col("date") < "1999-01-01").select("symbol", "date", "close")
    new = bars.where(F.col("date") >= "1998-01-01").select("symbol", "date", (F.col("close") + 1).alias("close"), "volume")
    return N.upsert(old, new, ["symbol", "date"])


@query("select p_brand as industry_code, lpad(cast(l_suppkey as varchar), 6, '0') as symbol, max(l_orderkey * 10 + l_linenumber) as last_seen from lineitem join part on l_partkey = p_partkey group by 1, 2")
def membership_dedup(spark: SparkSession, d: str) -> DataFrame:
    li, p = B.read(spark, d, "lineitem"), B.read(spark, d, "part")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("p_brand").alias("industry_code"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("last_seen"))
    return N.keep(rows, ["industry_code", "symbol"], [F.col("last_seen").desc()])


@query("""select symbol, date, close, null::double as volume from bars where date < date '1995-06-01'
    union all select symbol, date, null, volume from bars where date between date '1995-06-01' and date '1995-12-31'""")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    bars = B.daily(spark, d)
    a = bars.where(F.col("date") < "1995-06-01").select("symbol", "date", "close")
    b = bars.where(F.col("date").between("1995-06-01", "1995-12-31")).select("date", "symbol", "volume")
    return a.unionByName(b, allowMissingColumns=True)


_CACHED = "(select distinct symbol from bars where date < date '1995-02-01')"


@query(f"select symbol, name from profiles where symbol in {_CACHED}")
def cached_semi(spark: SparkSession, d: str) -> DataFrame:
    cached = B.daily(spark, d).where(F.col("date") < "1995-02-01").select("symbol").distinct()
    return B.profiles(spark, d).join(cached, "symbol", "left_semi").select("symbol", "name")


@query(f"select symbol, cast(null as varchar) as name from {_CACHED} where symbol not in (select symbol from profiles where not is_st)")
def missing_anti(spark: SparkSession, d: str) -> DataFrame:
    cached = B.daily(spark, d).where(F.col("date") < "1995-02-01").select("symbol").distinct()
    known = B.profiles(spark, d).where(~F.col("is_st"))
    return cached.join(known, "symbol", "left_anti").select("symbol", F.lit(None).cast("string").alias("name"))


@query("select distinct symbol from bars where year(date) = 1996 except select symbol from bars where date between date '1996-01-01' and date '1996-02-15'")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    bars = B.daily(spark, d)
    return bars.where("year(date) = 1996").select("symbol").distinct().subtract(bars.where(F.col("date").between("1996-01-01", "1996-02-15")).select("symbol"))


@query("select symbol from bars where date between date '1996-01-01' and date '1996-02-15' intersect select symbol from bars where date between date '1997-01-01' and date '1997-02-15'")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    at = lambda a, b: B.daily(spark, d).where(F.col("date").between(a, b)).select("symbol")
    return at("1996-01-01", "1996-02-15").intersect(at("1997-01-01", "1997-02-15"))


@query("""with m as (select symbol, name from profiles where symbol in (select symbol from bars) and contains(lower(name), 'supplier#00000007'))
    select min(symbol) as symbol, min(name) as name, 'name_partial' as match_type from m having count(*) = 1 and max(lower(name)) <> 'supplier#00000007'
    union all select symbol, name, 'symbol' from profiles where symbol = '000007' union all select '999123', null, 'symbol' where '999123' not in (select symbol from profiles)""")
def symbol_resolve(spark: SparkSession, d: str) -> DataFrame:
    """What a part of a name, a short code and an unknown code name."""
    known, cached = B.profiles(spark, d), B.daily(spark, d).select("symbol")
    return N.resolve(known, "Supplier#00000007", cached).unionByName(N.resolve(known, " 7 ", cached)).unionByName(N.resolve(known, "999123", cached))


@query("""with c as (select b.symbol, name from (select distinct symbol from bars) b left join profiles p using (symbol)), r as (select symbol, name,
    case when symbol = '000012' then 0 when starts_with(symbol, '000012') then 1 else 2 end as symbol_rank,
    case when starts_with(lower(name), '000012') then 0 when contains(lower(name), '000012') then 1 else 2 end as name_rank,
    case symbol when '000333' then 0 when '600036' then 1 when '600900' then 2 when '601166' then 3 when '300750' then 4 when '002594' then 5 else 6 end as preferred_rank from c)
    select * from r where contains(symbol, '000012') or contains(lower(name), '000012') order by symbol_rank, name_rank, preferred_rank, symbol limit 12""")
def symbol_choices(spark: SparkSession, d: str) -> DataFrame:
    return N.choices(B.profiles(spark, d), "12", cached=B.daily(spark, d))


@query("select min(date) as first, max(date) as last, count(*) as n_rows, count(distinct symbol) as n_symbols from bars")
def frame_bounds(spark: SparkSession, d: str) -> DataFrame:
    return N.bounds(B.daily(spark, d))


@query("select * from minutes")
def minute_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.minutes(spark, d)
