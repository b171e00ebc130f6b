"""Sources in common units, samples, stored windows, runs and their bookkeeping, selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import index as I
from ..operators import normalise as N
from ..operators import search as S
from ..operators import selection as L
from ..sources import bars as B
from ..sources import sinks
from ..streaming import ticks as T
from .learning import _attempts
from .registry import query, rounded
from .similarity import _TOP, _path, norm


@query("""select symbol, '360' as frequency, timestamp, date, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume, round(amount, 6) as amount,
    0.0::double as turnover, round(coalesce(close - pc, 0), 6) + 0.0 as change, round(coalesce(100 * (close - pc) / nullif(pc, 0), 0), 6) + 0.0 as pct_change, round(coalesce(100 * (high - low) / nullif(pc, 0), 0), 6) + 0.0 as amplitude
    from (select *, lag(close) over (partition by symbol order by timestamp) as pc from (select * replace (case when slot = 2 and day(date) % 5 = 0 then null else close end as close) from minutes)) where close is not null""")
def minutes_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Bars of six hours, some without a closing price."""
    m = B.minutes(spark, d).withColumn("close", F.when((F.col("slot") == 2) & (F.day("date") % 5 == 0), None).otherwise(F.col("close")))
    return rounded(N.minutes(m.drop("slot", "date"), "360"))


@query("select symbol, timestamp, close from minutes where timestamp >= timestamp '2024-01-10 00:00:00' and timestamp <= timestamp '2024-01-12 23:59:59'")
def minutes_until_end_of_day(spark: SparkSession, d: str) -> DataFrame:
    return sinks.between(B.minutes(spark, d), "2024-01-10", "2024-01-12").select("symbol", "timestamp", "close")


@query("""select 'sina' as source, symbol, date, volume, round(turnover / 100 * 100, 6) as turnover from bars
    union all select 'tencent', symbol, date, volume, round(turnover, 6) from bars""")
def source_units(spark: SparkSession, d: str) -> DataFrame:
    b = B.daily(spark, d).select("symbol", "date", "volume", "turnover")
    sina = N.source_units(b.withColumn("turnover", F.col("turnover") / 100), "sina")
    tencent = N.source_units(b.withColumnRenamed("volume", "amount"), "tencent")
    return rounded(sina.withColumn("source", F.lit("sina")).unionByName(tencent.withColumn("source", F.lit("tencent"))), "volume")


@query("select name, regexp_matches(name, 'ST|退') as is_st from (select case s_suppkey % 4 when 0 then '*ST ' || s_name when 1 then s_name || '退' else s_name end as name from supplier)")
def st_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, F.concat(F.lit("*ST "), "s_name")).when(k == 1, F.concat("s_name", F.lit("退"))).otherwise(F.col("s_name"))
    return B.read(spark, d, "supplier").select(name.alias("name")).withColumn("is_st", N.is_st(F.col("name")))


@query("select symbol, date from bars order by md5('7|' || symbol || '|' || cast(date as varchar)), symbol, date limit 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return N.sample(B.daily(spark, d).select("symbol", "date"), 50, 7, ["symbol", "date"])


@query("select symbol, anchor from (select symbol, arg_min(date, md5('11|' || symbol || '|' || cast(date as varchar))) as anchor from bars group by symbol) order by md5('11|' || symbol), symbol limit 8")
def random_anchors(spark: SparkSession, d: str) -> DataFrame:
    return N.anchors(B.daily(spark, d), 8, 11)


@query("""select l_orderkey, list(symbol order by n, symbol) as symbols
    from (select l_orderkey, lpad(cast(l_suppkey as varchar), 6, '0') as symbol, min(l_linenumber) as n from lineitem group by 1, 2) group by 1""")
def ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = B.read(spark, d, "lineitem").withColumn("symbol", F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    return N.first_wins(rows, "l_orderkey", "symbol", ["l_linenumber"])


@query("""select symbol, left(sha256('{"industry":' || to_json(industry) || ',"is_st":' || is_st || ',"listing_date":"' || cast(listing_date as varchar) || '","name":' || coalesce(cast(to_json(name) as varchar), 'null') || '}'), 16) as fingerprint
    from (select * replace (case when is_st then null else name end as name) from profiles)""")
def canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    p = B.profiles(spark, d).withColumn("name", F.when(~F.col("is_st"), F.col("name")))
    return p.select("symbol", N.fingerprint("name", "industry", "listing_date", "is_st").alias("fingerprint"))


@query("""select symbol, date, factor, round(value, 8) as value from (select symbol, date, unnest(['change', 'pct_change', 'amplitude']) as factor, unnest([change, pct_change, amplitude]) as value from norm) where value > 0""")
def factor_map(spark: SparkSession, d: str) -> DataFrame:
    """Positive factors of a bar, kept as a map by name and told out again."""
    names = ("change", "pct_change", "amplitude")
    m = F.create_map(*(x for c in names for x in (F.lit(c), F.col(c))))
    kept = norm(spark, d).select("symbol", "date", F.map_filter(m, lambda _, v: v > 0).alias("m"))
    return kept.select("symbol", "date", F.explode("m").alias("factor", "value")).withColumn("value", F.round("value", 8))


@query("""with r as (select o_orderkey as run, case o_orderstatus when 'O' then 'running' else 'completed' end as status, o_orderdate as started_at from orders where o_orderkey % 50 < 40),
    a as (select l_orderkey as run, max(l_shipdate) as attempted_at from lineitem where l_linenumber > 2 group by 1), j as (select run, coalesce(attempted_at, started_at) as last_activity from r left join a using (run) where status = 'running')
    select run, last_activity from j where timestamp '2001-08-01 12:00:00' - last_activity > interval '525600 minutes'""")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    runs = B.read(spark, d, "orders").where("o_orderkey % 50 < 40").select(F.col("o_orderkey").alias("run"), status.alias("status"), F.col("o_orderdate").alias("started_at"))
    attempts = B.read(spark, d, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("run"), F.col("l_shipdate").alias("attempted_at"))
    return K.stale_runs(runs, attempts, F.lit("2001-08-01 12:00:00").cast("timestamp_ntz"), 525600)


_RUNS = """select o_orderkey as run, case o_orderkey % 2 when 0 then 'daily' else '5' end as frequency, [lpad(cast(o_custkey % 3 as varchar), 6, '0'), lpad(cast(o_custkey % 2 as varchar), 6, '0')] as symbols,
    case o_orderkey % 3 when 0 then null else date '1995-01-01' end as start_date, date '1995-12-31' as end_date, case o_orderstatus when 'O' then 'running' when 'F' then 'completed' else 'partial' end as status, o_orderdate as started_at from orders"""


@query(f"with r as ({_RUNS}) select * from r where frequency = 'daily' and list_sort(symbols) = ['000000', '000001'] and start_date = date '1995-01-01' and end_date = date '1995-12-31' and status in ('running', 'partial') order by started_at desc, run desc limit 1")
def resumable_run(spark: SparkSession, d: str) -> DataFrame:
    code = lambda n: F.lpad((F.col("o_custkey") % n).cast("string"), 6, "0")
    day = lambda x: F.lit(x).cast("date")
    runs = B.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 2 == 0, "daily").otherwise("5").alias("frequency"), F.array(code(3), code(2)).alias("symbols"),
        F.when(F.col("o_orderkey") % 3 != 0, day("1995-01-01")).alias("start_date"), day("1995-12-31").alias("end_date"),
        F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("partial").alias("status"), F.col("o_orderdate").alias("started_at"),
    )
    return K.resumable(runs, "daily", ["000001", "000000"], "1995-01-01", "1995-12-31")


_ATTEMPTS = """a as (select lpad(cast(o_custkey as varchar), 6, '0') as symbol, row_number() over (partition by o_custkey order by o_orderkey) as attempt,
    case o_orderstatus when 'O' then 'completed' when 'F' then 'failed' else 'partial' end as status from orders)"""


@query(f"with {_ATTEMPTS} select symbol, max(attempt) as attempts from a group by symbol having arg_max(status, attempt) <> 'completed' and max(attempt) < 9")
def backfill_retry(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("attempt")).cast("long")
    return K.retry(_attempts(spark, d).withColumn("attempt", nth), 9)


@query("""select symbol, date, n, round(coalesce(100 * (close - open) / nullif(open, 0), 0), 6) + 0.0 as day_return, round(coalesce(100 * (high - low) / nullif(open, 0), 0), 6) + 0.0 as day_range, round(coalesce((close - low) / nullif(high - low, 0), 0.5), 6) + 0.0 as close_position
    from (select symbol, date, count(*) as n, arg_min(price, row(timestamp, event_id)) as open, arg_max(price, row(timestamp, event_id)) as close, max(price) as high, min(price) as low from ticks group by 1, 2)""")
def stream_daily_factors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.drained(T.daily_factors(T.ticks(T.read(spark, f"{d}/events.parquet"), "1 day"))))


_OPT = """o as (select l_suppkey, l_returnflag, case l_returnflag when 'A' then 'candidate_agreement' when 'N' then 'probability_band' else 'meta_correctness' end as method, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as place,
    count(*) as n, count(*) filter (where l_discount <= 0.05) / count(*) as accuracy, count(*) filter (where l_quantity <= 25) / count(*) as wilson, count(*) filter (where l_quantity <= 20) / count(*) as stable,
    count(*) filter (where l_tax <= 0.01) / count(*) as coverage, l_suppkey % 5 = 0 and l_returnflag <> 'A' as eligible from lineitem group by all),
    s as (select *, case when eligible then 0 when n >= 200 and coverage >= 0.1 then 1 when n > 0 then 2 else 3 end as pool, wilson * 0.55 + (case when stable = 0 then wilson else stable end) * 0.45 + accuracy * 0.2 + least(coverage, 0.3::double) * 0.08
    + least(n / 1000, 1.0::double) * 0.02 + case when eligible then 0.08::double else 0 end + case method when 'candidate_agreement' then 0.035::double when 'meta_correctness' then 0.015 else 0 end
    - case when method = 'probability_band' and not eligible then least(0.05::double, greatest(wilson - (case when stable = 0 then wilson else stable end), 0)) else 0 end as score from o)"""


@query(f"with {_OPT} select l_suppkey, method, pool, round(score, 6) as score, n from (select *, row_number() over (partition by l_suppkey order by pool, score desc, place) as r from s) where r = 1")
def confidence_selector(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("l_returnflag")
    share = lambda c: (F.count_if(c) / F.count("*"))
    o = B.read(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count("*").alias("n"), share(F.col("l_discount") <= 0.05).alias("accuracy"), share(F.col("l_quantity") <= 25).alias("wilson"), share(F.col("l_quantity") <= 20).alias("stable_wilson"), share(F.col("l_tax") <= 0.01).alias("coverage")
    )
    o = o.select("*", F.when(f == "A", "candidate_agreement").when(f == "N", "probability_band").otherwise("meta_correctness").alias("method"), F.when(f == "A", 0).when(f == "N", 1).otherwise(2).alias("place"), ((F.col("l_suppkey") % 5 == 0) & (f != "A")).alias("eligible"))
    return rounded(L.select(o, ["l_suppkey"], "place"))


@query("""select cast(o_orderkey as varchar) as run_id, o_orderdate as generated_at, round(o_totalprice / 1000000, 6) as accuracy, 0.25::double as brier from orders where o_orderstatus = 'F' order by generated_at desc, run_id desc limit 1""")
def train_gate(spark: SparkSession, d: str) -> DataFrame:
    """The latest run that passed, by the JSON of its artifact."""
    body = F.to_json(F.struct(F.struct(F.struct((F.col("o_orderstatus") == "F").alias("passed")).alias("acceptance"), F.round(F.col("o_totalprice") / 1000000, 6).alias("accuracy"), F.lit(0.25).alias("brier")).alias("result")))
    return L.passed(B.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("generated_at"), body.alias("body")))


@query("select 5 as window_size, count(*) as n_windows, count(distinct symbol) as symbols, max(end_date) as built_latest, max(len(price_path) + len(candle_geometry) + len(volume_liquidity)) as dimensions from enc5")
def index_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Windows stored and described by their manifest."""
    return I.build(norm(spark, d), 5, T.folder(spark), 1).select("window_size", "n_windows", "symbols", "built_latest", "dimensions")


@query(f"with {_TOP} select symbol, start_date, end_date, round(distance, 6) as distance, round(score, 6) as score from top")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """The windows most like the last one of the first symbol, one a symbol, from stored windows alone."""
    root = T.folder(spark)
    I.build(norm(spark, d), 5, root, 1)
    rows = I.load(spark, root, 5)
    # the query's row is found by the files' statistics, and nothing is encoded again
    first = rows.agg(F.min("symbol").alias("symbol"))
    q = rows.join(F.broadcast(first), "symbol", "left_semi").orderBy(F.col("end_date").desc()).limit(1)  # one row
    pairs = rows.crossJoin(F.broadcast(q.select(*(F.col(c).alias(f"q_{c}") for c in I.COLUMNS))))
    o = S.overlap_days(F.col("start_date"), F.col("end_date"), F.col("q_start_date"), F.col("q_end_date"))
    far = pairs.where(~((F.col("symbol") == F.col("q_symbol")) & (o > S.OVERLAP_DAYS)))
    near = far.withColumn("l2", S.euclid(F.concat("price_path", "candle_geometry"), F.concat("q_price_path", "q_candle_geometry"))).orderBy("l2", "symbol", "end_date").limit(200)
    b = S.balanced({"price_path": _path(5), "candle_geometry": S.rmse(F.col("candle_geometry"), F.col("q_candle_geometry"))})
    scored = near.select("symbol", "start_date", "end_date", b.alias("distance"), S.similarity(b).alias("score"))
    best = S.best_per(scored, ["symbol"], [F.col("score").desc(), F.col("distance"), F.col("end_date")], 1)
    return rounded(best.orderBy(F.col("score").desc(), "distance", "symbol", "end_date").limit(10).select("symbol", "start_date", "end_date", "distance", "score"))
