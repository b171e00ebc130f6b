"""Labels, factor snapshots, analogue votes, blends and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import factors as P
from ..operators import search as S
from ..sources import bars as B
from .registry import VIEWS, query, rounded
from .similarity import _r, norm_industry

VIEWS |= {
    "lab": """select symbol, date, h as horizon, d2, case when d2 is not null then 100 * (c2 / nullif(close, 0) - 1) end as return_pct, o2, h2, l2, c2 from
        (select symbol, date, close, unnest([1, 2]) as h, unnest([lead(date, 1) over w, lead(date, 2) over w]) as d2, unnest([lead(open, 1) over w, lead(open, 2) over w]) as o2,
        unnest([lead(high, 1) over w, lead(high, 2) over w]) as h2, unnest([lead(low, 1) over w, lead(low, 2) over w]) as l2, unnest([lead(close, 1) over w, lead(close, 2) over w]) as c2
        from bars window w as (partition by symbol order by date))""",
    "scn": """select symbol, date, horizon, return_pct, case when return_pct >= 3 then 'strong_up' when return_pct <= -3 then 'strong_down'
        when (h2 - greatest(o2, c2)) / greatest(h2 - l2, 1e-9) >= 0.45 then 'upper_shadow_pressure' when (least(o2, c2) - l2) / greatest(h2 - l2, 1e-9) >= 0.45 then 'lower_shadow_support'
        when return_pct > 0 then 'mild_up' when return_pct < 0 then 'mild_down' when return_pct is not null then 'flat' end as scenario from lab""",
    "cut": "select *, row_number() over (partition by symbol order by date desc) as back from bars where date <= date '1999-06-30'",
    "sn1": """select *, lag(close) over w as p1, coalesce(100 * (close / nullif(lag(close, 1) over w, 0) - 1), 0) as r1, coalesce(100 * (close / nullif(lag(close, 3) over w, 0) - 1), 0) as r3,
        coalesce(100 * (close / nullif(lag(close, 5) over w, 0) - 1), 0) as r5, ln(1 + volume) as lv, ln(1 + amount) as la, (high + low + close) / 3 as tp from cut where back <= 20 window w as (partition by symbol order by date)""",
    "sn2": """select *, greatest(high - low, abs(high - coalesce(p1, close)), abs(low - coalesce(p1, close))) as tr, case when close > p1 then volume when close < p1 then -volume else 0 end as sv,
        case when tp > lag(tp) over w then tp * volume when tp < lag(tp) over w then -tp * volume else 0 end as mf, sum(case when r1 > 0 then 0 else 1 end) over (partition by symbol order by date rows unbounded preceding) as ug,
        sum(case when r1 >= 9.5 then 0 else 1 end) over (partition by symbol order by date rows unbounded preceding) as lg from sn1 window w as (partition by symbol order by date)""",
    "sn3": """select *, sum(case when r1 > 0 then 1 else 0 end) over (partition by symbol, ug order by date rows unbounded preceding) as up_days,
        sum(case when r1 >= 9.5 then 1 else 0 end) over (partition by symbol, lg order by date rows unbounded preceding) as limit_days,
        stddev_pop(r1) over w5 as volatility_5d_pct, stddev_pop(r1) over w10 as volatility_10d_pct,
        case when stddev_pop(lv) over w20 <= 1e-9 then 0 else (lv - avg(lv) over w20) / stddev_pop(lv) over w20 end as volume_zscore,
        case when stddev_pop(la) over w20 <= 1e-9 then 0 else (la - avg(la) over w20) / stddev_pop(la) over w20 end as amount_zscore,
        case when stddev_pop(turnover) over w20 <= 1e-9 then 0 else (turnover - avg(turnover) over w20) / stddev_pop(turnover) over w20 end as turnover_zscore,
        coalesce(avg(volume) over w5 / nullif(avg(volume) over wp, 0), 1) as volume_trend_ratio, coalesce(avg(amount) over w5 / nullif(avg(amount) over wp, 0), 1) as amount_trend_ratio,
        coalesce(avg(turnover) over w5 / nullif(avg(turnover) over wp, 0), 1) as turnover_trend_ratio, 100 * (high - low) / close as range_pct, 100 * avg(tr) over w14 / close as atr_14_pct,
        coalesce(sum(sv) over w4 / nullif(sum(abs(volume)) over w5, 0), 0) as obv_trend_5, sum(greatest(mf, 0)) over w14 as pos, sum(greatest(-mf, 0)) over w14 as neg,
        abs(close - open) / greatest(high - low, 1e-9) as candle_body_ratio, (high - greatest(open, close)) / greatest(high - low, 1e-9) as upper_shadow_ratio,
        (least(open, close) - low) / greatest(high - low, 1e-9) as lower_shadow_ratio, (close - low) / greatest(high - low, 1e-9) as close_pos
        from sn2 window w4 as (partition by symbol order by date rows 3 preceding), w5 as (partition by symbol order by date rows 4 preceding), w10 as (partition by symbol order by date rows 9 preceding),
        w14 as (partition by symbol order by date rows 13 preceding), w20 as (partition by symbol order by date rows 19 preceding), wp as (partition by symbol order by date rows between 9 preceding and 5 preceding)""",
    "sn4": """select *, case when neg < 1e-9 then case when pos > 0 then 100 else 50 end else 100 - 100 / (1 + pos / neg) end as mfi_14,
        0.35 * greatest(amount_zscore, 0) + 0.25 * greatest(volume_zscore, 0) + 0.2 * greatest(turnover_zscore, 0) + greatest(range_pct, 0) / 10 + greatest(r1, 0) / 10 + 0.15 * greatest(obv_trend_5, 0) as large_order_fire_score,
        greatest(r1, 0) / 10 + upper_shadow_ratio + (1 - close_pos) + 0.1 * (greatest(volume_zscore, 0) + greatest(amount_zscore, 0)) as intraday_reversal_score from sn3 where back = 1""",
    "smp": """select horizon, scenario, return_pct, 1 / (1 + abs(close - 1500) / 1000) as similarity,
        least(greatest(exp(-1.5 * (abs(volume - 40) / greatest(volume, 40, 1) + abs(turnover - 4) / greatest(turnover, 4, 1)) / 2), 0.2), 1.0) as factor_similarity
        from scn join bars using (symbol, date) where date < date '1996-01-01'""",
    "prd": """select horizon, 0.5 + 0.4 * sin(volume) as prob, case when return_pct > 0 then 1.0 else 0.0 end as actual from lab join bars using (symbol, date) where return_pct is not null""",
}


@query(f"select symbol, date, horizon, {_r('return_pct')} from lab")
def forward_labels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.labels(B.daily(spark, d), (1, 2)).drop("scenario"))


@query("select symbol, date, horizon, case when d2 <= date '1998-03-31' then round(return_pct, 6) end as return_pct from lab where date between date '1998-03-01' and date '1998-04-15'")
def labels_asof_guard(spark: SparkSession, d: str) -> DataFrame:
    found = P.labels(B.daily(spark, d), (1, 2), "1998-03-31")
    return rounded(found.where(F.col("date").between("1998-03-01", "1998-04-15")).drop("scenario"))


@query("select symbol, date, horizon, scenario from scn")
def label_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return P.labels(B.daily(spark, d), (1, 2)).drop("return_pct")


_SNAP = ("volatility_5d_pct", "volatility_10d_pct", "volume_zscore", "amount_zscore", "turnover_zscore", "volume_trend_ratio", "amount_trend_ratio", "turnover_trend_ratio", "range_pct", "atr_14_pct",
         "obv_trend_5", "mfi_14", "candle_body_ratio", "upper_shadow_ratio", "lower_shadow_ratio", "large_order_fire_score", "intraday_reversal_score")


@query(f"""select symbol, date, round(r1, 6) as recent_return_1d_pct, round(r3, 6) as recent_return_3d_pct, round(r5, 6) as recent_return_5d_pct, {_r(*_SNAP)},
    round(0.45 * large_order_fire_score + 0.2 * greatest(coalesce(industry_return_trend_5, 0) - coalesce(market_trend_5, 0), 0) + volatility_10d_pct / 10 + 0.2 * least(limit_days, 3) + 0.1 * greatest(intraday_reversal_score, 0), 6) as short_hot_score, 10.0::double as limit_threshold_pct,
    cast(r1 >= 9.5 as int)::double as limit_up_like, cast(r1 <= -9.5 as int)::double as limit_down_like, cast(r1 >= 5 as int)::double as big_up, cast(r1 <= -5 as int)::double as big_down,
    up_days::double as consecutive_up_days, limit_days::double as consecutive_limit_up_days, cast(sign(r5) * sign(volume_trend_ratio - 1) < 0 as int)::double as price_volume_divergence,
    round(coalesce(market_trend_5, 0), 6) as market_trend_5, round(coalesce(industry_return_trend_5, 0), 6) as industry_trend_5, round(coalesce(industry_return_trend_5, 0) - coalesce(market_trend_5, 0), 6) as industry_relative_strength_5,
    cast((amount_zscore >= 1)::int + (volume_zscore >= 1)::int + (turnover_zscore >= 1)::int + (range_pct >= 3)::int + (volatility_10d_pct >= 2.5)::int + (large_order_fire_score >= 1.5)::int >= 3 as int)::double as short_candidate,
    cast(left(symbol, 3) in ('600', '601', '603', '605', '000', '001', '002', '003') as int)::double as main_board_only,
    case when limit_days <= 0 then 'none' when limit_days = 1 then 'first_board' when limit_days = 2 then 'second_board' else 'multi_board' end as board_chain_stage
    from sn4 left join (select date, market_trend_5 from market) using (date) left join profiles using (symbol) left join (select date, industry, industry_return_trend_5 from indctx) using (date, industry)""")
def factor_snapshot(spark: SparkSession, d: str) -> DataFrame:
    bars = B.daily(spark, d).join(B.profiles(spark, d).select("symbol", "industry"), "symbol", "left")
    market, industry = C.market(B.indexes(spark, d)).select("date", "market_trend_5"), C.industry(norm_industry(spark, d)).select("date", "industry", "industry_return_trend_5")
    return rounded(P.snapshot(bars.join(market, "date", "left").join(industry, ["date", "industry"], "left"), "1999-06-30"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    b = B.daily(spark, d).where(F.col("date") < "1996-01-01").select("symbol", "date", "close", "volume", "turnover")
    x = P.labels(B.daily(spark, d), (1, 2)).join(b, ["symbol", "date"])
    sim = P.factor_similarity({"v": F.col("volume"), "t": F.col("turnover")}, {"v": F.lit(40.0), "t": F.lit(4.0)})
    return x.select("horizon", "scenario", "return_pct", (1 / (1 + F.abs(F.col("close") - 1500) / 1000)).alias("similarity"), sim.alias("factor_similarity"))


@query("select horizon, count(*) as n, round(avg(factor_similarity), 6) as mean_factor_similarity, round(min(factor_similarity), 6) as least from smp group by horizon")
def factor_similarity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_samples(spark, d).groupBy("horizon").agg(F.count("*").alias("n"), F.avg("factor_similarity").alias("mean_factor_similarity"), F.min("factor_similarity").alias("least")))


_W = "(greatest(similarity, 0.001) ** 2 * factor_similarity)"


@query(f"select horizon, count(*) as n, round(sum({_W} * (return_pct > 0)::int) / sum({_W}), 6) as probability_up, round(sum({_W} * return_pct) / sum({_W}), 6) as expected_return, round(avg((return_pct > 0)::int), 6) as unweighted_up from smp where return_pct is not null group by horizon")
def analogue_vote(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.vote(_samples(spark, d)))


@query("select horizon, round(quantile_cont(return_pct, 0.1), 6) as p10, round(quantile_cont(return_pct, 0.5), 6) as p50, round(quantile_cont(return_pct, 0.9), 6) as p90 from smp where return_pct is not null group by horizon")
def analogue_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.quantiles(_samples(spark, d)))


@query(f"select horizon, scenario, round(w / sum(w) over (partition by horizon), 6) as share from (select horizon, scenario, sum({_W}) as w from smp where scenario is not null group by 1, 2)")
def analogue_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.scenarios(_samples(spark, d)))


@query("select symbol, n, round(case when n % 2 = 0 then a else 0.6 * a + 0.4 * m end, 6) as probability, case when n < 20 then 'insufficient' when n < 60 or case when n % 2 = 0 then a else 0.6 * a + 0.4 * m end between 0.45 and 0.55 then 'low' when n % 2 = 1 and n >= 100 then 'high' else 'medium' end as confidence from (select symbol, count(*) as n, avg((close > open)::int) as a, avg((high > 1500)::int) as m from bars group by symbol)")
def ensemble_blend(spark: SparkSession, d: str) -> DataFrame:
    up = lambda c: F.avg(c.cast("double"))
    x = B.daily(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), up(F.col("close") > F.col("open")).alias("a"), up(F.col("high") > 1500).alias("m"))
    p, tier = P.blended(F.col("a"), F.when(F.col("n") % 2 == 1, F.col("m")), F.col("n"))
    return rounded(x.select("symbol", "n", p.alias("probability"), tier.alias("confidence")))


@query("""with r as (select symbol, end_date, size, dist, row_number() over (partition by size order by dist, symbol, end_date) as k from
    (select symbol, date as end_date, unnest([5, 8]) as size, unnest([abs(close - 1500), abs(open - 1500)]) as dist from bars)),
    q as (select *, row_number() over (partition by symbol, end_date order by dist, size) as f from r where k <= 10) select symbol, end_date, size, round(dist, 6) as dist from q where f = 1 order by dist, symbol, end_date limit 20""")
def window_quota(spark: SparkSession, d: str) -> DataFrame:
    """Ten of each window size, the first of each window, the best twenty."""
    both = F.explode(F.array(F.struct(F.lit(5).alias("size"), F.abs(F.col("close") - 1500).alias("dist")), F.struct(F.lit(8).alias("size"), F.abs(F.col("open") - 1500).alias("dist")))).alias("x")
    rows = B.daily(spark, d).select("symbol", F.col("date").alias("end_date"), both).select("symbol", "end_date", "x.*")
    best = S.best_per(rows, ["size"], [F.col("dist"), F.col("symbol"), F.col("end_date")], 10)
    return rounded(S.best_per(best, ["symbol", "end_date"], [F.col("dist"), F.col("size")], 1).orderBy("dist", "symbol", "end_date").limit(20))


@query("""select horizon, count(*) as n, round(avg(((prob >= 0.5) = (actual = 1))::int), 6) as accuracy, round(avg((prob - actual) ** 2), 6) as brier,
    round(avg(case when abs(prob - 0.5) >= 0.1 then ((prob >= 0.5) = (actual = 1))::int end), 6) as confident_accuracy, round(avg((abs(prob - 0.5) >= 0.1)::int), 6) as confident_share,
    round(greatest(avg(actual), 1 - avg(actual)), 6) as baseline_accuracy, round(avg(actual) * (1 - avg(actual)), 6) as baseline_brier from prd group by rollup (horizon)""")
def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = P.labels(B.daily(spark, d), (1, 2)).where("return_pct is not null").join(B.daily(spark, d).select("symbol", "date", "volume"), ["symbol", "date"])
    return rounded(P.backtest(x.select("horizon", (0.5 + 0.4 * F.sin("volume")).alias("prob"), (F.col("return_pct") > 0).cast("double").alias("actual"))))
