"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Decimals of computed columns in results; sums may differ in their last bits from engine to engine.
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _zscored(with_views(sql))
        return f

    return add


def six(x: Column) -> Column:
    """A double rounded as the SQL's engine does: scaled, then to the nearest whole number, halves away from 0.  Spark's own ``round`` goes by
    the decimals that a double is printed with, which differs where these end on half a digit."""
    scaled = F.abs(x * 10.0**DIGITS)
    whole = F.rint(scaled)
    found = F.signum(x) * (whole + F.when(scaled - whole == 0.5, 1.0).otherwise(0.0)) / 10.0**DIGITS
    return F.when(F.abs(found) < float("inf"), found).otherwise(x) + F.lit(0.0)


def rounded(df: DataFrame, *but: str) -> DataFrame:
    """Doubles rounded, except the columns named; -0.0 becomes 0.0."""
    return df.select(*((F.round(F.col(f"`{c}`"), DIGITS) + F.lit(0.0)).alias(c) if t == "double" and c not in but else F.col(f"`{c}`") for c, t in df.dtypes))


#: Views of the oracle, each from those before it.
VIEWS: dict[str, str] = {
    "profiles": """select lpad(cast(s_suppkey as varchar), 6, '0') as symbol, s_name as name, n_name as industry, r_name as region,
        cast(date '1994-01-01' + cast(s_suppkey % 700 as int) as date) as listing_date, regexp_matches(s_name, '[05]$') as is_st
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "items": """select *, l_extendedprice / l_quantity as unit,
        row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as k from lineitem""",
    "bars": """select lpad(cast(l_suppkey as varchar), 6, '0') as symbol, cast(l_shipdate as date) as date, arg_min(unit, k) as open,
        max(unit * (1 + l_tax)) as high, min(unit * (1 - l_discount)) as low, arg_max(unit, k) as close, sum(l_quantity) as volume,
        round(sum(l_extendedprice), 2) as amount, sum(l_quantity) * 0.1 as turnover from items group by 1, 2""",
    "prior": "select *, lag(close) over (partition by symbol order by date) as pc from bars",
    "norm": """select symbol, date, open, high, low, close, volume, amount, turnover, coalesce(close - pc, 0) as change,
        coalesce(100 * (close - pc) / nullif(pc, 0), 0) as pct_change, coalesce(100 * (high - low) / nullif(pc, 0), 0) as amplitude from prior""",
    "ticks": """select lpad(cast(user_id as varchar), 6, '0') as symbol, ts as timestamp, cast(ts as date) as date, event_id, value as price,
        1 + coalesce(cast(json_extract_string(props, '$.k') as double), 0.0) as size from events""",
    "minutes": """select symbol, date, cast(floor(hour(timestamp) / 6) as int) as slot, min(timestamp) as timestamp, arg_min(price, row(timestamp, event_id)) as open,
        max(price) as high, min(price) as low, arg_max(price, row(timestamp, event_id)) as close, sum(size) as volume, sum(price * size) as amount
        from ticks group by 1, 2, 3""",
    "index_days": "select region as index_symbol, date, avg(close) as close from bars join profiles using (symbol) group by 1, 2",
    "indexes": """select *, coalesce(100 * (close / lag(close) over (partition by index_symbol order by date) - 1), 0) as pct_change from index_days""",
    "normi": "select norm.*, industry from norm join profiles using (symbol)",
    "mday": "select date, avg(pct_change) as market_return_mean from indexes group by date",
    "market": """select *, coalesce(stddev_samp(market_return_mean) over w, 0) as market_volatility_5, avg(market_return_mean) over w as market_trend_5
        from mday window w as (order by date rows between 4 preceding and current row)""",
    "iday": """select date, industry, avg(pct_change) as industry_return_mean, avg(turnover) as industry_turnover_mean, avg(amplitude) as industry_amplitude_mean,
        count(*) as constituents from normi group by 1, 2""",
    "indctx": "select *, avg(industry_return_mean) over (partition by industry order by date rows between 4 preceding and current row) as industry_return_trend_5 from iday",
    "w5": """select * from (select symbol, row_number() over (partition by symbol order by date) - 5 as start_idx, row_number() over (partition by symbol order by date) - 1 as end_idx,
        first_value(date) over w as start_date, date as end_date,
        list({'open': open, 'high': high, 'low': low, 'close': close, 'volume': volume, 'turnover': turnover, 'amplitude': amplitude, 'pct_change': pct_change}) over w as bars
        from norm window w as (partition by symbol order by date rows between 4 preceding and current row)) where len(bars) = 5""",
    "enc5": """select symbol, start_idx, end_idx, start_date, end_date, bars,
        list_concat(list_transform(bars, lambda x: x.close / (case when abs(bars[1].close) < 1e-9 then 1.0 else bars[1].close end) - 1),
          list_transform(range(1, 6), lambda i: case when i = 1 then 0.0 else (bars[i].close - bars[greatest(i - 1, 1)].close) / (case when abs(bars[greatest(i - 1, 1)].close) < 1e-9 then 1.0 else bars[greatest(i - 1, 1)].close end) end)) as price_path,
        list_concat(list_transform(bars, lambda x: (x.close - x.open) / (case when abs(x.high - x.low) < 1e-9 then 1.0 else x.high - x.low end)),
          list_transform(bars, lambda x: (x.high - greatest(x.open, x.close)) / (case when abs(x.high - x.low) < 1e-9 then 1.0 else x.high - x.low end)),
          list_transform(bars, lambda x: (least(x.open, x.close) - x.low) / (case when abs(x.high - x.low) < 1e-9 then 1.0 else x.high - x.low end))) as candle_geometry,
        list_concat(list_transform(zs(list_transform(bars, lambda x: ln(1 + greatest(x.volume, 0)))), lambda x: x), zs(list_transform(bars, lambda x: x.turnover)), zs(list_transform(bars, lambda x: x.amplitude))) as volume_liquidity
        from w5""",
    "fwd": """select symbol, date, h as horizon, 100 * (list_extract(cs, h) / close - 1) as return_pct, case when len(cs) >= h then 100 * (list_max(list_slice(hs, 1, h)) / close - 1) end as mfe_pct,
        case when len(cs) >= h then 100 * (list_min(list_slice(ls, 1, h)) / close - 1) end as mdd_pct from (select symbol, date, nullif(close, 0) as close, unnest([1, 3, 5, 10]) as h,
        coalesce(list(close) over w, []) as cs, coalesce(list(high) over w, []) as hs, coalesce(list(low) over w, []) as ls from bars window w as (partition by symbol order by date rows between 1 following and 10 following))""",
}


def _zscored(sql: str) -> str:
    """zs(list) written out: population z-scores of a list, zeros for a constant one."""
    while (at := sql.find("zs(")) >= 0:
        depth, end = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        a = sql[at + 3 : end - 1]
        sql = f"{sql[:at]}list_transform({a}, lambda z: case when list_stddev_pop({a}) < 1e-9 then 0.0 else (z - list_avg({a})) / list_stddev_pop({a}) end){sql[end:]}"
    return sql


def with_views(sql: str) -> str:
    """The SQL with the views that it needs before it."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if v not in need and re.search(rf"\b{v}\b", text):
                add(VIEWS[v])
                if v not in need:
                    need.append(v)

    own = re.match(r"\s*with\s+(recursive\s+)?", sql, re.I)
    add(sql)
    if not need:
        return sql
    head = ", ".join(f"{v} as ({VIEWS[v]})" for v in need)
    return f"with {own[1] or '' if own else ''}{head}{',' if own else ''} {sql[own.end() if own else 0:]}"
