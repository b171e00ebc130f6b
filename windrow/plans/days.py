"""Measures of days from intraday bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import intraday as I
from ..sources import bars as B
from .registry import VIEWS, query, rounded

_PCT = lambda a, b: f"(case when abs({b}) < 1e-12 then 0 else 100 * ({a} / nullif({b}, 0) - 1) end)"
_FIRST = lambda c, w="true": f"arg_min({c}, timestamp) filter (where {w})"
_FINAL = lambda c, w="true": f"arg_max({c}, timestamp) filter (where {w})"
_VOL = lambda w: f"coalesce(sum(volume) filter (where {w}), 0)"
_MIN = "(case when count(*) <= 1 then 1.0 else greatest(max(since) / 60, count(*)) end)"
_PER = lambda m: f"(sum(volume) / greatest({_MIN} / {m}, 1))"
_WHOLE = _PCT(_FINAL("close"), _FIRST("open"))
_LATE = _PCT(_FINAL("close"), _FIRST("open", "left_s <= 1800"))
_IN = lambda w: f"coalesce({_PCT(_FINAL('close', w), _FIRST('open', w))}, 0)"
_CORR = lambda a, b, n, w: f"(case when count(*) < {n} or coalesce(var_pop({a}) filter (where {w}), 0) <= 1e-18 or coalesce(var_pop({b}) filter (where {w}), 0) <= 1e-18 then 0 else corr({a}, {b}) filter (where {w}) end)"
VIEWS |= {
    "pl0": """select *, row_number() over w - 1 as i, count(*) over d as n, min(timestamp) over d as t0, max(timestamp) over d as t1, coalesce(100 * (close / nullif(lag(close) over w, 0) - 1), 0) as r,
        row_number() over (partition by symbol, date order by volume, timestamp) as by_volume, sum(volume) over d as all_volume from minutes window w as (partition by symbol, date order by timestamp), d as (partition by symbol, date)""",
    "pl1": """select *, lag(r) over (partition by symbol, date order by timestamp) as before, (epoch_us(timestamp) - epoch_us(t0)) / 1e6 as since, (epoch_us(t1) - epoch_us(timestamp)) / 1e6 as left_s, greatest((epoch_us(t1) - epoch_us(t0)) / 1e6, 1) as span,
        case when n > 1 then -1 + 2 * i / (n - 1) else 0 end as x, hour(timestamp) * 3600 + minute(timestamp) * 60 + second(timestamp) as clock, avg(r) over (partition by symbol, date) as rm from pl0""",
    "pl": "select *, x - sum(x * volume) over (partition by symbol, date) / nullif(all_volume, 0) as dx, r - rm as dr from pl1",
}
PARTS = {
    "intraday_returns": {
        "intraday_return": _WHOLE, "last_30min_return": _LATE, "last_30min_vs_day": f"{_LATE} / greatest(abs({_WHOLE}), 0.05)", "last_5min_return": _PCT(_FINAL("close"), _FIRST("open", "left_s <= 300")), "first_15min_return": _PCT(_FINAL("close", "since <= 900"), _FIRST("open", "since <= 900")),
        "midday_return": _IN("clock between 39600 and 41400"), "afternoon_start_return": _IN("clock between 46800 and 47700"), "vwap_deviation_eod": _PCT(_FINAL("close"), "(sum(amount) / nullif(sum(volume), 0))"), "intraday_trend_strength": f"abs({_WHOLE}) / greatest(sum(abs(r)), 0.05)",
    },
    "intraday_volume_shape": {
        "last_30min_volume_ratio": f"case when {_PER(30)} > 0 then {_VOL('left_s <= 1800')} / {_PER(30)} else 0 end", "first_15min_volume_ratio": f"case when {_PER(15)} > 0 then {_VOL('since <= 900')} / {_PER(15)} else 0 end", "closing_auction_volume_ratio": f"{_FINAL('volume')} / (sum(volume) / count(*))",
        "volume_distribution_skew": "case when sum(volume) <= 0 or count(*) <= 1 or sum(dx ** 2 * volume) / sum(volume) <= 1e-24 then 0 else sum(dx ** 3 * volume) / sum(volume) / (sum(dx ** 2 * volume) / sum(volume)) ** 1.5 end",
        "volume_entropy": "case when count(*) <= 1 then 0 else -sum(case when volume > 0 then volume / all_volume * ln(volume / all_volume) else 0 end) / ln(greatest(count(*), 2)) end", "volume_gini": "2 * sum(by_volume * volume) / (count(*) * sum(volume)) - (count(*) + 1) / count(*)",
        "morning_afternoon_imbalance": f"{_VOL('clock < 43200')} / greatest({_VOL('clock >= 43200')}, 1e-12)", "up_volume_ratio": f"{_VOL('r > 0')} / sum(volume)",
    },
    "intraday_moments": {
        "price_volume_corr_intraday": _CORR("r", "volume", 2, "true"), "return_autocorr_intraday": _CORR("r", "before", 3, "before is not null"), "realized_volatility_5min": "sqrt(sum(r * r))",
        "realized_skew": "case when count(*) < 3 or avg(dr ** 2) <= 1e-24 then 0 else avg(dr ** 3) / avg(dr ** 2) ** 1.5 end", "realized_kurtosis": "case when count(*) < 4 or avg(dr ** 2) <= 1e-24 then 0 else avg(dr ** 4) / avg(dr ** 2) ** 2 end",
    },
    "intraday_time_position": {
        "high_point_time": "arg_min(since, row(-high, timestamp)) / max(span)", "low_point_time": "arg_min(since, row(low, timestamp)) / max(span)", "intraday_close_position": f"case when max(high) - min(low) <= 1e-12 then 0.5 else ({_FINAL('close')} - min(low)) / (max(high) - min(low)) end",
    },
}


def _part(name: str, columns: dict[str, str]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(I.factors(B.minutes(spark, d)).select("symbol", "date", *columns))

    run.__name__ = name
    query(f"select symbol, date, {', '.join(f'round(cast({e} as double), 6) + 0.0::double as {c}' for c, e in columns.items())} from pl group by symbol, date")(run)


for _name, _cols in PARTS.items():
    _part(_name, _cols)
