"""Probe features by family, cross-section features, and order-dependent indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import pressure as R
from ..operators import probe as P
from ..sources import bars as B
from . import markets as _markets  # noqa: F401  whose views come first
from .registry import VIEWS, query, rounded
from .similarity import _r

_last = "bars"
for _kind, _layers in (("f", P.layers(P.Text(False))), ("x", P.cross_layers(P.Text(False)))):
    for _i, _layer in enumerate(_layers):
        VIEWS[f"{_kind}{_i}"] = "select *, " + ", ".join(f"{e} as {k}" for k, e in _layer.items()) + f" from {_last}"
        _last = f"{_kind}{_i}"

FAMILIES = {
    "padded_lag_pct": "ret_1 ret_2 ret_3 ret_5 ret_10 ret_20 volume_chg_1 volume_chg_5 amount_chg_1 amount_chg_5 turnover_chg_1 turnover_chg_5 ret_accel_1_3 ret_accel_3_10",
    "padded_rolling": "ret_mean_3 ret_mean_5 ret_mean_10 ret_std_5 ret_std_10 ret_std_20 turnover_mean_3 turnover_mean_5 turnover_sum_5 turnover_sum_10 turnover_sum_20 turnover_accel_5_20 amount_mean_3 range_mean_3",
    "rolling_zscore": "volume_z_5 volume_z_10 volume_z_20 amount_z_20 turnover_z_20", "rolling_pct_rank": "overnight_abs_rank_20 profit_pressure_20 profit_pressure_60",
    "bar_geometry": "range_pct body_pct upper_shadow_pct lower_shadow_pct close_position", "gap_features": "gap_pct overnight_return intraday_return overnight_intraday_gap overnight_vs_intraday overnight_return_3d_mean overnight_return_5d_mean reversal_intraday open_to_high_pct open_to_low_pct gap_fill_ratio gap_continue_score",
    "moving_averages": "ma_gap_5 ma_gap_10 ma_gap_20 mean_reversion_distance_5 dist_high_10 dist_high_20 dist_low_10 dist_low_20 breakout_20 breakdown_20", "bollinger": "bollinger_position_20 bollinger_width_20", "rsi": "rsi_6 rsi_14", "atr": "atr_14_pct atr_mean_3", "obv": "obv_trend_5", "mfi": "mfi_14", "cci": "cci_20", "williams_r": "williams_r_14", "adx": "adx_14",
    "limit_features": "limit_up_like limit_down_like failed_limit_up limit_touch_fail_proxy limit_down_bounce_pct limit_up_turnover near_limit_close limit_up_streak one_word_board_proxy t_shape_board_proxy t_plus_1_selling_pressure board_space_height_5 twenty_cm_board_risk limit_seal_quality_proxy first_board_entry second_board_entry new_high_board new_high_breakout_quality",
    "count_features": "big_up big_down up_count_3 up_count_5 down_count_3 down_count_5", "phase_filter": "short_phase_score_3 short_phase_days_3 active_phase", "personality": "limit_up_freq_60 near_limit_freq_60 failed_limit_freq_60 active_turnover_freq_60 stock_personality_score recognizable_backup highlight_score",
    "leader_memory": "former_leader_memory_120 former_leader_recall leader_faith_decay_60 leader_faith_decay_pressure", "price_position": "price_position_20 price_position_60", "cost_position": "cost_position_20 cost_position_60", "calendar_features": "day_of_week_sin day_of_week_cos month_start_3 month_end_3",
    "volume_features": "turnover_to_max_20 amount_to_max_20 climax_volume_ratio_60 climax_amount_ratio_60 volume_to_mean_20 amount_to_mean_20 daily_amount_300m_gate amount_300m_turnover_quality volume_price_match volume_price_divergence_5 new_high_volume_ratio_20",
    "pattern_features": "intraday_reversal_score failed_breakout_10 failed_breakout_20 money_flow_fire hot_exhaustion_score trend_exhaustion_score weak_to_strong_daily low_suck_reversal_proxy board_failure_repair monster_acceleration quant_oscillation_score_10 oscillation_breakout_signal consolidation_days_20 consolidation_breakout_20 reversal_with_volume risk_long_upper_after_big_up",
    "position_patterns": "low_position_big_yang low_position_volume_reversal ma5_pullback_entry ma5_break_exit strong_rebound_from_20low high_position_climax_risk trend_pullback_health",
    "lag_features": " ".join([f"ret_lag_{k}" for k in range(10)] + [f"{n}_lag_{k}" for n in ("range", "close_pos", "volume_z", "amount_z") for k in range(5)]),
    "interaction_features": "ret1_x_volume_z5 ret5_x_volume_z10 ret1_x_close_position range_x_volume_z5 turnover_x_range amount_z_x_range upper_shadow_x_volume_z lower_shadow_x_volume_z",
}
CROSS = {
    "cs_ranks": "cs_ret_1_rank cs_turnover_rank cs_amount_z_rank cs_volume_z_rank cs_range_rank cs_volatility_rank cs_hot_concentration_rank cs_price_rank",
    "cs_rates": "cs_market_positive_rate cs_market_mean_ret_1 cs_market_mean_range cs_short_pool_size_log cs_limit_up_rate cs_limit_down_rate cs_big_up_rate cs_big_down_rate cs_failed_limit_up_rate cs_near_limit_rate",
    "cs_hot_decile": "cs_hot_mean cs_hot_top_decile_mean", "cs_emotion": "cs_emotion_score rel_ret_1_to_market rel_range_to_market", "cs_products": "volume_z_x_cs_ret_rank close_pos_x_cs_range_rank",
}


#: Ratios of small whole numbers, which can end in a 5 just where six decimals are cut: ten decimals, in which sums of few such do not differ.
TEN = {"turnover_accel_5_20", "t_plus_1_selling_pressure", "turnover_to_max_20", "climax_volume_ratio_60", "volume_to_mean_20", "new_high_volume_ratio_20", "consolidation_breakout_20"}


def _family(name: str, columns: list[str], view: str, cross: bool) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = P.features(B.daily(spark, d))
        out = (P.cross_section(rows) if cross else rows).select("symbol", "date", *(F.round(c, 10).alias(c) if c in TEN else c for c in columns))
        return rounded(out, *TEN)

    run.__name__ = name
    query(f"select symbol, date, {', '.join(f'round({c}, {10 if c in TEN else 6}) + 0.0::double as {c}' for c in columns)} from {view}")(run)


for _name, _cols in FAMILIES.items():
    _family(_name, _cols.split(), "f6", False)
for _name, _cols in CROSS.items():
    _family(_name, _cols.split(), "x3", True)


@query("select symbol, date, label_date, label from f6 where position >= 25 and label is not null")
def probe_labels(spark: SparkSession, d: str) -> DataFrame:
    return P.features(B.daily(spark, d)).where("position >= 25 and label is not null").select("symbol", "date", "label_date", "label")


_REC = """with recursive s as (select symbol, date, close, row_number() over w as rn, 100 * (close - min(low) over w9) / greatest(max(high) over w9 - min(low) over w9, 1e-6) as rsv from bars
    window w as (partition by symbol order by date), w9 as (partition by symbol order by date rows 8 preceding)),
    e as (select symbol, date, rn, close, close as e12, close as e26, cast(0 as double) as sig, cast(50 as double) as k, cast(50 as double) as d from s where rn = 1
    union all select s.symbol, s.date, s.rn, s.close, s.close * (2.0::double / 13) + e12 * (1 - 2.0::double / 13), s.close * (2.0::double / 27) + e26 * (1 - 2.0::double / 27),
      ((s.close * (2.0::double / 13) + e12 * (1 - 2.0::double / 13)) - (s.close * (2.0::double / 27) + e26 * (1 - 2.0::double / 27))) * (2.0::double / 10) + sig * (1 - 2.0::double / 10),
      k * 2 / 3 + rsv / 3, d * 2 / 3 + (k * 2 / 3 + rsv / 3) / 3 from e join s on s.symbol = e.symbol and s.rn = e.rn + 1)"""


@query(f"{_REC} select symbol, date, round(100 * (e12 - e26 - sig) / greatest(close, 1e-6), 6) + 0.0::double as macd_hist, round(100 * sig / greatest(close, 1e-6), 6) + 0.0::double as macd_signal from e")
def macd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.recursions(B.daily(spark, d)).select("symbol", "date", "macd_hist", "macd_signal"))


@query(f"{_REC} select symbol, date, {_r('k', 'd').replace('as k', 'as kdj_k').replace('as d', 'as kdj_d')}, round(3 * k - 2 * d, 6) as kdj_j from e")
def kdj(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.recursions(B.daily(spark, d)).select("symbol", "date", "kdj_k", "kdj_d", "kdj_j"))


VIEWS["rb"] = """select date, r, p, u, f, b, sum(r) over (order by date rows between 3 preceding and 1 preceding) as r3 from
    (select date, avg(ret_1) as r, avg((ret_1 > 0)::int) as p, avg(limit_up_like) as u, avg(failed_limit_up) as f, avg(big_down) as b from x3 group by date)"""
VIEWS["pr"] = """select x.*, e.* exclude (date), st.cycle, st.strong_market_regime as smr, st.weak_market_oversold_regime as wmr, st.seal_rate_80_threshold as seal80, st.collapse_warning_signal as collapse,
    coalesce((r3 <= -1.5)::int, 0) * (r >= 0.8)::int * (1 - 5 * least(greatest(u, 0), 0.2)) * (1 + 2 * f + b) * (p < 0.65)::int as rebound,
    1 - cs_market_positive_rate + greatest(-cs_market_mean_ret_1, 0) / 5 + 2 * cs_limit_down_rate as weak, greatest(st.strong_market_regime, (cs_market_mean_ret_1 >= 0.8 and cs_market_positive_rate >= 0.55)::int) as strong,
    greatest(st.weak_market_oversold_regime, (cs_market_positive_rate <= 0.45 and (market_limit_down_count >= 5 or market_new_low_20_count > market_new_high_20_count))::int) as oversold,
    (ret_1 >= 3)::int * close_position * (1 + greatest(volume_z_20, 0) / 3) as chase, (cycle >= 3)::int as cyc, (market_limit_up_count >= 40)::int as hotm, greatest(rel_ret_1_to_market, 0) / 10 as lead, (dist_low_20 <= 0.08)::int as low20
    from x3 x join emo e on x.date = e.date join st3 st on x.date = st.date join rb on x.date = rb.date"""
_PRESSURES = {
    "cs_low_price_advantage": "(1 - cs_price_rank) * weak * (greatest(ret_1, 0) / 10 + near_limit_close + close_position)",
    "cs_weak_market_focus": "weak * cs_hot_concentration_rank * (close_position + near_limit_close)",
    "cs_stock_leads_index_rebound": "lead * cs_ret_1_rank * weak * close_position",
    "cs_reversal_day_leader_quality": "(cs_market_mean_ret_1 > 0 and cs_market_positive_rate >= 0.55 and cs_limit_down_rate <= cs_limit_up_rate + 1e-6)::int * cs_ret_1_rank * close_position * (1 + greatest(volume_z_20, 0) / 3)",
    "cs_emotion_bull_signal": "(cs_market_positive_rate >= 0.55)::int * (cs_limit_up_rate * 2 + cs_big_up_rate + cs_near_limit_rate + cs_hot_top_decile_mean * 0.1) * cs_ret_1_rank",
    "cs_strong_rebound_not_bottom_risk": "rebound",
    "market_cycle_failed_pressure": "cyc * market_failed_limit_up_rate * ln(1 + market_broken_board_count)",
    "market_cycle_broken_pressure": "cyc * ln(1 + market_broken_board_count) * (1 + greatest(market_emotion_score, 0) / 50)",
    "market_cycle_seal_pressure": "cyc * market_seal_rate * (1 + greatest(market_emotion_score, 0) / 50)",
    "market_monday_hot_new_high_risk": "(day_of_week_cos >= 0.9)::int * ln(1 + market_new_high_20_count) * hotm",
    "market_hot_cycle_short_pressure": "cyc * hotm * (market_failed_limit_up_rate + greatest(cs_emotion_score, 0) / 10)",
    "chase_market_up_alignment": "chase * (strong - oversold)",
    "strong_market_anti_drop": "strong * (ret_1 >= -1 and rel_ret_1_to_market >= -1)::int * close_position * (1 + daily_amount_300m_gate)",
    "weak_market_oversold_rebound": "oversold * low20 * (lower_shadow_pct + greatest(ret_1, 0) / 10) * (1 + greatest(volume_z_20, 0) / 3)",
    "second_board_leader_proxy": "second_board_entry * cs_ret_1_rank * (1 - market_failed_limit_up_rate) * (1 + greatest(market_max_board_height - 2, 0) / 5)",
    "seal80_second_board_quality": "seal80 * second_board_entry * close_position * (1 + daily_amount_300m_gate + greatest(volume_price_match, 0))",
    "bull_hotspot_bear_oversold_signal": "(smr - wmr) * (near_limit_close + lead + low20 * lower_shadow_pct)",
    "money_effect_chase_alignment": "chase * (least(greatest(money_effect_spread_20 / 5, -2), 2) + least(greatest(prev_top20_chase_win_rate - 0.5, -0.5), 0.5))",
    "collapse_hot_stock_risk": "collapse * (near_limit_close + greatest(hot_exhaustion_score, 0) + greatest(limit_up_streak - 1, 0))",
    "weak_rebound_money_effect": "oversold * greatest(prev_bottom20_rebound_return, 0) / 5 * (low20 + lower_shadow_pct)",
}


@query("select symbol, date, " + ", ".join(f"round({x}, 6) + 0.0::double as {k}" for k, x in _PRESSURES.items()) + " from pr")
def cs_pressures(spark: SparkSession, d: str) -> DataFrame:
    """The twenty columns that tell what a stock's day means under its market's."""
    emotion = M.emotion(M.ranked_rows(M.board_rows(B.daily(spark, d))))
    dates = emotion.join(M.structure(emotion), "date")
    found = R.with_pressures(P.cross_section(P.features(B.daily(spark, d))), dates)
    return rounded(found.select("symbol", "date", *_PRESSURES))


@query("""with g as (select *, turnover >= 3 as a, amount >= 200000000 or amount_z_20 >= 1 as l, range_pct >= 3 or ret_std_10 >= 2.5 or atr_14_pct >= 2.5 as v from f6),
    s as (select *, (a and l and v)::int as gates, a::int + l::int + (volume_z_20 >= 1)::int + v::int + (money_flow_fire >= 1.5)::int + (volume_to_mean_20 >= 1.5)::int + (amount_to_mean_20 >= 1.5)::int as flags from g),
    t as (select *, sum(gates) over (partition by symbol order by date rows 2 preceding) + 0.0::double as days, count(*) over (partition by symbol order by date rows 2 preceding) as n, first_value(gates) over (partition by symbol order by date rows 2 preceding) as head from s)
    select symbol, date, days + (3 - n) * head as short_phase_days_3, (gates = 1 and days + (3 - n) * head >= 2 and flags >= 2)::int::double as active_phase from t""")
def phase_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which rows are in an active phase: three gates today, and on two of three days, and two of seven abnormal flags."""
    return rounded(P.features(B.daily(spark, d)).select("symbol", "date", "short_phase_days_3", "active_phase"))
