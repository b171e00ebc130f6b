"""Daily features for direction models, as layers of window expressions.

A feature is an expression over the columns of the layers before it.  All windows share one partitioning and order, so
however many features are asked for there is one sort per symbol; columns that no asked feature needs are pruned.
Windows are padded at their start with the first value (see functions.rolling); the closed form is written out here, so
that the same text can be run by any SQL engine with windows."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_P = "partition by symbol order by date"


class Text:
    """Window expressions as text; engines differ in how lists are filtered alone."""

    def __init__(self, spark: bool = True):
        self.spark = spark

    def last(self, n: int) -> str:
        return f"over ({_P} rows {n - 1} preceding)"

    def head(self, x: str) -> str:
        return f"first_value({x}) over ({_P} rows unbounded preceding)"

    def missing(self, n: int) -> str:
        return f"greatest({n} - row_number() over ({_P}), 0)"

    def lag(self, x: str, k: int = 1) -> str:
        return f"coalesce(lag({x}, {k}) over ({_P}), {self.head(x)})"

    def change(self, x: str, k: int) -> str:
        return f"(100 * ({x} / greatest({self.lag(x, k)}, 0.000001) - 1))"

    def sum(self, x: str, n: int) -> str:
        return f"(sum({x}) {self.last(n)} + {self.missing(n)} * {self.head(x)})"

    def mean(self, x: str, n: int) -> str:
        return f"({self.sum(x, n)} / {n})"

    def max(self, x: str, n: int) -> str:
        return f"max({x}) {self.last(n)}"

    def min(self, x: str, n: int) -> str:
        return f"min({x}) {self.last(n)}"

    def std(self, x: str, n: int) -> str:
        square = f"((sum({x} * {x}) {self.last(n)} + {self.missing(n)} * {self.head(x)} * {self.head(x)}) / {n})"
        return f"(case when {self.max(x, n)} = {self.min(x, n)} then cast(0 as double) else sqrt(greatest({square} - {self.mean(x, n)} * {self.mean(x, n)}, 0)) end)"

    def z(self, x: str, n: int) -> str:
        return f"(({x} - {self.mean(x, n)}) / greatest({self.std(x, n)}, 0.000001))"

    def below(self, x: str, n: int, sign: str) -> str:
        """Share of the padded window's values v with v sign x."""
        listed = f"size(filter(collect_list({x}) {self.last(n)}, v -> v {sign} {x}))" if self.spark else f"len(list_filter(list({x}) {self.last(n)}, lambda v: v {sign} {x}))"
        return f"(({listed} + {self.missing(n)} * (case when {self.head(x)} {sign} {x} then 1 else 0 end)) / cast({n} as double))"

    def flag(self, condition: str) -> str:
        return f"cast(case when {condition} then 1 else 0 end as double)"

    def clip(self, x: str, low: float, high: float) -> str:
        return f"least(greatest({x}, {low}), {high})"


def layers(t: Text) -> list[dict[str, str]]:
    """Expressions by name; a layer uses columns of those before it."""
    f, den = t.flag, "greatest({}, 0.000001)".format
    one = {
        "pc": t.lag("close"), "ret_1": t.change("close", 1), "lv": "ln(1 + greatest(volume, 0))", "la": "ln(1 + greatest(amount, 0))", "hl": den("high - low"),
        "range_pct": f"100 * (high - low) / {den('close')}", "tp": "(high + low + close) / 3", "calendar_month": "date_trunc('month', date)",
        "body_pct": f"100 * (close - open) / {den('open')}", "intraday_return": f"100 * (close / {den('open')} - 1)", "open_to_high_pct": f"100 * (high / {den('open')} - 1)", "open_to_low_pct": f"100 * (low / {den('open')} - 1)",
    } | {f"ret_{k}": t.change("close", k) for k in (2, 3, 5, 10, 20)}
    two = {
        "close_position": "(close - low) / hl", "upper_shadow_pct": "(high - greatest(open, close)) / hl", "lower_shadow_pct": "(least(open, close) - low) / hl",
        "overnight_return": f"100 * (open / {den('pc')} - 1)", "high_return": f"100 * (high / {den('pc')} - 1)", "low_return": f"100 * (low / {den('pc')} - 1)",
        "tr": "greatest(high - low, abs(high - pc), abs(low - pc))", "dirv": "sign(close - pc) * volume", "tdir": f"tp - {t.lag('tp')}", "limit_up_like": f("ret_1 >= 9.5"), "limit_down_like": f("ret_1 <= -9.5"),
        "up_move": f"high - {t.lag('high')}", "down_move": f"{t.lag('low')} - low", "gain": "greatest(ret_1, 0)", "loss": "greatest(-ret_1, 0)", "big_up": f("ret_1 >= 5"), "big_down": f("ret_1 <= -5"), "upday": f("ret_1 > 0"), "downday": f("ret_1 < 0"),
        "volume_z_5": t.z("lv", 5), "volume_z_10": t.z("lv", 10), "volume_z_20": t.z("lv", 20), "amount_z_20": t.z("la", 20), "turnover_z_20": t.z("turnover", 20),
        "ma_5": t.mean("close", 5), "ma_10": t.mean("close", 10), "ma_20": t.mean("close", 20), "close_std_20": t.std("close", 20),
        "volume_chg_1": t.change("lv", 1), "volume_chg_5": t.change("lv", 5), "amount_chg_1": t.change("la", 1), "amount_chg_5": t.change("la", 5), "turnover_chg_1": t.change("turnover", 1), "turnover_chg_5": t.change("turnover", 5),
        "turnover_mean_3": t.mean("turnover", 3), "turnover_mean_5": t.mean("turnover", 5), "turnover_mean_20": t.mean("turnover", 20), "turnover_to_max_20": f"turnover / {den(t.max('turnover', 20))}", "amount_to_max_20": f"amount / {den(t.max('amount', 20))}",
        "climax_volume_ratio_60": f"volume / {den(t.max('volume', 60))}", "climax_amount_ratio_60": f"amount / {den(t.max('amount', 60))}", "volume_to_mean_20": f"volume / {den(t.mean('volume', 20))}", "amount_to_mean_20": f"amount / {den(t.mean('amount', 20))}",
        "turnover_sum_5": t.sum("turnover", 5), "turnover_sum_10": t.sum("turnover", 10), "turnover_sum_20": t.sum("turnover", 20), "amount_mean_3": t.mean("amount", 3), "range_mean_3": t.mean("range_pct", 3), "range_mean_20": t.mean("range_pct", 20),
        "hh_10": t.max("high", 10), "hh_14": t.max("high", 14), "hh_20": t.max("high", 20), "hh_60": t.max("high", 60), "ll_5": t.min("low", 5), "ll_10": t.min("low", 10), "ll_14": t.min("low", 14), "ll_20": t.min("low", 20), "ll_60": t.min("low", 60),
        "vwap_20": f"{t.sum('amount', 20)} / {den(t.sum('volume', 20))}", "vwap_60": f"{t.sum('amount', 60)} / {den(t.sum('volume', 60))}", "profit_pressure_20": t.below("close", 20, "<"), "profit_pressure_60": t.below("close", 60, "<"),
        "ret_std_5": t.std("ret_1", 5), "ret_std_10": t.std("ret_1", 10), "ret_std_20": t.std("ret_1", 20), "ret_mean_3": t.mean("ret_1", 3), "ret_mean_5": t.mean("ret_1", 5), "ret_mean_10": t.mean("ret_1", 10), "tp_mean_20": t.mean("tp", 20),
        "day_of_week_sin": "sin(2 * pi() * ({}) / 5)".format("weekday(date)" if t.spark else "isodow(date) - 1"), "day_of_week_cos": "cos(2 * pi() * ({}) / 5)".format("weekday(date)" if t.spark else "isodow(date) - 1"),
        "month_start_3": f("row_number() over (partition by symbol, calendar_month order by date) <= 3"), "month_end_3": f("row_number() over (partition by symbol, calendar_month order by date desc) <= 3"),
    }
    three = {
        "ret_accel_1_3": "ret_1 - ret_3 / 3", "ret_accel_3_10": "ret_3 / 3 - ret_10 / 10", "gap_pct": "overnight_return", "overnight_intraday_gap": "overnight_return - intraday_return", "overnight_vs_intraday": "overnight_return / greatest(abs(intraday_return), 0.05)", "reversal_intraday": "-intraday_return",
        "overnight_return_3d_mean": t.mean("overnight_return", 3), "overnight_return_5d_mean": t.mean("overnight_return", 5), "oa": "abs(overnight_return)",
        "ma_gap_5": f"close / {den('ma_5')} - 1", "ma_gap_10": f"close / {den('ma_10')} - 1", "ma_gap_20": f"close / {den('ma_20')} - 1", "mean_reversion_distance_5": f"close / {den('ma_5')} - 1",
        "bollinger_position_20": f"(close - (ma_20 - 2 * close_std_20)) / {den('4 * close_std_20')}", "bollinger_width_20": f"4 * close_std_20 / {den('ma_20')}",
        "dist_high_10": f"close / {den('hh_10')} - 1", "dist_high_20": f"close / {den('hh_20')} - 1", "dist_low_10": f"close / {den('ll_10')} - 1", "dist_low_20": f"close / {den('ll_20')} - 1", "breakout_20": f("close >= hh_20"), "breakdown_20": f("close <= ll_20"),
        "failed_limit_up": f("high_return >= 9.7 and ret_1 < 9.5"), "limit_touch_fail_proxy": f("high_return >= 9.7 and ret_1 < 9.0"), "near_limit_close": f("ret_1 >= 8 and close_position >= 0.75"), "limit_down_bounce_pct": f"case when low_return <= -9.5 then 100 * (close / {den('low')} - 1) else 0 end", "limit_up_turnover": "limit_up_like * turnover",
        "up_count_3": t.sum("upday", 3), "up_count_5": t.sum("upday", 5), "down_count_3": t.sum("downday", 3), "down_count_5": t.sum("downday", 5),
        "rsi_6": f"100 - 100 / (1 + {t.mean('gain', 6)} / {den(t.mean('loss', 6))})", "rsi_14": f"100 - 100 / (1 + {t.mean('gain', 14)} / {den(t.mean('loss', 14))})", "atr_14_pct": f"100 * {t.mean('tr', 14)} / {den('close')}",
        "obv_trend_5": f"(sum(dirv) {t.last(5)}) / {den(t.sum('volume', 5))}", "mpos": "case when tdir > 0 then tp * volume else 0 end", "mneg": "case when tdir < 0 then abs(tp * volume) else 0 end",
        "cci_dev": ("aggregate(transform(collect_list(tp) {w}, v -> abs(v - tp_mean_20)), cast(0 as double), (s, v) -> s + v)" if t.spark else "list_sum(list_transform(list(tp) {w}, lambda v: abs(v - tp_mean_20)))").format(w=t.last(20)) + f" + {t.missing(20)} * abs({t.head('tp')} - tp_mean_20)",
        "williams_r_14": f"-100 * (hh_14 - close) / {den('hh_14 - ll_14')}", "plus_dm": "case when up_move > down_move and up_move > 0 then up_move else 0 end", "minus_dm": "case when down_move > up_move and down_move > 0 then down_move else 0 end", "tr_sum": den(t.sum("tr", 14)),
        "failed_breakout_10": f("high >= hh_10 and close_position <= 0.45"), "failed_breakout_20": f("high >= hh_20 and close_position <= 0.45"), "volume_price_divergence_5": f("(ret_5 > 0 and volume_chg_5 < 0) or (ret_5 < 0 and volume_chg_5 > 0)"),
        "price_position_20": f"(close - ll_20) / {den('hh_20 - ll_20')}", "price_position_60": f"(close - ll_60) / {den('hh_60 - ll_60')}", "cost_position_20": f"close / {den('vwap_20')} - 1", "cost_position_60": f"close / {den('vwap_60')} - 1",
        "turnover_accel_5_20": f"turnover_sum_5 / {den('turnover_sum_20 / 4')}", "turnover_to_mean_20": f"turnover / {den('turnover_mean_20')}", "daily_amount_300m_gate": f("amount >= 300000000"), "limit_up_freq_60": t.mean("limit_up_like", 60),
        "active_flag": f("turnover >= 3 and amount >= 200000000 and range_pct >= 3"), "ret_sign": "case when abs(ret_1) >= 1 then sign(ret_1) else 0 end", "streak_group": f"sum(1 - limit_up_like) over ({_P} rows unbounded preceding)", "limit_freq_120": t.mean("limit_up_like", 120),
        "board_space_height_5": f"100 * (close / {den('ll_5')} - 1)", "std_mean_20": t.mean("ret_std_10", 20), "new_high_board": f("limit_up_like > 0.5 and close >= hh_60"), "reversal_with_volume": "-ret_1 * greatest(volume_z_20, 0)", "risk_long_upper_after_big_up": "big_up * upper_shadow_pct * greatest(volume_z_20, 0)",
        "gap_fill_ratio": t.clip(f"case when overnight_return > 0 then (open - low) / {den('open - pc')} when overnight_return < 0 then (high - open) / {den('pc - open')} else 0 end", 0, 5), "gap_continue_score": f"overnight_return * close_position * ({f('close > open')} * 2 - 1)",
        "intraday_reversal_score": "greatest(ret_1, 0) / 10 + upper_shadow_pct + (1 - close_position) + 0.1 * greatest(volume_z_20, 0) + 0.1 * greatest(amount_z_20, 0)", "limit_seal_quality_proxy": "limit_up_like * close_position * (1 - upper_shadow_pct) * greatest(least(amount_z_20, volume_z_20), 0)",
        "trend_exhaustion_score": f"ret_5 / {den('ret_std_10')} + upper_shadow_pct + volume_z_20 - close_position", "low_suck_reversal_proxy": "lower_shadow_pct * close_position * greatest(volume_z_20, 0)", "new_high_volume_ratio_20": f"{f('high >= hh_20')} * volume_to_mean_20",
        "one_word_board_proxy": f("overnight_return >= 9 and limit_up_like > 0.5 and range_pct <= 1.5"), "t_shape_board_proxy": f("overnight_return >= 8 and limit_up_like > 0.5 and low_return <= 5 and close_position >= 0.90"),
        "twenty_cm_board_risk": f("(left(symbol, 3) in ('300', '301', '688', '689') or left(symbol, 2) in ('83', '87', '43')) and (ret_1 >= 12 or high_return >= 12)"),
        "short_phase_score_3": "least(turnover_mean_3 / 3, 5) + least(amount_mean_3 / 200000000, 5) + least(range_mean_3 / 3, 5)",
    }
    four = {
        "overnight_abs_rank_20": t.below("oa", 20, "<="), "mfi_14": f"100 - 100 / (1 + {t.sum('mpos', 14)} / {den(t.sum('mneg', 14))})", "cci_20": f"(tp - tp_mean_20) / {den('0.015 * cci_dev / 20')}", "plus_di": f"100 * {t.sum('plus_dm', 14)} / tr_sum", "minus_di": f"100 * {t.sum('minus_dm', 14)} / tr_sum",
        "limit_up_streak": "sum(limit_up_like) over (partition by symbol, streak_group order by date rows unbounded preceding)", "atr_mean_3": t.mean("atr_14_pct", 3), "near_limit_freq_60": t.mean("near_limit_close", 60), "failed_limit_freq_60": t.mean("failed_limit_up", 60), "active_turnover_freq_60": t.mean("active_flag", 60),
        "phase_flag": f("turnover >= 3 and (amount >= 200000000 or amount_z_20 >= 1) and (range_pct >= 3 or ret_std_10 >= 2.5 or atr_14_pct >= 2.5)"), "sign_flip": f(f"ret_sign * {t.lag('ret_sign')} < 0"), "consolidation_day": f("range_pct <= range_mean_20 * 0.75 and ret_std_10 <= std_mean_20"),
        "former_freq": t.lag("limit_freq_120"), "t_plus_1_selling_pressure": f"{t.lag('limit_up_like')} * turnover_to_mean_20", "board_failure_repair": f(f"{t.lag('failed_limit_up')} > 0.5 and ret_1 >= 3 and close_position >= 0.70"),
        "weak_to_strong_daily": f(f"{t.lag('ret_1')} < 0 and gap_pct >= 0 and close_position >= 0.85 and ret_1 >= 3 and volume_to_mean_20 >= 1"),
        "money_flow_fire": "0.35 * greatest(amount_z_20, 0) + 0.25 * greatest(volume_z_20, 0) + 0.20 * greatest(turnover_z_20, 0) + greatest(range_pct, 0) / 10 + 0.15 * greatest(obv_trend_5, 0)", "hot_exhaustion_score": "greatest(amount_z_20, 0) * upper_shadow_pct + greatest(ret_1, 0) / 10 + failed_breakout_10 + failed_breakout_20",
        "amount_300m_turnover_quality": f"daily_amount_300m_gate * close_position * {t.clip('turnover / 10', 0, 2)} * {t.clip('range_pct / 5', 0, 2)}", "new_high_breakout_quality": f"new_high_board * close_position * least(volume_to_mean_20, 5) / {den('1 + upper_shadow_pct')}",
        "volume_price_match": f"{f('(ret_1 > 0 and close_position >= 0.60 and volume_to_mean_20 between 0.80 and 2.50) or (ret_1 between -3 and 0 and volume_to_mean_20 <= 1.10 and close >= ma_5 * 0.98)')} - volume_price_divergence_5 * 0.75 - {f('upper_shadow_pct >= 0.35 and volume_to_mean_20 >= 1.50')} * 0.75",
        "low_position_big_yang": f("price_position_60 <= 0.35 and ret_1 >= 5 and close_position >= 0.70 and volume_to_mean_20 >= 1.10"), "low_position_volume_reversal": f("price_position_20 <= 0.30 and lower_shadow_pct >= 0.25 and close_position >= 0.55 and volume_to_mean_20 >= 1.20"),
        "strong_rebound_from_20low": f("low <= ll_20 * 1.05 and ret_1 >= 3 and close_position >= 0.70 and volume_to_mean_20 >= 1"), "trend_pullback_health": f"{t.clip('ret_20', 0, 30)} / 30 * {t.clip('1 - abs(ma_gap_5) * 10', 0, 1)} * {t.clip('volume_to_mean_20', 0, 2)} * close_position",
    }
    five = {
        "dx": f"100 * abs(plus_di - minus_di) / {den('plus_di + minus_di')}", "short_phase_days_3": t.sum("phase_flag", 3), "peak_120": t.max("limit_up_streak", 120), "first_board_entry": f("limit_up_streak = 1"), "second_board_entry": f("limit_up_streak = 2"),
        "monster_acceleration": f("limit_up_streak >= 2 and volume_to_mean_20 <= 1.20 and close_position >= 0.90 and upper_shadow_pct <= 0.15"), "consolidation_days_20": t.sum("consolidation_day", 20), "quant_oscillation_score_10": f"{t.mean('sign_flip', 10)} * {t.clip('range_mean_3 / 5', 0, 3)}",
        "stock_personality_score": "limit_up_freq_60 * 3 + near_limit_freq_60 * 1.5 + active_turnover_freq_60 + least(turnover_mean_20 / 10, 2) + least(range_mean_20 / 5, 2)", "high_board_big_loss": f(f"{t.lag('limit_up_streak')} >= 2 and ret_1 <= -5"),
        "ma5_pullback_entry": f("(ret_10 >= 8 or near_limit_freq_60 >= 0.08) and low <= ma_5 * 1.02 and close >= ma_5 * 0.995 and close_position >= 0.55 and ret_1 >= -2.5"), "ma5_break_exit": f("(ret_10 >= 8 or near_limit_freq_60 >= 0.08) and close < ma_5 * 0.985 and ret_1 <= -2 and volume_to_mean_20 >= 1"),
        "high_position_climax_risk": f("price_position_60 >= 0.85 and (ret_10 >= 20 or limit_up_streak >= 2) and climax_amount_ratio_60 >= 0.80 and (upper_shadow_pct >= 0.25 or close_position <= 0.55)"),
    }
    six = {
        "adx_14": t.mean("dx", 14), "former_leader_memory_120": f"{t.clip(t.lag('peak_120') + ' / 5', 0, 1.5)} + {t.clip('former_freq * 8', 0, 2)}", "leader_faith_decay_60": t.mean("high_board_big_loss", 60), "recognizable_backup": f"stock_personality_score * near_limit_close * {f('limit_up_streak <= 1')}",
        "highlight_score": f"stock_personality_score + {t.clip('ma_gap_20 * 10', -2, 3)} + close_position + weak_to_strong_daily * 1.5 + new_high_breakout_quality * 0.5 - failed_limit_freq_60", "oscillation_breakout_signal": f"quant_oscillation_score_10 * {f('ret_1 >= 3')} * close_position * {t.clip('volume_to_mean_20', 0, 3)}",
        "consolidation_breakout_20": f"{f('close >= hh_20')} * consolidation_days_20 * least(volume_to_mean_20, 5)",
        "active_flags": " + ".join(f"(case when {c} then 1 else 0 end)" for c in ("turnover >= 3", "amount >= 200000000 or amount_z_20 >= 1", "volume_z_20 >= 1", "range_pct >= 3 or ret_std_10 >= 2.5 or atr_14_pct >= 2.5", "money_flow_fire >= 1.5", "volume_to_mean_20 >= 1.5", "amount_to_mean_20 >= 1.5")),
    }
    seven = {
        "former_leader_recall": f"former_leader_memory_120 * {f('ret_1 >= 5 or near_limit_close > 0.5')} * close_position * {t.clip('volume_to_mean_20', 0, 3)} / 3", "leader_faith_decay_pressure": "leader_faith_decay_60 * (limit_up_streak + near_limit_close + failed_limit_up)",
        "active_phase": f("phase_flag > 0.5 and short_phase_days_3 >= 2 and active_flags >= 2"), "ret1_x_volume_z5": "ret_1 * volume_z_5", "ret5_x_volume_z10": "ret_5 * volume_z_10", "ret1_x_close_position": "ret_1 * close_position", "range_x_volume_z5": "range_pct * volume_z_5", "turnover_x_range": "turnover * range_pct",
        "amount_z_x_range": "amount_z_20 * range_pct", "upper_shadow_x_volume_z": "upper_shadow_pct * volume_z_20", "lower_shadow_x_volume_z": "lower_shadow_pct * volume_z_20",
        "label_date": f"lead(date) over ({_P})", "label": f"case when lead(close) over ({_P}) is not null then {f(f'lead(close) over ({_P}) / close - 1 > 0')} end", "position": f"row_number() over ({_P}) - 1",
    } | {f"ret_lag_{k}": "ret_1" if not k else t.lag("ret_1", k) for k in range(10)} | {f"{n}_lag_{k}": x if not k else t.lag(x, k) for n, x in (("range", "range_pct"), ("close_pos", "close_position"), ("volume_z", "volume_z_20"), ("amount_z", "amount_z_20")) for k in range(5)}
    return [one, two, three, four, five, six, seven]


def features(bars: DataFrame) -> DataFrame:
    for layer in layers(Text()):
        bars = bars.withColumns({k: F.expr(x) for k, x in layer.items()})
    return bars


def recursions(bars: DataFrame) -> DataFrame:
    """symbol, date, macd_hist, macd_signal, kdj_k, kdj_d, kdj_j: order-dependent recursions, one symbol's history at a time."""

    def ema(x: np.ndarray, span: int) -> np.ndarray:
        return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        c = pdf["close"].to_numpy(float)
        dif = ema(c, 12) - ema(c, 26)
        signal, scale = ema(dif, 9), np.maximum(c, 1e-6)
        low, high = (getattr(pdf[k].rolling(9, min_periods=1), f)().to_numpy() for k, f in (("low", "min"), ("high", "max")))
        rsv = 100 * (c - low) / np.maximum(high - low, 1e-6)
        third = lambda x: pd.Series(np.append(50.0, x[1:])).ewm(alpha=1 / 3, adjust=False).mean().to_numpy()  # noqa: E731  both begin at 50
        k = third(rsv)
        d = third(k)
        return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], "macd_hist": 100 * (dif - signal) / scale, "macd_signal": 100 * signal / scale, "kdj_k": k, "kdj_d": d, "kdj_j": 3 * k - 2 * d})

    return bars.select("symbol", "date", "high", "low", "close").groupBy("symbol").applyInPandas(run, "symbol string, date date, macd_hist double, macd_signal double, kdj_k double, kdj_d double, kdj_j double")


_DAY = "partition by date"


def pct_rank(raw: str) -> str:
    """Percentile rank within the date with the average of ties; values that six decimals do not tell apart are ties."""
    x = f"round({raw}, 6)"
    return f"((rank() over ({_DAY} order by {x}) + (count(*) over (partition by date, {x}) - 1) * cast(0.5 as double)) / count({x}) over ({_DAY}))"


def cross_layers(t: Text) -> list[dict[str, str]]:
    """Measures of each row's standing within its date, and of the date itself."""
    mean = lambda x: f"avg({x}) over ({_DAY})"
    ranks = {"ret_1": "ret_1", "turnover": "turnover", "amount_z": "amount_z_20", "volume_z": "volume_z_20", "range": "range_pct", "volatility": "ret_std_10", "price": "close"}
    one = {f"cs_{k}_rank": pct_rank(x) for k, x in ranks.items()} | {
        "cs_market_positive_rate": mean(t.flag("ret_1 > 0")), "cs_market_mean_ret_1": mean("ret_1"), "cs_market_mean_range": mean("range_pct"), "cs_short_pool_size_log": f"ln(1 + count(*) over ({_DAY}))", "hot": "amount_z_20 + turnover_z_20 + range_pct / 10",
        "cs_limit_up_rate": mean("limit_up_like"), "cs_limit_down_rate": mean("limit_down_like"), "cs_big_up_rate": mean("big_up"), "cs_big_down_rate": mean("big_down"), "cs_failed_limit_up_rate": mean("failed_limit_up"), "cs_near_limit_rate": mean("near_limit_close"),
    }
    two = {"cs_hot_mean": mean("hot"), "cs_hot_concentration_rank": pct_rank("hot"), "hot_p90": (f"percentile(hot, 0.9) over ({_DAY})" if t.spark else f"quantile_cont(hot, 0.9) over ({_DAY})")}
    three = {"cs_hot_top_decile_mean": f"avg(case when hot >= hot_p90 then hot end) over ({_DAY})"}
    four = {
        "cs_emotion_score": "2 * cs_limit_up_rate + cs_big_up_rate + cs_near_limit_rate + 0.1 * cs_hot_top_decile_mean - 2 * cs_limit_down_rate - cs_big_down_rate - 0.5 * cs_failed_limit_up_rate", "rel_ret_1_to_market": "ret_1 - cs_market_mean_ret_1", "rel_range_to_market": "range_pct / greatest(abs(cs_market_mean_range), 0.000001)",
        "volume_z_x_cs_ret_rank": "volume_z_20 * cs_ret_1_rank", "close_pos_x_cs_range_rank": "close_position * cs_range_rank",
    }
    return [one, two, three, four]


def cross_section(rows: DataFrame) -> DataFrame:
    for layer in cross_layers(Text()):
        rows = rows.withColumns({k: F.expr(x) for k, x in layer.items()})
    return rows

