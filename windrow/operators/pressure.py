"""Pressures and alignments of a row with its market: what a stock's own day means under the day's market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, flag, positive

#: The columns that with_pressures() adds.
NAMES = (
    "cs_low_price_advantage cs_weak_market_focus cs_stock_leads_index_rebound cs_reversal_day_leader_quality cs_emotion_bull_signal cs_strong_rebound_not_bottom_risk "
    "market_cycle_failed_pressure market_cycle_broken_pressure market_cycle_seal_pressure market_monday_hot_new_high_risk market_hot_cycle_short_pressure "
    "chase_market_up_alignment strong_market_anti_drop weak_market_oversold_rebound second_board_leader_proxy seal80_second_board_quality "
    "bull_hotspot_bear_oversold_signal money_effect_chase_alignment collapse_hot_stock_risk weak_rebound_money_effect"
).split()


def rebounds(rows: DataFrame) -> DataFrame:
    """(date, cs_strong_rebound_not_bottom_risk): a strong day after three weak ones that has no broad support."""
    mean = lambda c: F.avg(c)
    day = rows.groupBy("date").agg(mean("ret_1").alias("r"), mean((F.col("ret_1") > 0).cast("double")).alias("p"), mean("limit_up_like").alias("u"), mean("failed_limit_up").alias("f"), mean("big_down").alias("b"))
    before = F.sum("r").over(Window.orderBy("date").rowsBetween(-3, -1))  # one row a trading day
    weak = F.coalesce(flag(before <= -1.5), F.lit(0.0))
    risk = weak * flag(F.col("r") >= 0.8) * (1 - 5 * clip(F.col("u"), 0.0, 0.2)) * (1 + 2 * F.col("f") + F.col("b")) * flag(F.col("p") < 0.65)
    return day.select("date", risk.alias("cs_strong_rebound_not_bottom_risk"))


def with_pressures(rows: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Adds the columns NAMES to cross-section rows; ``dates`` holds the market's own columns by date, and what it lacks counts as 0."""
    if dates is not None:
        rows = rows.join(dates.select("date", *(c for c in dates.columns if c not in rows.columns)), "date", "left")
    rows = rows.join(rebounds(rows), "date", "left")
    have = set(rows.columns)
    c = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)
    ret, pos, near, vol = c("ret_1"), c("close_position"), c("near_limit_close"), positive(c("volume_z_20"))
    up, mean, rank, rel = c("cs_market_positive_rate"), c("cs_market_mean_ret_1"), c("cs_ret_1_rank"), positive(c("rel_ret_1_to_market"))
    weak = positive(1 - up) + positive(-mean) / 5 + 2 * c("cs_limit_down_rate")
    turned = flag(mean > 0) * flag(up >= 0.55) * flag(c("cs_limit_down_rate") <= c("cs_limit_up_rate") + 1e-6)
    strong = F.greatest(c("strong_market_regime"), flag((mean >= 0.80) & (up >= 0.55)))
    oversold = F.greatest(c("weak_market_oversold_regime"), flag((up <= 0.45) & ((c("market_limit_down_count") >= 5) | (c("market_new_low_20_count") > c("market_new_high_20_count")))))
    chase = flag(ret >= 3) * pos * (1 + vol / 3)
    cycle, hot = flag(c("cycle_day_count") >= 3), flag(c("market_limit_up_count") >= 40)
    failed, broken, mood = c("market_failed_limit_up_rate"), F.log1p(positive(c("market_broken_board_count"))), 1 + positive(c("market_emotion_score")) / 50
    low, shadow, gate, second = flag(c("dist_low_20") <= 0.08), c("lower_shadow_pct"), c("daily_amount_300m_gate"), c("second_board_entry")
    heat = 2 * c("cs_limit_up_rate") + c("cs_big_up_rate") + c("cs_near_limit_rate") + 0.1 * c("cs_hot_top_decile_mean")
    values: dict[str, Column] = {
        "cs_low_price_advantage": (1 - c("cs_price_rank")) * weak * (positive(ret) / 10 + near + pos), "cs_weak_market_focus": weak * c("cs_hot_concentration_rank") * (pos + near),
        "cs_stock_leads_index_rebound": rel / 10 * rank * weak * pos, "cs_reversal_day_leader_quality": turned * rank * pos * (1 + vol / 3), "cs_emotion_bull_signal": flag(up >= 0.55) * heat * rank,
        "market_cycle_failed_pressure": cycle * failed * broken, "market_cycle_broken_pressure": cycle * broken * mood, "market_cycle_seal_pressure": cycle * c("market_seal_rate") * mood,
        "market_monday_hot_new_high_risk": flag(c("day_of_week_cos") >= 0.90) * F.log1p(positive(c("market_new_high_20_count"))) * hot, "market_hot_cycle_short_pressure": cycle * hot * (failed + positive(c("cs_emotion_score")) / 10),
        "chase_market_up_alignment": chase * (strong - oversold), "strong_market_anti_drop": strong * flag(ret >= -1) * flag(c("rel_ret_1_to_market") >= -1) * pos * (1 + gate),
        "weak_market_oversold_rebound": oversold * low * (shadow + positive(ret) / 10) * (1 + vol / 3), "second_board_leader_proxy": second * rank * (1 - failed) * (1 + positive(c("market_max_board_height") - 2) / 5),
        "seal80_second_board_quality": c("seal_rate_80_threshold") * second * pos * (1 + gate + positive(c("volume_price_match"))), "bull_hotspot_bear_oversold_signal": c("bull_hotspot_bear_oversold") * (near + rel / 10 + low * shadow),
        "money_effect_chase_alignment": chase * (clip(c("money_effect_spread_20") / 5, -2.0, 2.0) + clip(c("prev_top20_chase_win_rate") - 0.5, -0.5, 0.5)),
        "collapse_hot_stock_risk": c("collapse_warning_signal") * (near + positive(c("hot_exhaustion_score")) + positive(c("limit_up_streak") - 1)), "weak_rebound_money_effect": oversold * positive(c("prev_bottom20_rebound_return")) / 5 * (low + shadow),
        "cs_strong_rebound_not_bottom_risk": c("cs_strong_rebound_not_bottom_risk"),
    }
    return rows.withColumns(values)
