"""Limit boards, market emotion by date, board structure by symbol and date, cross-market returns.

Rows are worked on in three passes: by symbol (changes, streaks), by date (ranks, totals) and, for what depends on the
days before, over the small table of dates.  Rules are conditions over named columns, kept as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import change_null, lag_null, max_last, mean_last, min_last, ordered, streak_of

LIMIT, ONE_WORD, SEALED = 9.5, 9.0, 0.95

#: Conditions of the market's phases; the first that holds is the code, 6 if none does.
PHASES = {
    "ice": "ad < 0.5 and up < 20 and (broken > 0.60 or premium < -3)",
    "trial": "up between 20 and 40 and broken between 0.40 and 0.60 and premium between -1 and 1",
    "upswing": "ad > 2 and up between 40 and 80 and broken < 0.30 and premium > 3",
    "climax": "up > 80 and broken < 0.20 and premium > 5",
    "divergence": "up between 30 and 50 and broken between 0.40 and 0.55 and premium between 0 and 2",
    "ebbing": "ad < 1 and up < 20 and (broken > 0.50 or premium < -2)",
}
#: Signals of a date, over its totals and what the days before were.
SIGNALS = {
    "liquidity_exhaustion_signal": "down >= 10 or down_rate >= 0.02 or (new_low > new_high * 1.5 and ad < 0.75) or ebbing = 1",
    "market_split_signal": "(up >= 10 and down >= 5) or (up >= 20 and broken >= 0.50)",
    "vol_stagnation_signal": "near_high and ad <= 1.2 and up < up_max_10",
    "volume_is_king_signal": "pressure >= 1.10 and percentile >= 0.60 and up >= 20 and broken < 0.50 and ad >= 1",
    "ground_volume_risk": "percentile <= 0.20 and up < 20 and ad < 1",
    "seal_rate_80_threshold": "seal >= 0.80 and up >= 10",
    "strong_market_regime": "ad >= 1.50 and up >= 30 and broken <= 0.35 and pressure >= 1",
    "weak_market_oversold_regime": "ad <= 0.75 and (down >= 5 or new_low > new_high) and (broken >= 0.45 or premium <= -2 or percentile <= 0.35)",
    "collapse_warning_signal": "(chase <= -2 or chase_win <= 0.40) and rebound <= 0 and (ad < 1 or down >= 5 or broken >= 0.45)",
    "bull_rotation_upgrade": "cycle >= 3 and up >= up_mean_5 and pressure >= 1 and boards >= 2",
    "post_decline_transition": "fell and pressure >= 1 and ad >= 1.20 and up >= up_before and broken <= 0.50",
    "decline_stabilize_signal": "fell and new_low <= new_low_before and down <= down_before and ad >= 0.80 and premium >= -3",
}


def board_rows(bars: DataFrame) -> DataFrame:
    """Each bar with its change, limit flags, board streak and what the day before was; unknown flags are false."""
    before = lag_null("close")
    up = lambda x: F.coalesce(100 * (F.col(x) / F.nullif(before, F.lit(0.0)) - 1), F.lit(-1e9))
    b = bars.withColumns({
        "prev_close": before, "ret": change_null("close"), "position": (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)),
        "touched": up("high") >= LIMIT, "low_up": up("low") >= ONE_WORD, "new_high": F.coalesce(F.col("close") >= max_last("close", 20, 5), F.lit(False)), "new_low": F.coalesce(F.col("close") <= min_last("close", 20, 5), F.lit(False)),
        "volume_vs_prev": F.coalesce(F.col("volume") / F.nullif(lag_null("volume"), F.lit(0.0)), F.lit(0.0)),
    })
    b = b.withColumn("limit_up", F.coalesce(F.col("ret") >= LIMIT, F.lit(False))).withColumn("limit_down", F.coalesce(F.col("ret") <= -LIMIT, F.lit(False)))
    b = b.withColumn("sealed", F.col("limit_up") & (F.coalesce("position", F.lit(0.0)) >= SEALED)).withColumn("one_word", F.col("limit_up") & F.col("low_up"))
    b = b.withColumn("failed", F.col("touched") & ~F.col("sealed"))
    b = streak_of(b, "board", F.col("limit_up"))
    prev = lambda c, default: F.coalesce(F.lag(c).over(ordered()), F.lit(default))
    b = b.withColumns({"prev_board": prev("board", 0.0), "prev_limit_up": prev("limit_up", False), "prev_failed": prev("failed", False), "prev_ret": prev("ret", 0.0)})
    return b.withColumn("promoted", (F.col("board") == F.col("prev_board") + 1) & (F.col("board") > 1))


def ranked_rows(rows: DataFrame, n: int = 20) -> DataFrame:
    """Adds whether a symbol was among the n best or worst of its day before; ties go by symbol."""
    day = Window.partitionBy("date")
    rank = lambda o: F.when(F.col("ret").isNotNull(), F.row_number().over(day.orderBy(o, "symbol")))
    out = rows.withColumn("top_rank", rank(F.col("ret").desc_nulls_last())).withColumn("bottom_rank", rank(F.col("ret").asc_nulls_last()))
    was = lambda c: F.coalesce(F.lag(c).over(ordered()) <= n, F.lit(False))
    return out.withColumn("prev_top", was("top_rank")).withColumn("prev_bottom", was("bottom_rank"))


def emotion(rows: DataFrame) -> DataFrame:
    """One row a date: counts, rates, promotions, premiums."""
    n = lambda c: F.sum(F.col(c).cast("double"))
    ratio = lambda hit, of: F.coalesce(F.sum((F.col(hit) & of).cast("double")) / F.nullif(F.sum(of.cast("double")), F.lit(0.0)), F.lit(0.0))
    under = lambda flag, x: F.coalesce(F.avg(F.when(F.col(flag), x)), F.lit(0.0))
    level = F.col("prev_board")
    top, bottom = under("prev_top", F.col("ret")), under("prev_bottom", F.col("ret"))
    height = F.max("board")
    return rows.withColumn("prev_boards", F.col("prev_board") >= 2).groupBy("date").agg(
        n("limit_up").alias("market_limit_up_count"), n("limit_down").alias("market_limit_down_count"), n("failed").alias("market_broken_board_count"),
        ratio("failed", F.col("touched")).alias("market_broken_board_rate"), ratio("failed", F.col("touched") & (level == 0)).alias("market_broken_board_rate_1st"), ratio("failed", F.col("touched") & (level == 1)).alias("market_broken_board_rate_1to2"),
        F.avg(F.col("failed").cast("double")).alias("market_failed_limit_up_rate"), F.avg(F.col("sealed").cast("double")).alias("market_seal_rate"), ratio("sealed", F.col("touched")).alias("market_limit_seal_success_rate"),
        F.avg(F.col("limit_down").cast("double")).alias("market_limit_down_rate"), n("one_word").alias("market_one_word_board_count"), (n("limit_up") - n("failed") - n("limit_down")).alias("market_emotion_score"),
        (F.coalesce(F.sum((F.col("ret") > 0).cast("double")), F.lit(0.0)) / F.greatest(F.coalesce(F.sum((F.col("ret") < 0).cast("double")), F.lit(0.0)), F.lit(1.0))).alias("market_advance_decline_ratio"),
        n("new_high").alias("market_new_high_20_count"), n("new_low").alias("market_new_low_20_count"), F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("market_active_turnover_mean"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("market_active_amount_sum"),
        height.alias("market_max_board_height"), F.coalesce(F.count_distinct(F.when(F.col("board") > 0, F.col("board"))) / F.nullif(height, F.lit(0.0)), F.lit(0.0)).alias("market_echelon_completeness"),
        ratio("promoted", level > 0).alias("market_board_promotion_rate"), ratio("promoted", level == 1).alias("market_board_promotion_rate_1to2"), ratio("promoted", level == 2).alias("market_board_promotion_rate_2to3"), ratio("promoted", level >= 3).alias("market_board_promotion_rate_high"),
        under("prev_limit_up", F.col("ret")).alias("prev_limit_up_premium"), under("prev_boards", F.col("ret")).alias("prev_board_premium"),
        top.alias("prev_top20_chase_return"), under("prev_top", F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("prev_top20_chase_win_rate"), bottom.alias("prev_bottom20_rebound_return"), (top - bottom).alias("money_effect_spread_20"),
    )


#: Short names that the rules use.
SHORT = {
    "up": "market_limit_up_count", "down": "market_limit_down_count", "down_rate": "market_limit_down_rate", "broken": "market_broken_board_rate", "score": "market_emotion_score", "premium": "prev_limit_up_premium",
    "amount": "market_active_amount_sum", "seal": "market_limit_seal_success_rate", "chase": "prev_top20_chase_return", "chase_win": "prev_top20_chase_win_rate", "rebound": "prev_bottom20_rebound_return",
    "new_high": "market_new_high_20_count", "new_low": "market_new_low_20_count", "ad": "market_advance_decline_ratio", "boards": "market_max_board_height",
}


def _dates(df: DataFrame) -> DataFrame:
    """One key for the table of dates, which has a row a trading day, so that the same helpers serve it."""
    return df.withColumn("symbol", F.lit(""))


def phases(dates: DataFrame) -> DataFrame:
    x = dates.select("date", *(F.col(v).alias(k) for k, v in SHORT.items()))
    code = F.lit(6.0)
    for i, rule in reversed(list(enumerate(PHASES.values()))):
        code = F.when(F.expr(rule), float(i)).otherwise(code)
    x = x.withColumns({k: F.when(F.expr(r), 1.0).otherwise(0.0) for k, r in PHASES.items()} | {"code": code})
    x = streak_of(streak_of(_dates(x), "ice_days", F.col("score") < 0), "premium_days", F.col("premium") > 3)
    risk = ((F.col("climax") > 0) & (F.col("premium_days") >= 2)) | (F.col("premium") > 5)
    setup = ((F.col("ice") > 0) & (F.col("ice_days") >= 2)) | (F.col("premium") < -3)
    return x.withColumn("climax_risk", F.when(risk, 1.0).otherwise(0.0)).withColumn("rebound_setup", F.when(setup, 1.0).otherwise(0.0))


def structure(dates: DataFrame) -> DataFrame:
    """Signals of each date, over phases() of emotion()."""
    x = phases(dates)
    share = F.collect_list("amount").over(ordered().rowsBetween(-59, 0))
    x = x.withColumns({
        "pressure": F.coalesce(F.col("amount") / F.nullif(mean_last("amount", 20, 5), F.lit(0.0)), F.lit(0.0)),
        "near_high": F.col("amount") >= F.coalesce(max_last("amount", 20, 5), F.col("amount")) * 0.90,
        "percentile": F.when(F.size(share) < 10, 0.5).otherwise(F.size(F.filter(share, lambda v: v <= F.col("amount"))) / F.size(share)),
        "up_max_10": F.coalesce(max_last("up", 10, 3), F.col("up")), "up_mean_5": F.coalesce(mean_last("up", 5, 2), F.col("up")),
        "up_before": F.coalesce(lag_null("up"), F.col("up")), "down_before": F.coalesce(lag_null("down"), F.col("down")), "new_low_before": F.coalesce(lag_null("new_low"), F.col("new_low")),
        "fell": (F.coalesce(F.sum("score").over(ordered().rowsBetween(-3, -1)), F.lit(0.0)) < 0) | (F.coalesce(F.avg("ad").over(ordered().rowsBetween(-3, -1)), F.lit(1.0)) < 0.80),
    })
    x = streak_of(x, "cycle", F.expr("score > 0 and up >= 20 and broken < 0.50"))
    x = streak_of(x, "diverging", F.expr("broken >= 0.40 or divergence > 0"))
    x = x.withColumns({k: F.when(F.expr(r), 1.0).otherwise(0.0) for k, r in SIGNALS.items()})
    climax = F.when(F.expr("near_high and up >= 40 and broken < 0.35 and premium >= 0"), 2.0).when(F.expr("near_high and (market_split_signal = 1 or broken >= 0.45)"), 1.0).otherwise(0.0)
    phase = F.when(F.expr("liquidity_exhaustion_signal = 1 or vol_stagnation_signal = 1 or climax_risk > 0"), -1.0).when(F.expr("cycle >= 2 and broken < 0.40 and premium >= 0"), 1.0).otherwise(0.0)
    friday = F.expr("weekday(date) = 4 and ad < 1 and up < 30 and (broken >= 0.45 or premium < 0 or ground_volume_risk = 1)")
    return x.select(
        "date", F.col("cycle").alias("cycle_day_count"), F.col("diverging").alias("divergence_day_count"), F.col("pressure").alias("market_amount_ratio_20"), F.col("percentile").alias("market_amount_percentile_60"), *SIGNALS,
        climax.alias("quant_climax_type"), phase.alias("buy_sell_cycle_phase"), F.greatest(F.least(F.col("pressure") / 2 + F.col("up") / 100 + F.col("boards") / 10, F.lit(3.0)), F.lit(0.0)).alias("theme_capacity_score"),
        (F.col("strong_market_regime") - F.col("weak_market_oversold_regime")).alias("bull_hotspot_bear_oversold"), F.when(friday, 1.0).otherwise(0.0).alias("weak_friday_risk"),
    )


def board_structure(rows: DataFrame) -> DataFrame:
    """Board measures of each bar, beside the whole market's of its date."""
    day = Window.partitionBy("date")
    n = lambda c: F.sum(F.col(c).cast("double")).over(day)
    f: dict[str, Column] = {}
    b = streak_of(rows, "shrink_days", F.col("volume_vs_prev") < 1.0)
    b = streak_of(b, "down_days", F.col("ret") < 0)
    b = b.withColumns({
        "max_board": F.max("board").over(day), "max_prev": F.max("prev_board").over(day), "ups": n("limit_up"), "downs": n("limit_down"), "market": F.count("symbol").over(day).cast("double"), "brokens": n("failed"),
        "volume_before": lag_null("volume"), "full_before": max_last("volume", 60, 10), "mean_5": mean_last("close", 5),
    })
    b = b.withColumn("full_before", lag_null("full_before")).withColumn("broken_rate", F.col("brokens") / F.greatest(F.col("ups") + F.col("brokens"), F.lit(1.0)))
    b = b.withColumn("space_break", F.expr("coalesce(prev_board >= 2 and prev_board >= max_prev and (board <= 0 or ret <= -7), false)")).withColumn("broke", F.max(F.col("space_break").cast("int")).over(day))
    rules = {
        "is_space_board": "board > 0 and board >= max_board", "is_first_board": "board = 1", "is_second_board": "board = 2", "is_high_board": "board >= 3",
        "shrink_after_rotten": "prev_failed and volume_vs_prev < 0.70", "explosive_vol_next_weak": "volume_before >= full_before * 0.95 and coalesce(100 * (open / prev_close - 1), 0) < 1",
        "first_divergence_flag": "prev_board >= 2 and board <= prev_board and volume_vs_prev >= 1", "first_negative_flag": "prev_ret >= 5 and ret < 0 and close >= mean_5",
        "break_node_new_dragon": "broke = 1 and board = 1", "mid_cap_trap_risk": "(downs >= 10 or downs / market >= 0.02) and max_prev >= 3 and prev_board >= 2 and prev_board < max_prev",
        "buy_rise_divergence": "ret >= 3 and volume_vs_prev >= 1.2 and coalesce(position, 0.5) < 0.70", "bet_decline_exhaustion": "down_days >= 3 and volume_vs_prev >= 1 and coalesce(position, 0) >= 0.45",
        "one_day_trip_risk_proxy": "board = 1 and (ups <= 3 or broken_rate >= 0.50)",
    }
    f = {k: F.when(F.expr(r), 1.0).otherwise(0.0) for k, r in rules.items()}
    return b.select(
        "symbol", "date", F.col("board").alias("board_count"), F.col("prev_board").alias("prev_board_count"), F.col("promoted").cast("double").alias("board_promoted_today"),
        (F.col("board") / F.greatest("max_board", F.lit(1.0))).alias("board_vs_max"), F.greatest(F.col("max_board") - F.col("board"), F.lit(0.0)).alias("board_height_suppression"), "volume_vs_prev",
        F.when(F.col("volume_vs_prev") >= 1.0, 2.0).when(F.col("volume_vs_prev") >= 0.7, 1.0).otherwise(0.0).alias("volume_health_zone"), F.col("shrink_days").alias("consecutive_shrink_days"),
        *(x.alias(k) for k, x in f.items()), f["break_node_new_dragon"].alias("dragon_replace_signal"), F.when(F.col("promoted"), 1.0).when(F.expr("prev_board > 0 and board <= 0"), -1.0).otherwise(0.0).alias("board_keep_break_signal"),
    )


def cross_market(indexes: DataFrame, lag: int = 0, spans: tuple[int, ...] = (1, 3, 5), names: list[str] | None = None) -> DataFrame:
    """date and, by index, its changes over some rows, taken ``lag`` rows late; dates of any index."""
    w = Window.partitionBy("index_symbol").orderBy("date")
    late = indexes.withColumn("c", F.lag("close", lag).over(w) if lag else F.col("close"))
    change = {k: 100 * (F.col("c") / F.nullif(F.lag("c", k).over(w), F.lit(0.0)) - 1) for k in spans}
    long = late.select("date", F.regexp_replace(F.lower("index_symbol"), " ", "_").alias("index_symbol"), *(x.alias(f"ret_{k}") for k, x in change.items()))
    # the indexes are few and named by the caller's table; without names, their sorted list is read first
    names = names or sorted(r[0] for r in long.select("index_symbol").distinct().collect())
    return long.groupBy("date").pivot("index_symbol", names).agg(*(F.max(f"ret_{k}").alias(f"ret_{k}") for k in spans))
