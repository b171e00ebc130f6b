"""Boards, market emotion, structure, and other markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market as M
from ..sources import bars as B
from .registry import VIEWS, query, rounded
from .similarity import _r

_D = lambda c: f"cast({c} as int)::double"
_RATIO = lambda hit, of: f"coalesce(sum(({hit} and {of})::int) / nullif(sum(({of})::int), 0), 0)"
_STREAK = lambda c, name, src, key="symbol": f"select * exclude (_f, _g), sum(_f) over (partition by {key + ', ' if key else ''}_g order by date rows unbounded preceding)::double as {name} from (select *, sum(1 - _f) over ({'partition by ' + key if key else ''} order by date rows unbounded preceding) as _g from (select *, case when {c} then 1 else 0 end as _f from {src}))"
VIEWS |= {
    "bd0": """select *, lag(close) over w as prev_close, 100 * (close / nullif(lag(close) over w, 0) - 1) as ret, (close - low) / nullif(high - low, 0) as position,
        coalesce(100 * (high / nullif(lag(close) over w, 0) - 1) >= 9.5, false) as touched, coalesce(100 * (low / nullif(lag(close) over w, 0) - 1) >= 9.0, false) as low_up,
        count(*) over w20 >= 5 and close >= max(close) over w20 as new_high, count(*) over w20 >= 5 and close <= min(close) over w20 as new_low,
        coalesce(volume / nullif(lag(volume) over w, 0), 0) as volume_vs_prev from bars window w as (partition by symbol order by date), w20 as (partition by symbol order by date rows 19 preceding)""",
    "bd1": """select *, coalesce(ret >= 9.5, false) as limit_up, coalesce(ret <= -9.5, false) as limit_down, coalesce(ret >= 9.5, false) and coalesce(position, 0) >= 0.95 as sealed,
        coalesce(ret >= 9.5, false) and low_up as one_word, touched and not (coalesce(ret >= 9.5, false) and coalesce(position, 0) >= 0.95) as failed from bd0""",
    "bd2": _STREAK("limit_up", "board", "bd1"),
    "bd3": """select *, coalesce(lag(board) over w, 0) as prev_board, coalesce(lag(limit_up) over w, false) as prev_limit_up, coalesce(lag(failed) over w, false) as prev_failed, coalesce(lag(ret) over w, 0) as prev_ret,
        board = coalesce(lag(board) over w, 0) + 1 and board > 1 as promoted, case when ret is not null then row_number() over (partition by date order by ret desc nulls last, symbol) end as top_rank,
        case when ret is not null then row_number() over (partition by date order by ret asc nulls last, symbol) end as bottom_rank from bd2 window w as (partition by symbol order by date)""",
    "bd": "select *, coalesce(lag(top_rank) over w <= 20, false) as prev_top, coalesce(lag(bottom_rank) over w <= 20, false) as prev_bottom from bd3 window w as (partition by symbol order by date)",
    "emo": f"""select date, sum(limit_up::int)::double as market_limit_up_count, sum(limit_down::int)::double as market_limit_down_count, sum(failed::int)::double as market_broken_board_count,
        {_RATIO('failed', 'touched')} as market_broken_board_rate, {_RATIO('failed', '(touched and prev_board = 0)')} as market_broken_board_rate_1st, {_RATIO('failed', '(touched and prev_board = 1)')} as market_broken_board_rate_1to2,
        avg(failed::int) as market_failed_limit_up_rate, avg(sealed::int) as market_seal_rate, {_RATIO('sealed', 'touched')} as market_limit_seal_success_rate, avg(limit_down::int) as market_limit_down_rate,
        sum(one_word::int)::double as market_one_word_board_count, (sum(limit_up::int) - sum(failed::int) - sum(limit_down::int))::double as market_emotion_score,
        coalesce(sum((ret > 0)::int), 0) / greatest(coalesce(sum((ret < 0)::int), 0), 1) as market_advance_decline_ratio, sum(new_high::int)::double as market_new_high_20_count, sum(new_low::int)::double as market_new_low_20_count,
        avg(turnover) as market_active_turnover_mean, sum(amount) as market_active_amount_sum, max(board) as market_max_board_height, coalesce(count(distinct case when board > 0 then board end) / nullif(max(board), 0), 0) as market_echelon_completeness,
        {_RATIO('promoted', 'prev_board > 0')} as market_board_promotion_rate, {_RATIO('promoted', 'prev_board = 1')} as market_board_promotion_rate_1to2, {_RATIO('promoted', 'prev_board = 2')} as market_board_promotion_rate_2to3, {_RATIO('promoted', 'prev_board >= 3')} as market_board_promotion_rate_high,
        coalesce(avg(ret) filter (where prev_limit_up), 0) as prev_limit_up_premium, coalesce(avg(ret) filter (where prev_board >= 2), 0) as prev_board_premium, coalesce(avg(ret) filter (where prev_top), 0) as prev_top20_chase_return,
        coalesce(avg((ret > 0)::int) filter (where prev_top), 0) as prev_top20_chase_win_rate, coalesce(avg(ret) filter (where prev_bottom), 0) as prev_bottom20_rebound_return,
        coalesce(avg(ret) filter (where prev_top), 0) - coalesce(avg(ret) filter (where prev_bottom), 0) as money_effect_spread_20 from bd group by date""",
    "ph0": "select date, " + ", ".join(f"{v} as {k}" for k, v in M.SHORT.items()) + " from emo",
    "ph1": "select *, " + ", ".join(f"case when {r} then 1.0::double else 0.0::double end as {k}" for k, r in M.PHASES.items()) + ", case " + " ".join(f"when {r} then {i}" for i, r in enumerate(M.PHASES.values())) + " else 6 end::double as code from ph0",
    "ph2": _STREAK("score < 0", "ice_days", "ph1", ""),
    "ph3": _STREAK("premium > 3", "premium_days", "ph2", ""),
    "ph": "select *, case when (climax > 0 and premium_days >= 2) or premium > 5 then 1.0::double else 0.0::double end as climax_risk, case when (ice > 0 and ice_days >= 2) or premium < -3 then 1.0::double else 0.0::double end as rebound_setup from ph3",
    "st0": """select *, case when count(*) over w20 >= 5 then coalesce(amount / nullif(avg(amount) over w20, 0), 0) else 0 end as pressure, amount >= (case when count(*) over w20 >= 5 then max(amount) over w20 else amount end) * 0.90 as near_high,
        case when count(*) over w60 < 10 then 0.5 else len(list_filter(list(amount) over w60, lambda v: v <= amount)) / len(list(amount) over w60) end as percentile,
        case when count(*) over w10 >= 3 then max(up) over w10 else up end as up_max_10, case when count(*) over w5 >= 2 then avg(up) over w5 else up end as up_mean_5,
        coalesce(lag(up) over w, up) as up_before, coalesce(lag(down) over w, down) as down_before, coalesce(lag(new_low) over w, new_low) as new_low_before,
        coalesce(sum(score) over w3, 0) < 0 or coalesce(avg(ad) over w3, 1) < 0.80 as fell from ph
        window w as (order by date), w3 as (order by date rows between 3 preceding and 1 preceding), w5 as (order by date rows 4 preceding), w10 as (order by date rows 9 preceding), w20 as (order by date rows 19 preceding), w60 as (order by date rows 59 preceding)""",
    "st1": _STREAK("score > 0 and up >= 20 and broken < 0.50", "cycle", "st0", ""),
    "st2": _STREAK("broken >= 0.40 or divergence > 0", "diverging", "st1", ""),
    "st3": "select *, " + ", ".join(f"case when {r} then 1.0::double else 0.0::double end as {k}" for k, r in M.SIGNALS.items()) + " from st2",
    "bs1": _STREAK("volume_vs_prev < 1.0", "shrink_days", "bd"),
    "bs2": _STREAK("ret < 0", "down_days", "bs1"),
    "bs3": """select *, max(board) over d as max_board, max(prev_board) over d as max_prev, sum(limit_up::int) over d as ups, sum(limit_down::int) over d as downs, count(*) over d as market, sum(failed::int) over d as brokens,
        lag(volume) over w as volume_before, case when count(*) over w60 >= 10 then max(volume) over w60 end as full_now, avg(close) over w5 as mean_5 from bs2
        window d as (partition by date), w as (partition by symbol order by date), w5 as (partition by symbol order by date rows 4 preceding), w60 as (partition by symbol order by date rows 59 preceding)""",
    "bs": """select *, lag(full_now) over (partition by symbol order by date) as full_before, brokens / greatest(ups + brokens, 1) as broken_rate,
        max(coalesce(prev_board >= 2 and prev_board >= max_prev and (board <= 0 or ret <= -7), false)::int) over (partition by date) as broke from bs3""",
}


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return M.board_rows(B.daily(spark, d))


def _emotion(spark: SparkSession, d: str) -> DataFrame:
    return M.emotion(M.ranked_rows(_rows(spark, d)))


@query("select symbol, date, board, prev_board, promoted, sealed, failed from bd")
def board_streak(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("symbol", "date", "board", "prev_board", "promoted", "sealed", "failed")


_RULE = lambda c, name: f"{_D(f'coalesce({c}, false)')} as {name}"


@query("select symbol, date, board as board_count, prev_board as prev_board_count, promoted::int::double as board_promoted_today, round(board / greatest(max_board, 1), 6) as board_vs_max, greatest(max_board - board, 0) as board_height_suppression, round(volume_vs_prev, 6) as volume_vs_prev, "
       "case when volume_vs_prev >= 1 then 2.0::double when volume_vs_prev >= 0.7 then 1.0::double else 0.0::double end as volume_health_zone, shrink_days as consecutive_shrink_days, "
       + ", ".join((_RULE("board > 0 and board >= max_board", "is_space_board"), _RULE("board = 1", "is_first_board"), _RULE("board = 2", "is_second_board"), _RULE("board >= 3", "is_high_board"), _RULE("prev_failed and volume_vs_prev < 0.70", "shrink_after_rotten"),
                    _RULE("volume_before >= full_before * 0.95 and coalesce(100 * (open / prev_close - 1), 0) < 1", "explosive_vol_next_weak"), _RULE("prev_board >= 2 and board <= prev_board and volume_vs_prev >= 1", "first_divergence_flag"), _RULE("prev_ret >= 5 and ret < 0 and close >= mean_5", "first_negative_flag"),
                    _RULE("broke = 1 and board = 1", "break_node_new_dragon"), _RULE("broke = 1 and board = 1", "dragon_replace_signal"), _RULE("(downs >= 10 or downs / market >= 0.02) and max_prev >= 3 and prev_board >= 2 and prev_board < max_prev", "mid_cap_trap_risk"),
                    _RULE("ret >= 3 and volume_vs_prev >= 1.2 and coalesce(position, 0.5) < 0.70", "buy_rise_divergence"), _RULE("down_days >= 3 and volume_vs_prev >= 1 and coalesce(position, 0) >= 0.45", "bet_decline_exhaustion"), _RULE("board = 1 and (ups <= 3 or broken_rate >= 0.50)", "one_day_trip_risk_proxy")))
       + ", case when promoted then 1.0::double when prev_board > 0 and board <= 0 then -1.0::double else 0.0::double end as board_keep_break_signal from bs")
def board_structure(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.board_structure(M.ranked_rows(_rows(spark, d))))


def _part(name: str, *cols: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(_emotion(spark, d).select("date", *cols))

    run.__name__ = name
    return query(f"select date, {_r(*cols)} from emo")(run)


market_emotion_counts = _part("market_emotion_counts", "market_limit_up_count", "market_limit_down_count", "market_broken_board_count", "market_one_word_board_count", "market_new_high_20_count", "market_new_low_20_count", "market_emotion_score", "market_active_turnover_mean", "market_active_amount_sum")
market_emotion_rates = _part("market_emotion_rates", "market_broken_board_rate", "market_broken_board_rate_1st", "market_broken_board_rate_1to2", "market_failed_limit_up_rate", "market_seal_rate", "market_limit_seal_success_rate", "market_limit_down_rate", "market_advance_decline_ratio")
market_promotion = _part("market_promotion", "market_board_promotion_rate", "market_board_promotion_rate_1to2", "market_board_promotion_rate_2to3", "market_board_promotion_rate_high")
market_echelon = _part("market_echelon", "market_max_board_height", "market_echelon_completeness")
market_premium = _part("market_premium", "prev_limit_up_premium", "prev_board_premium", "prev_top20_chase_return", "prev_top20_chase_win_rate", "prev_bottom20_rebound_return", "money_effect_spread_20")


@query("select date, code as emotion_phase_code, " + ", ".join(f"{k} as emotion_phase_{k}" for k in M.PHASES) + ", ice_days as consecutive_ice_days, premium_days as consecutive_high_premium_days, climax_risk as emotion_climax_next_day_risk, rebound_setup as emotion_ice_rebound_setup from ph")
def market_phase(spark: SparkSession, d: str) -> DataFrame:
    p = M.phases(_emotion(spark, d))
    names = {"ice_days": "consecutive_ice_days", "premium_days": "consecutive_high_premium_days", "climax_risk": "emotion_climax_next_day_risk", "rebound_setup": "emotion_ice_rebound_setup"}
    return p.select("date", F.col("code").alias("emotion_phase_code"), *(F.col(k).alias(f"emotion_phase_{k}") for k in M.PHASES), *(F.col(k).alias(v) for k, v in names.items()))


@query("select date, cycle as cycle_day_count, diverging as divergence_day_count, round(pressure, 6) as market_amount_ratio_20, round(percentile, 6) as market_amount_percentile_60, " + ", ".join(M.SIGNALS) + """,
    case when near_high and up >= 40 and broken < 0.35 and premium >= 0 then 2.0::double when near_high and (market_split_signal = 1 or broken >= 0.45) then 1.0::double else 0.0::double end as quant_climax_type,
    case when liquidity_exhaustion_signal = 1 or vol_stagnation_signal = 1 or climax_risk > 0 then -1.0::double when cycle >= 2 and broken < 0.40 and premium >= 0 then 1.0::double else 0.0::double end as buy_sell_cycle_phase,
    round(greatest(least(pressure / 2 + up / 100 + boards / 10, 3), 0), 6) as theme_capacity_score, strong_market_regime - weak_market_oversold_regime as bull_hotspot_bear_oversold,
    case when isodow(date) = 5 and ad < 1 and up < 30 and (broken >= 0.45 or premium < 0 or ground_volume_risk = 1) then 1.0::double else 0.0::double end as weak_friday_risk from st3""")
def market_structure(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.structure(_emotion(spark, d)))


@query("select date, symbol, top_rank::int as top_rank, bottom_rank::int as bottom_rank, prev_top, prev_bottom from bd where top_rank <= 20 or bottom_rank <= 20 or prev_top or prev_bottom")
def top_bottom_20(spark: SparkSession, d: str) -> DataFrame:
    return M.ranked_rows(_rows(spark, d)).where("top_rank <= 20 or bottom_rank <= 20 or prev_top or prev_bottom").select("date", "symbol", "top_rank", "bottom_rank", "prev_top", "prev_bottom")


@query("select date, round(percentile, 6) as amount_percentile from st0")
def amount_percentile_60(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.structure(_emotion(spark, d)).select("date", F.col("market_amount_percentile_60").alias("amount_percentile")))


@query("with l as (select *, lag(close) over (partition by index_symbol order by date) as c from indexes), r as (select date, replace(lower(index_symbol), ' ', '_') as s, "
       + ", ".join(f"100 * (c / nullif(lag(c, {k}) over (partition by index_symbol order by date), 0) - 1) as r{k}" for k in (1, 3, 5)) + " from l) select date, "
       + ", ".join(f"round(max(r{k}) filter (where s = '{s}'), 6) as {s}_ret_{k}" for s in ("africa", "america", "asia", "europe", "middle_east") for k in (1, 3, 5)) + " from r group by date")
def cross_market_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.cross_market(B.indexes(spark, d), 1))
