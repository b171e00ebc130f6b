"""Point-in-time factors, labels, analogues and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, flag, positive
from ..functions.rolling import last, lag_null, ordered, std_of, streak_of
from .normalise import main_board

ABNORMAL = 3


def limit_threshold(symbol: Column) -> Column:
    three = F.left(symbol, F.lit(3))
    return F.when(three.isin("300", "301", "688"), 20.0).when(symbol.startswith("8") | symbol.startswith("4") | (three == "920"), 30.0).otherwise(10.0)


def labels(bars: DataFrame, horizons: tuple[int, ...], as_of: str | None = None) -> DataFrame:
    """symbol, date, horizon, return_pct, scenario of the bar h rows on; null where there is none, or it is later than ``as_of``."""
    entry = F.when(F.abs("close") < 1e-9, None).otherwise(F.col("close"))

    def one(h: int) -> Column:
        ahead = {c: F.lead(c, h).over(ordered()) for c in ("date", "open", "high", "low", "close")}
        return F.struct(F.lit(h).alias("horizon"), F.struct(*(v.alias(k) for k, v in ahead.items())).alias("bar"), entry.alias("entry"))

    rows = bars.select("symbol", "date", F.array(*map(one, horizons)).alias("x")).select("symbol", "date", F.explode("x").alias("x"))
    known = F.col("x.bar.date").isNotNull() & (F.lit(True) if as_of is None else F.col("x.bar.date") <= F.lit(as_of).cast("date"))
    r = F.when(known, 100 * (F.col("x.bar.close") / F.col("x.entry") - 1))
    out = rows.select("symbol", "date", F.col("x.horizon").alias("horizon"), r.alias("return_pct"), F.col("x.bar").alias("bar"))
    spread = F.greatest(F.col("bar.high") - F.col("bar.low"), F.lit(1e-9))
    upper = (F.col("bar.high") - F.greatest("bar.open", "bar.close")) / spread
    lower = (F.least("bar.open", "bar.close") - F.col("bar.low")) / spread
    x = F.col("return_pct")
    scenario = (
        F.when(x >= 3, "strong_up").when(x <= -3, "strong_down").when(upper >= 0.45, "upper_shadow_pressure").when(lower >= 0.45, "lower_shadow_support")
        .when(x > 0, "mild_up").when(x < 0, "mild_down").when(x.isNotNull(), "flat")
    )
    return out.select("symbol", "date", "horizon", "return_pct", scenario.alias("scenario"))


def snapshot(bars: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    """The factors of each symbol at its last bar up to ``as_of``, over its last ``n`` bars; trends of the market and the industry are 0
    where the bars have no such columns."""
    b = bars.where(F.col("date") <= F.lit(as_of).cast("date"))
    c, pc = F.col("close"), lag_null("close")
    b = b.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))).where(F.col("back") <= n)
    ret = lambda k: F.coalesce(100 * (c / F.nullif(F.lag("close", k).over(ordered()), F.lit(0.0)) - 1), F.lit(0.0))
    b = b.withColumns({
        "r1": ret(1), "r3": ret(3), "r5": ret(5), "lv": F.log1p("volume"), "la": F.log1p("amount"),
        "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.coalesce(pc, c)), F.abs(F.col("low") - F.coalesce(pc, c))),
        "sv": F.when(c > pc, F.col("volume")).when(c < pc, -F.col("volume")).otherwise(0.0),
        "tp": (F.col("high") + F.col("low") + c) / 3,
    })
    b = b.withColumn("mf", F.when(F.col("tp") > F.lag("tp").over(ordered()), F.col("tp") * F.col("volume")).when(F.col("tp") < F.lag("tp").over(ordered()), -F.col("tp") * F.col("volume")).otherwise(0.0))
    thr = limit_threshold(F.col("symbol"))
    b = streak_of(b, "up_days", F.col("r1") > 0)
    b = streak_of(b, "limit_days", F.col("r1") >= F.greatest(thr - 0.5, F.lit(1.0)))
    whole = last(n)
    z = lambda x: F.when((F.stddev_pop(x).over(whole) <= 1e-9) | (F.count("*").over(whole) < 2), 0.0).otherwise((F.col(x) - F.avg(x).over(whole)) / F.stddev_pop(x).over(whole))
    trend = lambda x: F.coalesce(F.avg(x).over(last(5)) / F.nullif(F.avg(x).over(ordered().rowsBetween(-9, -5)), F.lit(0.0)), F.lit(1.0))
    spread = F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))
    pos, neg = F.sum(positive(F.col("mf"))).over(last(14)), F.sum(positive(-F.col("mf"))).over(last(14))
    b = b.withColumns({
        "volatility_5d_pct": F.stddev_pop("r1").over(last(5)), "volatility_10d_pct": F.stddev_pop("r1").over(last(10)),
        "volume_zscore": z("lv"), "amount_zscore": z("la"), "turnover_zscore": z("turnover"),
        "volume_trend_ratio": trend("volume"), "amount_trend_ratio": trend("amount"), "turnover_trend_ratio": trend("turnover"),
        "range_pct": 100 * (F.col("high") - F.col("low")) / c, "atr_14_pct": 100 * F.avg("tr").over(last(14)) / c,
        "obv_trend_5": F.coalesce(F.sum("sv").over(last(4)) / F.nullif(F.sum(F.abs("volume")).over(last(5)), F.lit(0.0)), F.lit(0.0)),
        "mfi_14": F.when(neg < 1e-9, F.when(pos > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + pos / F.greatest(neg, F.lit(1e-9)))),
        "candle_body_ratio": F.abs(c - F.col("open")) / spread, "upper_shadow_ratio": (F.col("high") - F.greatest("open", "close")) / spread,
        "lower_shadow_ratio": (F.least("open", "close") - F.col("low")) / spread, "close_pos": (c - F.col("low")) / spread,
    })
    f = b.where("back = 1").withColumn("limit_threshold_pct", thr)
    fire = 0.35 * positive(F.col("amount_zscore")) + 0.25 * positive(F.col("volume_zscore")) + 0.20 * positive(F.col("turnover_zscore")) + positive(F.col("range_pct")) / 10 + positive(F.col("r1")) / 10 + 0.15 * positive(F.col("obv_trend_5"))
    reversal = positive(F.col("r1")) / 10 + F.col("upper_shadow_ratio") + (1 - F.col("close_pos")) + 0.1 * (positive(F.col("volume_zscore")) + positive(F.col("amount_zscore")))
    edge = F.greatest(thr - 0.5, F.lit(1.0))
    f = f.withColumn("large_order_fire_score", fire).withColumn("intraday_reversal_score", reversal)
    context = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in bars.columns else F.lit(0.0)
    f = f.withColumns({"market_trend": context("market_trend_5"), "industry_trend": context("industry_return_trend_5")}).withColumn("strength", F.col("industry_trend") - F.col("market_trend"))
    abnormal = [F.col("amount_zscore") >= 1, F.col("volume_zscore") >= 1, F.col("turnover_zscore") >= 1, F.col("range_pct") >= 3, F.col("volatility_10d_pct") >= 2.5, F.col("large_order_fire_score") >= 1.5]
    return f.select(
        "symbol", "date", F.col("r1").alias("recent_return_1d_pct"), F.col("r3").alias("recent_return_3d_pct"), F.col("r5").alias("recent_return_5d_pct"),
        "volatility_5d_pct", "volatility_10d_pct", "volume_zscore", "amount_zscore", "turnover_zscore", "volume_trend_ratio", "amount_trend_ratio", "turnover_trend_ratio", "range_pct", "atr_14_pct",
        "obv_trend_5", "mfi_14", "candle_body_ratio", "upper_shadow_ratio", "lower_shadow_ratio", "large_order_fire_score", "intraday_reversal_score",
        (0.45 * F.col("large_order_fire_score") + 0.20 * positive(F.col("strength")) + F.col("volatility_10d_pct") / 10 + 0.20 * F.least("limit_days", F.lit(3.0)) + 0.10 * positive(F.col("intraday_reversal_score"))).alias("short_hot_score"),
        "limit_threshold_pct", flag(F.col("r1") >= edge).alias("limit_up_like"), flag(F.col("r1") <= -edge).alias("limit_down_like"), flag(F.col("r1") >= 5).alias("big_up"), flag(F.col("r1") <= -5).alias("big_down"),
        F.col("market_trend").alias("market_trend_5"), F.col("industry_trend").alias("industry_trend_5"), F.col("strength").alias("industry_relative_strength_5"),
        flag(sum(map(flag, abnormal), F.lit(0.0)) >= 3).alias("short_candidate"), flag(main_board(F.col("symbol"))).alias("main_board_only"), F.col("up_days").alias("consecutive_up_days"), F.col("limit_days").alias("consecutive_limit_up_days"),
        flag(F.signum(F.col("r5")) * F.signum(F.col("volume_trend_ratio") - 1) < 0).alias("price_volume_divergence"),
        F.when(F.col("limit_days") <= 0, "none").when(F.col("limit_days") == 1, "first_board").when(F.col("limit_days") == 2, "second_board").otherwise("multi_board").alias("board_chain_stage"),
    )


def factor_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """exp(-1.5 times the mean relative distance) of two sets of factors, in [0.2, 1]."""
    d = sum((F.abs(a[k] - b[k]) / F.greatest(F.abs(a[k]), F.abs(b[k]), F.lit(1.0)) for k in a), F.lit(0.0)) / len(a)
    return clip(F.exp(-1.5 * d), 0.2, 1.0)


def vote(samples: DataFrame) -> DataFrame:
    """By horizon of a table (horizon, similarity, factor_similarity, return_pct): weighted share up, mean, and the plain ones."""
    w = F.pow(F.greatest("similarity", F.lit(0.001)), 2) * F.col("factor_similarity")
    x = samples.where("return_pct is not null").withColumn("w", w)
    up = (F.col("return_pct") > 0).cast("double")
    return x.groupBy("horizon").agg(F.count("*").alias("n"), (F.sum(F.col("w") * up) / F.sum("w")).alias("probability_up"), (F.sum(F.col("w") * F.col("return_pct")) / F.sum("w")).alias("expected_return"), F.avg(up).alias("unweighted_up"))


def quantiles(samples: DataFrame) -> DataFrame:
    q = F.percentile("return_pct", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return samples.where("return_pct is not null").groupBy("horizon").agg(q.alias("q")).select("horizon", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def scenarios(samples: DataFrame) -> DataFrame:
    x = samples.where("scenario is not null").withColumn("w", F.pow(F.greatest("similarity", F.lit(0.001)), 2) * F.col("factor_similarity"))
    by = x.groupBy("horizon", "scenario").agg(F.sum("w").alias("w"))
    return by.select("horizon", "scenario", (F.col("w") / F.sum("w").over(Window.partitionBy("horizon"))).alias("share"))


def blended(analogue: Column, model: Column, n: Column) -> tuple[Column, Column]:
    """(probability, confidence): 0.6 analogues and 0.4 model where there is one; few samples or an even chance make it low."""
    p = F.when(model.isNull(), analogue).otherwise(0.6 * analogue + 0.4 * model)
    tier = F.when(n < 20, "insufficient").when((n < 60) | p.between(0.45, 0.55), "low").when(model.isNotNull() & (n >= 100), "high").otherwise("medium")
    return p, tier


def backtest(predictions: DataFrame) -> DataFrame:
    """Accuracy, Brier score, confident share and baseline of (horizon, prob, actual), by horizon and over all."""
    hit = ((F.col("prob") >= 0.5) == (F.col("actual") == 1)).cast("double")
    sure = F.abs(F.col("prob") - 0.5) >= 0.1
    base = F.avg("actual")
    return predictions.rollup("horizon").agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(F.pow(F.col("prob") - F.col("actual"), 2)).alias("brier"), F.avg(F.when(sure, hit)).alias("confident_accuracy"),
        F.avg(sure.cast("double")).alias("confident_share"), F.greatest(base, 1 - base).alias("baseline_accuracy"), (base * (1 - base)).alias("baseline_brier"),
    )


__all__ = ["backtest", "blended", "factor_similarity", "labels", "limit_threshold", "quantiles", "scenarios", "snapshot", "std_of", "vote"]
