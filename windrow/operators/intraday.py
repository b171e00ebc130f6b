"""Measures of a day from its intraday bars: one window pass for positions and steps, one aggregate a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["symbol", "date"]


def _pct(value: Column, base: Column) -> Column:
    return F.when(F.abs(base) < 1e-12, 0.0).otherwise(100 * (value / F.nullif(base, F.lit(0.0)) - 1))


def _corr(x: Column, y: Column, n: Column, least: int) -> Column:
    """Pearson's correlation from sums; 0 where a side is constant or there are too few."""
    mx, my = F.avg(x), F.avg(y)
    vx, vy = F.avg(x * x) - mx * mx, F.avg(y * y) - my * my
    return F.when((n < least) | (vx <= 1e-18) | (vy <= 1e-18), 0.0).otherwise((F.avg(x * y) - mx * my) / F.sqrt(vx * vy))


def placed(bars: DataFrame) -> DataFrame:
    """Bars with their place in the day, first and last times, the step in per cent and the one before, and the rank by volume."""
    b = bars.dropna(subset=["open", "high", "low", "close"]).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    w, day = Window.partitionBy(*GROUP).orderBy("timestamp"), Window.partitionBy(*GROUP)
    step = F.coalesce(100 * (F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1), F.lit(0.0))
    b = b.withColumns({
        "i": F.row_number().over(w) - 1, "n": F.count("*").over(day), "t0": F.min("timestamp").over(day), "t1": F.max("timestamp").over(day), "r": step,
        "by_volume": F.row_number().over(Window.partitionBy(*GROUP).orderBy("volume", "timestamp")), "all_volume": F.sum("volume").over(day),
    })
    seconds = lambda a, z: (F.unix_micros(F.col(z).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6
    b = b.withColumns({"before": F.lag("r").over(w), "since": seconds("t0", "timestamp"), "left": seconds("timestamp", "t1"), "span": F.greatest(seconds("t0", "t1"), F.lit(1.0)), "x": F.when(F.col("n") > 1, -1 + 2 * F.col("i") / (F.col("n") - 1)).otherwise(0.0)})
    clock = F.hour("timestamp") * 3600 + F.minute("timestamp") * 60 + F.second("timestamp")
    b = b.withColumn("clock", clock).withColumn("mean_x", F.sum(F.col("x") * F.col("volume")).over(day) / F.nullif(F.col("all_volume"), F.lit(0.0))).withColumn("mean_r", F.avg("r").over(day))
    return b.withColumn("dx", F.col("x") - F.col("mean_x")).withColumn("dr", F.col("r") - F.col("mean_r"))


def factors(bars: DataFrame) -> DataFrame:
    """symbol, date and 25 measures of each day."""
    b = placed(bars)
    first = lambda c, when=None: F.min_by(c, F.when(when, F.col("timestamp")) if when is not None else F.col("timestamp"))
    final = lambda c, when=None: F.max_by(c, F.when(when, F.col("timestamp")) if when is not None else F.col("timestamp"))
    volume = lambda when: F.coalesce(F.sum(F.when(when, F.col("volume"))), F.lit(0.0))
    n, total = F.count("*"), F.sum("volume")
    minutes = F.when(n <= 1, 1.0).otherwise(F.greatest(F.max("since") / 60, n.cast("double")))
    per = lambda m: total / F.greatest(minutes / m, F.lit(1.0))
    ratio = lambda x, y: F.when(y > 0, x / F.nullif(y, F.lit(0.0))).otherwise(0.0)
    late, last5, early, midday, noon = F.col("left") <= 1800, F.col("left") <= 300, F.col("since") <= 900, F.col("clock").between(39600, 41400), F.col("clock").between(46800, 47700)
    opened, closed = first("open"), final("close")
    whole, tail = _pct(closed, opened), _pct(closed, first("open", late))
    inside = lambda when: F.coalesce(_pct(final("close", when), first("open", when)), F.lit(0.0))
    high, low = F.max("high"), F.min("low")
    p = F.col("volume") / F.nullif(F.col("all_volume"), F.lit(0.0))
    m2r, m3r, m4r = (F.avg(F.pow("dr", F.lit(k))) for k in (2, 3, 4))
    sx2, sx3 = (F.sum(F.pow("dx", F.lit(k)) * F.col("volume")) / F.nullif(total, F.lit(0.0)) for k in (2, 3))
    morning, afternoon = volume(F.col("clock") < 43200), volume(F.col("clock") >= 43200)
    return b.groupBy(*GROUP).agg(
        whole.alias("intraday_return"), tail.alias("last_30min_return"), (tail / F.greatest(F.abs(whole), F.lit(0.05))).alias("last_30min_vs_day"), _pct(closed, first("open", last5)).alias("last_5min_return"), ratio(volume(late), per(30)).alias("last_30min_volume_ratio"),
        _pct(final("close", early), first("open", early)).alias("first_15min_return"), ratio(volume(early), per(15)).alias("first_15min_volume_ratio"), inside(midday).alias("midday_return"), inside(noon).alias("afternoon_start_return"),
        ratio(final("volume"), total / n).alias("closing_auction_volume_ratio"), _pct(closed, F.when(total > 0, F.sum("amount") / F.nullif(total, F.lit(0.0))).otherwise(closed)).alias("vwap_deviation_eod"),
        (F.min_by("since", F.struct(-F.col("high"), F.col("timestamp"))) / F.max("span")).alias("high_point_time"), (F.min_by("since", F.struct("low", "timestamp")) / F.max("span")).alias("low_point_time"),
        F.when(high - low <= 1e-12, 0.5).otherwise((closed - low) / F.nullif(high - low, F.lit(0.0))).alias("intraday_close_position"), F.when((total <= 0) | (n <= 1) | (sx2 <= 1e-24), 0.0).otherwise(sx3 / F.pow(sx2, F.lit(1.5))).alias("volume_distribution_skew"),
        F.when((total <= 0) | (n <= 1), 0.0).otherwise(-F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0)) / F.ln(F.greatest(n, F.lit(2)))).alias("volume_entropy"), F.when(total <= 0, 0.0).otherwise(2 * F.sum(F.col("by_volume") * F.col("volume")) / (n * F.nullif(total, F.lit(0.0))) - (n + 1) / n).alias("volume_gini"),
        _corr(F.col("r"), F.col("volume"), n, 2).alias("price_volume_corr_intraday"), _corr(F.when(F.col("before").isNotNull(), F.col("r")), F.col("before"), n, 3).alias("return_autocorr_intraday"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("realized_volatility_5min"),
        F.when((n < 3) | (m2r <= 1e-24), 0.0).otherwise(m3r / F.pow(m2r, F.lit(1.5))).alias("realized_skew"), F.when((n < 4) | (m2r <= 1e-24), 0.0).otherwise(m4r / (m2r * m2r)).alias("realized_kurtosis"), (F.abs(whole) / F.greatest(F.sum(F.abs("r")), F.lit(0.05))).alias("intraday_trend_strength"),
        (F.when((morning == 0) & (afternoon == 0), volume(F.col("i") < F.floor(F.col("n") / 2)) / F.greatest(volume(F.col("i") >= F.floor(F.col("n") / 2)), F.lit(1e-12))).otherwise(morning / F.greatest(afternoon, F.lit(1e-12)))).alias("morning_afternoon_imbalance"),
        ratio(volume(F.col("r") > 0), total).alias("up_volume_ratio"),
    )
