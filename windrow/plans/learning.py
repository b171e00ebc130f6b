"""Splits, grids, models, catalog and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import wilson
from ..operators import catalog as K
from ..operators import factors as P
from ..operators import models as M
from ..operators import probe as R
from ..sources import bars as B
from ..streaming import ticks as T
from . import prediction
from .registry import VIEWS, query, rounded

assert prediction.VIEWS is VIEWS  # its views come first

USED = ["ret_1", "ret_5", "range_pct", "close_position", "volume_z_20", "amount_z_20", "turnover_mean_5"]
_TRAIN, _TEST, _END = "1999-12-31", "2000-02-01", "2001-06-30"
VIEWS |= {
    "sp0": "select symbol, date, label_date, label, ret_1, ret_5, range_pct, close_position, volume_z_20, amount_z_20, turnover_mean_5 from f6 where position >= 25 and label is not null",
    "spd": f"select distinct label_date from sp0 where label_date <= date '{_TRAIN}'",
    "spn": "select greatest(least(cast(floor(count(*) * 0.8) as int), count(*) - 1), 1) as s from spd",
    "spc": "select max(label_date) filter (where i = s) as validation_start, max(label_date) filter (where i = greatest(s - 5, 0)) as embargo_start from (select label_date, row_number() over (order by label_date) - 1 as i from spd), spn",
    "sp": f"""select * from (select sp0.*, case when label_date <= date '{_TRAIN}' and label_date < embargo_start then 'fit' when label_date <= date '{_TRAIN}' and label_date >= validation_start then 'valid'
        when date >= date '{_TEST}' and label_date <= date '{_END}' then 'lockbox' end as part from sp0, spc) where part is not null""",
    "pr": "select 0.5 + 0.4 * sin(volume) as prob, case when return_pct > 0 then 1 else 0 end as actual from lab join bars using (symbol, date) where return_pct is not null and horizon = 1",
}


def _split(spark: SparkSession, d: str) -> DataFrame:
    rows = R.features(B.daily(spark, d)).where("position >= 25 and label is not null").select("symbol", "date", "label_date", "label", *USED)
    return M.split(rows, _TRAIN, _TEST, _END)


@query("select part, count(*) as n, min(date) as first, max(date) as last, min(label_date) as first_label, max(label_date) as last_label from sp group by part")
def purged_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).groupBy("part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.min("label_date").alias("first_label"), F.max("label_date").alias("last_label"))


@query("select max(label_date) filter (where part = 'fit') as fit_label_end, min(label_date) filter (where part = 'valid') as validation_label_start, max(label_date) filter (where part = 'fit') < min(label_date) filter (where part = 'valid') as purged from sp")
def split_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    return M.overlap_check(_split(spark, d))


@query("with s as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in USED) + " from sp where part = 'fit') select symbol, date, part, " + ", ".join(f"round(({c} - m_{c}) / (case when s_{c} < 1e-9 then 1 else s_{c} end), 6) + 0.0::double as {c}" for c in USED) + " from sp, s")
def train_standardize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.standardised(_split(spark, d), USED).drop("label_date", "label"))


@query("with s as (select " + ", ".join(f"avg({c}) as m_{c}, case when stddev_samp({c}) < 1e-9 then 1 else stddev_samp({c}) end as s_{c}" for c in USED) + """ from sp where part = 'fit'),
    o as (select *, row_number() over (order by date, symbol) - 1 as k, count(*) over () as n from sp where part = 'fit'), c as (select *, least(4, greatest(1, n // 2000)) as cs from o),
    b as (select *, (select count(*) from range(1, 5) t(i) where i <= cs and round_even(n * i / cs, 0) <= k) as chunk from c),
    l as (""" + " union all ".join(f"select cs, chunk, label as y, '{c}' as feature, ({c} - m_{c}) / s_{c} as x from b, s" for c in USED) + """),
    w as (select feature, avg(x * y) - avg(x) * avg(y) as cov, (avg(x * y) - avg(x) * avg(y)) / greatest(stddev_samp(y), 1e-6) as g from l group by 1),
    p as (select feature, (avg(x * y) - avg(x) * avg(y)) / greatest(stddev_samp(y), 1e-6) as s from l where cs > 1 group by feature, chunk having count(*) >= 50),
    q as (select feature, quantile_disc(abs(s), 0.5) as med, avg((sign(s) = sign(g))::int) as agree from p join w using (feature) group by feature)
    select feature, round(coalesce((0.65 * abs(g) + 0.35 * med) * (0.5 + 0.5 * agree), abs(g)), 6) as score from w left join q using (feature)""")
def feature_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.feature_scores(_split(spark, d).where("part = 'fit'"), USED))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    x = P.labels(B.daily(spark, d), (1,)).where("return_pct is not null").join(B.daily(spark, d).select("symbol", "date", "volume"), ["symbol", "date"])
    return x.select((0.5 + 0.4 * F.sin("volume")).alias("prob"), F.when(F.col("return_pct") > 0, 1).otherwise(0).alias("actual"))


@query("select round(0.25 + i * 0.005::double, 6) as threshold, round(avg(((prob >= 0.25 + i * 0.005::double) = (actual = 1))::int), 6) as accuracy from pr, (select unnest(range(0, 101)) as i) group by i")
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.thresholds(_predictions(spark, d)))


_WIL = "(case when n <= 0 then 0 else (h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((h / n * (1 - h / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n) end)"


@query(f"""with g as (select 0.02 + i * ((0.30::double - 0.02) / 56) as margin, unnest(['both', 'long', 'short']) as side from (select unnest(range(0, 57)) as i)),
    l as (select margin, side, prob, actual, case side when 'both' then prob <= greatest(0.5 - margin, 0.02) or prob >= least(0.5 + margin, 0.98) when 'long' then prob >= least(0.5 + margin, 0.98) else prob <= greatest(0.5 - margin, 0.02) end as inside from pr, g),
    a as (select margin, side, cast(sum(inside::int) as bigint) as n, sum((inside and (prob >= 0.5) = (actual = 1))::int) as h, avg(inside::int) as coverage from l group by 1, 2)
    select round(margin, 6) as margin, side, n, round(coverage, 6) as coverage, round(h / greatest(n, 1), 6) as accuracy, round({_WIL}, 6) as wilson from a""")
def confidence_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.bands(_predictions(spark, d)))


@query(f"select symbol, n, round({_WIL}, 6) as wilson from (select symbol, count(*) as n, sum((close > open)::int) as h from bars group by symbol)")
def wilson_bound(spark: SparkSession, d: str) -> DataFrame:
    by = B.daily(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.sum((F.col("close") > F.col("open")).cast("long")).alias("h"))
    return rounded(by.select("symbol", "n", wilson(F.col("h"), F.col("n")).alias("wilson")))


_ACC = """select symbol, count(*) * 100 as test_rows, count(*) * (ascii(right(symbol, 1)) % 4 * 10) as n, cast(floor(count(*) * (ascii(right(symbol, 1)) % 4 * 10) * 0.8) as bigint) as h, 0.15 + 0.02 * (ascii(right(symbol, 1)) % 7) as cb, ascii(right(symbol, 1)) % 5 = 0 as ff from bars group by symbol"""


@query(f"""with a as ({_ACC}), b as (select *, {_WIL.replace(' n', ' greatest(n, 1)').replace('(n', '(greatest(n, 1)')} as w from a)
    select symbol, round(w, 6) as wilson_lower, h / greatest(n, 1) >= 0.75 and cb < 0.25 and w >= 0.75 and (n >= 10000 or n / test_rows >= 0.10) and n >= 1000 and n <= test_rows and not ff as passed from b""")
def acceptance_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.ascii(F.right("symbol", F.lit(1)))
    by = B.daily(spark, d).groupBy("symbol").agg(F.count("*").alias("c"))
    n = F.col("c") * (k % 4 * 10)
    m = by.select("symbol", (F.col("c") * 100).alias("test_rows"), n.alias("confident_count"), F.floor(n * 0.8).alias("confident_correct"), (0.15 + 0.02 * (k % 7)).alias("confident_brier"), F.lit(0.25).alias("baseline_brier"), (k % 5 == 0).alias("future_filter"))
    return rounded(M.acceptance(m).select("symbol", "wilson_lower", "passed"))


def _fit_valid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _split(spark, d).cache()
    return s.where("part = 'fit'"), s.where("part = 'valid'")


def _judged(rows: DataFrame) -> DataFrame:
    hit = ((F.col("prob") >= 0.5) == (F.col("label") == 1)).cast("double")
    return rows.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(F.pow(F.col("prob") - F.col("label"), 2)).alias("brier"))


def _model(name: str, make) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        fit, valid = _fit_valid(spark, d)
        return rounded(_judged(make(fit, valid)))

    run.__name__ = name
    query()(run)


_KEYS = ["symbol", "date"]
_model("logistic_model", lambda fit, valid: M.logistic(fit, USED)(valid))
_model("gbt_model", lambda fit, valid: M.boosted(fit, USED)(valid))
_model("mlp_model", lambda fit, valid: M.perceptron(fit, USED)(valid))
_model("average_ensemble", lambda fit, valid: M.averaged([M.logistic(fit, USED), M.boosted(fit, USED)], valid, _KEYS))
_model("calibrated_probability", lambda fit, valid: M.calibrated(M.logistic(fit, USED)(valid).select("prob", "label"), M.logistic(fit, USED)(valid).select("prob", "label")))


@query()
def agreement_selector(spark: SparkSession, d: str) -> DataFrame:
    fit, valid = _fit_valid(spark, d)
    both = M.logistic(fit, USED)(valid).select(*_KEYS, "label", F.col("prob").alias("p1")).join(M.boosted(fit, USED)(valid).select(*_KEYS, F.col("prob").alias("p2")), _KEYS)
    return rounded(M.agreement(both, ["p1", "p2"]))


@query()
def regime_selector(spark: SparkSession, d: str) -> DataFrame:
    fit, valid = _fit_valid(spark, d)
    return rounded(M.regimes(M.logistic(fit, USED)(valid).select("label", "prob", *USED), USED))


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    early = B.daily(spark, d).where(F.col("date") < "2001-01-01")
    full = B.daily(spark, d)
    of = lambda df, n: df.agg(F.countDistinct("symbol").alias("symbols"), F.max("date").alias("built_latest")).select(F.lit(n).alias("window_size"), "symbols", "built_latest")
    return of(full, 5).unionByName(of(early, 8)).unionByName(of(full.where("symbol > '000003'"), 10))


_MAN = """m as (select 5 as window_size, count(distinct symbol) as symbols, max(date) as built_latest from bars union all select 8, count(distinct symbol), max(date) from bars where date < date '2001-01-01'
    union all select 10, count(distinct symbol), max(date) from bars where symbol > '000003'), h as (select m.*, (symbols > 0 and symbols < (select count(distinct symbol) from bars)) or built_latest < (select max(date) from bars) as stale from m)"""


@query(f"with {_MAN} select * from h")
def index_health(spark: SparkSession, d: str) -> DataFrame:
    return K.health(_manifests(spark, d), B.daily(spark, d))


@query(f"with {_MAN}, w as (select unnest([5, 8, 10, 20]) as window_size), j as (select w.window_size, stale from w left join h using (window_size)) select 'missing_indexes' as reason, list(window_size order by window_size) filter (where stale or stale is null) as window_sizes from j")
def maintain_decision(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, (5, 8, 10, 20)))).alias("window_size"))
    return K.decision(wanted, K.health(_manifests(spark, d), B.daily(spark, d)))


_ATT = "a as (select o_custkey % 7 as run, lpad(cast(o_custkey as varchar), 6, '0') as symbol, o_orderkey as attempt, case o_orderstatus when 'O' then 'completed' when 'F' then 'failed' else 'partial' end as status from orders), l as (select * from (select *, row_number() over (partition by run, symbol order by attempt desc) as r from a) where r = 1)"


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "failed").otherwise("partial")
    return B.read(spark, d, "orders").select((F.col("o_custkey") % 7).alias("run"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("symbol"), F.col("o_orderkey").alias("attempt"), status.alias("status"))


@query(f"with {_ATT} select run, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in ("completed", "failed", "partial")) + " from l group by run")
def backfill_status(spark: SparkSession, d: str) -> DataFrame:
    return K.backfill_status(_attempts(spark, d))


@query(f"with {_ATT} select run, symbol, attempt, status from l")
def catalog_latest(spark: SparkSession, d: str) -> DataFrame:
    return K.latest(_attempts(spark, d), ["run", "symbol"], "attempt")


_TICKS = "t as (select lpad(cast(user_id as varchar), 6, '0') as symbol, ts, event_id, value as price from events)"
_BAR = "arg_min(price, row(ts, event_id)) as open, max(price) as high, min(price) as low, arg_max(price, row(ts, event_id)) as close, count(*) as n"


@query(f"with {_TICKS} select symbol, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, {_BAR} from t group by 1, 2")
def stream_minute_bars(spark: SparkSession, d: str) -> DataFrame:
    return T.drained(T.bars(T.ticks(T.read(spark, f"{d}/events.parquet"))))


@query(f"with {_TICKS}, s as (select *, unnest([0, 1]) as k from t), b as (select symbol, time_bucket(interval '3 hours', ts, timestamp '1970-01-01') - k * interval '3 hours' as start, ts, event_id, price from s) select symbol, start, {_BAR} from b group by 1, 2")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return T.drained(T.bars(T.ticks(T.read(spark, f"{d}/events.parquet")), "6 hours", "3 hours"))


@query(f"with {_TICKS}, g as (select *, case when ts - lag(ts) over w >= interval '12 hours' then 1 else 0 end as b from t window w as (partition by symbol order by ts)), s as (select *, sum(b) over (partition by symbol order by ts rows unbounded preceding) as k from g) select symbol, min(ts) as start, max(ts) + interval '12 hours' as \"end\", count(*) as n, cast(sum(round(price * 100)) as bigint) as cents from s group by symbol, k")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return T.drained(T.sessions(T.ticks(T.read(spark, f"{d}/events.parquet"))))


@query(f"with {_TICKS} select symbol, max(ts) as ts, arg_max(price, row(ts, event_id)) as price from t group by symbol")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last tick of each symbol, kept up to date by a stream's batches."""
    root = T.folder(spark)
    path, marks = f"{root}/table", f"{root}/marks"
    put = T.upserting(path, ["symbol"])

    def last(batch: DataFrame, epoch: int) -> None:
        new = batch.groupBy("symbol").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "event_id")).alias("x")).select("symbol", F.col("x.ts").cast("timestamp_ntz").alias("ts"), "x.price")
        put(new, epoch)

    T.ticks(T.read(spark, f"{d}/events.parquet")).writeStream.foreachBatch(last).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return T.current(spark, path)


@query("""with e as (select *, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') + interval '6 hours' as stop from events),
    m as (select (select max(ts) from e where event_id % 3 = 0) - interval '1 hour' as late, (select max(ts) from e) - interval '1 hour' as closed)
    select lpad(cast(user_id as varchar), 6, '0') as symbol, start, count(*) as n from e, m where stop <= closed and (event_id % 3 < 2 or stop > late) group by 1, 2""")
def stream_late_drop(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of a stream that appends closed windows: what the third brings for windows that the first closed is dropped.

    Rows are late by the watermark that the batch before went by, so the second batch's are not yet."""
    root, events = T.folder(spark), B.read(spark, d, "events")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{root}/batch-{k}")
    read = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/batch-*")
    bars = T.bars(T.ticks(read))
    return T.appended(bars, f"{root}/table", f"{root}/marks").select("symbol", "start", "n")
