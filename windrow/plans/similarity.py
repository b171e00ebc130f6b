"""Context, windows, vectors, neighbours, scores, ranking and what came after."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..operators import context as C
from ..operators import normalise as N
from ..operators import search as S
from ..operators import windows as W
from ..sources import bars as B
from .registry import DIGITS, query, rounded, six


def norm(spark: SparkSession, d: str) -> DataFrame:
    return N.bars(B.daily(spark, d, by_symbol=True))


def norm_industry(spark: SparkSession, d: str) -> DataFrame:
    return norm(spark, d).join(B.profiles(spark, d).select("symbol", "industry"), "symbol")


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def _l(name: str, to: str | None = None) -> str:
    return f"list_transform({name}, lambda v: round(v, 6) + 0.0) as {to or name}"


def _six():
    """Arrow UDF: an array's doubles rounded as ``registry.six`` does.  All is nested, so that workers need no copy of this package."""
    scale = 10.0**DIGITS

    def run(a: pa.Array) -> pa.Array:
        x = a.values.to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.abs(x * scale)
            whole = np.rint(scaled)
            found = np.sign(x) * (whole + (scaled - whole == 0.5)) / scale
        out = pa.array(np.where(np.abs(found) < np.inf, found, x) + 0.0, mask=np.asarray(a.values.is_null()))
        return pa.ListArray.from_arrays(a.offsets, out, mask=a.is_null() if a.null_count else None)

    return F.arrow_udf(run, ArrayType(DoubleType()))


def arr(name: str, to: str | None = None):
    return _six()(F.col(name)).alias(to or name)


@query(f"select date, {_r('market_return_mean', 'market_volatility_5', 'market_trend_5')} from market")
def market_context(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.market(B.indexes(spark, d)))


_IND = ("industry_return_mean", "industry_turnover_mean", "industry_amplitude_mean", "industry_return_trend_5")


@query(f"select date, industry, constituents, {_r(*_IND)} from indctx")
def industry_context(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.industry(norm_industry(spark, d)))


@query(f"select symbol, date, {_r('market_return_mean', 'market_trend_5')} from (select symbol, date, coalesce(market_return_mean, 0) as market_return_mean, coalesce(market_trend_5, 0) as market_trend_5 from bars left join market using (date))")
def bars_with_market(spark: SparkSession, d: str) -> DataFrame:
    cols = ["market_return_mean", "market_trend_5"]
    return rounded(C.with_context(B.daily(spark, d).select("symbol", "date"), C.market(B.indexes(spark, d)), ["date"], cols))


@query(f"select symbol, date, {_r('industry_return_mean', 'industry_return_trend_5')} from (select symbol, date, coalesce(industry_return_mean, 0) as industry_return_mean, coalesce(industry_return_trend_5, 0) as industry_return_trend_5 from normi left join indctx using (date, industry))")
def bars_with_industry(spark: SparkSession, d: str) -> DataFrame:
    rows, cols = norm_industry(spark, d), ["industry_return_mean", "industry_return_trend_5"]
    return rounded(C.with_context(rows.select("symbol", "date", "industry"), C.industry(rows), ["date", "industry"], cols).drop("industry"))


_FACTOR = "select b.symbol, b.date, round(coalesce(f.v, 0), 6) as v, case when f.v is null then 0.0::double else 1.0::double end as v_available from bars b left join (select symbol, date, pct_change as v from norm where day(date) <= 15) f on b.symbol = f.symbol and b.date = f.date"


def _factor(spark: SparkSession, d: str) -> DataFrame:
    v = norm(spark, d).where("day(date) <= 15").select("symbol", "date", F.col("pct_change").alias("v"))
    return C.with_factor(B.daily(spark, d).select("symbol", "date"), v, ["symbol", "date"], ["v"])


@query(_FACTOR)
def factor_left_join(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_factor(spark, d))


@query(f"select round(avg(v_available), 6) as v_coverage, count(*) as n_rows from ({_FACTOR})")
def factor_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.coverage(_factor(spark, d), ["v"]))


@query("select symbol, start_idx, end_idx, start_date, end_date, list_transform(bars, lambda x: x.close) as closes from w5")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    w = W.sliding(norm(spark, d), 5, ("close",))
    return w.select("symbol", "start_idx", "end_idx", "start_date", "end_date", F.col("bars")["close"].alias("closes"))


_Q = """with q as (select symbol, date, case when ascii(right(symbol, 1)) % 5 = 0 and day(date) = 7 then null else close end as close, open, high, low, case when day(date) % 9 = 0 then 0 else volume end as volume from bars),
m as (select symbol, date, (open is not null)::int + (high is not null)::int + (low is not null)::int + (close is not null)::int + (volume is not null)::int as p,
 case when coalesce(volume, 0) = 0 then 1 else 0 end as z, case when close is not null and high >= greatest(open, close, low) and low <= least(open, close, high) then 0 else 1 end as b from q),
s as (select symbol, date as end_date, count(*) over w as n, sum(p) over w / 25.0::double as present_ratio, sum(z) over w / 5.0::double as zero_volume_ratio, sum(b) over w as b from m window w as (partition by symbol order by date rows between 4 preceding and current row))
select symbol, end_date, round(present_ratio, 6) as present_ratio, round(zero_volume_ratio, 6) as zero_volume_ratio, present_ratio >= 0.95 and zero_volume_ratio <= 0.2 and b = 0 as passes from s where n = 5"""


@query(_Q)
def window_quality(spark: SparkSession, d: str) -> DataFrame:
    b = B.daily(spark, d)
    b = b.withColumn("close", F.when((F.ascii(F.right("symbol", F.lit(1))) % 5 == 0) & (F.day("date") == 7), None).otherwise(F.col("close")))
    return rounded(W.quality(b.withColumn("volume", F.when(F.day("date") % 9 == 0, 0.0).otherwise(F.col("volume"))), 5))


def _enc(spark: SparkSession, d: str, *parts: str) -> DataFrame:
    return W.vectors(norm(spark, d), 5, parts or tuple(W.SOURCES))


@query(f"select symbol, end_date, {_l('price_path')} from enc5")
def enc_price_path(spark: SparkSession, d: str) -> DataFrame:
    return _enc(spark, d, "price_path").select("symbol", "end_date", arr("price_path"))


@query(f"select symbol, end_date, {_l('candle_geometry')} from enc5")
def enc_candle(spark: SparkSession, d: str) -> DataFrame:
    return _enc(spark, d, "candle_geometry").select("symbol", "end_date", arr("candle_geometry"))


@query(f"select symbol, end_date, {_l('volume_liquidity')} from enc5")
def enc_volume(spark: SparkSession, d: str) -> DataFrame:
    return _enc(spark, d, "volume_liquidity").select("symbol", "end_date", arr("volume_liquidity"))


@query("""with c as (select symbol, date, industry, coalesce(market_return_mean, 0) as a, coalesce(market_trend_5, 0) as b, coalesce(market_volatility_5, 0) as c, coalesce(industry_return_mean, 0) as d, coalesce(industry_return_trend_5, 0) as e
    from normi left join market using (date) left join indctx using (date, industry)),
    l as (select symbol, date as end_date, list(a) over w as a, list(b) over w as b, list(c) over w as c, list(d) over w as d, list(e) over w as e from c window w as (partition by symbol order by date rows between 4 preceding and current row))
    select symbol, end_date, list_transform(list_concat(a, b, c, d, e), lambda v: round(v, 6) + 0.0) as environment from l where len(a) = 5""")
def enc_environment(spark: SparkSession, d: str) -> DataFrame:
    rows = norm_industry(spark, d)
    both = C.with_context(rows, C.market(B.indexes(spark, d)), ["date"], list(W.CONTEXT[:3]))
    both = C.with_context(both, C.industry(rows), ["date", "industry"], list(W.CONTEXT[3:]))
    fields = ("open", "high", "low", "close", *W.CONTEXT)
    return W.encoded(W.sliding(both, 5, fields)).select("symbol", "end_date", arr("environment"))


_SUM = lambda a: f"[list_avg({a}), list_stddev_pop({a}), {a}[1], {a}[5]]"


@query(f"select symbol, end_date, list_transform(list_concat(price_path, candle_geometry, {', '.join(_SUM(f'list_slice(volume_liquidity, {1 + 5 * i}, {5 + 5 * i})') for i in range(3))}), lambda v: round(v, 6) + 0.0) as recall from enc5")
def recall_projection(spark: SparkSession, d: str) -> DataFrame:
    return _enc(spark, d, "recall").select("symbol", "end_date", arr("recall"))


@query("select count(*) as n_windows, count(distinct symbol) as n_symbols, min(start_date) as first, max(end_date) as last, max(len(price_path) + len(candle_geometry) + len(volume_liquidity)) as dimensions from enc5")
def manifest_stats(spark: SparkSession, d: str) -> DataFrame:
    dims = (F.size("price_path") + F.size("candle_geometry") + F.size("volume_liquidity")).cast("long")
    return _enc(spark, d).agg(F.count("*").alias("n_windows"), F.countDistinct("symbol").alias("n_symbols"), F.min("start_date").alias("first"), F.max("end_date").alias("last"), F.max(dims).alias("dimensions"))


_V = "v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e, label from embeddings), q as (select e as qe from v where vec_id = (select min(vec_id) from v))"
_ZV = _V + """, l as (select vec_id, unnest(e) as x, generate_subscripts(e, 1) as i from v), st as (select i, avg(x) as m, stddev_pop(x) as s from l group by i),
 sv as (select vec_id, list((x - m) / (case when s < 1e-12 then 1.0 else s end) order by i) as e from l join st using (i) group by vec_id)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = B.read(spark, d, "embeddings")
    return v, v.orderBy("vec_id").limit(1)


@query(f"with {_V} select vec_id, label, round(list_distance(e, qe), 6) as distance from v, q order by list_distance(e, qe), vec_id limit 20")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return rounded(S.nearest(v, q, "embedding", "vec_id", 20).select("vec_id", "label", "distance"))


@query(f"with {_ZV} select vec_id, list_transform(e, lambda v: round(v, 6) + 0.0) as embedding from sv")
def vector_standardize(spark: SparkSession, d: str) -> DataFrame:
    return S.standardised(B.read(spark, d, "embeddings"), "embedding", "vec_id").select("vec_id", arr("embedding"))


@query(f"with {_ZV}, q2 as (select e as qe from sv where vec_id = (select min(vec_id) from sv)) select vec_id, round(list_distance(e, qe), 6) as distance from sv, q2 order by list_distance(e, qe), vec_id limit 20")
def knn_standardized(spark: SparkSession, d: str) -> DataFrame:
    z = S.standardised(B.read(spark, d, "embeddings"), "embedding", "vec_id")
    return rounded(S.nearest(z, z.orderBy("vec_id").limit(1), "embedding", "vec_id", 20).select("vec_id", "distance"))


@query(f"with {_V} select vec_id, label, round(dist, 6) as distance from (select vec_id, label, list_distance(e, qe) as dist, row_number() over (partition by label order by list_distance(e, qe), vec_id) as r from v, q) where r <= 3")
def knn_by_partition(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    one = q.select(F.col("embedding").cast("array<double>").alias("q"))
    scored = v.crossJoin(F.broadcast(one)).select("vec_id", "label", S.euclid(F.col("embedding").cast("array<double>"), F.col("q")).alias("distance"))
    return rounded(S.best_per(scored, ["label"], [F.col("distance"), F.col("vec_id")], 3))


@query(f"with {_V} select vec_id, round(sqrt(greatest(list_dot_product(e, e) + list_dot_product(qe, qe) - 2 * list_dot_product(e, qe), 0)), 4) as distance from v, q order by list_distance(e, qe), vec_id limit 20")
def knn_dot_identity(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return S.blocked_nearest(v, list(q.first()["embedding"]), "embedding", "vec_id", 20).select("vec_id", (F.round("distance", 4) + F.lit(0.0)).alias("distance"))


_PAIR = "q as (select * from enc5 where symbol = (select min(symbol) from enc5) order by end_date desc limit 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every window beside the query window: the last one of the first symbol."""
    # Only the first symbols' windows are made to find the query: those up to the first with days in five classes of 63, and thus five days.
    items, seen = B.items(spark, d), F.bit_or(F.expr("shiftleft(1L, pmod(datediff(date, date'1970-01-01'), 63))"))
    enough = items.groupBy("symbol").agg(seen.alias("days")).agg(F.min(F.when(F.bit_count("days") >= 5, F.col("symbol"))).alias("enough"))  # one row
    own = N.bars(B.days(items.join(F.broadcast(enough), F.col("symbol") <= F.coalesce("enough", "symbol"), "left_semi")))
    q = W.vectors(own, 5).orderBy("symbol", F.col("end_date").desc()).limit(1)
    one = q.select(*(F.col(c).alias(f"q_{c}") for c in ("symbol", "start_date", "end_date", "price_path", "candle_geometry", "volume_liquidity")))
    return _enc(spark, d).crossJoin(F.broadcast(one))


_OV = "cast(greatest(date_diff('day', greatest(a.start_date, q.start_date), least(a.end_date, q.end_date)) + 1, 0) as int)"


@query(f"with {_PAIR} select a.symbol, a.end_date, {_OV} as overlap from enc5 a, q where {_OV} > 0")
def overlap_days(spark: SparkSession, d: str) -> DataFrame:
    o = S.overlap_days(F.col("start_date"), F.col("end_date"), F.col("q_start_date"), F.col("q_end_date")).cast("int")
    return _pairs(spark, d).select("symbol", "end_date", o.alias("overlap")).where("overlap > 0")


@query(f"with {_PAIR} select a.symbol, count(*) as n from enc5 a, q where {_OV} <= 2 group by a.symbol")
def scope_historical(spark: SparkSession, d: str) -> DataFrame:
    o = S.overlap_days(F.col("start_date"), F.col("end_date"), F.col("q_start_date"), F.col("q_end_date"))
    return _pairs(spark, d).where(o <= S.OVERLAP_DAYS).groupBy("symbol").agg(F.count("*").alias("n"))




#: Trailing zeros are trimmed before the root mean square, and the shorter side is padded, so only the common length counts.
_LEN = lambda c: f"greatest(coalesce(list_max(list_transform(range(1, len(a.{c}) + 1), lambda i: case when a.{c}[i] <> 0 then i else 0 end)), 0), coalesce(list_max(list_transform(range(1, len(q.{c}) + 1), lambda i: case when q.{c}[i] <> 0 then i else 0 end)), 0))"
_TR = lambda c: f"(case when list_sum(list_transform(a.{c}, lambda v: abs(v))) = 0 or list_sum(list_transform(q.{c}, lambda v: abs(v))) = 0 then 'inf'::double else sqrt(list_sum(list_transform(range(1, len(a.{c}) + 1), lambda i: (a.{c}[i] - q.{c}[i]) * (a.{c}[i] - q.{c}[i]))) / {_LEN(c)}) end)"
_LEVELS = lambda v: f"list_slice({v}, 1, coalesce(list_max(list_transform(range(1, 6), lambda i: case when {v}[i] <> 0 then i else 0 end)), 0))"
#: The cells of the table of time warping over two paths of at most five levels, each from its three neighbours.
_CELL = lambda i, j: "0.0::double" if i == j == 0 else "'inf'::double" if not i or not j else f"c{i}{j}"
_CELLS = ", ".join(f"case when {abs(i - j)} <= band then abs(x[{i}] - y[{j}]) + least({_CELL(i - 1, j)}, {_CELL(i, j - 1)}, {_CELL(i - 1, j - 1)}) else 'inf'::double end as c{i}{j}" for i in range(1, 6) for j in range(1, 6))
_ALL = ", ".join(f"c{i}{j}" for i in range(1, 6) for j in range(1, 6))


def _warped(source: str, a: str, q: str, *more: str) -> str:
    """CTE sc: symbol, start_date, end_date, price (the time-warping distance of the levels) and more columns of the pairs in ``source``."""
    return f"""dx as (select a.symbol, a.start_date, a.end_date, {", ".join((*more, f"{_LEVELS(a)} as x", f"{_LEVELS(q)} as y"))} from {source}),
    dy as (select *, len(x) as n, len(y) as m, greatest(abs(len(x) - len(y)), greatest(len(x), len(y)) // 4, 2) as band from dx),
    dz as (select *, {_CELLS} from dy), sc as (select * exclude ({_ALL}, x, y, n, m, band), case when n = 0 or m = 0 then 'inf'::double else [{_ALL}][(n - 1) * 5 + m] / (n + m) end as price from dz)"""


_SC = _warped("enc5 a, q", "a.price_path", "q.price_path", f"{_TR('candle_geometry')} as candle", f"{_TR('volume_liquidity')} as vol")
_BAL = "(case when price < 'inf' then 0.45 * price else 0 end + case when candle < 'inf' then 0.2 * candle else 0 end + case when vol < 'inf' then 0.2 * vol else 0 end) / nullif(case when price < 'inf' then 0.45 else 0 end + case when candle < 'inf' then 0.2 else 0 end + case when vol < 'inf' then 0.2 else 0 end, 0)"
_SHAPE = "(case when price < 'inf' then 0.45 * price else 0 end + case when candle < 'inf' then 0.2 * candle else 0 end) / nullif(case when price < 'inf' then 0.45 else 0 end + case when candle < 'inf' then 0.2 else 0 end, 0)"


def _scores(spark: SparkSession, d: str, *parts: str) -> DataFrame:
    """The parts' distances, price, candle and vol unless some are named."""
    sides = lambda c: (F.col(c), F.col(f"q_{c}"))
    levels = (F.slice(x, 1, 5) for x in sides("price_path"))
    every = {"price": ("dtw", *levels), "candle": ("rmse", *sides("candle_geometry")), "vol": ("rmse", *sides("volume_liquidity"))}
    return S.scored(_pairs(spark, d), ["symbol", "end_date"], {k: every[k] for k in parts or every})


def _as_in_sql(df: DataFrame) -> DataFrame:
    """Doubles rounded by ``six``."""
    return df.select(*(six(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes))


def _path(size: int):
    """How far two windows' price levels are apart, by time warping."""
    return S.dtw_distance(F.slice("price_path", 1, size), F.slice("q_price_path", 1, size))


@query(f"with {_PAIR}, {_SC} select symbol, end_date, {_r('price', 'candle', 'vol')} from sc")
def rmse_components(spark: SparkSession, d: str) -> DataFrame:
    return _as_in_sql(_scores(spark, d))


@query(f"with {_PAIR}, {_SC} select symbol, end_date, round({_BAL}, 6) as distance, round(1 / (1 + {_BAL}), 6) as similarity from sc")
def balanced_score(spark: SparkSession, d: str) -> DataFrame:
    b = S.balanced({"price_path": F.col("price"), "candle_geometry": F.col("candle"), "volume_liquidity": F.col("vol")})
    return _as_in_sql(_scores(spark, d).select("symbol", "end_date", b.alias("distance"), S.similarity(b).alias("similarity")))


@query(f"with {_PAIR}, {_SC} select symbol, end_date, round({_SHAPE}, 6) as distance, round(1 / (1 + {_SHAPE}), 6) as similarity from sc")
def shape_score(spark: SparkSession, d: str) -> DataFrame:
    b = S.balanced({"price_path": F.col("price"), "candle_geometry": F.col("candle")})
    return _as_in_sql(_scores(spark, d, "price", "candle").select("symbol", "end_date", b.alias("distance"), S.similarity(b).alias("similarity")))


@query(f"""with {_PAIR}, near as (select a.*, q.price_path as qp from enc5 a, q order by list_distance(a.price_path, q.price_path), a.symbol, a.end_date limit 200),
    {_warped("near a", "a.price_path", "a.qp")} select symbol, end_date, round(price, 6) as dtw from sc""")
def dtw_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The 200 nearest windows by price path, scored by dynamic time warping over the levels."""
    near = _pairs(spark, d).withColumn("l2", S.euclid(F.col("price_path"), F.col("q_price_path"))).orderBy("l2", "symbol", "end_date").limit(200)
    return rounded(near.select("symbol", "end_date", _path(5).alias("dtw")))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Recall of 200 by distance after the overlap filter, then scores and whether ten days follow."""
    p = _pairs(spark, d)
    o = S.overlap_days(F.col("start_date"), F.col("end_date"), F.col("q_start_date"), F.col("q_end_date"))
    far = p.where(~((F.col("symbol") == F.col("q_symbol")) & (o > S.OVERLAP_DAYS)))
    near = far.withColumn("l2", S.euclid(F.concat("price_path", "candle_geometry"), F.concat("q_price_path", "q_candle_geometry"))).orderBy("l2", "symbol", "end_date").limit(200)
    b = S.balanced({"price_path": _path(5), "candle_geometry": S.rmse(F.col("candle_geometry"), F.col("q_candle_geometry"))})
    return near.select("symbol", "start_date", "end_date", b.alias("distance"), S.similarity(b).alias("score"))


_CAND = f"""{_PAIR}, near as (select a.*, q.price_path as qp, q.candle_geometry as qc from enc5 a, q where not (a.symbol = q.symbol and {_OV} > 2)
    order by list_distance(list_concat(a.price_path, a.candle_geometry), list_concat(q.price_path, q.candle_geometry)), a.symbol, a.end_date limit 200),
    {_warped("near a, q", "a.price_path", "q.price_path", _TR('candle_geometry') + " as candle")}, cand as (select symbol, start_date, end_date, {_SHAPE} as distance, 1 / (1 + {_SHAPE}) as score from sc)"""
_TOP = f"{_CAND}, best as (select * from (select *, row_number() over (partition by symbol order by score desc, distance, end_date) as r from cand) where r = 1), top as (select symbol, start_date, end_date, distance, score from best order by score desc, distance, symbol, end_date limit 10)"


def _top(spark: SparkSession, d: str) -> DataFrame:
    best = S.best_per(_candidates(spark, d), ["symbol"], [F.col("score").desc(), F.col("distance"), F.col("end_date")], 1)
    return best.orderBy(F.col("score").desc(), "distance", "symbol", "end_date").limit(10)


@query(f"with {_TOP} select t.symbol, start_date, end_date, round(distance, 6) as distance, round(score, 6) as score, horizon, {_r('return_pct', 'mfe_pct', 'mdd_pct')} from top t join fwd f on t.symbol = f.symbol and t.end_date = f.date")
def similar_windows(spark: SparkSession, d: str) -> DataFrame:
    """Which past windows look most like the query window, one a symbol, and what came next."""
    stats = S.forward(B.daily(spark, d)).withColumnRenamed("date", "end_date")
    return rounded(stats.join(F.broadcast(_top(spark, d)), ["symbol", "end_date"]))  # ten rows


@query()
def ranked_matches(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    last = S.forward(B.daily(spark, d), (10,)).select("symbol", F.col("date").alias("end_date"), F.col("return_pct").isNotNull().alias("has_forward"))
    return rounded(S.ranked(last.join(F.broadcast(c), ["symbol", "end_date"]).select("symbol", "start_date", "end_date", "distance", "score", "has_forward"), 10))  # 200 rows


@query(f"with {_CAND} select symbol, start_date, end_date, round(distance, 6) as distance, round(score, 6) as score from cand order by score desc, symbol, end_date limit 10")
def ranked_hook(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_candidates(spark, d).orderBy(F.col("score").desc(), "symbol", "end_date").limit(10))


@query(f"with {_PAIR}, n as (select count(*) as n from enc5), k as (select n, least(n, greatest(200, 250)) as k1 from n), f as (select a.symbol, a.end_date, {_OV} as o from enc5 a, q, k order by list_distance(a.price_path, q.price_path), a.symbol, a.end_date limit 250), s as (select count(*) as c from f where o <= 2) select k1, c as survivors, case when c < 20 then least(n, greatest(4 * k1, 2000, 800)) else k1 end as k2 from k, s")
def adaptive_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many are recalled at first, how many outlive the overlap filter, and how many are recalled then (top 10)."""
    p = _pairs(spark, d).withColumn("dist", S.euclid(F.col("price_path"), F.col("q_price_path")))
    o = S.overlap_days(F.col("start_date"), F.col("end_date"), F.col("q_start_date"), F.col("q_end_date"))
    n = p.agg(F.count("*").alias("n")).withColumn("k1", F.least("n", F.lit(250)))
    live = p.orderBy("dist", "symbol", "end_date").limit(250).where(o <= 2).agg(F.count("*").alias("survivors"))
    return n.crossJoin(live).select("k1", "survivors", F.when(F.col("survivors") < 20, F.least("n", F.greatest(4 * F.col("k1"), F.lit(2000)))).otherwise(F.col("k1")).alias("k2"))


@query(f"select symbol, date, horizon, {_r('return_pct', 'mfe_pct', 'mdd_pct')} from fwd")
def forward_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.forward(B.daily(spark, d)))


@query("select horizon, count(return_pct) as n, round(avg(return_pct), 6) as mean_return, round(avg(case when return_pct > 0 then 1.0 when return_pct is not null then 0.0 end), 6) as win_rate, round(avg(mfe_pct), 6) as mean_mfe, round(avg(mdd_pct), 6) as mean_mdd from fwd group by horizon")
def aggregate_forward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.forward_summary(S.forward(B.daily(spark, d))))


@query(f"with {_TOP}, j as (select t.*, horizon, return_pct, mfe_pct, mdd_pct from top t join fwd f on t.symbol = f.symbol and t.end_date = f.date) select symbol, start_date, end_date, round(score, 6) as score, " + ", ".join(f"round(max(case when horizon = {h} then {c}_pct end), 6) as {c}_{h}" for h in S.HORIZONS for c in ("return", "mfe", "mdd")) + " from j group by all")
def export_wide(spark: SparkSession, d: str) -> DataFrame:
    stats = S.forward(B.daily(spark, d)).withColumnRenamed("date", "end_date").join(F.broadcast(_top(spark, d)), ["symbol", "end_date"])
    cells = [F.max(F.when(F.col("horizon") == h, F.col(f"{c}_pct"))).alias(f"{c}_{h}") for h in S.HORIZONS for c in ("return", "mfe", "mdd")]
    return rounded(stats.groupBy("symbol", "start_date", "end_date", "score").agg(*cells))


