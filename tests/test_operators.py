import datetime as dt
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import oracle
from windrow.api import Cache, Engine, SearchRequest
from windrow.functions import rolling as R
from windrow.operators import catalog, index, market, models, normalise, probe, search, selection, windows
from windrow.plans import ORACLES, QUERIES, registry, similarity
from windrow.sources import level2, sinks

DAY = dt.date(2024, 1, 1)


def bars(spark, closes, symbol="000001", **more):
    rows = [(symbol, DAY + dt.timedelta(i), c, c + 0.5, c - 0.5, c, more.get("volume", [100.0] * len(closes))[i], c * 100, 3.0) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, amount double, turnover double")


def test_padded_rolling_equals_padding(spark):
    x = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6, 5.0]
    t = probe.Text()
    got = bars(spark, x).select(*(F.expr(e).alias(k) for k, e in {"m": t.mean("close", 4), "s": t.std("close", 4), "b": t.below("close", 4, "<=")}.items()), "date").orderBy("date").collect()
    full = [x[0]] * 3 + x
    for i, r in enumerate(got):
        w = np.array(full[i : i + 4])
        assert (r["m"], r["s"], r["b"]) == pytest.approx((w.mean(), w.std(), (w <= x[i]).mean()))


def test_streak(spark):
    got = R.streak_of(bars(spark, [1, 2, 3, 2, 3, 4, 5]), "up", F.col("close") >= 3).orderBy("date").collect()
    assert [r["up"] for r in got] == [0, 0, 1, 0, 1, 2, 3]


def test_windows(spark):
    b = normalise.bars(bars(spark, range(1, 9)))
    w = windows.sliding(b, 5).orderBy("end_idx").collect()
    assert [(r["start_idx"], r["end_idx"]) for r in w] == [(0, 4), (1, 5), (2, 6), (3, 7)]
    holed = bars(spark, range(1, 9)).withColumn("close", F.when(F.col("date") == DAY + dt.timedelta(2), None).otherwise(F.col("close")))
    passed = windows.quality(holed, 4).where("passes").orderBy("end_date").collect()
    assert [(r["end_date"] - DAY).days for r in passed] == [6, 7]


def test_trailing_zeros_switch_a_part_off(spark):
    r = spark.range(1).select(search.rmse(search.trimmed(F.array(F.lit(0.0), F.lit(0.0))), search.trimmed(F.array(F.lit(1.0)))).alias("a"), search.balanced({"price_path": F.lit(1.0), "environment": F.lit(float("inf"))}).alias("b")).first()
    assert r["a"] == float("inf") and r["b"] == 1.0


def warped(a, b):
    """The cheapest path through all pairs within the band, by plain recursion."""
    n, m = len(a), len(b)
    band = max(abs(n - m), max(n, m) // 4, 2)

    def cost(i, j):
        if i == j == 0:
            return 0.0
        if i < 1 or j < 1 or abs(i - j) > band:
            return float("inf")
        return abs(a[i - 1] - b[j - 1]) + min(cost(i - 1, j), cost(i, j - 1), cost(i - 1, j - 1))

    return cost(n, m) / (n + m) if n and m else float("inf")


def test_dtw(spark):
    rng = np.random.default_rng(1)
    pairs = [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([0.0, 0.0, 1.0], [0.0, 1.0, 1.0]), ([], [1.0])] + [(rng.random(rng.integers(1, 8)).tolist(), rng.random(rng.integers(1, 8)).tolist()) for _ in range(40)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<double>, b array<double>")
    got = {r["k"]: r["d"] for r in df.select("k", search.dtw_distance(df["a"], df["b"]).alias("d")).collect()}
    assert [got[k] for k in range(len(pairs))] == pytest.approx([warped(a, b) for a, b in pairs])


def test_dtw_of_odd_arrays(spark):
    """Arrays of many lengths, with trailing zeros, null rows and a long one, in batches."""
    rng = np.random.default_rng(2)
    draw = lambda n: np.r_[rng.random(rng.integers(0, n)), np.zeros(rng.integers(0, 3))].tolist()
    pairs = [(draw(9), draw(9)) for _ in range(300)] + [(draw(70), draw(70)) for _ in range(5)] + [(rng.random(400).tolist(), [1.0, 0.0, 2.0])]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)] + [(-1, None, [1.0]), (-2, [1.0], None)], "k int, a array<double>, b array<double>").repartition(2)
    got = {r["k"]: r["d"] for r in df.select("k", search.dtw_distance(df["a"], df["b"]).alias("d")).collect()}
    cut = lambda a: a[: max((i + 1 for i, x in enumerate(a) if x), default=0)]
    assert [got[k] for k in range(len(pairs))] == [folded(cut(a), cut(b)) for a, b in pairs]
    assert got[-1] is None and got[-2] is None
    assert df.limit(0).select(search.dtw_distance(df["a"], df["b"])).collect() == []


@pytest.mark.parametrize("name", ["balanced_score", "rmse_components", "shape_score"])
def test_scores_of_many_pairs_are_quick(spark, monkeypatch, name):
    """Arrays are not made anew for each cell of a table."""
    array = lambda seed, n: F.array(*(F.col("id") % (seed + i) / 7.0 + 0.1 for i in range(n)))
    parts = {"price_path": 10, "candle_geometry": 15, "volume_liquidity": 15}
    pairs = spark.range(0, 60_000, 1, 1).select(F.col("id").cast("string").alias("symbol"), F.lit(DAY).alias("start_date"), F.lit(DAY).alias("end_date"), *(array(s + n, n).alias(f"{q}{c}") for s, q in ((3, ""), (40, "q_")) for c, n in parts.items()))
    monkeypatch.setattr(similarity, "_pairs", lambda spark, d: pairs)
    start = time.monotonic()
    QUERIES[name](spark, "").write.format("noop").mode("overwrite").save()
    assert time.monotonic() - start < 10


@pytest.mark.parametrize("name", ["rmse_components", "shape_score"])
def test_scores_deal_bars_once(spark, small, name):
    """One shuffle by symbol makes days and windows; nothing is evaluated element by element, as lambda functions are."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    windows_side = plan[: plan.index("BroadcastExchange")]
    assert "lambda" not in plan and windows_side.count("Exchange hashpartitioning(symbol") == 1


@pytest.mark.parametrize("name", ["rmse_components", "shape_score"])
def test_query_window_where_the_first_symbol_has_none(spark, small, tmp_path, name):
    con = duckdb.connect()
    for t in oracle.TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    con.execute(f"create view l as select * from '{small}/lineitem.parquet'")
    few = "select distinct cast(l_shipdate as date) from l where l_suppkey = (select min(l_suppkey) from l) order by 1 limit 4"
    con.execute(f"copy (select * from l where l_suppkey <> (select min(l_suppkey) from l) or cast(l_shipdate as date) in ({few})) to '{tmp_path}/lineitem.parquet'")
    oracle.same(spark, oracle.connect(str(tmp_path)), QUERIES[name], ORACLES[name], str(tmp_path))


def folded(a, b):
    """As ``warped``, by its table."""
    n, m = len(a), len(b)
    band, cost = max(abs(n - m), max(n, m) // 4, 2), np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    return cost[n, m] / (n + m) if n and m else float("inf")


def turnovers():
    rng = np.random.default_rng(3)
    return [(rng.integers(1, 60, 5) * 0.1).tolist() for _ in range(400)]


def test_volume_scores_as_in_sql(spark):
    """To the last bit, so that values that end on half a digit are rounded alike."""
    rows = [(k, [(100.0, x, 1.0) for x in xs]) for k, xs in enumerate(turnovers())]
    made = windows.with_volume(spark.createDataFrame(rows, "k int, bars array<struct<volume:double,turnover:double,amplitude:double>>"))
    got = {r["k"]: r["volume_liquidity"][5:10] for r in made.select("k", "volume_liquidity").collect()}
    sql = "select list_transform(?::double[], lambda z: case when list_stddev_pop(?::double[]) < 1e-9 then 0.0 else (z - list_avg(?::double[])) / list_stddev_pop(?::double[]) end)"
    con = duckdb.connect()
    assert [got[k] for k in range(len(rows))] == [con.execute(sql, [xs] * 4).fetchall()[0][0] for xs in turnovers()]


def test_recall_summaries_as_in_sql(spark):
    rows = [(k, xs) for k, xs in enumerate(turnovers())]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k int, a array<double>").select("k", windows.summary(F.col("a")).alias("s")).collect()}
    con = duckdb.connect()
    assert [got[k] for k, _ in rows] == [list(con.execute("select list_avg(a), list_stddev_pop(a), a[1], a[5] from (select ?::double[] as a)", [xs]).fetchall()[0]) for _, xs in rows]


def drawn(spark):
    """Bars of four symbols, one of them too short for a window, with a constant stretch and flat days."""
    rng = np.random.default_rng(5)
    rows = []
    for k, n in enumerate((40, 3, 5, 23)):
        for i in range(n):
            c, o = (rng.integers(90_000, 100_000, 2) / rng.integers(1, 50, 2)).tolist()
            flat = i % 7 == 3
            volume = 10.0 if i < 6 else float(rng.integers(0, 300))
            rows.append((f"{k:06d}", DAY + dt.timedelta(i), *((c,) * 4 if flat else (o, max(o, c) + rng.random(), min(o, c) - rng.random(), c)), volume, volume * 0.1))
    return normalise.bars(spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, turnover double"))


@pytest.mark.parametrize("size", [1, 3, 5])
def test_vectors_are_encoded_windows(spark, size):
    """As made from arrays of bars, also where a batch ends within a window; logarithms may differ in their last bits."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = windows.vectors(drawn(spark), size, (*windows.SOURCES, "recall")).orderBy("symbol", "end_idx").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = windows.recall_vector(windows.encoded(windows.sliding(drawn(spark), size)), size).orderBy("symbol", "end_idx").collect()
    keys = ("symbol", "start_idx", "end_idx", "start_date", "end_date", "price_path", "candle_geometry")
    assert len(got) == len(want) > 0 and [[r[k] for k in keys] for r in got] == [[r[k] for k in keys] for r in want]
    for g, w in zip(got, want):
        assert g["volume_liquidity"] == pytest.approx(w["volume_liquidity"], abs=1e-9) and g["recall"] == pytest.approx(w["recall"], abs=1e-9)


def test_recall_as_in_sql_to_the_last_bit(spark):
    """Logarithms of volumes too, which Java takes otherwise."""
    con = duckdb.connect()
    norm = con.from_df(drawn(spark).toPandas())  # noqa: F841
    sums = ", ".join(similarity._SUM(f"list_slice(volume_liquidity, {1 + 5 * i}, {5 + 5 * i})") for i in range(3))
    views = ", ".join(f"{v} as ({registry.VIEWS[v]})" for v in ("w5", "enc5"))
    sql = registry._zscored(f"with {views} select symbol, end_idx, volume_liquidity, list_concat(price_path, candle_geometry, {sums}) from enc5 order by 1, 2")
    want = con.execute(sql).fetchall()
    got = windows.vectors(drawn(spark), 5, ("volume_liquidity", "recall")).orderBy("symbol", "end_idx").select("symbol", "end_idx", "volume_liquidity", "recall").collect()
    assert len(want) == 36 + 1 + 19 and [tuple(r) for r in got] == want


def test_arrays_are_rounded_as_in_sql(spark):
    """Ratios of prices that end on half a digit, which Spark's round takes the other way, and odd values."""
    closes = [25067.52 / 34, 7436.16 / 5, 25231.36 / 44, 25863.04 / 5, 1520.64 / 27]
    path = windows.price_path(F.array(*(F.struct(F.lit(c).alias("close")) for c in closes)))
    odd = [0.0000005, -0.0000005, 0.5e-6 - 1e-22, 1.5e-6, 2.5e-6, -2.5e-6, 8.0203125, 1e300, 1e305, -0.0, 4503599627.370497, float("inf"), float("-inf"), None]
    df = spark.range(1).select(F.concat(path, F.array(*(F.lit(x).cast("double") for x in odd))).alias("x"))
    raw, got = df.select("x", similarity.arr("x", "y")).first()
    con = duckdb.connect()
    assert got == con.execute("select list_transform(?::double[], lambda v: round(v, 6) + 0.0)", [raw]).fetchall()[0][0]


def test_names_and_suggestions(spark):
    universe = spark.createDataFrame([("000001", "Alpha"), ("000002", "Beta"), ("600036", "Alpha Two"), ("000333", "Gamma 0003"), ("999999", "Beta")], "symbol string, name string")
    cached = universe.where("symbol <> '000002'").select("symbol")
    one = lambda q, **more: [tuple(r) for r in normalise.resolve(universe, q, **more).collect()]
    assert one("1") == [("000001", "Alpha", "symbol")] and one("alpha") == [("000001", "Alpha", "name")] and one("two") == [("600036", "Alpha Two", "name_partial")]
    assert one("beta") == [] and one("beta", cached=cached) == [("999999", "Beta", "name")] and one("424242") == [("424242", None, "symbol")] and one("zzz") == []
    assert [r["symbol"] for r in normalise.choices(universe, "").collect()] == ["000333", "600036", "000001", "000002", "999999"]
    assert [r["symbol"] for r in normalise.choices(universe, "a", cached=cached).collect()] == ["600036", "000001", "000333", "999999"]
    assert [r["symbol"] for r in normalise.choices(universe, "alpha").collect()] == ["600036", "000001"]


def test_exchanges(spark):
    codes = ["600000", "688001", "730001", "510300", "113001", "430047", "400001", "920001", "830799", "840001", "000001", "900901"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in df.select(normalise.exchange(df["c"])).collect()] == ["sh", "sh", "sh", "sz", "sz", "bj", "sz", "bj", "bj", "sz", "sz", "sh"]


def test_ranking_caps_and_overlap(spark):
    d = lambda i: DAY + dt.timedelta(i)
    rows = [("a", d(0), d(4), 0.9, 0.1, True), ("a", d(1), d(5), 0.8, 0.2, True), ("a", d(10), d(14), 0.7, 0.3, True), ("a", d(20), d(24), 0.6, 0.4, True), ("b", d(0), d(4), 0.95, 0.05, False), ("c", d(0), d(4), 0.1, 9.0, True)]
    c = spark.createDataFrame(rows, "symbol string, start_date date, end_date date, score double, distance double, has_forward boolean")
    got = [(r["symbol"], r["score"]) for r in search.ranked(c, 10).collect()]
    assert got == [("a", 0.9), ("a", 0.7), ("c", 0.1), ("b", 0.95)]


def test_board_streak_and_space_board(spark):
    b = bars(spark, [10, 11, 12.1, 13.31], "000001").unionByName(bars(spark, [10, 10, 10, 10], "000002"))
    r = market.board_structure(market.ranked_rows(market.board_rows(b))).where("symbol = '000001'").orderBy("date").collect()
    assert r[-1]["board_count"] == 3 and r[-1]["is_space_board"] == 1


def test_symbols(spark):
    got = spark.createDataFrame([("SH600000",), ("bj83", ), ("csi300",), ("1234567",)], "s string").select(normalise.symbol(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in got] == ["600000", "000083", "000300", "234567"]


def test_level2(spark, tmp_path):
    (tmp_path / "t.csv").write_text("symbol,timestamp,price,volume,amount,side\n1,2024-01-02 09:30:00,1.5,x,,B\n2,nonsense,1,1,1,S\n")
    df, about = level2.load(spark, str(tmp_path / "t.csv"), "trades")
    assert [(r["symbol"], r["price"], r["volume"], r["amount"]) for r in df.collect()] == [("000001", 1.5, None, None)]
    assert df.columns == ["symbol", "timestamp", "price", "volume", "amount", "side", "trade_id", "order_id", "buyer_order_id", "seller_order_id"]
    with pytest.raises(ValueError, match="amount"):
        level2.validated(df.drop("amount"), "trades")
    with pytest.raises(ValueError, match="indicative_price"):
        level2.validated(spark.range(1), "auction")


def test_versions_and_reports(spark, tmp_path):
    old, new = bars(spark, [1, 2]).select("symbol", "date", "close"), bars(spark, [5]).select("symbol", "date", "close", "volume")
    sinks.put(old, str(tmp_path / "v"), ["symbol", "date"], 1)
    got = sinks.put(new, str(tmp_path / "v"), ["symbol", "date"], 2).orderBy("date").collect()
    assert [r["close"] for r in got] == [5.0, 2.0]
    sinks.to_csv(old, str(tmp_path / "x.csv"))
    sinks.to_html(old, str(tmp_path / "x.html"))
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbf") and "000001" in (tmp_path / "x.html").read_text()


def test_api(spark, small):
    engine = Engine(spark, small)
    found = engine.search(SearchRequest("000001", "2001-06-30", top_k=3)).collect()
    assert len(found) == 3 and found == sorted(found, key=lambda r: (not r["has_forward"], -r["score"]))
    assert engine.doctor()["ready"]
    with pytest.raises(ValueError):
        SearchRequest("1", "2001-01-01", window_size=2)
    c = Cache(size=1)
    c.put(1, "a")
    c.put(2, "b")
    assert c.get(1) is None and c.get(2) == "b"


def test_minutes(spark):
    at = lambda m: dt.datetime(2024, 1, 2, 9, m)
    rows = [("a", at(1), 10.0, 10.0, None), ("a", at(0), 8.0, 8.0, None), ("a", at(2), None, 9.0, None), ("a", at(3), 11.0, 12.0, 7.0), ("b", None, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, close double, high double, change double").withColumns({"open": F.lit("1.5"), "low": F.col("high")})
    got = normalise.minutes(df, "5").orderBy("timestamp").collect()
    assert [(r["timestamp"], r["change"], r["pct_change"], r["turnover"], r["open"]) for r in got] == [(at(0), 0.0, 0.0, 0.0, 1.5), (at(1), 2.0, 25.0, 0.0, 1.5), (at(3), 7.0, 0.0, 0.0, 1.5)]
    assert {(r["date"], r["frequency"]) for r in got} == {(dt.date(2024, 1, 2), "5")}


def test_times_and_relaxed_types(spark, tmp_path):
    df = spark.sql("select explode(array(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-02 23:59:59', timestamp_ntz'2024-01-03 00:00:00')) as timestamp")
    assert sinks.between(df, "2024-01-01", "2024-01-02").count() == 2 and sinks.between(df, None, "2024-01-02 00:00:00").count() == 1 and sinks.between(df, "2024-01-02").count() == 2
    spark.sql("select 1 as x, 'a' as s").write.parquet(str(tmp_path / "i"))
    spark.sql("select cast(0.5 as float) as x").write.parquet(str(tmp_path / "f"))
    wanted = spark.sql("select 1.0d as x, 'a' as s").schema
    assert sorted((r["x"], r["s"]) for r in sinks.relaxed(spark, [str(tmp_path / "i"), str(tmp_path / "f")], wanted).collect()) == [(0.5, None), (1.0, "a")]
    with pytest.raises(ValueError, match="x is int"):
        sinks.relaxed(spark, [str(tmp_path / "i")], spark.sql("select '' as x").schema)


def test_samples_do_not_depend_on_the_dealing(spark):
    df = spark.range(500).selectExpr("cast(id as string) as symbol", "id as date")
    one, two = (sorted(r["date"] for r in normalise.sample(df.repartition(n), 20, 3, ["symbol"]).collect()) for n in (1, 7))
    other = sorted(r["date"] for r in normalise.sample(df, 20, 4, ["symbol"]).collect())
    assert one == two and len(one) == 20 and one != other


def test_stored_windows(spark, tmp_path):
    b, root = normalise.bars(bars(spark, range(1, 13)).unionByName(bars(spark, range(5, 17), "000002"))), str(tmp_path)
    with pytest.raises(FileNotFoundError):
        index.load(spark, root, 5)
    made = index.build(b, 5, root, 1).first()
    assert (made["n_windows"], made["symbols"], made["dimensions"]) == (16, 2, 40)
    key = ["symbol", "end_idx", "price_path", "candle_geometry", "volume_liquidity"]
    fresh = windows.encoded(windows.sliding(b, 5)).select(*key)
    assert sorted(map(str, index.load(spark, root, 5).select(*key).collect())) == sorted(map(str, fresh.collect()))
    # windows of a build that was cut off have no manifest and are not seen
    index.load(spark, root, 5, check=False).limit(3).write.parquet(f"{root}/window_size=5/windows/v=2")
    assert index.load(spark, root, 5).count() == 16
    index.load(spark, root, 5, check=False).limit(3).write.mode("append").parquet(f"{root}/window_size=5/windows/v=1")
    with pytest.raises(ValueError, match="n_windows"):
        index.load(spark, root, 5)


def test_inputs_must_not_change_during_a_build(spark, tmp_path):
    spark.range(3).write.parquet(path := str(tmp_path / "x"))
    before = catalog.input_snapshot(spark, [path, str(tmp_path / "absent")])
    catalog.unchanged(spark, [path], before)
    spark.range(4).write.mode("append").parquet(path)
    with pytest.raises(RuntimeError, match="changed"):
        catalog.unchanged(spark, [path], before)
    assert catalog.snapshot_fingerprint(before) != catalog.snapshot_fingerprint(catalog.input_snapshot(spark, [path]))


def test_training_needs_a_passed_run(spark):
    body = lambda ok: f'{{"result": {{"acceptance": {{"passed": {ok}}}, "accuracy": 0.9}}}}'
    runs = spark.createDataFrame([("a", 1, body("true")), ("b", 2, body("false")), ("c", 3, "{broken")], "run_id string, generated_at long, body string")
    assert selection.may_train(runs)["run_id"] == "a" and selection.may_train(runs, "a")["accuracy"] == 0.9
    for asked in ("b", "c", "z"):
        with pytest.raises(PermissionError):
            selection.may_train(runs, asked)


def test_selector_pools(spark):
    columns = "k string, place int, method string, eligible boolean, accuracy double, wilson double, stable_wilson double, coverage double, n long"
    rows = [("x", 0, "probability_band", False, 0.99, 0.99, 0.99, 0.9, 5000), ("x", 1, "meta_correctness", True, 0.5, 0.5, 0.5, 0.1, 10),
            ("y", 0, "probability_band", False, 0.9, 0.9, 0.9, 0.9, 199), ("y", 1, "meta_correctness", False, 0.1, 0.1, None, 0.1, 200),
            ("z", 0, "other", False, None, None, None, None, 0), ("z", 1, "other", False, None, None, None, None, 0)]
    got = {r["k"]: (r["method"], r["pool"]) for r in selection.select(spark.createDataFrame(rows, columns), ["k"], "place").collect()}
    assert got == {"x": ("meta_correctness", 0), "y": ("meta_correctness", 1), "z": ("other", 3)}


def test_engine_searches_stored_windows(spark, small, tmp_path):
    request, key = SearchRequest("000001", "2001-06-30", top_k=3), ["symbol", "end_date", "score"]
    engine = Engine(spark, small, str(tmp_path))
    without = engine.search(request).select(*key).collect()
    assert engine.build(5, 1)["window_size"] == 5
    assert engine.search(request).select(*key).collect() == without


def test_agreement_by_counts_equals_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), int(y)) for a, b, y in zip(rng.random(300).round(2), rng.random(300).round(2), rng.integers(0, 2, 300))]
    got = models.agreement(spark.createDataFrame(rows, "a double, b double, label int"), ["a", "b"], 7).collect()
    for r in got:
        means = [((a + b) / 2, y) for a, b, y in rows if (a >= 0.5) == (b >= 0.5) and abs((0.0 + a + b) / 2 - 0.5) >= r["margin"]]
        assert r["n"] == len(means) and r["accuracy"] == pytest.approx(np.mean([(p >= 0.5) == (y == 1) for p, y in means]))
    assert len(got) == 7
