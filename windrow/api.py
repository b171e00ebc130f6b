"""What the command line and a server would call: search, prediction, status and exports over one data folder."""

from __future__ import annotations

import argparse
import time
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import factors, index, normalise, search, windows
from .session import session
from .sources import bars, sinks


@dataclass(frozen=True)
class SearchRequest:
    symbol: str
    end_date: str
    window_size: int = 5
    top_k: int = 10
    recall_k: int = 200
    scope: str = "all"

    def __post_init__(self) -> None:
        if not 3 <= self.window_size <= 240 or self.top_k < 1 or self.recall_k < 1 or self.scope not in ("all", "historical"):
            raise ValueError("window_size is 3 to 240, top_k and recall_k are positive, scope is all or historical")


@dataclass
class Cache:
    """The latest results, for some seconds."""

    size: int = 64
    seconds: float = 300.0
    kept: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key: object):
        at, value = self.kept.get(key, (0.0, None))
        if value is not None and time.monotonic() - at <= self.seconds:
            self.kept.move_to_end(key)
            return value
        self.kept.pop(key, None)
        return None

    def put(self, key: object, value: object) -> None:
        self.kept[key] = (time.monotonic(), value)
        self.kept.move_to_end(key)
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)


class Engine:
    def __init__(self, spark: SparkSession, folder: str, stored: str | None = None):
        """``stored`` is where indexes are built and looked for; without it each search makes its windows."""
        self.spark, self.folder, self.stored, self.cache = spark, folder, stored, Cache()

    def bars(self) -> DataFrame:
        return normalise.bars(bars.daily(self.spark, self.folder))

    def resolve(self, query: str) -> str:
        found = normalise.resolve(bars.profiles(self.spark, self.folder), query, self.bars()).collect()
        if not found:
            raise ValueError(f"{query!r} names no symbol, or more than one")
        return found[0]["symbol"]

    def build(self, size: int, version: int) -> dict:
        """Stores the windows of a size; earlier results are forgotten."""
        if self.stored is None:
            raise ValueError("the engine has no folder for indexes")
        inputs = [f"{self.folder}/{t}.parquet" for t in bars.TABLES]
        made = index.build(self.bars(), size, self.stored, version, inputs).first().asDict()
        self.cache.kept.clear()
        return made

    def windows(self, size: int) -> DataFrame:
        """Stored windows, held against their manifest, or windows made now."""
        if self.stored is not None:
            try:
                return index.load(self.spark, self.stored, size)
            except FileNotFoundError:
                pass
        return windows.encoded(windows.sliding(self.bars(), size))

    def search(self, request: SearchRequest, past: bool = False) -> DataFrame:
        """symbol, start_date, end_date, distance, score, has_forward, by rank; of ``past`` windows, which end before the asked one
        begins, alone."""
        if (hit := self.cache.get((request, past))) is not None:
            return hit
        all_ = self.windows(request.window_size)
        code = self.resolve(request.symbol)
        asked = all_.where((F.col("symbol") == code) & (F.col("end_date") <= F.lit(request.end_date).cast("date"))).orderBy(F.col("end_date").desc()).limit(1)
        parts = ("price_path", "candle_geometry", "volume_liquidity")
        one = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("symbol", "start_date", "end_date", *parts)))
        pairs = all_.crossJoin(F.broadcast(one))  # one row
        if past:
            pairs = pairs.where("end_date < q_start_date")
        shared = search.overlap_days(F.col("start_date"), F.col("end_date"), F.col("q_start_date"), F.col("q_end_date"))
        own = F.col("symbol") == F.col("q_symbol") if request.scope == "all" else F.lit(True)
        near = pairs.where(~(own & (shared > search.OVERLAP_DAYS))).withColumn("l2", search.euclid(F.concat(*parts), F.concat(*(f"q_{p}" for p in parts)))).orderBy("l2", "symbol", "end_date").limit(request.recall_k)
        levels = lambda c: F.slice(c, 1, request.window_size)
        distance = {p: search.rmse(F.col(p), F.col(f"q_{p}")) for p in parts[1:]} | {"price_path": search.dtw_distance(levels("price_path"), levels("q_price_path"))}
        scored = near.withColumn("distance", search.balanced(distance)).withColumn("score", search.similarity(F.col("distance")))
        known = self.forward().where(F.col("horizon") == 10).select("symbol", F.col("date").alias("end_date"), F.col("return_pct").isNotNull().alias("has_forward"))
        picked = known.join(F.broadcast(scored.select("symbol", "start_date", "end_date", "distance", "score")), ["symbol", "end_date"])  # recall_k rows
        result = search.ranked(picked.select("symbol", "start_date", "end_date", "distance", "score", "has_forward"), request.top_k)
        self.cache.put((request, past), result)
        return result

    def forward(self) -> DataFrame:
        return search.forward(bars.daily(self.spark, self.folder))

    def predict(self, request: SearchRequest) -> DataFrame:
        """By horizon, the analogues' vote; only windows that end before the asked one begins are looked for."""
        found = self.search(request, past=True).select("symbol", F.col("end_date").alias("date"), F.col("score").alias("similarity"))
        labels = factors.labels(bars.daily(self.spark, self.folder), (1, 2), request.end_date)
        return factors.vote(labels.join(F.broadcast(found), ["symbol", "date"]).withColumn("factor_similarity", F.lit(1.0)))  # top_k rows

    def status(self) -> dict:
        row = normalise.bounds(bars.daily(self.spark, self.folder)).first()
        return {"rows": row["n_rows"], "symbols": row["n_symbols"], "first": str(row["first"]), "last": str(row["last"]), "spark": self.spark.version, "adaptive": self.spark.conf.get("spark.sql.adaptive.enabled")}

    def doctor(self) -> dict:
        state = self.status()
        ready = state["rows"] > 0
        return {"ready": ready, "advice": [] if ready else ["no bars: put the tables into the data folder"]} | state


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="windrow")
    p.add_argument("command", choices=["search", "predict", "status", "doctor", "query", "build"])
    p.add_argument("folder")
    p.add_argument("--symbol", default="000001")
    p.add_argument("--end-date", default="2001-06-30")
    p.add_argument("--window", type=int, default=5)
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--name", help="of a registered query")
    p.add_argument("--index", help="folder of stored windows")
    p.add_argument("--csv")
    p.add_argument("--html")
    a = p.parse_args(args)
    engine = Engine(session(), a.folder, a.index)
    if a.command == "build":
        print(engine.build(a.window, int(time.time())))
        return
    if a.command in ("status", "doctor"):
        print(getattr(engine, a.command)())
        return
    if a.command == "query":
        from .plans import QUERIES

        found = QUERIES[a.name](engine.spark, a.folder)
    else:
        found = getattr(engine, a.command)(SearchRequest(a.symbol, a.end_date, a.window, a.top))
    if a.csv:
        sinks.to_csv(found, a.csv)
    if a.html:
        sinks.to_html(found, a.html)
    found.show(50, truncate=False)


if __name__ == "__main__":
    main()
