"""Which selector of confident rows is taken, and whether a model may be trained at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows and share of rows that a constrained selector keeps at least, and the weights of its score.
MIN_ROWS, MIN_COVERAGE = 200, 0.10
METHOD_BONUS = {"candidate_agreement": 0.035, "meta_correctness": 0.015}


def selector_score(method: Column, eligible: Column, accuracy: Column, wilson: Column, stable: Column, coverage: Column, count: Column) -> Column:
    """Wilson bounds over all rows (0.55) and over the worst stretch (0.45), accuracy (0.2), coverage up to 0.3 (0.08), up to a thousand
    rows (0.02), and bonuses; a probability band that is not eligible pays for its unstable bound.  Nulls count as 0, a worst bound of 0 as none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole, ok = zero(wilson), F.coalesce(eligible, F.lit(False))
    worst = F.coalesce(F.nullif(zero(stable), F.lit(0.0)), whole)
    bonus = F.lit(0.0)
    for name, x in METHOD_BONUS.items():
        bonus = F.when(method == name, x).otherwise(bonus)
    shaky = F.when((method == "probability_band") & ~ok, F.least(F.lit(0.05), F.greatest(whole - worst, F.lit(0.0)))).otherwise(0.0)
    parts = (whole * 0.55, worst * 0.45, zero(accuracy) * 0.2, F.least(zero(coverage), F.lit(0.3)) * 0.08, F.least(zero(count.cast("double")) / 1000, F.lit(1.0)) * 0.02, F.when(ok, 0.08).otherwise(0.0), bonus, -shaky)
    return sum(parts[1:], parts[0])


def select(options: DataFrame, by: list[str], order: str) -> DataFrame:
    """By group the selector of highest score among the eligible ones, else those with rows and coverage enough, else those with any
    rows, else all; equal scores go to the first by ``order``."""
    c = F.col
    score = selector_score(c("method"), c("eligible"), c("accuracy"), c("wilson"), c("stable_wilson"), c("coverage"), c("n"))
    pool = F.when(c("eligible"), 0).when((c("n") >= MIN_ROWS) & (c("coverage") >= MIN_COVERAGE), 1).when(c("n") > 0, 2).otherwise(3)
    rows = options.select("*", score.alias("score"), pool.alias("pool"))
    return rows.groupBy(*by).agg(F.max_by(F.struct("method", "pool", "score", "n"), F.struct(-c("pool"), "score", -c(order))).alias("x")).select(*by, "x.*")


def passed(artifacts: DataFrame, run_id: str | None = None) -> DataFrame:
    """Of (run_id, generated_at, body), body JSON: the run asked for, or else the latest, if its acceptance passed; no row means no training."""
    ok = artifacts.where(F.get_json_object("body", "$.result.acceptance.passed") == "true")
    ok = ok.where(F.col("run_id") == run_id) if run_id else ok
    number = lambda k: F.get_json_object("body", f"$.result.{k}").cast("double").alias(k)
    return ok.orderBy(F.col("generated_at").desc(), F.col("run_id").desc()).limit(1).select("run_id", "generated_at", number("accuracy"), number("brier"))


def may_train(artifacts: DataFrame, run_id: str | None = None) -> dict:
    found = passed(artifacts, run_id).first()
    if found is None:
        raise PermissionError("no probe run has passed" if run_id is None else f"run {run_id} has not passed")
    return found.asDict()
