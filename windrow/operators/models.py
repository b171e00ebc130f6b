"""Time splits, standardisation, feature scores, models, calibration, grids and the acceptance gate."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import wilson

# What a model must reach on the lockbox.
TARGET, MIN_ROWS, MIN_COVERAGE, STAT_ROWS = 0.75, 10_000, 0.10, 1_000


def split_dates(rows: DataFrame, train_end: str, fraction: float = 0.2, embargo: int = 5) -> DataFrame:
    """One row: where validation starts among the distinct label dates up to ``train_end``, and the embargo before it."""
    dates = rows.where(F.col("label_date") <= F.lit(train_end).cast("date")).select("label_date").distinct()
    placed = dates.withColumn("i", F.row_number().over(Window.orderBy("label_date")) - 1)  # a row a date
    n = dates.agg(F.count("*").alias("n"))
    at = n.select(F.greatest(F.least((F.col("n") * (1 - fraction)).cast("int"), F.col("n") - 1), F.lit(1)).alias("s")).withColumn("e", F.greatest(F.col("s") - embargo, F.lit(0)))
    return placed.crossJoin(F.broadcast(at)).agg(F.max(F.when(F.col("i") == F.col("s"), F.col("label_date"))).alias("validation_start"), F.max(F.when(F.col("i") == F.col("e"), F.col("label_date"))).alias("embargo_start"))


def split(rows: DataFrame, train_end: str, test_start: str, end: str, fraction: float = 0.2, embargo: int = 5) -> DataFrame:
    """Adds ``part``: fit, valid or lockbox; rows of the embargo and of other times go."""
    cut = split_dates(rows, train_end, fraction, embargo)
    train = F.col("label_date") <= F.lit(train_end).cast("date")
    part = (
        F.when(train & (F.col("label_date") < F.col("embargo_start")), "fit").when(train & (F.col("label_date") >= F.col("validation_start")), "valid")
        .when((F.col("date") >= F.lit(test_start).cast("date")) & (F.col("label_date") <= F.lit(end).cast("date")), "lockbox")
    )
    return rows.crossJoin(F.broadcast(cut)).withColumn("part", part).where("part is not null").drop("validation_start", "embargo_start")


def overlap_check(parts: DataFrame) -> DataFrame:
    last, first = F.max(F.when(F.col("part") == "fit", F.col("label_date"))), F.min(F.when(F.col("part") == "valid", F.col("label_date")))
    return parts.agg(last.alias("fit_label_end"), first.alias("validation_label_start"), (last < first).alias("purged"))


def standardised(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less the fit rows' mean, over their sample deviation (1 where that is 0)."""
    fit = parts.where("part = 'fit'").agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-9, 1.0).otherwise(F.col(f"s_{c}"))).alias(c) for c in columns]
    return parts.crossJoin(F.broadcast(fit)).select(*[c for c in parts.columns if c not in columns], *z)


def feature_scores(rows: DataFrame, columns: list[str], label: str = "label", chunks: int = 4, per_chunk: int = 2000, least: int = 50) -> DataFrame:
    """feature, score of the columns, standardised over the rows: 0.65 of the label's covariance over its deviation, absolute, and 0.35
    of the same's lower median over chunks of the rows in order of date and symbol, weighted by how many chunks agree in sign.

    Rows are numbered within their date and by how many rows the dates before have, so no window spans all rows."""
    day = rows.groupBy("date").agg(F.count("*").alias("d"))
    before = F.coalesce(F.sum("d").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a trading day
    day = day.select("date", before.alias("before"), F.sum("d").over(Window.partitionBy()).alias("n"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy("symbol")) - 1).join(F.broadcast(day), "date").withColumn("k", F.col("k") + F.col("before"))
    many = F.least(F.lit(chunks), F.greatest(F.lit(1), F.floor(F.col("n") / per_chunk))).cast("int")
    edge = lambda i: F.rint(F.col("n") * i / F.col("chunks"))
    chunk = F.size(F.filter(F.sequence(F.lit(1), F.col("chunks")), lambda i: edge(i) <= F.col("k")))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns))).alias("f")
    long = numbered.withColumn("chunks", many).select("chunks", chunk.alias("chunk"), F.col(label).cast("double").alias("y"), each).select("chunks", "chunk", "y", "f.*")
    # one pass over the rows: a chunk's moments, from which those of all rows follow
    moments = {"m": F.count("*").cast("double"), "mx": F.avg("x"), "my": F.avg("y"), "c": F.covar_pop("x", "y"), "vx": F.var_pop("x"), "vy": F.var_pop("y"), "chunks": F.max("chunks")}
    part = long.groupBy("feature", "chunk").agg(*(v.alias(k) for k, v in moments.items()))
    mean = lambda v: F.sum(F.col("m") * v) / F.sum("m")
    pooled = lambda v, a, b: mean(F.col(v) + F.col(a) * F.col(b)) - mean(F.col(a)) * mean(F.col(b))
    sample = lambda v, n: F.sqrt(F.greatest(v, F.lit(0.0)) * n / (n - 1))
    chunk_of = F.struct("m", "c", "vy", "chunks")
    by = part.groupBy("feature").agg(pooled("c", "mx", "my").alias("c"), pooled("vx", "mx", "mx").alias("vx"), pooled("vy", "my", "my").alias("vy"), F.sum("m").alias("n"), F.collect_list(chunk_of).alias("parts")).where("n > 1")
    by = by.withColumn("sx", sample(F.col("vx"), F.col("n"))).withColumn("sx", F.when(F.col("sx") < 1e-9, 1.0).otherwise(F.col("sx")))
    by = by.withColumn("g", F.col("c") / F.col("sx") / F.greatest(sample(F.col("vy"), F.col("n")), F.lit(1e-6)))
    signed = lambda p: p["c"] / F.col("sx") / F.greatest(sample(p["vy"], p["m"]), F.lit(1e-6))
    s = by.withColumn("s", F.transform(F.filter("parts", lambda p: (p["m"] >= least) & (p["chunks"] > 1)), signed))
    middle = F.element_at(F.array_sort(F.transform("s", F.abs)), F.floor((F.size("s") + 1) / 2).cast("int"))
    agree = F.size(F.filter("s", lambda x: F.signum(x) == F.signum("g"))) / F.size("s")
    score = F.when(F.size("s") == 0, F.abs("g")).otherwise((0.65 * F.abs("g") + 0.35 * middle) * (0.5 + 0.5 * agree))
    return s.select("feature", F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)).alias("score"))


def top_features(scores: DataFrame, most: int) -> list[str]:
    """The best ``most`` features, in order of name."""
    return sorted(r["feature"] for r in scores.orderBy(F.col("score").desc(), "feature").limit(most).collect())


def steps(low: float, high: float, n: int) -> Column:
    """n values from low to high."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) + i * ((high - low) / (n - 1)))


def thresholds(predictions: DataFrame) -> DataFrame:
    """Accuracy of (prob, actual) at each of 101 thresholds.

    Rows are counted by the greatest threshold that they pass first, so the grid is laid over 102 counts and not over rows."""
    step = F.least(F.greatest(F.floor((F.col("prob") - 0.25) / 0.005 + 1e-9), F.lit(-1)), F.lit(100)).cast("int")
    counts = predictions.groupBy(step.alias("step")).agg(F.sum("actual").alias("up"), F.count("*").alias("n"))
    laid = counts.select("up", "n", "step", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("i"))
    hit = F.when(F.col("step") >= F.col("i"), F.col("up")).otherwise(F.col("n") - F.col("up"))
    return laid.groupBy("i").agg((F.sum(hit) / F.sum("n")).alias("accuracy")).select((0.25 + F.col("i") * 0.005).alias("threshold"), "accuracy")


def bands(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of each margin and side: how many rows lie beyond, their share, accuracy and Wilson bound."""
    margins = steps(0.02, 0.30, 57)
    # a row that lies beyond a margin lies beyond all smaller ones, so rows are counted by how many they lie beyond on either side first
    below = F.size(F.filter(margins, lambda m: F.col("prob") <= F.greatest(threshold - m, F.lit(0.02))))
    above = F.size(F.filter(margins, lambda m: F.col("prob") >= F.least(threshold + m, F.lit(0.98))))
    hit = (F.col("prob") >= threshold) == (F.col("actual") == 1)
    counts = predictions.where("prob is not null").groupBy(below.alias("below"), above.alias("above")).agg(F.count("*").alias("rows"), F.count_if(hit).alias("hit"))
    laid = counts.select("*", F.posexplode(margins).alias("i", "margin")).withColumn("side", F.explode(F.array(F.lit("both"), F.lit("long"), F.lit("short"))))
    low, high = F.col("i") < F.col("below"), F.col("i") < F.col("above")
    inside = F.when(F.col("side") == "both", low | high).when(F.col("side") == "long", high).otherwise(low)
    part = lambda c: F.sum(F.when(inside, F.col(c)).otherwise(0))
    out = laid.groupBy("margin", "side").agg(part("rows").alias("n"), part("hit").alias("hits"), F.sum("rows").alias("of"))
    return out.select("margin", "side", "n", (F.col("n") / F.col("of")).alias("coverage"), (F.col("hits") / F.greatest("n", F.lit(1))).alias("accuracy"), wilson(F.col("hits"), F.col("n")).alias("wilson"))


def acceptance(metrics: DataFrame) -> DataFrame:
    """Adds ``passed`` to rows of (test_rows, confident_count, confident_correct, confident_brier, baseline_brier, future_filter)."""
    n, hits = F.col("confident_count"), F.col("confident_correct")
    lower = wilson(hits, F.greatest(n, F.lit(1)))
    conditions = [
        hits / F.greatest(n, F.lit(1)) >= TARGET, (F.col("baseline_brier") > 0) & (F.col("confident_brier") < F.col("baseline_brier")), lower >= TARGET,
        (n >= MIN_ROWS) | (n / F.greatest("test_rows", F.lit(1)) >= MIN_COVERAGE), n >= STAT_ROWS, (n >= 0) & (n <= F.col("test_rows")), ~F.col("future_filter"),
    ]
    return metrics.withColumn("wilson_lower", lower).withColumn("passed", F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False)))


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(rows)


def probability(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1])


def logistic(fit: DataFrame, columns: list[str]):
    """Balanced classes; L2 of strength 1 over the sum of squares, as a rate per row."""
    n = fit.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    weight = F.when(F.col("label") == 1, n["n"] / (2.0 * max(n["p"], 1))).otherwise(n["n"] / (2.0 * max(n["n"] - n["p"], 1)))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    ready = assembled(fit, columns).withColumn("w", weight)
    scaled = scaler.fit(ready)
    model = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="w", regParam=1.0 / max(n["n"], 1), standardization=False, maxIter=100).fit(scaled.transform(ready))
    return lambda rows: probability(model, scaled.transform(assembled(rows, columns)))


def boosted(fit: DataFrame, columns: list[str], **options):
    model = GBTClassifier(labelCol="label", seed=7, **({"maxIter": 10, "maxDepth": 3} | options)).fit(assembled(fit, columns))
    return lambda rows: probability(model, assembled(rows, columns))


def perceptron(fit: DataFrame, columns: list[str], hidden: tuple[int, ...] = (16,)):
    model = MultilayerPerceptronClassifier(labelCol="label", layers=[len(columns), *hidden, 2], seed=7, maxIter=30).fit(assembled(fit, columns))
    return lambda rows: probability(model, assembled(rows, columns))


def averaged(models: list, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the models' probabilities."""
    found = [m(rows).select(*keys, "label", "prob") for m in models]
    return reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.first("label").alias("label"), F.avg("prob").alias("prob"))


def calibrated(valid: DataFrame, rows: DataFrame) -> DataFrame:
    """Platt's calibration on (prob, label): a logistic regression on the log-odds; with fewer than 50 rows nothing changes."""
    odds = lambda p: F.log(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))))
    if valid.limit(50).count() < 50:
        return rows
    model = LogisticRegression(labelCol="label", maxIter=50).fit(assembled(valid.withColumn("odds", odds(F.col("prob"))), ["odds"]))
    scale, bias = min(max(model.coefficients[0], 0.05), 5.0), min(max(model.intercept, -5.0), 5.0)
    return rows.withColumn("prob", 1 / (1 + F.exp(-(scale * odds(F.col("prob")) + bias))))


def agreement(rows: DataFrame, probs: list[str], margins: int = 61) -> DataFrame:
    """Of each margin: rows on whose side of 0.5 all models are, by at least the margin of their mean, and their accuracy."""
    up = [F.col(p) >= 0.5 for p in probs]
    agree = reduce(lambda a, b: a & b, up) | reduce(lambda a, b: a & b, [~u for u in up])
    mean = sum((F.col(p) for p in probs), F.lit(0.0)) / len(probs)
    values = steps(0.0, 0.3, margins)
    rows = rows.select("label", agree.alias("agree"), mean.alias("prob"))
    hit = (F.col("prob") >= 0.5) == (F.col("label") == 1)
    passed = F.when(F.col("agree"), F.size(F.filter(values, lambda m: F.abs(F.col("prob") - 0.5) >= m))).otherwise(0)
    counts = rows.groupBy(passed.alias("passed")).agg(F.count("*").alias("rows"), F.count_if(hit).alias("hit"), F.count(hit).alias("known"))
    laid = counts.select("*", F.posexplode(values).alias("i", "margin"))
    part = lambda c: F.sum(F.when(F.col("i") < F.col("passed"), F.col(c)).otherwise(0))
    return laid.groupBy("margin").agg(part("rows").alias("n"), (part("hit") / F.nullif(part("known"), F.lit(0))).alias("accuracy"))


def regimes(rows: DataFrame, features: list[str], cuts: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """Of each feature and quantile of it: how many rows lie at or above, and the accuracy of their predictions."""
    q = rows.agg(*(F.percentile_approx(c, list(cuts), 10_000).alias(c) for c in features))
    edge = q.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("edges")) for c in features))).alias("e")).select("e.feature", F.posexplode("e.edges").alias("i", "edge"))
    long = rows.select("label", "prob", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in features))).alias("f")).select("label", "prob", "f.*")
    hit = (F.col("prob") >= 0.5) == (F.col("label") == 1)
    found = long.join(F.broadcast(edge), "feature").where("x >= edge").groupBy("feature", "i").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"))
    return found.select("feature", F.element_at(F.array(*map(F.lit, cuts)), F.col("i") + 1).alias("quantile"), "n", "accuracy")
