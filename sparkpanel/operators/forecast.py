"""Return forecasting: splits, folds, preprocessing, encoders, models and scores."""

from __future__ import annotations

import math
import random
import statistics
import time
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import drop_table, written
from ..panel import Axis, ratio
from .quantiles import column_quantiles
from .ranking import rank_spread

AX = Axis()


def train_test_split(df: DataFrame, offset: int, cut: str | None = None, fraction: float | None = None, ax: Axis = AX) -> tuple[DataFrame, DataFrame]:
    """Train up to the cut; test starts ``offset`` distinct train times before its end (negative offset), for warm-up."""
    if (cut is None) == (fraction is None):
        raise ValueError("give either a cut or a fraction")
    times = sorted(r[0] for r in df.select(ax.time).distinct().collect())  # the calendar
    at = times[int(fraction * len(times))] if fraction is not None else df.sparkSession.sql(f"SELECT TIMESTAMP'{cut}'").first()[0]
    train_times = [t for t in times if t <= at]
    start = train_times[offset]
    return df.filter(F.col(ax.time) <= F.lit(at)), df.filter(F.col(ax.time) >= F.lit(start))


def walk_forward_folds(df: DataFrame, train: int, validate: int, step: int, moving: bool = True, ax: Axis = AX) -> DataFrame:
    """Fold table (fold, role, from_index, to_index) over the distinct times; the last validation may be short."""
    n = df.select(ax.time).distinct().agg(F.count("*").alias("n"))
    folds = n.select(F.explode(F.sequence(F.lit(0), ((F.col("n") - 1 - train) / step).cast("int"))).alias("fold"), "n").filter(F.col("fold") * step + train <= F.col("n") - 1)
    i = F.col("fold") * step
    first = i if moving else F.lit(0)
    roles = F.array(F.struct(F.lit("train").alias("role"), first.alias("a"), (i + train - 1).alias("b")), F.struct(F.lit("validate").alias("role"), (i + train).alias("a"), F.least(i + train + validate - 1, F.col("n") - 1).alias("b")))
    return folds.select("fold", F.explode(roles).alias("x")).select("fold", "x.role", F.col("x.a").cast("int").alias("from_index"), F.col("x.b").cast("int").alias("to_index"))


def fold_rows(df: DataFrame, folds: DataFrame, ax: Axis = AX) -> DataFrame:
    """Panel rows of each fold and role: a range join on the times' numbers."""
    times = df.select(ax.time).distinct().withColumn("__i", F.row_number().over(Window.orderBy(ax.time)) - 1)  # the calendar
    ranges = folds.join(times, (F.col("__i") >= F.col("from_index")) & (F.col("__i") <= F.col("to_index"))).select("fold", "role", ax.time)
    return df.join(ranges, ax.time)


def preprocess(train: DataFrame, df: DataFrame, columns: list[str], limit: float = 1.5) -> DataFrame:
    """Mean imputation, robust scaling by median and interquartile range, and clipping, all fitted on train."""
    fitted = train.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    filled = train.crossJoin(F.broadcast(fitted)).select(*[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) for c in columns])
    each = column_quantiles(filled, columns, [0.25, 0.5, 0.75])
    q = each.agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"__q_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(fitted)).crossJoin(F.broadcast(q))  # tables of one row
    scaled = {c: ratio(F.coalesce(F.col(c), F.col(f"__m_{c}")) - F.col(f"__q_{c}")[1], F.col(f"__q_{c}")[2] - F.col(f"__q_{c}")[0]) for c in columns}
    return out.select(*[F.least(F.greatest(scaled[c], F.lit(-limit)), F.lit(limit)).alias(c) if c in scaled else F.col(c) for c in df.columns])


def zero_count(columns: list[str], zero: bool = True) -> Column:
    return sum((F.when((F.col(c) == 0) if zero else (F.col(c) != 0), 1).otherwise(0) for c in columns), F.lit(0))


def target_encode(train: DataFrame, df: DataFrame, category: str, target: str, name: str) -> DataFrame:
    means = train.groupBy(category).agg(F.avg(target).alias(name))
    return df.join(means, category, "left")


def target_encode_cv(df: DataFrame, category: str, target: str, fold: Column, name: str) -> DataFrame:
    """Mean of the other folds' targets of the category; null where there are none."""
    df = df.withColumn("__fold", fold)
    own, all_ = Window.partitionBy(category, "__fold"), Window.partitionBy(category)
    total = F.sum(target).over(all_) - F.coalesce(F.sum(target).over(own), F.lit(0.0))
    n = F.count(target).over(all_) - F.count(target).over(own)
    return df.withColumn(name, ratio(total, n.cast("double"))).drop("__fold")


def target_encode_loo(df: DataFrame, category: str, target: str, name: str) -> DataFrame:
    w = Window.partitionBy(category)
    return df.withColumn(name, ratio(F.sum(target).over(w) - F.col(target), (F.count(target).over(w) - 1).cast("double")))


def information_coefficient(x: str, y: str) -> Column:
    """Correlation as an aggregate; -2 when a side doesn't vary. (``corr`` itself raises an error then.)"""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    c = F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y))))
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(-2.0))


def sharpe_score(df: DataFrame, r: str, prediction: str, n: int, ax: Axis = AX) -> DataFrame:
    return rank_spread(df, r, prediction, n, ax).agg(ratio(F.avg("port_r"), F.stddev_samp("port_r")).alias("sharpe"))


def weighted_average_coefficients(df: DataFrame, features: list[str], y: str, threshold: float = 0.0, weight: str | None = "IC", n: int = 10, ax: Axis = AX) -> DataFrame:
    """Each feature's weight, zero when small: mean per-time information coefficient (IC), Sharpe ratio of its n-tile spread (SR), or an equal share."""
    if weight is None:
        return df.sparkSession.createDataFrame([(f, 1.0 / len(features)) for f in features], "feature string, coefficient double")
    long = df.unpivot([ax.time, ax.name, y], features, "feature", "value")
    if weight == "IC":
        each = long.groupBy("feature", ax.time).agg(F.corr("value", y).alias("x"))
        score = F.avg(F.when(~F.isnan("x"), F.col("x")))
    else:
        w = Window.partitionBy("feature", ax.time)
        at = F.row_number().over(w.orderBy("value", ax.name)) / F.count("*").over(w)
        ranked = long.filter(F.col("value").isNotNull() & F.col(y).isNotNull()).withColumn("__p", at)
        each = ranked.groupBy("feature", ax.time).agg((F.avg(F.when(F.col("__p") > 1 - 1 / n, F.col(y))) - F.avg(F.when(F.col("__p") <= 1 / n, F.col(y)))).alias("x"))
        score = ratio(F.avg("x"), F.stddev_samp("x"))
    return each.groupBy("feature").agg(score.alias("__m")).select("feature", F.when(F.abs("__m") <= threshold, 0.0).otherwise(F.col("__m")).alias("coefficient"))


def weighted_average_predict(df: DataFrame, coefficients: dict[str, float]) -> Column:
    total = sum(abs(c) for c in coefficients.values())
    return ratio(sum((F.col(f) * c for f, c in coefficients.items()), F.lit(0.0)), F.lit(float(total)))


def model_pipeline(name: str, features: list[str], label: str, **options):
    """Spark ML pipeline: imputation, assembly, scaling and a regressor."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor

    made = {"forest": RandomForestRegressor, "boosted": GBTRegressor, "tree": DecisionTreeRegressor, "linear": LinearRegression, "elastic": LinearRegression}[name]
    if name == "elastic":
        options = {"regParam": 0.01, "elasticNetParam": 0.5} | options
    filled = [f"{f}__f" for f in features]
    return Pipeline(stages=[
        Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
        made(featuresCol="__x", labelCol=label, predictionCol="prediction", **options),
    ])


def walk_forward_predict(df: DataFrame, folds: DataFrame, pipeline, keep: list[str], ax: Axis = AX) -> DataFrame:
    """Out-of-sample predictions of all folds: fit on each train window, predict the next.

    The folds' rows are written once, for the fits now and the predictions when they are asked for.
    """
    return _predict(written(fold_rows(df, folds, ax), "folds")[0], folds, pipeline, keep)


def _predict(rows: DataFrame, folds: DataFrame, pipeline, keep: list[str]) -> DataFrame:
    parts = []
    for fold in sorted(r.fold for r in folds.select("fold").distinct().collect()):  # a row for each fold
        part = rows.filter(F.col("fold") == fold)
        parts.append(pipeline.fit(part.filter("role = 'train'")).transform(part.filter("role = 'validate'")).select("fold", *keep, "prediction"))
    return reduce(DataFrame.unionByName, parts)


def candidates(grid: dict[str, list], make: Callable) -> dict[str, object]:
    """A pipeline for each point of a grid of parameters, named by it."""
    points = [dict(zip(grid, v, strict=True)) for v in product(*grid.values())]
    return {", ".join(f"{k}={v}" for k, v in p.items()): make(**p) for p in points}


def search(df: DataFrame, folds: DataFrame, pipelines: dict[str, object], label: str, trials: int | None = None, seconds: float | None = None, seed: int = 1, ax: Axis = AX) -> DataFrame:
    """Mean information coefficient over the folds of each candidate, best first.

    With ``trials`` that many candidates are tried, drawn by a seed; with
    ``seconds`` no candidate begins after that time.
    """
    names, began, rows = [*pipelines], time.monotonic(), []
    of_folds, path = written(fold_rows(df, folds, ax), "folds")  # once for all candidates
    if trials is not None and trials < len(names):
        names = random.Random(seed).sample(names, trials)
    for name in names:
        if seconds is not None and rows and time.monotonic() - began > seconds:
            break
        p = _predict(of_folds, folds, pipelines[name], [ax.time, label])
        ic = p.groupBy("fold").agg(information_coefficient("prediction", label).alias("ic")).agg(F.avg("ic")).first()[0]
        rows.append((name, ic))
    drop_table(df.sparkSession, path)
    return df.sparkSession.createDataFrame(rows, "candidate string, ic double").orderBy(F.desc("ic"), "candidate")


#: Rows dealt out among each other in one task, about.
DEAL_ROWS = 100_000


def permutation_importance(model, df: DataFrame, features: list[str], label: str, repeats: int = 1, seed: int = 1) -> DataFrame:
    """Drop of the information coefficient when one feature's values are dealt out anew: mean and deviation over the repeats."""
    spark, ic = df.sparkSession, lambda d: d.agg(information_coefficient("prediction", label)).first()[0]
    base, rows = ic(model.transform(df)), []
    groups = max(1, -(-df.count() // DEAL_ROWS))
    # rows are numbered in two orders within random groups and joined on the number: each row gets another row's value
    keyed = df.withColumn("__k", F.xxhash64(*df.columns)).withColumn("__b", F.pmod("__k", F.lit(groups)))
    for f in features:
        drops = []
        for k in range(repeats):
            left = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy("__k")))
            right = keyed.select(f, "__b", F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64("__k", F.lit(seed + k)))).alias("__n"))
            drops.append(float(base - ic(model.transform(left.drop(f).join(right, ["__b", "__n"])))))
        rows.append((f, sum(drops) / repeats, statistics.stdev(drops) if repeats > 1 else None))
    return spark.createDataFrame(rows, "feature string, drop double, deviation double")


def univariate_scores(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """F statistic and p-value of the regression of the label on each feature alone, from one aggregation."""
    from .portfolio import incomplete_beta

    full = {f: F.col(f).isNotNull() & F.col(label).isNotNull() for f in features}
    row = df.agg(*[F.corr(F.when(full[f], F.col(f)), F.when(full[f], F.col(label))).alias(f"r_{f}") for f in features], *[F.count(F.when(full[f], 1)).alias(f"n_{f}") for f in features]).first()
    out = []
    for f in features:
        c, k = row[f"r_{f}"], row[f"n_{f}"] - 2
        if c is None or math.isnan(c) or k < 1:
            out.append((f, None, None))
            continue
        share = min(c * c, 1 - 1e-16)
        out.append((f, share / (1 - share) * k, incomplete_beta(k / 2, 0.5, 1 - share)))
    return df.sparkSession.createDataFrame(out, "feature string, f double, p double")


def select_features(scores: DataFrame, percentile: float | None = None, family_error: float | None = None) -> list[str]:
    """Features of the highest F statistics (a percentage of all), or those whose p-value is under the family-wise error's share."""
    rows = sorted((r for r in scores.collect() if r.f is not None), key=lambda r: (-r.f, r.feature))  # one row for each feature
    if percentile is not None:
        rows = rows[: max(1, math.ceil(len(rows) * percentile / 100))]
    if family_error is not None:
        rows = [r for r in rows if r.p < family_error / max(len(rows), 1)]
    return [r.feature for r in rows]


def partial_dependence(model, df: DataFrame, feature: str, grid: list[float]) -> DataFrame:
    """Mean prediction with one feature set to each grid value in turn."""
    points = df.sparkSession.createDataFrame([(float(g),) for g in grid], "grid double")
    return model.transform(df.drop(feature).crossJoin(F.broadcast(points)).withColumn(feature, F.col("grid"))).groupBy("grid").agg(F.avg("prediction").alias("prediction"))


def feature_importance(model, features: list[str]) -> DataFrame:
    """Mean and standard deviation of importances over a forest's trees."""
    import numpy as np
    from pyspark.sql import SparkSession

    each = np.array([t.featureImportances.toArray() for t in model.stages[-1].trees])
    return SparkSession.active().createDataFrame([(f, float(m), float(s)) for f, m, s in zip(features, each.mean(0), each.std(0), strict=True)], "feature string, mean double, std double")
