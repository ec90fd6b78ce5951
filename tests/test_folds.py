"""Fold algebra against fitting and scoring every fold by Spark ML."""

import math

import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import folds, forecast
from sparkpanel.plans import forecasts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    """Features with gaps, in most months."""
    df = forecasts.frame(spark, DATA)
    gap = F.pmod(F.xxhash64("name", "date"), F.lit(5))
    return df.withColumn("mom", F.when(gap == 0, None).when(gap == 1, float("nan")).otherwise(F.col("mom"))).withColumn("risk", F.when(gap == 2, None).otherwise(F.col("risk"))).persist()


GRID = {"linear": (0.0, 0.0), "ridge": (0.02, 0.0), "elastic": (0.01, 0.5), "lasso": (0.005, 1.0), "nothing left": (50.0, 1.0)}


def pipeline(penalty, mix):
    return forecast.model_pipeline("linear", forecasts.FEATURES, "y", regParam=penalty, elasticNetParam=mix, **({"solver": "normal"} if not mix else {}), tol=1e-12)


def test_same_numbers_as_the_loop(spark, frame):
    spans = forecast.walk_forward_folds(frame, 36, 12, 12).filter("fold < 2")
    got = {r.candidate: r.ic for r in folds.search_linear(frame, spans, GRID, forecasts.FEATURES, "y").collect()}
    want = {r.candidate: r.ic for r in forecast.search(frame, spans, {n: pipeline(*p) for n, p in GRID.items()}, "y").collect()}
    assert got.keys() == want.keys() == GRID.keys()
    assert all(math.isclose(got[n], want[n], abs_tol=1e-6) for n in GRID), (got, want)
    assert got["nothing left"] == -2.0


@pytest.mark.parametrize("name", ["linear", "elastic"])
def test_same_predictions_as_the_loop(spark, frame, name):
    spans = forecast.walk_forward_folds(frame, 36, 12, 12).filter("fold < 2")
    key = lambda df: {(r.fold, r.name, r.date): r.prediction for r in df.collect()}
    got = key(folds.predict_linear(frame, spans, forecasts.FEATURES, "y", ["name", "date"], *GRID[name]))
    want = key(forecast.walk_forward_predict(frame, spans, pipeline(*GRID[name]), ["name", "date"]))
    assert got.keys() == want.keys() and len(got) > 100
    assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_candidates_at_once_and_their_budget(spark, frame):
    spans = forecast.walk_forward_folds(frame, 36, 12, 12).filter("fold < 2")
    made = {n: pipeline(*GRID[n]) for n in ("linear", "ridge", "elastic")}
    got = {r.candidate: r.ic for r in folds.search_at_once(frame, spans, made, "y", 2).collect()}
    want = {r.candidate: r.ic for r in forecast.search(frame, spans, made, "y").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[n], want[n], abs_tol=1e-9) for n in want)
    ticks = iter(range(0, 1000, 100))
    assert [r.candidate for r in folds.search_at_once(frame, spans, made, "y", 1, 50, lambda: next(ticks)).collect()] == ["linear"]


def test_empty_training(spark, frame):
    none = folds.Moments.collect(folds.month_moments(frame.filter("false"), forecasts.FEATURES, "y"))
    assert len(none.label) == 0 and folds.search_linear(frame.filter("false"), forecast.walk_forward_folds(frame, 36, 12, 12).filter("false"), GRID, forecasts.FEATURES, "y").count() == 0
    seen = folds.Moments.collect(folds.month_moments(frame, forecasts.FEATURES, "y"))
    fitted = folds.fit(seen.between(5, 4))
    assert fitted.intercept == 0.0 and not fitted.coefficients.any() and folds.fit(seen.between(0, 9)).score(seen.between(5, 4)) == -2.0
