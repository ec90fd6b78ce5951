"""Linear and elastic candidates of a walk-forward search from monthly moments: one scan for all folds and candidates.

A fold's training window is a range of times, so its normal equations are sums
of the times' own sums. Those sums (a row for each time) are all that leaves Spark;
fits and scores of any number of candidates follow from them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Axis
from .forecast import information_coefficient

AX = Axis()


def month_moments(df: DataFrame, features: list[str], label: str, ax: Axis = AX) -> DataFrame:
    """One row a time: sums of products of features and label, split by which features are there (null and NaN are missing).

    ``label`` has n, the label's sum and its sum of squares; ``own`` for each feature its count, its sum, its
    product with the label and the label's sum where it is missing; ``both`` the products of two present features,
    ``alone`` the first feature's sum where the second is missing, ``neither`` how often both are, for all pairs.
    """
    y = F.col(label).cast("double")
    rows = df.select(ax.time, y.alias("__y"), *[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features]).withColumn("__one", F.when(F.col("__y").isNotNull(), 1.0))
    x, here = {f: F.when(F.col("__y").isNotNull(), F.col(f)) for f in features}, {f: F.col(f).isNotNull() for f in features}
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    own = [c for f in features for c in (zero(F.when(here[f], F.col("__one"))), zero(x[f]), zero(x[f] * F.col("__y")), zero(F.when(~here[f], F.col("__y"))))]
    pairs = [(a, b) for a in features for b in features]
    return rows.groupBy(ax.time).agg(
        F.array(zero("__one"), zero("__y"), zero(F.col("__y") * F.col("__y"))).alias("label"), F.array(*own).alias("own"), F.array(*[zero(x[a] * x[b]) for a, b in pairs]).alias("both"),
        F.array(*[zero(F.when(~here[b], x[a])) for a, b in pairs]).alias("alone"), F.array(*[zero(F.when(~here[a] & ~here[b], F.col("__one"))) for a, b in pairs]).alias("neither"),
    )


@dataclass(frozen=True)
class Moments:
    """Sums of some times' rows."""

    label: np.ndarray
    own: np.ndarray
    both: np.ndarray
    alone: np.ndarray
    neither: np.ndarray

    @staticmethod
    def collect(months: DataFrame, ax: Axis = AX) -> Moments:
        """All times in order, along the first axis; a calendar of them, times the square of the features."""
        rows = months.orderBy(ax.time).collect()
        k = len(rows[0].own) // 4 if rows else 0
        square = lambda name: np.array([r[name] for r in rows], float).reshape(len(rows), k, k)
        return Moments(np.array([r.label for r in rows], float).reshape(len(rows), 3), np.array([r.own for r in rows], float).reshape(len(rows), k, 4), square("both"), square("alone"), square("neither"))

    def between(self, first: int, last: int) -> Moments:
        return Moments(*(getattr(self, f)[first : last + 1].sum(axis=0) for f in ("label", "own", "both", "alone", "neither")))

    def means(self) -> np.ndarray:
        """Each feature's mean where it is there; 0 where it never is."""
        return np.divide(self.own[:, 1], self.own[:, 0], out=np.zeros(len(self.own)), where=self.own[:, 0] > 0)

    def filled(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of x, x x' and x y with missing features at ``m``."""
        missing = self.label[0] - self.own[:, 0]
        products = self.both + self.alone * m[None, :] + self.alone.T * m[:, None] + self.neither * np.outer(m, m)
        return self.own[:, 1] + missing * m, products, self.own[:, 2] + self.own[:, 3] * m


@dataclass(frozen=True)
class LinearFit:
    """prediction = intercept + coefficients . features, missing features at ``means``."""

    means: np.ndarray
    coefficients: np.ndarray
    intercept: float

    def score(self, seen: Moments) -> float:
        """Correlation of the prediction with the label; -2 where one doesn't vary."""
        n, y, yy = seen.label
        if n == 0:
            return -2.0
        x, xx, xy = seen.filled(self.means)
        b = self.coefficients
        mean = b @ x / n
        spread, cover, other = b @ xx @ b / n - mean * mean, b @ xy / n - mean * y / n, yy / n - (y / n) ** 2
        # under the rounding of the sums a prediction doesn't vary
        return float(cover / np.sqrt(spread * other)) if spread > 1e-12 * max(b @ xx @ b / n, 1e-300) and other > 0 else -2.0


def fit(train: Moments, penalty: float = 0.0, mix: float = 0.0, tolerance: float = 1e-13, sweeps: int = 20_000) -> LinearFit:
    """Least squares with an elastic-net penalty on standardised features and label, as Spark ML's linear regression has it.

    ``mix`` is the share of the absolute penalty. Features and label that don't vary in training get no coefficient.
    """
    n, total, squares = train.label
    m = train.means()
    if n == 0:
        return LinearFit(m, np.zeros(len(m)), 0.0)
    _, xx, xy = train.filled(m)
    mean = total / n
    cover, with_y, spread_y = xx / n - np.outer(m, m), xy / n - m * mean, squares / n - mean * mean
    deviation = np.sqrt(np.maximum(np.diag(cover), 0))
    varies = deviation > 1e-12 * np.maximum(np.sqrt(np.diag(xx) / n), 1e-300)
    out = np.zeros(len(m))
    if spread_y > 0 and varies.any():
        s, sy = deviation[varies], np.sqrt(spread_y)
        r, v = cover[np.ix_(varies, varies)] / np.outer(s, s), with_y[varies] / (s * sy)
        one, two = penalty / sy * mix, penalty / sy * (1 - mix)
        if not one:
            b = np.linalg.pinv(r + two * np.eye(len(v)), hermitian=True) @ v
        else:
            b = np.zeros(len(v))
            for _ in range(sweeps):
                before = b.copy()
                for j in range(len(b)):
                    left = v[j] - r[j] @ b + r[j, j] * b[j]
                    b[j] = np.sign(left) * max(abs(left) - one, 0.0) / (r[j, j] + two)
                if np.abs(b - before).max() < tolerance:
                    break
        out[varies] = b * sy / s
    return LinearFit(m, out, float(mean - out @ m))


def _windows(folds: DataFrame) -> dict[int, dict[str, tuple[int, int]]]:
    """Ranges of times by fold and role; two rows a fold."""
    out: dict = {}
    for r in folds.collect():
        out.setdefault(r.fold, {})[r.role] = (r.from_index, r.to_index)
    return out


def search_linear(df: DataFrame, folds: DataFrame, grid: dict[str, tuple[float, float]], features: list[str], label: str, ax: Axis = AX) -> DataFrame:
    """Mean information coefficient over the folds of each candidate (name: penalty and mix), best first, from one scan of df.

    The same numbers as ``forecast.search`` with pipelines of mean imputation, scaling and linear regression.
    """
    months, spans = Moments.collect(month_moments(df, features, label, ax), ax), _windows(folds)
    seen = {f: (months.between(*w["train"]), months.between(*w["validate"])) for f, w in spans.items()}
    rows = [(name, float(np.mean([fit(train, *point).score(held) for train, held in seen.values()]))) for name, point in grid.items() if seen]
    return df.sparkSession.createDataFrame(rows, "candidate string, ic double").orderBy(F.desc("ic"), "candidate")


def predict_linear(df: DataFrame, folds: DataFrame, features: list[str], label: str, keep: list[str], penalty: float = 0.0, mix: float = 0.0, ax: Axis = AX) -> DataFrame:
    """Out-of-sample predictions of all folds: fold, the columns to keep, prediction. One scan fits all folds, one projection predicts.

    The same as ``forecast.walk_forward_predict`` with such a pipeline.
    """
    months, spans = Moments.collect(month_moments(df, features, label, ax), ax), _windows(folds)
    rows = []
    for fold, w in spans.items():
        made = fit(months.between(*w["train"]), penalty, mix)
        rows.append((fold, *w["validate"], made.intercept, made.means.tolist(), made.coefficients.tolist()))
    fits = df.sparkSession.createDataFrame(rows, "fold int, __from int, __to int, __c double, __m array<double>, __b array<double>")
    times = df.select(ax.time).distinct().withColumn("__i", F.row_number().over(Window.orderBy(ax.time)) - 1)  # the calendar
    held = times.join(F.broadcast(fits), (F.col("__i") >= F.col("__from")) & (F.col("__i") <= F.col("__to"))).drop("__i", "__from", "__to")  # a row for each fold
    there = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
    total = sum((F.coalesce(there(f), F.col("__m")[i]) * F.col("__b")[i] for i, f in enumerate(features)), F.col("__c"))
    return df.join(F.broadcast(held), ax.time).select("fold", *keep, total.alias("prediction"))  # a row for each time and fold that predicts it


def search_at_once(df: DataFrame, folds: DataFrame, pipelines: dict[str, object], label: str, workers: int = 4, seconds: float | None = None, clock: Callable[[], float] = time.monotonic, ax: Axis = AX) -> DataFrame:
    """Mean information coefficient of candidates that need Spark ML, several at once, best first.

    The fold rows are persisted once for all candidates; at most ``workers``
    candidates run at a time, so idle executors of one fill up with another's tasks. With ``seconds``
    no candidate begins after that time, but for the first.
    """
    from .forecast import fold_rows

    began = clock()
    rows = fold_rows(df, folds, ax).persist()
    numbers = sorted(r.fold for r in folds.select("fold").distinct().collect())  # a row for each fold
    first = next(iter(pipelines), None)

    def score(name: str) -> tuple[str, float] | None:
        if seconds is not None and name != first and clock() - began > seconds:
            return None
        each = []
        for k in numbers:
            part = rows.filter(F.col("fold") == k)
            found = pipelines[name].fit(part.filter("role = 'train'")).transform(part.filter("role = 'validate'"))
            each.append(found.agg(information_coefficient("prediction", label)).first()[0])
        return name, float(sum(each) / len(each))

    try:
        with ThreadPoolExecutor(workers) as pool:
            tried = list(pool.map(inheritable_thread_target(df.sparkSession)(score), pipelines))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([t for t in tried if t], "candidate string, ic double").orderBy(F.desc("ic"), "candidate")
