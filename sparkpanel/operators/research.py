"""Empirical asset-pricing research: summaries, autocorrelation, factor regressions, Fama-MacBeth."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..panel import Axis, ratio
from .eda import side_by_side
from .quantiles import column_quantiles

AX = Axis()


def average_acf(df: DataFrame, value: str, lags: int, ax: Axis = AX) -> DataFrame:
    """Autocorrelation at lags 1..n of each entity, averaged over entities."""
    w = Window.partitionBy(ax.name).orderBy(ax.time)
    x = df.filter(F.col(value).isNotNull()).withColumn("__d", F.col(value) - F.avg(value).over(ax.entity()))
    x = x.select(ax.name, "__d", *[(F.col("__d") * F.lead("__d", k).over(w)).alias(f"__{k}") for k in range(1, lags + 1)])
    each = x.groupBy(ax.name).agg(*[ratio(F.sum(f"__{k}"), F.sum(F.col("__d") * F.col("__d"))).alias(f"{k}") for k in range(1, lags + 1)])
    return each.unpivot([ax.name], [f"{k}" for k in range(1, lags + 1)], "lag", "acf").groupBy(F.col("lag").cast("int").alias("lag")).agg(F.avg("acf").alias("acf"))


def summarize_signal(df: DataFrame, value: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), lags: int = 0, ax: Axis = AX) -> DataFrame:
    """Times, entities, rows; mean and std over cross-sections, over histories and pooled; quantiles, and the average autocorrelation at lags 1..lags."""
    df = df.filter(F.col(value).isNotNull())
    by = lambda key, n: df.groupBy(key).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).agg(F.avg("m").alias(f"mean_{n}"), F.avg("s").alias(f"std_{n}"))
    pooled = df.agg(
        F.count_distinct(ax.time).alias("times"), F.count_distinct(ax.name).alias("names"), F.count("*").alias("n"), F.avg(value).alias("mean_pooled"), F.stddev_samp(value).alias("std_pooled"),
    )
    q = column_quantiles(df, [value], list(quantiles)).select(*[F.col("q")[i].alias(f"q{int(100 * p)}") for i, p in enumerate(quantiles)])
    tables = [by(ax.time, "section"), by(ax.name, "series"), q]
    if lags:
        tables.append(average_acf(df, value, lags, ax).groupBy().pivot("lag", list(range(1, lags + 1))).agg(F.first("acf")).withColumnsRenamed({f"{k}": f"acf{k}" for k in range(1, lags + 1)}))
    for one in tables:  # of one row each
        pooled = pooled.crossJoin(one)
    return pooled


def summarize_variables(df: DataFrame, columns: list[str], quantiles: list[float]) -> DataFrame:
    q = column_quantiles(df, columns, quantiles).select(F.col("column").alias("variable"), *[F.col("q")[i].alias(f"q{int(100 * p)}") for i, p in enumerate(quantiles)])
    return side_by_side(df, columns, mean=F.avg, std=F.stddev_samp).withColumnRenamed("column", "variable").join(q, "variable", "left")  # a row for each column


def hac_ols(x: np.ndarray, y: np.ndarray, lags: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares with Bartlett-kernel robust t statistics and normal p-values."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    u = x * (y - x @ beta)[:, None]
    s = u.T @ u
    for k in range(1, min(lags, len(y) - 1) + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    t = beta / np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 1e-300))
    norm = NormalDist()
    return beta, t, np.array([2 * (1 - norm.cdf(abs(v))) for v in t])


def factor_regression(df: DataFrame, keys: list[str], y: str, factors: list[str], lags: int = 3, ax: Axis = AX) -> DataFrame:
    """Per key the regression on factors with constant: term, coefficient, t and p, in long form."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", term string, coefficient double, t double, p double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y, *factors]).sort_values(ax.time)
        if len(pdf) <= len(factors) + 1:
            return pd.DataFrame(columns=[*keys, "term", "coefficient", "t", "p"])
        x = np.column_stack([np.ones(len(pdf)), pdf[factors].to_numpy(float)])
        beta, t, p = hac_ols(x, pdf[y].to_numpy(float), lags)
        return pd.DataFrame({**{k: [v] * len(beta) for k, v in zip(keys, key, strict=True)}, "term": ["alpha", *factors], "coefficient": beta, "t": t, "p": p})

    return df.select(*keys, ax.time, y, *factors).groupBy(*keys).applyInPandas(run, schema)


#: Factors of the models by name, but for momentum.
MODELS = {"CAPM": ("mkt_rf",), "FF3": ("mkt_rf", "smb", "hml"), "FF5": ("mkt_rf", "smb", "hml", "rmw", "cma"), "q-factor": ("r_mkt", "r_me", "r_ia", "r_roe", "r_eg")}


#: Windows whose sums are made together; bounds a task's memory.
WINDOW_BLOCK = 1024


def rolling_hac(x: np.ndarray, y: np.ndarray, window: int, lags: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hac_ols`` of every full window, a row each: coefficients, t and p. Leading axes are histories of one length.

    A window's sums are differences of running sums, so it costs the factors and not
    its length. Scores are x (y - x b) and so quadratic in b: their lagged products follow from running sums of the
    products of x and (x, y) with those ``k`` rows before. Windows of few rows for
    their factors are refitted: their residuals are so small that sums would leave few of their digits.
    """
    p, count = x.shape[-1], y.shape[-1] - window + 1
    out = [np.empty((*y.shape[:-1], max(count, 0), p)) for _ in range(3)]
    if window < 3 * p:
        for *h, i in np.ndindex(*y.shape[:-1], max(count, 0)):
            rows = (*h, slice(i, i + window))
            out[0][*h, i], out[1][*h, i], out[2][*h, i] = hac_ols(x[rows], y[rows], lags)
        return out[0], out[1], out[2]
    for at in range(0, count, WINDOW_BLOCK):
        upto = min(count, at + WINDOW_BLOCK)
        xs, z = x[..., at : upto + window - 1, :], np.concatenate([x, y[..., None]], axis=-1)[..., at : upto + window - 1, :]
        first = np.arange(upto - at)

        def sums(each: np.ndarray, axis: int, skip: int = 0, first: np.ndarray = first) -> np.ndarray:
            """Of each window, over all its rows but the first ``skip``; ``each`` begins at row ``skip``."""
            each = np.moveaxis(each, axis, 0)
            run = np.concatenate([np.zeros((1, *each.shape[1:])), each.cumsum(axis=0)])
            return np.moveaxis(run[first + window - skip] - run[first], 0, axis)

        inverse = np.linalg.pinv(sums(xs[..., :, None] * xs[..., None, :], -3), hermitian=True)
        beta = np.einsum("...ij,...j->...i", inverse, sums(xs * z[..., -1:], -2))
        turn = np.concatenate([-beta, np.ones((*beta.shape[:-1], 1))], axis=-1)
        crossed = xs[..., :, None] * z[..., None, :]  # a row's score is this times (-b, 1)
        rows, s = crossed.shape[-3], np.zeros((*beta.shape, p))
        for k in range(min(lags, window - 1) + 1):
            products = sums(np.einsum("...ia,...jb->...iajb", crossed[..., k:, :, :], crossed[..., : rows - k, :, :]), -5, k)
            g = np.einsum("...iajb,...a,...b->...ij", products, turn, turn)
            s += g if k == 0 else (1 - k / (lags + 1)) * (g + np.swapaxes(g, -1, -2))
        spread = np.einsum("...ij,...jk,...ki->...i", inverse, s, inverse)
        t = beta / np.sqrt(np.maximum(spread, 1e-300))
        out[0][..., at:upto, :], out[1][..., at:upto, :] = beta, t
        out[2][..., at:upto, :] = np.vectorize(math.erfc, otypes=[float])(np.abs(t) / math.sqrt(2))
    return out[0], out[1], out[2]


#: Rows of entities that are regressed together; bounds a task's memory, but for the longest history.
ROWS = 1 << 16
#: Entities whose results are returned together.
KEYS = 256


def rolling_hac_many(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, window: int, lags: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rolling_hac`` of histories that follow one another, of ``sizes`` rows: all their full windows in order.

    Histories of one length are stacked, so the running sums are each history's own.
    """
    counts, p = np.maximum(sizes - window + 1, 0), x.shape[1]
    first, start = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    out = [np.empty((counts.sum(), p)) for _ in range(3)]
    for size in np.unique(sizes[counts > 0]):
        there = np.flatnonzero(sizes == size)
        for part in np.array_split(there, max(1, -(-len(there) * int(size) // ROWS))):
            rows, at = first[part, None] + np.arange(size), start[part, None] + np.arange(size - window + 1)
            for o, got in zip(out, rolling_hac(x[rows], y[rows], window, lags), strict=True):
                o[at] = got
    return out[0], out[1], out[2]


def rolling_factor_arrays(df: DataFrame, keys: list[str], y: str, factors: list[str], window: int, lags: int = 3, ax: Axis = AX) -> DataFrame:
    """``rolling_factor_regression`` with a row for each key and time: arrays of coefficients, t and p, of the constant first.

    A task takes histories as lists, many at once.
    """
    kinds = {f.name: f for f in df.schema.fields}
    values = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[kinds[k] for k in (*keys, ax.time)], *[T.StructField(c, values) for c in ("coefficient", "t", "p")]])
    columns = [y, *factors]
    full = df.select(*keys, ax.time, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"__{i}") for i, c in enumerate(columns)])
    full = full.dropna(subset=[f"__{i}" for i in range(len(columns))])
    row = F.struct(F.col(ax.time).alias("time"), *[f"__{i}" for i in range(len(columns))])
    listed = full.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("__rows")).filter(F.size("__rows") >= window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch["__rows"]).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            for low in range(0, len(sizes), KEYS):  # of one batch, so that what is returned stays small
                part = slice(low, min(low + KEYS, len(sizes)))
                rows = batch["__rows"].slice(low, KEYS).flatten()
                z = np.column_stack([rows.field(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))])
                own = sizes[part]
                found = rolling_hac_many(np.column_stack([np.ones(len(z)), z[:, 1:]]), z[:, 0], own, window, lags)
                counts = own - window + 1
                shift = np.repeat(ends[part] - own - (ends[low] - sizes[low]) + window - 1 - (np.cumsum(counts) - counts), counts)
                at = pa.array(shift + np.arange(counts.sum()))
                key = pa.array(low + np.repeat(np.arange(len(own)), counts))
                width = len(columns)
                lists = [pa.ListArray.from_arrays(np.arange(0, f.size + 1, width, dtype=np.int32), pa.array(f.ravel())) for f in found]
                yield pa.RecordBatch.from_arrays([*[batch[k].take(key) for k in keys], rows.field(0).take(at), *lists], names=schema.names)

    return listed.mapInArrow(run, schema)


def rolling_factor_regression(df: DataFrame, keys: list[str], y: str, factors: list[str], window: int, lags: int = 3, ax: Axis = AX) -> DataFrame:
    """Per key and time the regression on factors over the last ``window`` rows: term, coefficient, t and p; full windows only.

    Rows with a missing value are left out, so a window spans them.
    """
    each = rolling_factor_arrays(df, keys, y, factors, window, lags, ax)
    terms = F.array(*[F.lit(t) for t in ("alpha", *factors)])
    return each.select(*keys, ax.time, F.inline(F.arrays_zip(terms.alias("term"), "coefficient", "t", "p")))


def factor_alpha(df: DataFrame, keys: list[str], r: str, model: str = "FF3", momentum: bool = False, rf: str = "rf", window: int | None = None, lags: int = 3, ax: Axis = AX) -> DataFrame:
    """Regression of the excess return on the factors of a model by name, over all rows or rolling windows of them."""
    factors = [*MODELS[model], *["mom"] * momentum]
    excess = df.withColumn("__excess", F.col(r) - F.col(rf))
    if window:
        return rolling_factor_regression(excess, keys, "__excess", factors, window, lags, ax)
    return factor_regression(excess, keys, "__excess", factors, lags, ax)


def fama_macbeth(df: DataFrame, y: str, xs: list[str], bandwidth: int = 5, keys: list[str] | None = None, ax: Axis = AX) -> DataFrame:
    """Mean of per-time cross-section coefficients with Bartlett-kernel t statistics.

    Each time's moments (X'X, X'y) are sums; only those small matrices are solved in Python.
    """
    keys = keys or []
    terms = ["const", *xs]
    full = df.filter(" and ".join(f"{c} is not null" for c in [y, *xs]))
    value = {"const": F.lit(1.0), **{c: F.col(c).cast("double") for c in [*xs, y]}}
    cells = [(a, b) for i, a in enumerate(terms) for b in terms[i:]]
    sums = [F.sum(value[a] * value[b]).alias(f"m{i}") for i, (a, b) in enumerate(cells)] + [F.sum(value[a] * value[y]).alias(f"v{i}") for i, a in enumerate(terms)]
    moments = full.groupBy(*keys, ax.time).agg(F.count("*").alias("n"), *sums).filter(F.col("n") > len(terms))
    kinds = dict(df.dtypes)
    prefix = "".join(f"{k} {kinds[k]}, " for k in keys)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                m = np.zeros((len(terms),) * 2)
                for i, (a, b) in enumerate(cells):
                    m[terms.index(a), terms.index(b)] = m[terms.index(b), terms.index(a)] = getattr(r, f"m{i}")
                beta = np.linalg.pinv(m) @ np.array([getattr(r, f"v{i}") for i in range(len(terms))])
                rows += [(*[getattr(r, k) for k in keys], getattr(r, ax.time), t, float(b)) for t, b in zip(terms, beta, strict=True)]
            yield pd.DataFrame(rows, columns=[*keys, ax.time, "term", "beta"])

    betas = moments.mapInPandas(solve, f"{prefix}{ax.time} {kinds[ax.time]}, term string, beta double")
    w = Window.partitionBy(*keys, "term")
    d = betas.withColumn("__d", F.col("beta") - F.avg("beta").over(w))
    order = w.orderBy(ax.time)
    d = d.select(*keys, "term", "beta", "__d", *[(F.col("__d") * F.lag("__d", k).over(order)).alias(f"g{k}") for k in range(1, bandwidth + 1)])
    variance = F.sum(F.col("__d") * F.col("__d")) + sum((2 * (1 - k / (bandwidth + 1)) * F.coalesce(F.sum(f"g{k}"), F.lit(0.0)) for k in range(1, bandwidth + 1)), F.lit(0.0))
    out = d.groupBy(*keys, "term").agg(F.avg("beta").alias("coefficient"), F.count("*").alias("n"), variance.alias("__v"))
    return out.select(*keys, "term", "coefficient", ratio(F.col("coefficient") * F.col("n"), F.sqrt(F.greatest("__v", F.lit(0.0)))).alias("t"), "n")


def clean_factors(df: DataFrame, date: str, values: list[str], digits: int) -> DataFrame:
    """Factor rows of one frequency: missing codes dropped, percent to fractions."""
    ok = F.length(F.trim(F.col(date))) == digits
    for v in values:
        ok = ok & ~F.col(v).isin(-99.99, -999.0)
    return df.filter(ok).select(F.trim(F.col(date)).alias(date), *[(F.col(v) / 100).alias(v) for v in values])


def q_factor_key(year: Column, part: Column, width: int = 2) -> Column:
    return F.concat(year.cast("string"), F.lpad(part.cast("string"), width, "0"))


def breakpoints(df: DataFrame, value: str, shares: list[float], ax: Axis = AX) -> DataFrame:
    """Percentile breakpoints of each time, in millions. (``sections.breakpoints`` for times of any size.)"""
    edges = df.groupBy(ax.time).agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("q"))
    return edges.select(ax.time, *[(F.col("q")[i] * 1e6).alias(f"p{int(100 * s)}") for i, s in enumerate(shares)])


def linear_regression(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Pooled least squares by Spark ML: one row per term, with RMSE and R squared."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    full = df.select(y, *xs).dropna()
    model = LinearRegression(featuresCol="__x", labelCol=y, solver="normal").fit(VectorAssembler(inputCols=xs, outputCol="__x").transform(full))
    rows = [("const", float(model.intercept)), *zip(xs, map(float, model.coefficients), strict=True)]
    return df.sparkSession.createDataFrame([(t, c, float(model.summary.rootMeanSquaredError), float(model.summary.r2)) for t, c in rows], "term string, coefficient double, rmse double, r2 double")


def stars(p: float) -> str:
    return "*" * sum(p <= x for x in (0.1, 0.05, 0.01)) if not math.isnan(p) else ""
