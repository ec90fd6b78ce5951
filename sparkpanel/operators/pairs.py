"""Pairs trading on long tables keyed by pair and time."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..panel import ratio

KEYS = ["x", "y"]


def rows(start: int | None, end: int = 0, keys: list[str] = KEYS):
    return history(keys).rowsBetween(Window.unboundedPreceding if start is None else start, end)


def history(keys: list[str] = KEYS):
    return Window.partitionBy(*keys).orderBy("date")


def hedge_ratio(method: str, window: int = 12, constant: bool = True, keys: list[str] = KEYS) -> Column:
    """Constant 1, or the slope of p_y on p_x in full windows, with or without a constant."""
    if method == "1":
        return F.lit(1.0)
    w = rows(-window + 1, keys=keys)
    slope = F.regr_slope("p_y", "p_x").over(w) if constant else ratio(F.sum(F.col("p_y") * F.col("p_x")).over(w), F.sum(F.col("p_x") * F.col("p_x")).over(w))
    return F.when(F.count("*").over(w) >= window, slope)


def kalman_hedge(df: DataFrame, state_cov: float = 1e-4, noise: float = 1e-2, constant: bool = False, state_mean: float = 0.0, drift: float | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Hedge ratio by a Kalman filter with a random-walk state: sequential within a pair, parallel over pairs.

    The state is the ratio, with a constant (constant, ratio); it starts at
    state_mean with the covariance state_cov in every cell and moves by drift
    (state_cov where none is given) a step.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y, n = pdf["p_y"].to_numpy(), 1 + constant
        x = np.column_stack([*[np.ones(len(pdf))] * constant, pdf["p_x"].to_numpy()])
        state, cov, out = np.full(n, state_mean), np.full((n, n), state_cov), np.empty(len(pdf))
        step = np.eye(n) * (state_cov if drift is None else drift)
        for i, row in enumerate(x):
            cov = cov + step * (i > 0)
            gain = cov @ row / (row @ cov @ row + noise)
            state = state + gain * (y[i] - row @ state)
            cov = cov - np.outer(gain, row) @ cov
            out[i] = state[-1]
        return pdf.assign(hr=out)

    schema = df.withColumn("hr", F.lit(0.0)).schema
    return df.groupBy(*keys).applyInPandas(run, schema)


def spread(position: float | None = None, digits: int = 0) -> Column:
    """p_y - hr * p_x; with a position, the ratio of whole shares (half-even rounding)."""
    if position is None:
        return F.col("p_y") - F.col("hr") * F.col("p_x")
    n = F.bround(ratio(F.lit(position), F.col("p_y")), digits)
    return F.col("p_y") - ratio(F.bround(n * F.col("hr"), digits), n) * F.col("p_x")


def spread_zscore(window: int = 12, keys: list[str] = KEYS) -> Column:
    w = rows(-window + 1, keys=keys)
    return F.when(F.count("spread").over(w) >= window, ratio(F.col("spread") - F.avg("spread").over(w), F.stddev_samp("spread").over(w)))


def spread_ecdf(window: int = 12, keys: list[str] = KEYS) -> Column:
    """Share of the full window's spreads that don't exceed the present one."""
    w = rows(-window + 1, keys=keys)
    seen = F.collect_list("spread").over(w)
    return F.when(F.count("spread").over(w) >= window, F.size(F.filter(seen, lambda v: v <= F.col("spread"))) / F.lit(float(window)))


def positions(df: DataFrame, enter: float, leave: float, signal: str = "zscore", keys: list[str] = KEYS) -> DataFrame:
    """long and short legs of the spread by threshold crossings, carried forward; 0 before the first.

    A z-score enters long below -enter and short above enter; an ecdf signal
    enters long below enter and short above 1 - enter. The later assignment of
    the same row wins: long closes on a short entry or its exit, then opens;
    short closes on a long entry or its exit, then opens.
    """
    s, before = F.col("signal"), F.lag("signal").over(history(keys))
    low, high = ((-enter, -leave), (enter, leave)) if signal == "zscore" else ((enter, leave), (1 - enter, 1 - leave))
    crossed = lambda up, level: F.coalesce((s > level) & (before <= level) if up else (s < level) & (before >= level), F.lit(False))
    df = df.withColumns({"__up": crossed(True, high[0]), "__down": crossed(False, low[0]), "__end_long": crossed(True, low[1]), "__end_short": crossed(False, high[1])})
    long = F.when(F.col("__down"), 1).when(F.col("__end_long") | F.col("__up"), 0)
    short = F.when(F.col("__up"), -1).when(F.col("__end_short") | F.col("__down"), 0)
    df = df.withColumns({"__l": long, "__s": short})
    w = rows(None, keys=keys)
    out = df.withColumns({"long": F.coalesce(F.last("__l", ignorenulls=True).over(w), F.lit(0)), "short": F.coalesce(F.last("__s", ignorenulls=True).over(w), F.lit(0))})
    return out.withColumn("position", F.col("long") + F.col("short")).drop("__up", "__down", "__end_long", "__end_short", "__l", "__s")


def pair_return(df: DataFrame, rebalance: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Spread change over the price of the bought leg, in the position held before; 0 when flat.

    The ratio is that of entry or, with ``rebalance``, that of the row before.
    """
    h = history(keys)
    df = df.withColumn("__held", F.coalesce(F.lag("position").over(h), F.lit(0)))
    fresh = F.when((F.col("position") != 0) & (F.col("position") != F.col("__held")), F.col("hr"))
    df = df.withColumn("__ratio", F.lag("hr").over(h) if rebalance else F.last(fresh, ignorenulls=True).over(rows(None, -1, keys)))
    d = lambda c: F.col(c) - F.lag(c).over(h)
    move = d("p_y") - F.col("__ratio") * d("p_x")
    bought = F.when(F.col("__held") > 0, F.lag("p_y").over(h)).otherwise(F.lag("p_x").over(h) * F.abs("__ratio"))
    return df.withColumn("r", F.when(F.col("__held") == 0, 0.0).otherwise(F.coalesce(ratio(F.col("__held") * move, bought), F.lit(0.0)))).drop("__held", "__ratio")


def backtest(df: DataFrame, hedge: str = "OLS", window: int = 12, constant: bool = True, signal: str = "zscore", signal_window: int = 12, enter: float = 1.5, leave: float = 0.5, rebalance: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Pair rows (p_x, p_y) with hr, spread, signal, positions and r; hedge is 1, OLS or KF, signal zscore or ecdf."""
    df = kalman_hedge(df, constant=constant, keys=keys) if hedge == "KF" else df.withColumn("hr", hedge_ratio(hedge, window, constant, keys))
    df = df.withColumn("spread", spread())
    made = spread_zscore(signal_window, keys) if signal == "zscore" else spread_ecdf(signal_window, keys)
    return pair_return(positions(df.withColumn("signal", made), enter, leave, signal, keys), rebalance, keys)


def pair_stats(df: DataFrame, per_year: float = 12.0, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg((ratio(F.avg("r"), F.stddev_samp("r")) * math.sqrt(per_year)).alias("sharpe"), (F.product(1 + F.col("r")) - 1).alias("cumr"))


def half_life(df: DataFrame) -> DataFrame:
    """Months for half of the spread's deviation to vanish; null where it doesn't."""
    before = df.withColumn("__b", F.lag("spread").over(history())).withColumn("__d", F.col("spread") - F.col("__b"))
    beta = before.groupBy(*KEYS).agg(F.regr_slope("__d", "__b").alias("beta"))
    life = ratio(F.lit(-math.log(2)), F.col("beta"))
    return beta.select(*KEYS, F.when(F.floor(life) > 0, F.floor(life)).alias("half_life"))


def adf_statistic(series: np.ndarray, lags: int | None = None, constant: bool = True) -> float:
    """t statistic of the lagged level in an augmented Dickey-Fuller regression.

    Without a number of lags, 0 to ceil(12 (n / 100) ** (1/4)) of them (fewer in
    short series) are fitted on the sample that all share, and the one of the least
    AIC is fitted again on all its rows.
    """
    series = np.asarray(series, float)
    d, trend = np.diff(series), int(constant)
    if len(d) < 4 or np.ptp(series) == 0:
        return float("nan")

    def design(k: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
        """Level, constant and k lagged differences, without the first ``drop`` rows."""
        columns = [series[drop:-1], *[np.ones(len(d) - drop)] * trend, *[d[drop - i : len(d) - i] for i in range(1, k + 1)]]
        return np.column_stack(columns), d[drop:]

    if lags is None:
        most = min(len(series) // 2 - trend - 1, math.ceil(12 * (len(series) / 100) ** 0.25))
        if most < 0:
            return float("nan")
        x, y = design(most, most)
        aic = []
        for k in range(most + 1):
            e = y - x[:, : 1 + trend + k] @ np.linalg.lstsq(x[:, : 1 + trend + k], y, rcond=None)[0]
            aic.append(len(y) * math.log(max(e @ e / len(y), 1e-300)) + 2 * (1 + trend + k))
        lags = int(np.argmin(aic))
    if len(d) - lags <= 1 + trend + lags:
        return float("nan")
    x, y = design(lags, lags)
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    return float(beta[0] / math.sqrt(max(e @ e / (len(y) - x.shape[1]) * inverse[0, 0], 1e-300)))


#: MacKinnon's (1994) response surfaces with a constant, for one and two variables. Below TAU[1] the
#: p-value is that of SMALL's polynomial in the statistic on the normal scale, above it LARGE's; outside TAU[0] to TAU[2] it is 0 or 1.
TAU = {1: (-18.83, -1.61, 2.74), 2: (-18.86, -2.62, 0.92)}
SMALL = {1: (2.1659, 1.4412, 0.038269), 2: (2.92, 1.5012, 0.039796)}
LARGE = {1: (1.7339, 0.93202, -0.12745, -0.010368), 2: (2.1945, 0.64695, -0.29198, -0.042377)}


def approximate_p(statistic: float, variables: int) -> float:
    """p-value of a Dickey-Fuller statistic with constant, or of the residual of a regression of two variables."""
    if not math.isfinite(statistic):
        return float("nan")
    low, star, high = TAU[variables]
    if not low <= statistic <= high:
        return float(statistic > high)
    terms = SMALL[variables] if statistic <= star else LARGE[variables]
    return NormalDist().cdf(sum(c * statistic**i for i, c in enumerate(terms)))


def engle_granger(df: DataFrame, cutoff: float = 1.0, lags: int | None = None) -> DataFrame:
    """Cointegration statistic and p-value of each pair: least squares, then ADF of the residual (with ``lags`` differences, or as many as AIC asks for)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        a = np.column_stack([pdf["p_x"], np.ones(len(pdf))])
        e = pdf["p_y"].to_numpy() - a @ np.linalg.lstsq(a, pdf["p_y"].to_numpy(), rcond=None)[0]
        t = adf_statistic(e, lags, constant=False)  # the first regression has it
        return pd.DataFrame({"x": [pdf["x"].iloc[0]], "y": [pdf["y"].iloc[0]], "statistic": [t], "p": [approximate_p(t, 2)]})

    return df.groupBy(*KEYS).applyInPandas(run, "x string, y string, statistic double, p double").filter(F.col("p") <= cutoff).orderBy("p", "x", "y")


def adf_of(df: DataFrame, value: str, keys: list[str] = KEYS) -> DataFrame:
    """ADF statistic and p-value of each pair's series, or of each series with the same keys."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = adf_statistic(pdf.sort_values("date")[value].dropna().to_numpy())
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"statistic": [t], "p": [approximate_p(t, 1)]})

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", statistic double, p double")


def score(stats: DataFrame, weights: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Weighted sum of z-scores over all pairs, or over those with the same ``by``; the moments are one row, or one for each."""
    moments = stats.groupBy(*by or []).agg(*[f(F.when(~F.isnan(c), F.col(c))).alias(f"__{n}_{c}") for c in weights for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = sum((w * ratio(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c, w in weights.items()), F.lit(0.0))
    joined = stats.join(F.broadcast(moments), by) if by else stats.crossJoin(F.broadcast(moments))
    return joined.withColumn("score", z).drop(*[c for c in moments.columns if c.startswith("__")])


def walk_forward_windows(df: DataFrame, look_back: int, look_ahead: int) -> DataFrame:
    """Windows (window, start, cut, stop) of months from the first date on: train in [start, cut), trade in [cut, stop).

    The last window is the last whose cut doesn't pass the last date; it may be short.
    """
    ends = df.agg(F.trunc(F.min("date"), "month").alias("first"), F.max("date").alias("last"))
    month = lambda n: F.add_months("first", F.col("window") * look_ahead + n).cast("timestamp")
    each = ends.select("first", "last", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.months_between("last", "first") / look_ahead).cast("int")))).alias("window"))
    return each.select("window", month(0).alias("start"), month(look_back).alias("cut"), month(look_back + look_ahead).alias("stop"), "last").filter("cut <= last").drop("last")


def walk_forward_pairs(prices: DataFrame, look_back: int, look_ahead: int, n: int, weights: dict[str, float], warm_up: int = 0, **options) -> DataFrame:
    """window, date, mean return and number of pairs of the n pairs that score best in the months before each window.

    prices are pair rows (x, y, date, p_x, p_y). The backtest (``options`` of
    ``backtest``) starts anew in each training window, and in each trading window
    ``warm_up`` months before its cut, so nothing carries over from one window to
    the next. All windows and pairs are one job, keyed by window and pair.
    """
    windows = walk_forward_windows(prices, look_back, look_ahead)  # one row for each window of the calendar
    keys = ["window", *KEYS]
    begin = F.add_months("cut", -warm_up).cast("timestamp")

    def within(first: Column, last: Column) -> DataFrame:
        keyed = prices.join(F.broadcast(windows), (F.col("date") >= first) & (F.col("date") < last))
        return backtest(keyed, keys=keys, **options)

    train = within(F.col("start"), F.col("cut"))
    stats = pair_stats(train, keys=keys).join(adf_of(train.select(*keys, "date", "spread"), "spread", keys), keys)
    order = Window.partitionBy("window").orderBy(F.desc_nulls_last(F.when(~F.isnan("score"), F.col("score"))), "x", "y")
    best = score(stats, weights, ["window"]).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).select(*keys)
    trade = within(begin, F.col("stop")).filter(F.col("date") >= F.col("cut"))
    return trade.join(best, keys, "left_semi").groupBy("window", "date").agg(F.avg("r").alias("r"), F.count("*").alias("n"))


def greedy_disjoint(scored: DataFrame, n: int) -> DataFrame:
    """The pairs a scan by score would take, each name once: rounds of pairs that rank first for both members."""
    order = lambda k: Window.partitionBy(k).orderBy(F.desc("score"), "x", "y")
    left, taken = scored.filter("score is not null"), None
    while True:
        # every name's best open pair, whether the name is x or y
        named = left.withColumn("name", F.explode(F.array("x", "y")))
        best = named.withColumn("__n", F.row_number().over(order("name"))).filter("__n = 1")
        chosen = best.groupBy("x", "y", "score").count().filter("count = 2").select("x", "y", "score").checkpoint()
        if chosen.isEmpty():
            break
        taken = chosen if taken is None else taken.unionByName(chosen)
        used = chosen.select(F.explode(F.array("x", "y")).alias("name")).distinct()
        left = left.join(used.withColumnRenamed("name", "x"), "x", "left_anti").join(used.withColumnRenamed("name", "y"), "y", "left_anti").select("x", "y", "score").checkpoint()
    taken = scored.select("x", "y", "score").limit(0) if taken is None else taken
    return taken.orderBy(F.desc("score"), "x", "y").limit(n)
