"""Rolling and cumulative features of one entity's history, as window expressions.

Each function gives a Column; columns that share a window are computed in one
pass when they are selected together (``features``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Axis, log_growth, ratio

AX = Axis()


def features(df: DataFrame, **columns: Column) -> DataFrame:
    """df with all columns added in one projection."""
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def full_window_filter(df: DataFrame, start: int, end: int, ax: Axis = AX) -> DataFrame:
    """Rows whose frame is complete."""
    n = F.count(ax.time).over(ax.rows(start, end))
    return df.withColumn("__n", n).filter(F.col("__n") >= end - start + 1).drop("__n")


def rolling_sum(value, start, end, ax=AX) -> Column:
    return F.sum(value).over(ax.rows(start, end))


def rolling_mean(value, start, end, ax=AX) -> Column:
    return F.avg(value).over(ax.rows(start, end))


def rolling_std(value, start, end, ax=AX) -> Column:
    return F.stddev_samp(value).over(ax.rows(start, end))


def rolling_skewness(value, start, end, ax=AX) -> Column:
    return F.skewness(value).over(ax.rows(start, end))


def rolling_kurtosis(value, start, end, ax=AX) -> Column:
    return F.kurtosis(value).over(ax.rows(start, end))


def rolling_rsd(value, start, end, ax=AX) -> Column:
    return ratio(rolling_std(value, start, end, ax), rolling_mean(value, start, end, ax))


def rolling_zscore(value, start, end, ax=AX) -> Column:
    return ratio(F.col(value) - rolling_mean(value, start, end, ax), rolling_std(value, start, end, ax))


def time_series_ratio(value, start, end, ax=AX) -> Column:
    return ratio(F.col(value), rolling_mean(value, start, end, ax))


def change(value, lag=1, pct=False, ax=AX) -> Column:
    before = F.lag(value, lag).over(ax.history())
    return ratio(F.col(value) - before, before) if pct else F.col(value) - before


def autocorrelation(value, lagged: str, ax=AX) -> Column:
    """Correlation of a value with an already lagged column over the entity's history."""
    return F.corr(value, lagged).over(ax.entity())


def section_zscore(value, ax=AX) -> Column:
    w = ax.section()
    return ratio(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))


def every_nth_row(df: DataFrame, nth: int, ax: Axis = AX) -> DataFrame:
    """Rows whose 1-based number within the entity is a multiple of nth."""
    return df.withColumn("__n", F.row_number().over(ax.history())).filter(F.col("__n") % nth == 0).drop("__n")


def wealth(r, start, end, ax=AX) -> Column:
    return F.exp(F.sum(log_growth(r)).over(ax.rows(start, end)))


def cumulative_return(r, start, end, ax=AX) -> Column:
    return wealth(r, start, end, ax) - 1


def contract_return(price, fee=0.0, lag=1, ax=AX) -> Column:
    """Return of a contract on 100 units, less a fee on both sides."""
    before = 100 * F.lag(price, lag).over(ax.history())
    return ratio(100 * F.col(price) - before - 2 * fee, before)


def comovement(r, market, start, end, which="same", ax=AX) -> Column:
    """Share of frame rows where both go the same way, both up, or both down; null counts as no."""
    test = {
        "same": F.signum(r) == F.signum(market),
        "up": (F.col(r) > 0) & (F.col(market) > 0),
        "down": (F.col(r) < 0) & (F.col(market) < 0),
    }[which]
    return F.avg(F.when(test, 1.0).otherwise(0.0)).over(ax.rows(start, end))


def rolling_correlation(r, market, start, end, ax=AX) -> Column:
    return F.corr(r, market).over(ax.rows(start, end))


def rolling_beta(r, market, start, end, ax=AX) -> Column:
    return F.regr_slope(r, market).over(ax.rows(start, end))


def rolling_max(value, start, end, ax=AX) -> Column:
    return F.max(value).over(ax.rows(start, end))


def rolling_min(value, start, end, ax=AX) -> Column:
    return F.min(value).over(ax.rows(start, end))


def one_sided(r, up: bool) -> Column:
    """The return on its side of zero, 0 on the other."""
    side = F.col(r) > 0 if up else F.col(r) < 0
    return F.col(r) * F.when(side, 1.0).otherwise(0.0)


def drawdown(df: DataFrame, r: str, name: str = "drawdown", ax: Axis = AX) -> DataFrame:
    """Cumulative wealth over its running maximum, less one."""
    out = df.withColumn("__w", wealth(r, None, 0, ax))
    return out.withColumn(name, ratio(F.col("__w"), rolling_max("__w", None, 0, ax)) - 1).drop("__w")


def consecutive(df: DataFrame, r: str, name: str = "run", ax: Axis = AX) -> DataFrame:
    """Signed length so far of the run of returns of one sign (zero is positive)."""
    up = F.when(F.col(r) >= 0, 1).otherwise(-1)
    out = df.withColumn("__up", up)
    out = out.withColumn("__new", F.when(F.col("__up") == F.lag("__up").over(ax.history()), 0).otherwise(1))
    out = out.withColumn("__run", F.sum("__new").over(ax.rows(None, 0)))
    w = Window.partitionBy(ax.name, "__run").orderBy(ax.time)
    return out.withColumn(name, F.row_number().over(w) * F.col("__up")).drop("__up", "__new", "__run")


def new_high_low(df: DataFrame, r: str, name: str = "extreme", ax: Axis = AX) -> DataFrame:
    """1 where the cumulative return is at its running maximum, -1 at its minimum, 0 between."""
    out = df.withColumn("__c", cumulative_return(r, None, 0, ax))
    high, low = rolling_max("__c", None, 0, ax), rolling_min("__c", None, 0, ax)
    return out.withColumn(name, F.when(F.col("__c") >= high, 1).when(F.col("__c") <= low, -1).otherwise(0)).drop("__c")


def drawdown_speed(df: DataFrame, r: str, name: str = "speed", ax: Axis = AX) -> DataFrame:
    """Drawdown over the number of rows since the running maximum; null at the maximum."""
    out = drawdown(df, r, "__d", ax).withColumn("__i", F.row_number().over(ax.history()))
    out = out.withColumn("__top", F.last(F.when(F.col("__d") == 0, F.col("__i")), ignorenulls=True).over(ax.rows(None, 0)))
    return out.withColumn(name, ratio(F.col("__d"), (F.col("__i") - F.col("__top")).cast("double"))).drop("__d", "__i", "__top")


def forward_return(r, start, end, ax=AX) -> Column:
    return cumulative_return(r, start, end, ax)


def signal_variations(df: DataFrame, signals: list[str], lookbacks: list[int], lag: int = 1, ax: Axis = AX) -> DataFrame:
    """Per signal: difference, rolling means and crossovers, all in one projection."""
    columns = {}
    for s in signals:
        columns[f"diff_{s}"] = change(s, lag, ax=ax)
        for k in lookbacks:
            mean = rolling_mean(s, -k + 1, 0, ax)
            columns[f"avg_{s}_{k}"] = mean
            columns[f"crossover_{s}_{k}"] = ratio(F.col(s), mean)
    return features(df, **columns)


def forward_fill(value, ax=AX) -> Column:
    return F.last(value, ignorenulls=True).over(ax.rows(None, 0))


def rolling_ecdf(value, n, ax=AX) -> Column:
    """Share of the last n values that don't exceed the present one, for short windows; ``windows.rolling_ecdf`` is for long ones."""
    seen = F.collect_list(value).over(ax.rows(-n + 1, 0))
    return F.size(F.filter(seen, lambda x: x <= F.col(value))) / F.lit(float(n))


def rolling_ols(y, x, window, constant=True, ax=AX) -> Column:
    """Slope of y on x in full windows."""
    w = ax.rows(-window + 1, 0)
    full = F.count(F.col(y) * F.col(x)).over(w) >= window
    slope = F.regr_slope(y, x).over(w) if constant else ratio(F.sum(F.col(y) * F.col(x)).over(w), F.sum(F.col(x) * F.col(x)).over(w))
    return F.when(full, slope)


def section_weight(value, ax=AX) -> Column:
    """Inverse-value weights within a time."""
    inverse = ratio(F.lit(1.0), F.col(value))
    return ratio(inverse, F.sum(inverse).over(ax.section()))
