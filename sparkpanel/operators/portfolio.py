"""Quantile portfolios: sorts, long-short legs, costs, statistics and allocation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..panel import Axis, ratio
from .ranking import every_nth, ntile_rank

AX = Axis()
LONG_SHORT = "high_minus_low"


def aggregate(ranked: DataFrame, keys: list[str], r: str, weight: str | None = None, covariates: list[str] | None = None, members: bool = False, ax: Axis = AX) -> DataFrame:
    """Per key: weighted return, number of returns, means of covariates and, where asked for, the sorted ``members``.

    A null return is left out of the numerator, its weight stays in the denominator.
    The list of members grows with a bucket; what needs only their changes takes ``members_that_left``.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    return ranked.groupBy(*keys).agg(
        ratio(F.sum(F.col(r) * w), F.sum(w)).alias("r"),
        *([F.sort_array(F.collect_list(F.col(ax.name).cast("string"))).alias("members")] if members else []),
        F.count(r).alias("n_assets"),
        *[F.avg(c).alias(c) for c in covariates or []],
    )


def long_short(ports: DataFrame, keys: list[str], n: int, rank: str = "sig_rank") -> DataFrame:
    """The top bucket's return less the bottom's, where both are there: conditional sums, no self-join."""
    high, low = F.col(rank) == n, F.col(rank) == 1
    legs = ports.groupBy(*keys).agg(
        F.max(F.when(high, F.col("r"))).alias("__h"), F.max(F.when(low, F.col("r"))).alias("__l"),
        F.sum(F.when(high | low, F.col("n_assets"))).alias("n_assets"), F.count(F.when(high, 1)).alias("__nh"), F.count(F.when(low, 1)).alias("__nl"),
    )
    return legs.filter("__nh > 0 and __nl > 0").select(*keys, F.lit(LONG_SHORT).alias(rank), (F.col("__h") - F.col("__l")).alias("r"), "n_assets")


def ranked_rows(df: DataFrame, signal: str, n: int, condition: str | None = None, n_condition: int = 0, dependent: bool = False, ax: Axis = AX) -> DataFrame:
    """Rows that have a signal (and condition; neither null nor NaN) with their buckets: sig_rank, and cond_rank in double sorts."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    clean = df.filter(known(signal))
    by = []
    if condition:
        clean = clean.filter(known(condition)).withColumn("cond_rank", ntile_rank(condition, n_condition, ax=ax))
        by = ["cond_rank"]
    return clean.withColumn("sig_rank", ntile_rank(signal, n, *(by if dependent else []), ax=ax))


def sort_portfolios(df: DataFrame, signal: str, r: str, n: int, weight: str | None = None, condition: str | None = None, n_condition: int = 0,
                    dependent: bool = False, shift: int = 1, covariates: list[str] | None = None, members: bool = False, ax: Axis = AX) -> DataFrame:
    """Single, independent or dependent double sort with long-short rows and returns ``shift`` times later (port_r).

    Rows without a signal or condition (null or NaN) are dropped first. Double sorts carry cond_rank; ``members`` lists each bucket's names.
    """
    by = ["cond_rank"] if condition else []
    ranked = ranked_rows(df, signal, n, condition, n_condition, dependent, ax)
    ports = aggregate(ranked, [ax.time, "sig_rank", *by], r, weight, covariates, members, ax)
    both = ports.withColumn("sig_rank", F.col("sig_rank").cast("string")).unionByName(long_short(ports, [ax.time, *by], n), allowMissingColumns=True)
    later = F.lag("r", shift).over(Window.partitionBy("sig_rank", *by).orderBy(ax.time))
    return both.withColumn("port_r", later)


def trading_cost(n_assets, turnover: float, commission: float, position) -> Column:
    return ratio(2 * F.col(n_assets) * turnover * commission, F.col(position))


def sort_return(ports: DataFrame, days: int = 1, per_year: float = 252.0, r: str = "port_r", keys: tuple[str, ...] = ("sig_rank",), average_over: str | None = None, covariates: tuple[str, ...] = (), cost: str | None = None, ax: Axis = AX) -> DataFrame:
    """Per rank: mean, t statistic, p-value, annual Sharpe ratio and return, and means of the number of assets and covariates, of every ``days``-th row.

    ``average_over``, one of the keys (the second rank), is averaged out at each
    time first; ``cost`` is a column that the return is taken net of.
    """
    rows = ports.filter(F.col(r).isNotNull()).withColumn("__r", F.col(r) - F.col(cost) if cost else F.col(r))
    if average_over:
        keys = tuple(k for k in keys if k != average_over)
        rows = rows.groupBy(ax.time, *keys).agg(*[F.avg(c).alias(c) for c in ("__r", "n_assets", *covariates)])
    rows = every_nth(rows, list(keys), ax.time, days)
    stats = rows.groupBy(*keys).agg(F.avg("__r").alias("mean"), F.stddev_samp("__r").alias("std"), F.count("__r").alias("n"), F.avg("n_assets").alias("n_assets"), *[F.avg(c).alias(f"{c}_mean") for c in covariates])
    scale = per_year / days
    t = ratio(F.col("mean") * F.sqrt("n"), F.col("std"))
    return stats.select(
        *keys, "mean", t.alias("t"), t_pvalue(t, F.col("n") - 1).alias("p"), (ratio("mean", "std") * math.sqrt(scale)).alias("sharpe"),
        (F.pow(1 + F.col("mean"), scale) - 1).alias("annual"), "n", "n_assets", *[f"{c}_mean" for c in covariates],
    )


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    total = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def t_pvalue(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of a t statistic; an Arrow UDF over a handful of result rows."""

    @F.pandas_udf(T.DoubleType())
    def p(t, n):
        import pandas as pd

        return pd.Series([None if pd.isna(x) or not k > 0 else incomplete_beta(k / 2, 0.5, k / (k + x * x)) for x, k in zip(t, n, strict=True)], dtype="float64")

    return p(t, freedom.cast("double"))


def members_that_left(ranked: DataFrame, keys: list[str], ax: Axis = AX) -> DataFrame:
    """(keys, time, name): names of a bucket at its time before that are not in it at this time.

    A row a name and bucket, and a look at the name's next time there: no column grows with a bucket.
    """
    at, named = Window.partitionBy(*keys).orderBy(ax.time), Window.partitionBy(*keys, ax.name).orderBy(ax.time)
    times = ranked.select(*keys, ax.time).distinct().withColumn("__next", F.lead(ax.time).over(at))  # the calendar of each bucket
    seen = ranked.select(*keys, ax.name, ax.time).distinct().withColumn("__seen", F.lead(ax.time).over(named))
    left = seen.join(times, [*keys, ax.time]).filter(F.col("__next").isNotNull() & ~F.col("__next").eqNullSafe(F.col("__seen")))
    return left.select(*keys, F.col("__next").alias(ax.time), ax.name)


def turnover(ports: DataFrame, ranked: DataFrame, n: int, keys: tuple[str, ...] = (), single_trip: float = 0.001, ax: Axis = AX) -> DataFrame:
    """Share of each leg's previous members that left, and the long-short return net of their cost.

    ``ports`` and ``ranked`` are of one sort (``sort_portfolios`` and ``ranked_rows``).
    """
    bucket = ["sig_rank", *keys]
    legs = ranked.filter(F.col("sig_rank").isin(1, n)).select(*bucket, ax.name, ax.time)
    before = F.lag("__n").over(Window.partitionBy(*bucket).orderBy(ax.time))
    sizes = legs.groupBy(*bucket, ax.time).agg(F.count("*").alias("__n")).withColumn("__before", before)
    left = members_that_left(legs, bucket, ax).groupBy(*bucket, ax.time).agg(F.count("*").alias("__left"))
    gone = ratio(F.coalesce("__left", F.lit(0)).cast("double"), F.col("__before").cast("double"))
    each = sizes.join(left, [*bucket, ax.time], "left").withColumn("__gone", gone)
    moved = each.groupBy(ax.time, *keys).agg(F.max(F.when(F.col("sig_rank") == n, F.col("__gone"))).alias("turnover_high"), F.max(F.when(F.col("sig_rank") == 1, F.col("__gone"))).alias("turnover_low"))
    spread = ports.filter(F.col("sig_rank") == LONG_SHORT).select(ax.time, *keys, "r")
    cost = 2 * single_trip * (F.coalesce("turnover_high", F.lit(0.0)) + F.coalesce("turnover_low", F.lit(0.0)))
    return spread.join(moved, [ax.time, *keys]).withColumn("net_r", F.col("r") - cost)


PER_YEAR = {"D": 252, "W": 52, "M": 12, "Q": 4, "Y": 1}


def return_stats(df: DataFrame, keys: list[str], r: str = "r", frequency: str = "M", rf: str | None = None, ax: Axis = AX) -> DataFrame:
    """25 statistics of each return series; with ``rf`` the Sharpe and Sortino ratios are of excess returns."""
    m = PER_YEAR[frequency]
    df = df.filter(F.col(r).isNotNull()).withColumn("__x", F.col(r) - (F.col(rf) if rf else F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy(ax.time).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__w", F.product(1 + F.col(r)).over(w))
    df = df.withColumn("__dd", ratio("__w", F.max("__w").over(w)) - 1)
    cut = df.groupBy(*keys).agg(F.percentile(r, F.array(F.lit(0.05), F.lit(0.01))).alias("__q"))
    df = df.join(cut, keys)
    x, up, down = F.col(r), F.col(r) > 0, F.col(r) < 0
    s = df.groupBy(*keys).agg(
        F.avg(x).alias("average"), F.max(x).alias("max"), F.min(x).alias("min"), F.min("__dd").alias("max_drawdown"), F.stddev_samp(x).alias("volatility"),
        F.stddev_samp(F.when(down, x)).alias("downside"), F.first(F.col("__q")[0]).alias("var95"), F.first(F.col("__q")[1]).alias("var99"),
        F.avg(F.when(x <= F.col("__q")[0], x)).alias("es95"), F.avg(F.when(x <= F.col("__q")[1], x)).alias("es99"),
        F.product(1 + x).alias("__growth"), F.count(x).alias("n"), F.avg("__x").alias("__mean_x"), F.stddev_samp("__x").alias("__std_x"),
        F.avg(F.when(up, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.when(down, 1.0).otherwise(0.0)).alias("loss_rate"),
        F.sum(F.when(up, x)).alias("gross_profit"), F.sum(F.when(down, x)).alias("gross_loss"), F.avg(F.when(up, x)).alias("average_up"), F.avg(F.when(down, x)).alias("average_down"),
    )
    geometric = F.pow("__growth", ratio(F.lit(float(m)), F.col("n").cast("double"))) - 1
    drop = F.abs("max_drawdown")
    return s.select(
        *keys, "average", "max", "min", "max_drawdown", "volatility", "downside", "var95", "var99", "es95", "es99",
        (F.col("average") * m).alias("annual_average"), geometric.alias("annual_geometric"), (F.col("volatility") * math.sqrt(m)).alias("annual_volatility"), (F.col("downside") * math.sqrt(m)).alias("annual_downside"),
        ratio("__mean_x", "__std_x").alias("sharpe"), ratio("average", "volatility").alias("naive_sharpe"), ratio("__mean_x", "downside").alias("sortino"), ratio(F.col("average"), drop).alias("calmar"),
        (ratio("__mean_x", "__std_x") * math.sqrt(m)).alias("annual_sharpe"), (ratio("__mean_x", "downside") * math.sqrt(m)).alias("annual_sortino"), ratio(F.col("average") * m, drop).alias("annual_calmar"),
        "hit_rate", "loss_rate", "gross_profit", "gross_loss", "average_up", "average_down",
        ratio(F.col("average_up"), F.abs("average_down")).alias("slugging"), ratio(F.col("gross_profit"), F.abs("gross_loss")).alias("profit_factor"),
    )


def wealth_curve(df: DataFrame, keys: list[str], r: str = "r", ax: Axis = AX) -> DataFrame:
    """Wealth and drawdown of each series over time; null returns count as none."""
    w = Window.partitionBy(*keys).orderBy(ax.time).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("wealth", F.product(1 + F.coalesce(r, F.lit(0.0))).over(w))
    return out.withColumn("drawdown", ratio("wealth", F.max("wealth").over(w)) - 1)


def allocate_leveraged(df: DataFrame, r: str, leverage: float, target: float, deviation: float, ax: Axis = AX) -> DataFrame:
    """Weight of a leveraged asset that drifts with returns and is reset to target when it strays by deviation.

    Each weight follows from the one before, so an entity's history is walked in
    order, entities in parallel, in time linear in the rows.
    """
    import pandas as pd

    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ax.time)
        w, weights = None, []
        for x in pdf["__r"]:
            if w is not None:
                grown = w * (1 + leverage * x)
                w = grown / (grown + 1 - w)
            w = target if w is None or abs(w - target) >= deviation else w
            weights.append(w)
        return pdf.assign(weight=weights, port_r=leverage * pdf["__r"].to_numpy() * weights)[[ax.name, ax.time, "weight", "port_r"]]

    rows = df.select(ax.name, ax.time, F.coalesce(F.col(r).cast("double"), F.lit(0.0)).alias("__r"))
    return rows.groupBy(ax.name).applyInPandas(run, f"{ax.name} {kinds[ax.name]}, {ax.time} {kinds[ax.time]}, weight double, port_r double")


def factor_sweep(df: DataFrame, signals: list[str], forwards: list[str], n: int, ax: Axis = AX) -> DataFrame:
    """Mean and t statistic of every signal x forward return x rank, in one pass over long data."""
    long = df.unpivot([ax.time, ax.name, *forwards], signals, "sig", "value").filter("value is not null")
    keys = [ax.time, "sig"]
    rank = F.ntile(n).over(Window.partitionBy(*keys).orderBy("value", ax.name))
    both = long.withColumn("rank", rank).unpivot([ax.time, "sig", "rank"], forwards, "forward", "r")
    ports = both.groupBy(ax.time, "sig", "forward", "rank").agg(F.avg("r").alias("r"))
    spread = ports.groupBy(ax.time, "sig", "forward").agg((F.max(F.when(F.col("rank") == n, F.col("r"))) - F.max(F.when(F.col("rank") == 1, F.col("r")))).alias("r")).withColumn("rank", F.lit(0))
    stats = ports.unionByName(spread).groupBy("sig", "forward", "rank").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("r").alias("n"))
    return stats.select("sig", "forward", "rank", "mean", ratio(F.col("mean") * F.sqrt("n"), F.col("std")).alias("t"), "n")


def significant_sorts(stats: DataFrame, least_mean: float, most_p: float | None = None, least_t: float | None = None, rank: str = "sig_rank") -> DataFrame:
    """Long-short rows of a mean return of at least least_mean either way, by p-value or t statistic, smallest mean first."""
    sure = F.lit(True)
    if most_p is not None:
        sure = sure & (F.col("p") <= most_p)
    if least_t is not None:
        sure = sure & (F.abs("t") >= least_t)
    return stats.filter((F.col(rank) == LONG_SHORT) & (F.abs("mean") > least_mean) & sure).orderBy("mean")


def parameter_sweep(grid: dict[str, list], objective, metric: str) -> DataFrame:
    """The objective (a function of one value for each parameter, to a table of one row) over the grid, best metric first: one plan."""
    from itertools import product

    parts = []
    for values in product(*grid.values()):
        point = dict(zip(grid, values, strict=True))
        parts.append(objective(**point).withColumns({k: F.lit(v) for k, v in point.items()}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(F.desc(metric))
