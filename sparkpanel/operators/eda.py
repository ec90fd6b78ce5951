"""Data-quality summaries in long form, one row per column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..panel import ratio
from .quantiles import column_quantiles


def melt(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(column, value) rows of numeric columns as doubles."""
    return df.select(*(keep or []), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keep or [], columns, "column", "value")


def side_by_side(df: DataFrame, columns: list[str], **cells: Callable[[str], Column]) -> DataFrame:
    """One row a column with the aggregates ``cells`` of it, from one aggregate of all columns: only partial results are shuffled."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), *[made(c).alias(name) for name, made in cells.items()]) for c in columns])
    return wide.agg(each.alias("__e")).select(F.explode("__e").alias("__e")).select("__e.*")


def quantile_rows(df: DataFrame, columns: list[str], ps: list[float]) -> dict[str, list[float | None]]:
    """Quantiles by column, a few numbers each."""
    return {r.column: r.q for r in column_quantiles(df, columns, ps).collect()}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, median, std, skew and kurtosis (sample-adjusted), min and max."""
    n = F.col("count").cast("double")
    s = side_by_side(df, columns, count=F.count, mean=F.avg, std=F.stddev_samp, g1=F.skewness, g2=F.kurtosis, min=F.min, max=F.max)
    skew = F.col("g1") * ratio(F.sqrt(n * (n - 1)), n - 2)
    kurtosis = ratio((n - 1) * ((n + 1) * F.col("g2") + 6), (n - 2) * (n - 3))
    s = s.join(column_quantiles(df, columns, [0.5]).select("column", F.col("q")[0].alias("median")), "column", "left")  # a row for each column
    return s.select("column", "count", "mean", "median", "std", skew.alias("skew"), kurtosis.alias("kurtosis"), "min", "max")


def info(df: DataFrame, columns: list[str]) -> DataFrame:
    """Type, distinct count, share of zeros and of nulls."""
    kinds = dict(df.dtypes)
    kind = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    s = melt(df, columns).groupBy("column").agg(F.count_distinct("value").alias("distinct"), F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0)).alias("zero_share"), F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("null_share"))
    return s.select("column", kind[F.col("column")].alias("dtype"), "distinct", "zero_share", "null_share")


def histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Counts of equal-width bins from minimum to maximum; the last bin holds the maximum."""
    span = {r.column: (r.lo, r.hi) for r in side_by_side(df, columns, lo=F.min, hi=F.max).collect()}  # two numbers a column

    def at(c: str) -> Column:
        low, high = span[c]
        if low is None:
            return F.lit(None).cast("int")
        v = F.col(c).cast("double")
        share = F.floor((v - low) * bins / (high - low)) if high > low else F.lit(0)
        return F.when(v.isNotNull(), F.least(share, F.lit(bins - 1))).cast("int")

    binned = df.select(*[at(c).alias(c) for c in columns]).unpivot([], columns, "column", "bin")
    return binned.filter("bin is not null").groupBy("column", "bin").agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each value of each column, null among them, most first."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.groupBy("column", "value").agg(F.count("*").alias("n")).orderBy("column", F.desc("n"), "value")


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and number of outliers; columns without values don't appear."""
    q = {c: v for c, v in quantile_rows(df, columns, [0.25, 0.5, 0.75]).items() if v[0] is not None}

    def inside(c: str) -> Column:
        reach = 1.5 * (q[c][2] - q[c][0])
        return F.col(c).between(q[c][0] - reach, q[c][2] + reach)

    if not q:
        return df.sparkSession.createDataFrame([], "column string, q1 double, median double, q3 double, whisker_low double, whisker_high double, outliers long")
    fixed = {name: (lambda c, i=i: F.any_value(F.lit(q[c][i]))) for i, name in enumerate(("q1", "median", "q3"))}
    return side_by_side(
        df, [c for c in columns if c in q], **fixed, whisker_low=lambda c: F.min(F.when(inside(c), F.col(c))), whisker_high=lambda c: F.max(F.when(inside(c), F.col(c))),
        outliers=lambda c: F.count(F.when(F.col(c).isNotNull() & ~inside(c), 1)),
    )


def analyze(df: DataFrame, columns: list[str], method: str = "std", distance: float = 3.0) -> DataFrame:
    """Shares of missing, zero, unique, most frequent and outlying values, with min and max."""
    if method == "std":
        bounds = {r.column: (r.m - distance * r.sd, r.m + distance * r.sd) if r.sd is not None else None for r in side_by_side(df, columns, m=F.avg, sd=F.stddev_samp).collect()}  # two numbers a column
    else:
        q = quantile_rows(df, columns, [0.25, 0.75])
        bounds = {c: (a - distance * (b - a), b + distance * (b - a)) if a is not None else None for c, (a, b) in q.items()}
    beyond = lambda c: F.count(F.when((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1]), 1)) if bounds[c] else F.count(F.lit(None))
    s = side_by_side(df, columns, n=lambda c: F.count(F.lit(1)), missing=lambda c: F.count(F.when(F.col(c).isNull(), 1)), zero=lambda c: F.count(F.when(F.col(c) == 0, 1)), outlier=beyond, min=F.min, max=F.max)
    # values are counted before they are shuffled
    counts = melt(df, columns).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("k")).groupBy("column").agg(F.count("*").alias("unique"), F.max("k").alias("top"))
    met = s.join(F.broadcast(counts), "column", "left").fillna(0, ["unique"])  # a row for each column
    share = lambda c: ratio(F.col(c).cast("double"), F.col("n").cast("double")).alias(f"{c}_share")
    return met.select("column", *[share(c) for c in ("missing", "zero", "unique", "top", "outlier")], "min", "max")


def columns_by_null_share(df: DataFrame, most: float) -> list[str]:
    """Columns whose share of nulls doesn't exceed ``most``: one aggregation, one row."""
    row = df.agg(*[F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if (row[c] or 0.0) <= most]


def correlation_matrix(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """All pairwise correlations from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: row[i] for i, p in enumerate(pairs)}


def drop_correlated(df: DataFrame, target: str, columns: list[str], most: float) -> list[str]:
    """Columns left after a scan of pairs that drops the one less correlated with the target."""
    corr = correlation_matrix(df, [target, *columns])
    gone: set[str] = set()
    for i, a in enumerate(columns):
        if a in gone:
            continue
        for b in columns[i + 1 :]:
            c = corr[a, b]
            if c is not None and abs(c) > most:
                gone.add(a if (corr[target, a] or 0) <= (corr[target, b] or 0) else b)
                if a in gone:
                    break
    return [c for c in columns if c not in gone]
