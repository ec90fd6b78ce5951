"""Ranks, buckets and selections; every order ends with the entity, so ties are settled.

These columns sort a section (a date) in one task, which suits dates of up to some millions of
entities and needs no job of its own. ``sections`` has the same ranks for sections of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Axis, ratio

AX = Axis()


def ntile_rank(signal, n, *by, ax=AX) -> Column:
    """Bucket 1..n of the signal within a time (and further keys)."""
    return F.ntile(n).over(ax.section(*by).orderBy(signal, ax.name))


def average_rank(signal, descending=False, ax=AX) -> Column:
    """Rank within a time; equal values share the mean of their ranks."""
    order = F.desc(signal) if descending else F.asc(signal)
    return F.rank().over(ax.section().orderBy(order)) + (F.count(signal).over(ax.section(signal)) - 1) / 2


def pct_rank(signal, ax=AX) -> Column:
    return average_rank(signal, ax=ax) / F.count(signal).over(ax.section())


def qcut_rank(df: DataFrame, value: str, n: int, name: str = "bucket", ax: Axis = AX) -> DataFrame:
    """Bucket by interpolated quantile edges of a time: right-closed, lowest included, equal edges collapse. (``sections.qcut`` for times of any size.)"""
    inner = [i / n for i in range(1, n)]
    edges = df.groupBy(ax.time).agg(F.percentile(value, F.array(*[F.lit(q) for q in inner])).alias("__edges"))
    over = F.size(F.filter("__edges", lambda e: F.col(value) > e))
    return df.join(edges, ax.time).withColumn(name, F.when(F.col(value).isNotNull(), over + 1)).drop("__edges")


def rank_spread(df: DataFrame, r: str, prediction: str, n: int, ax: Axis = AX) -> DataFrame:
    """Per time the mean return of the top 1/n less that of the bottom 1/n by prediction."""
    share = F.row_number().over(ax.section().orderBy(prediction, ax.name)) / F.count("*").over(ax.section())
    ranked = df.filter(F.col(prediction).isNotNull()).withColumn("__p", share)
    top, low = F.avg(F.when(F.col("__p") > 1 - 1 / n, F.col(r))), F.avg(F.when(F.col("__p") <= 1 / n, F.col(r)))
    return ranked.groupBy(ax.time).agg((top - low).alias("port_r"))


def top_by_size(df: DataFrame, size: str, k: int, ax: Axis = AX) -> DataFrame:
    """The k largest of each time; equal sizes share the mean of their ranks."""
    return df.withColumn("__r", average_rank(size, True, ax)).filter(F.col("__r") <= k).drop("__r")


def top_n(df: DataFrame, signal: str, n: int, money: float, price: str, *ties: str) -> DataFrame:
    """The n largest rows, an equal share of money each, and whole shares for it."""
    best = df.orderBy(F.desc_nulls_last(signal), *ties).limit(n)
    return best.withColumn("money", F.lit(money / n)).withColumn("shares", F.floor(ratio(F.col("money"), F.col(price))))


def long_short_targets(df: DataFrame, signal: str, n: int, money: float, ax: Axis = AX) -> DataFrame:
    """Per time: the lowest n get -money/n, the highest n money/n, the others 0."""
    low = F.row_number().over(ax.section().orderBy(F.asc(signal), ax.name))
    high = F.row_number().over(ax.section().orderBy(F.desc(signal), F.desc(ax.name)))
    out = df.withColumn("__l", low).withColumn("__h", high)
    target = F.when(F.col("__l") <= n, -money / n).when(F.col("__h") <= n, money / n).otherwise(0.0)
    return out.withColumn("target", target).drop("__l", "__h")


def last_row(df: DataFrame, ax: Axis = AX) -> DataFrame:
    """Each entity's row at its latest time."""
    w = Window.partitionBy(ax.name).orderBy(F.desc(ax.time))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def every_nth(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w) - 1).filter(F.col("__n") % n == 0).drop("__n")


def sample_rows(df: DataFrame, n: int, *key: str) -> DataFrame:
    """A sample of about n rows, always the same: those whose key hashes low. Rows of one key stay or go together; a null is an empty text."""
    total = df.agg(F.count("*").alias("__total"))
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    share = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.crossJoin(F.broadcast(total)).filter(share < n / F.col("__total")).drop("__total")  # one row


#: Ranges that a whole table's order is cut into for running totals.
RANGES = 256


def running_total(df: DataFrame, key: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of ``value`` over all rows up to each, in the given order; ``key`` is its leading number.

    No task takes the whole table: rows are cut into ranges of the key by
    approximate quantiles, ranges are summed (RANGES rows at most), and a window
    within each range adds what came before it.
    """
    keyed = df.withColumns({"__key": key.cast("double"), "__value": value})
    cuts = keyed.agg(F.percentile_approx("__key", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 10 * RANGES).alias("__cuts"))
    ranged = keyed.crossJoin(F.broadcast(cuts)).withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__key"))), F.lit(0))).drop("__cuts")  # one row
    sums = ranged.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    before = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__before"))
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.join(F.broadcast(before), "__range")  # RANGES rows
    return within.withColumn(name, F.sum("__value").over(w) + F.col("__before")).drop("__key", "__value", "__range", "__before")


def assign_slots(accounts: DataFrame, ranked: DataFrame, per_position: float) -> DataFrame:
    """accounts (account, value) get floor(value / per_position) slots in their order; ranked (name, rank) fill them by rank."""
    slots = accounts.withColumn("slots", F.floor(F.col("value") / per_position)).filter("slots > 0")
    upto = running_total(slots, F.col("account"), [F.col("account")], F.col("slots"), "__to")
    each = upto.select("account", F.explode(F.sequence(F.col("__to") - F.col("slots") + 1, F.col("__to"))).alias("rank"))
    return ranked.join(each, "rank").select("account", "name", "rank")
