"""Cleaning, linking and reshaping of vendor tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Axis, log_growth, ratio

AX = Axis()


def null_if_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) < 0, None).otherwise(F.col(c)) for c in columns})


def recode(column: str, mapping: dict) -> Column:
    out = F.col(column)
    for old, new in reversed(mapping.items()):
        out = F.when(F.col(column) == old, new).otherwise(out)
    return out


def cast_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in schema.items()})


def one_hot(df: DataFrame, column: str, levels: list, drop_first: bool = False) -> DataFrame:
    return df.select("*", *[(F.col(column).eqNullSafe(v)).cast("int").alias(f"{column}_{v}") for v in levels[drop_first:]])


def text_concat(columns: list[str], separator: str = " ") -> Column:
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def multi_join(tables: list[DataFrame], on: list[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, how), tables)


def membership_flag(df: DataFrame, members: DataFrame, on: list[str], flag: str) -> DataFrame:
    """df with 'Y' where the key is among the members', null elsewhere."""
    return df.join(members.select(*on).distinct().withColumn(flag, F.lit("Y")), on, "left")


def interval_join(fact: DataFrame, history: DataFrame, keys: list[str], date: str, start: str, end: str, open_ended: bool = True) -> DataFrame:
    """Facts with the history rows valid at their date; a null end is open where ``open_ended``.

    Each fact meets all rows of its key; ``intervals.interval_tree_join`` is for keys with long histories.
    """
    upto = F.col(date) <= F.col(end)
    valid = (F.col(date) >= F.col(start)) & ((F.col(end).isNull() | upto) if open_ended else upto)
    named = history.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in history.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
    return fact.join(named, same & valid).drop(*[f"__{k}" for k in keys])


def asof_join(fact: DataFrame, history: DataFrame, keys: list[str], date: str, effect: str, values: list[str]) -> DataFrame:
    """Facts with the latest history values at or before their date; earlier facts are dropped.

    Both sides go through one sort by key and date; nothing is multiplied. Null
    keys match nothing, as in any equi-join.
    """
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    fact, history = fact.filter(keyed), history.filter(keyed)
    old = history.select(*keys, F.col(effect).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"), F.lit(None).cast(fact.select(F.struct("*")).schema[0].dataType).alias("__f"))
    new = fact.select(*keys, F.col(date).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(old.schema["__v"].dataType).alias("__v"), F.struct("*").alias("__f"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side", *[F.col(f"__v.{v}") for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    found = old.unionByName(new).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return found.filter("__side = 1 and __v is not null").select("__f.*", *[F.col(f"__v.{v}") for v in values])


def pair_panel(prices: DataFrame, value: str = "price", pairs: DataFrame | None = None, ax: Axis = AX) -> DataFrame:
    """Rows of pairs on the times both have: x is the later name, y the earlier.

    Of the given ``pairs`` (x, y), or of all: then the rows are half the square of the names, for
    each time. ``tiles.pair_moments`` ranks all pairs without forming them.
    """
    if pairs is None:
        names = prices.select(ax.name).distinct()
        pairs = names.select(F.col(ax.name).alias("x")).join(names.select(F.col(ax.name).alias("y")), F.col("x") > F.col("y"))
    side = lambda n: prices.select(F.col(ax.name).alias(n), ax.time, F.col(value).alias(f"p_{n}"))
    return pairs.select("x", "y").join(side("x"), "x").join(side("y"), ["y", ax.time]).select("x", "y", ax.time, "p_x", "p_y")


def period_end(frequency: str, t: Column) -> Column:
    """Last day of the week (a Friday), month, quarter or year of a date."""
    month = F.last_day
    return {
        "W": F.next_day(F.date_sub(t, 1), "FRI"), "M": month(t), "Q": month(F.add_months(F.date_trunc("quarter", t).cast("date"), 2)), "Y": month(F.add_months(F.date_trunc("year", t).cast("date"), 11)),
    }[frequency]


def downsample(df: DataFrame, r: str, means: list[str], lasts: list[str], sums: list[str], frequency: str, fill_gaps: bool = False, ax: Axis = AX) -> DataFrame:
    """Entity history at week (to Friday), month, quarter or year ends.

    Observed periods only; with ``fill_gaps`` also those between an entity's first
    and last, with a return and sums of 0 and other values null.
    """
    out = df.groupBy(ax.name, period_end(frequency, F.col(ax.time)).alias(ax.time)).agg(
        (F.exp(F.coalesce(F.sum(log_growth(r)), F.lit(0.0))) - 1).alias(r), *[F.avg(c).alias(c) for c in means],
        *[F.max_by(c, ax.time).alias(c) for c in lasts], *[F.sum(c).alias(c) for c in sums],
    )
    if not fill_gaps:
        return out
    step = {"W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTHS", "Y": "INTERVAL 1 YEAR"}[frequency]
    first = F.min(ax.time) if frequency == "W" else F.trunc(F.min(ax.time), "month").cast("date")
    each = out.groupBy(ax.name).agg(F.sequence(first, F.max(ax.time), F.expr(step)).alias("__t")).select(ax.name, F.explode("__t").alias(ax.time))
    each = each.withColumn(ax.time, period_end(frequency, F.col(ax.time)))
    zero = [r, *sums]
    filled = each.join(out, [ax.name, ax.time], "left")
    return filled.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in out.dtypes if c in zero})


def drop_duplicates(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in the given order, which settles ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter("__n > 1").drop("__n")


def pivot_wide(df: DataFrame, index: list[str], column: str, value: str, levels: list, fill=0) -> DataFrame:
    return df.groupBy(*index).pivot(column, levels).agg(F.first(value)).fillna(fill)


def complete_series(df: DataFrame, ax: Axis = AX) -> DataFrame:
    """Entities observed at every time."""
    times = df.agg(F.count_distinct(ax.time).alias("__all"))
    full = df.groupBy(ax.name).agg(F.count_distinct(ax.time).alias("__n")).join(F.broadcast(times), F.col("__n") == F.col("__all")).select(ax.name)
    return df.join(full, ax.name, "left_semi")


def fill_report(fills: DataFrame, symbol: str, shares: str, price: str, commission: str, pnl: str) -> DataFrame:
    """Per symbol and in total (null symbol): shares, VWAP, commission and profit."""
    return fills.rollup(symbol).agg(
        F.sum(shares).alias("shares"), ratio(F.sum(F.col(shares) * F.col(price)), F.sum(shares)).alias("vwap"), F.sum(commission).alias("commission"), F.sum(pnl).alias("pnl")
    )


def history_average(df: DataFrame, value: str, n: int, ax: Axis = AX) -> DataFrame:
    """Latest time and mean value of each entity's last n rows, if it has n and is up to date."""
    w = Window.partitionBy(ax.name).orderBy(F.desc(ax.time))
    last = df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n)
    newest = df.agg(F.max(ax.time).alias("__new"))
    found = last.groupBy(ax.name).agg(F.max(ax.time).alias(ax.time), F.avg(value).alias(value), F.count("*").alias("__k"))
    return found.filter(F.col("__k") == n).join(F.broadcast(newest), F.col(ax.time) == F.col("__new")).drop("__k", "__new")


def trading_days(spark, start: str, end: str, nth: int = 1, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays from start to end that are no holidays (column date), every nth from the first."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)) AS date").filter(F.weekday("date") < 5)
    if holidays is not None:
        days = days.join(holidays.select("date").distinct(), "date", "left_anti")
    # a calendar: a few hundred rows a year whatever the data
    return days.withColumn("__n", F.row_number().over(Window.orderBy("date")) - 1).filter(F.col("__n") % nth == 0).select("date")
