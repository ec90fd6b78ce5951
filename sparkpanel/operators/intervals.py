"""Interval join for keys with long histories: dates meet intervals in equal dyadic bins, without a range test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widest bin is 2 to this power; times are days, microseconds or the integers themselves.
LEVELS = 62


def _number(column: str, kind: str) -> Column:
    """A time as a long of its finest unit, in order."""
    if kind == "date":
        return F.unix_date(column).cast("long")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("long")


def dyadic_bins(start: Column, stop: Column) -> Column:
    """The fewest bins [place * 2^level, (place + 1) * 2^level) that make up [start, stop): an array of (level, place), two a level at most.

    On a level, what is left of the interval has a bin of its own at either end where that end is odd.
    """
    levels = F.sequence(F.lit(0), F.lit(LEVELS))

    def ends(level: Column) -> Column:
        low = -F.call_function("shiftright", -start, level)  # rounded up
        high = F.call_function("shiftright", stop, level)
        open_ = low < high
        left = F.when(open_ & (F.pmod(low, F.lit(2)) == 1), F.struct(level.alias("level"), low.alias("place")))
        right = F.when(open_ & (F.pmod(high, F.lit(2)) == 1), F.struct(level.alias("level"), (high - 1).alias("place")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(levels, ends)), lambda b: b.isNotNull())


def interval_tree_join(fact: DataFrame, history: DataFrame, keys: list[str], date: str, start: str, end: str, open_ended: bool = True) -> DataFrame:
    """fact with all rows of history whose interval (both ends included) holds its date, as ``etl.interval_join`` gives.

    Each interval is cut into dyadic bins, and each fact asks for the one bin
    of every level that holds its date: what meets belongs together, so the join makes its output
    and nothing else, and a key with a long history is spread over its bins. Costs a row of a fact for each
    level that any interval uses (about the log of the longest interval, of what lies between the first and the last date of the facts), and two rows of an interval for each
    level at most. With few intervals a key, ``etl.interval_join`` is cheaper.

    Null keys, dates or starts match nothing; a null end is open where ``open_ended`` and matches nothing
    otherwise; an end before its start holds no date. Columns of history take their names
    into the result, without the keys.
    """
    kind = dict(fact.dtypes)[date]
    values = [c for c in history.columns if c not in keys]
    kinds = {kind, *(dict(history.dtypes)[c] for c in (start, end))}
    whole = {"tinyint", "smallint", "int", "bigint"}
    if not (len(kinds) == 1 or kinds <= whole) or not (kind == "date" or kind.startswith("timestamp") or kind in whole):
        raise TypeError(f"dates, timestamps or integers of one kind are needed, not {sorted(kinds)}")
    first, most = fact.agg(F.min(_number(date, kind)), F.max(_number(date, kind))).first()  # two numbers
    if first is None:
        first, most = 0, -1  # no dates: no bins
    begin = F.when(F.col(start).isNotNull(), F.greatest(_number(start, kind), F.lit(first).cast("long")))
    last = F.least(_number(end, kind), F.lit(most).cast("long")) if open_ended else F.when(F.col(end).isNotNull(), F.least(_number(end, kind), F.lit(most).cast("long")))
    bins = history.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*values).alias("__v"), F.explode(dyadic_bins(begin, last + 1)).alias("__b"))
    bins = bins.select("*", F.col("__b.level").alias("__level"), F.col("__b.place").alias("__place")).drop("__b")
    levels = sorted(r[0] for r in bins.select("__level").distinct().collect())  # LEVELS numbers at most
    if not levels:
        levels = [0]
    asked = fact.withColumn("__ask", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("__at", F.call_function("shiftright", _number(date, kind), F.col("__ask")))
    # exploded bins are far more than Spark guesses from the files, so they are never broadcast
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys]) & (F.col("__ask") == F.col("__level")) & (F.col("__at") == F.col("__place"))
    return asked.join(bins.hint("merge"), same).select(*fact.columns, *[F.col(f"__v.{v}").alias(v) for v in values])
