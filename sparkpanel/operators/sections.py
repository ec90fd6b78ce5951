"""Ranks, buckets and breakpoints of sections too large for one task.

The windows of ``ranking`` sort each section (a date, a market, a whole table)
in one task. Here rows are dealt by ranges of (section, value, tie), so that one
section spreads over many tasks; each range counts its rows, and the counts of
the ranges before it give every row its position in the whole section.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import written
from ..panel import Axis, ratio

AX = Axis()

#: Ranges of rows at least; more where the session has more shuffle partitions.
RANGES = 96
#: Ends of ranges that are broadcast at most.
MOST_ENDS = 200_000


def _same(pairs: list[tuple[str, str]]) -> Column:
    """Equality of columns, nulls equal."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def positions(df: DataFrame, section: list[str], value: str, *ties: str, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """df with each row's place in its section by ``value`` and then ``ties``.

    ``position`` counts 1, 2, 3, ...; ``rank`` is the position of the first row
    of the same value and ``tied`` how many rows have it; ``size`` counts the
    section's rows that have a value. Rows without a value (null or NaN) have null in
    all but ``size``. An empty ``section`` makes one section of the whole table.

    No task holds more than a range of rows, however large a section or a group
    of equal values is; only equal (value, ties) stay together. Dealt rows are written
    once, so a range's number is the same whenever it is read; what is joined back are
    two rows for each range and section at most. Rows that are equal in all of these
    columns may take each other's places.
    """
    n = ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    has = F.col(value).isNotNull() & ~F.isnan(value) if dict(df.dtypes)[value] in ("double", "float") else F.col(value).isNotNull()
    way = F.desc if descending else F.asc
    order = [~F.col("__has"), way(value), *[F.asc(t) for t in ties]]
    dealt = df.withColumn("__has", has).repartitionByRange(n, *section, *order).withColumn("__range", F.spark_partition_id())
    rows, _ = written(dealt, "ranges")
    here = ["__range", *section, "__has"]
    by_value = Window.partitionBy(*here).orderBy(way(value))
    rows = rows.withColumns(
        {
            "__at": F.row_number().over(Window.partitionBy(*here).orderBy(way(value), *[F.asc(t) for t in ties])),
            "__first": F.rank().over(by_value),
            "__equal": F.count("*").over(Window.partitionBy(*here, value)),
        }
    )
    # two ends of each range and section: the equal values that may go on in the next range
    lowest, highest = F.min_by(value, "__first"), F.max_by(value, "__first")
    ends = rows.groupBy(*here).agg(
        F.count("*").alias("__n"), lowest.alias("__low"), highest.alias("__high"), F.min_by("__equal", "__first").alias("__n_low"), F.max_by("__equal", "__first").alias("__n_high"), F.max("__first").alias("__last")
    )
    every = Window.partitionBy(*[f"__s{i}" for i in range(len(section))], "__s_has")
    ends = ends.select("*", *[F.col(c).alias(f"__s{i}") for i, c in enumerate(section)], F.col("__has").alias("__s_has"))
    upto = every.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends, _ = written(ends.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))), "range-ends")
    small = F.broadcast if ends.count() <= MOST_ENDS else (lambda t: t)  # else a join by section, as sections are many and so small
    kept = [*[f"__s{i}" for i in range(len(section))], "__s_has"]
    tails = ends.select(*kept, F.explode(F.array(
        F.struct(F.col("__low").alias("v"), F.col("__n_low").alias("n"), (F.col("__before") + 1).alias("at")),
        F.struct(F.col("__high").alias("v"), F.when(F.col("__last") > 1, F.col("__n_high")).otherwise(F.lit(0)).alias("n"), (F.col("__before") + F.col("__last")).alias("at")),
    )).alias("e"))
    groups = tails.groupBy(*kept, F.col("e.v").alias("__v")).agg(F.min("e.at").alias("__rank"), F.sum("e.n").alias("__tied"))
    offsets = ends.select(F.col("__range").alias("__r"), *kept, "__before")
    sizes = ends.filter("__s_has").groupBy(*[f"__s{i}" for i in range(len(section))]).agg(F.sum("__n").alias("size"))
    met = rows.join(small(offsets), _same([("__range", "__r"), ("__has", "__s_has"), *[(c, f"__s{i}") for i, c in enumerate(section)]])).drop("__r", *kept)
    met = met.join(small(groups), _same([(value, "__v"), ("__has", "__s_has"), *[(c, f"__s{i}") for i, c in enumerate(section)]]), "left").drop("__v", *kept)
    if section:
        met = met.join(small(sizes), _same([(c, f"__s{i}") for i, c in enumerate(section)]), "left").drop(*kept)
    else:
        met = met.crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("size"))))  # one row
    only = lambda c: F.when(F.col("__has"), c)
    return met.select(
        *df.columns, only(F.col("__before") + F.col("__at")).alias("position"), only(F.coalesce("__rank", F.col("__before") + F.col("__first"))).alias("rank"),
        only(F.coalesce("__tied", "__equal")).alias("tied"), F.coalesce("size", F.lit(0)).alias("size"),
    )


def ntile(n: int) -> Column:
    """Bucket 1..n of a row with ``position`` and ``size``: the first buckets take the rows left over."""
    at, size = F.col("position"), F.col("size")
    least, more = F.floor(size / n), size % n
    wide = more * (least + 1)
    return F.when(at <= wide, F.floor((at - 1) / (least + 1)) + 1).otherwise(more + F.floor((at - 1 - wide) / least) + 1).cast("int")


def average_rank() -> Column:
    """Rank of a row with ``rank`` and ``tied``; equal values share the mean of their positions."""
    return F.col("rank") + (F.col("tied") - 1) / 2


def pct_rank() -> Column:
    return ratio(average_rank(), F.col("size"))


def breakpoints(placed: DataFrame, section: list[str], value: str, shares: list[float]) -> DataFrame:
    """Interpolated quantiles of each section, as an array ``edges``, from rows with ``position`` and ``size``.

    Two rows of a section are gathered for each share, whatever its size. Sections without a value don't appear.
    """
    def part(share: float) -> Column:
        at = (F.col("size") - 1) * F.lit(float(share)) + 1
        below, more = F.floor(at), at - F.floor(at)
        weight = F.when(F.col("position") == below, 1 - more).when((F.col("position") == below + 1) & (more > 0), more)
        return F.when(weight.isNotNull(), weight * F.col(value))

    found = placed.filter("position is not null").select(*section, *[part(q).alias(f"__q{i}") for i, q in enumerate(shares)])
    any_of = reduce(lambda a, b: a | b, [F.col(f"__q{i}").isNotNull() for i in range(len(shares))])
    return found.filter(any_of).groupBy(*section).agg(F.array(*[F.sum(f"__q{i}") for i in range(len(shares))]).alias("edges"))


def qcut(placed: DataFrame, section: list[str], value: str, n: int, name: str = "bucket") -> DataFrame:
    """placed with the bucket of ``value`` between the section's n - 1 inner quantiles, right-closed."""
    edges = breakpoints(placed, section, value, [i / n for i in range(1, n)])
    named = edges.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(section)], "edges")
    over = sum(((F.col(value) > F.col("edges")[i]).cast("int") for i in range(n - 1)), F.lit(1))
    met = placed.join(named, _same([(c, f"__s{i}") for i, c in enumerate(section)]), "left") if section else placed.crossJoin(F.broadcast(named))  # one row
    return met.withColumn(name, F.when(F.col("position").isNotNull(), over)).drop("edges", *[f"__s{i}" for i in range(len(section))])
