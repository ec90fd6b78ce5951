"""Exact quantiles without gathering a group's values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Brackets of groups that are broadcast at most.
BROADCAST_BRACKETS = 100_000
#: Ranks within which the approximate quantile is trusted, as one part of the rows in so many.
ACCURACY = 10_000


def percentiles(df: DataFrame, by: list[str], value: str, ps: list[float]) -> DataFrame:
    """Per group ``by``: n, and q, the interpolated quantiles ``ps`` of the values that are neither null nor NaN.

    An approximate quantile on either side brackets each rank; only the values in
    the bracket, a few rows in ACCURACY, are sorted, and those below are counted.
    Groups are joined by their columns, null ones too.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    edge = 4.0 / ACCURACY
    around = [min(1.0, max(0.0, p + e)) for p in ps for e in (-edge, edge)]
    brackets = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("__v", F.array(*map(F.lit, around)), ACCURACY).alias("__b"))
    each = brackets.select(
        *by, "n",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("at"), F.col("__b")[2 * i].alias("low"), F.col("__b")[2 * i + 1].alias("high")) for i, p in enumerate(ps)])).alias("x"),
    ).select(*by, "n", "x.*")
    named = each.withColumnsRenamed({c: f"__{c}" for c in by})
    same = [rows[c].eqNullSafe(named[f"__{c}"]) for c in by]
    small = F.broadcast if by and named.count() <= BROADCAST_BRACKETS else (lambda t: t)  # else a join by group, as there are many
    met = rows.join(small(named), same) if by else rows.crossJoin(F.broadcast(named))  # one row for each quantile
    side = F.when(F.col("__v") < F.col("low"), -1).when(F.col("__v") > F.col("high"), 1).otherwise(0).alias("side")
    inside = F.when(F.col("__v").between(F.col("low"), F.col("high")), F.col("__v")).alias("v")
    # of the values outside, those next to the bracket may be one of the two that a quantile lies between
    counts = met.groupBy(*by, "i", "n", "at", side, inside).agg(F.count("*").alias("count"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    counts = counts.withColumn("v", F.when(F.col("side") < 0, F.col("__max")).otherwise(F.col("__min"))).drop("__min", "__max")
    w = Window.partitionBy(*by, "i").orderBy("side", "v")
    upto = F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("count"))
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("upto"))
    low, high = F.floor("at"), F.ceil("at")
    found = ranked.groupBy(*by, "i", "n", "at").agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))
    part = F.col("at") - F.floor("at")
    value_of = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part)
    return found.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value_of.alias("q")))), lambda x: x["q"]).alias("q"))


def number(column: str) -> Column:
    """A column as a double, NaN as null."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def column_quantiles(df: DataFrame, columns: list[str], ps: list[float]) -> DataFrame:
    """One row a column: column, n, and q, the interpolated quantiles ``ps`` of its values that are neither null nor NaN.

    Columns stay side by side: one aggregate makes a sketch of each, which
    brackets all ranks, a second counts what is below each bracket and finds its neighbours, and of the values
    only those within a bracket (a few rows in ACCURACY, as counts of each value) are shuffled. Rows are
    never melted or joined. A column without values has n = 0 and null quantiles.
    """
    spark = df.sparkSession
    wide = df.select(*[number(c).alias(f"c{k}") for k, c in enumerate(columns)])
    edge = 4.0 / ACCURACY
    around = [min(1.0, max(0.0, p + e)) for p in ps for e in (-edge, edge)]
    sketch = wide.agg(*[F.struct(F.count(f"c{k}").alias("n"), F.percentile_approx(f"c{k}", F.array(*map(F.lit, around)), ACCURACY).alias("b")).alias(f"c{k}") for k in range(len(columns))]).first()  # two numbers a share
    spots = [(k, i, sketch[k].n, p * (sketch[k].n - 1), sketch[k].b[2 * i], sketch[k].b[2 * i + 1]) for k in range(len(columns)) if sketch[k].n for i, p in enumerate(ps)]
    if not spots:
        return spark.createDataFrame([(c, 0, [None] * len(ps)) for c in columns], "column string, n long, q array<double>")
    of = lambda k: F.col(f"c{k}")
    counted = [F.struct(F.count(F.when(of(k) < low, 1)).alias("below"), F.max(F.when(of(k) < low, of(k))).alias("before"), F.min(F.when(of(k) > high, of(k))).alias("after")).alias(f"s{j}") for j, (k, _, _, _, low, high) in enumerate(spots)]
    known = wide.agg(*counted).first()  # three numbers a share
    within = [of(k).between(low, high) for k, _, _, _, low, high in spots]
    some = within[0]
    for w in within[1:]:
        some = some | w
    cells = F.array(*[F.when(w, F.struct(F.lit(j).alias("j"), of(k).alias("v"))) for j, (w, (k, *_)) in enumerate(zip(within, spots, strict=True))])
    inside = wide.filter(some).select(F.explode(cells).alias("e")).filter("e is not null").groupBy("e.j", "e.v").agg(F.count("*").alias("k"))
    rows = [(j, columns[k], i, n, at, known[j].below, known[j].before, known[j].after) for j, (k, i, n, at, _, _) in enumerate(spots)]
    asked = spark.createDataFrame(rows, "j int, column string, i int, n long, at double, below long, before double, after double")
    w = Window.partitionBy("j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.join(F.broadcast(asked), "j").withColumn("upto", F.col("below") + F.sum("k").over(w))  # a row for each column and share
    holds = lambda rank: (F.col("upto") - F.col("k") <= rank) & (rank < F.col("upto"))
    low, high = F.floor("at"), F.ceil("at")
    found = placed.groupBy("column", "i", "n", "at", "below", "before", "after").agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))
    a, b = F.coalesce("a", F.when(low < F.col("below"), F.col("before")).otherwise(F.col("after"))), F.coalesce("b", F.when(high < F.col("below"), F.col("before")).otherwise(F.col("after")))
    value = F.when(a == b, a).otherwise(a + (b - a) * (F.col("at") - low))
    out = found.groupBy("column", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("q")))), lambda x: x["q"]).alias("q"))
    empty = [(c, 0, [None] * len(ps)) for k, c in enumerate(columns) if not sketch[k].n]
    return out.unionByName(spark.createDataFrame(empty, "column string, n long, q array<double>")) if empty else out
