"""Interval join by dyadic bins against the range test."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import etl, intervals

D0 = dt.date(1969, 11, 1)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("kind", ["date", "timestamp", "bigint"])
@pytest.mark.parametrize("open_ended", [True, False])
def test_equals_the_range_test(spark, kind, open_ended):
    rng = random.Random(4)
    day = lambda: None if rng.random() < 0.05 else D0 + dt.timedelta(rng.randrange(120))
    as_kind = lambda c: F.unix_date(c).cast("long") if kind == "bigint" else F.col(c).cast(kind)
    facts = [(rng.choice(["a", "b", None]), rng.randrange(2), day(), i) for i in range(300)] * 2
    past = [(rng.choice(["a", "b", None]), rng.randrange(2), day(), day(), i) for i in range(200)]
    fact = spark.createDataFrame(facts, "k string, k2 int, d date, id int").withColumn("d", as_kind("d"))
    history = spark.createDataFrame(past, "k string, k2 int, s date, e date, v int").withColumn("s", as_kind("s")).withColumn("e", as_kind("e"))
    got = intervals.interval_tree_join(fact, history, ["k", "k2"], "d", "s", "e", open_ended)
    want = etl.interval_join(fact, history, ["k", "k2"], "d", "s", "e", open_ended)
    assert got.columns == want.columns and rows_of(got) == rows_of(want) and got.count() > 100


def test_bins_make_up_the_interval(spark):
    rng = random.Random(5)
    rows = [(s, s + n) for s, n in ((rng.randrange(-1000, 1000), rng.randrange(0, 300)) for _ in range(300))] + [(0, 0), (5, 4), (-(2**40), 2**40)]
    got = spark.createDataFrame(rows, "s long, e long").select("s", "e", intervals.dyadic_bins(F.col("s"), F.col("e")).alias("b")).collect()
    for r in got:
        spans = sorted((b.place << b.level, (b.place + 1) << b.level) for b in r.b)
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert (spans[0][0], spans[-1][1]) == (r.s, r.e) if r.e > r.s else not spans
        assert len(spans) <= 2 * max(1, (r.e - r.s).bit_length())


def test_one_key_with_many_facts_and_intervals(spark):
    n = 100_000
    fact = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 7 % n).alias("d"), F.col("id").alias("f"))
    history = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("s"), (F.col("id") + F.col("id") % 3).alias("e"), F.col("id").alias("h"))
    began = time.time()
    got = intervals.interval_tree_join(fact, history, ["k"], "d", "s", "e").agg(F.count("*"), F.sum("f"), F.sum("h")).first()
    # day d is in the intervals that start at d, at d - 1 where (d - 1) % 3 >= 1, and at d - 2 where (d - 2) % 3 = 2
    want = [(d, s) for d in range(n) for s in (d, d - 1, d - 2) if s >= 0 and d <= s + s % 3]
    assert got[0] == len(want) and got[2] == sum(s for _, s in want)
    assert time.time() - began < 60


def test_empty_tables_and_kinds(spark):
    fact = spark.createDataFrame([("a", 1)], "k string, d long")
    none = spark.createDataFrame([], "k string, s long, e long, v int")
    assert intervals.interval_tree_join(fact, none, ["k"], "d", "s", "e").collect() == []
    with pytest.raises(TypeError):
        intervals.interval_tree_join(fact, none.withColumn("s", F.lit("x")), ["k"], "d", "s", "e")


def test_open_ends_use_levels_of_the_dates_only(spark):
    """An open interval is cut where the facts' dates end: no copies of a fact for levels that no date can meet."""
    import datetime as dt

    fact = spark.createDataFrame([(1, dt.date(1998, 1, 1) + dt.timedelta(days=i)) for i in range(100)], "k int, d date")
    history = spark.createDataFrame([(1, dt.date(1990, 1, 1), None, 1), (1, dt.date(1998, 2, 1), dt.date(2050, 1, 1), 2)], "k int, a date, b date, h int")
    met = intervals.interval_tree_join(fact, history, ["k"], "d", "a", "b")
    asked = [len(line.split(",")) for line in met._jdf.queryExecution().analyzed().toString().split("\n") if "explode(array(" in line]
    assert met.count() == 169 and asked and max(asked) <= 10
