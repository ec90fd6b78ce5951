"""Ranks of large sections by ranges against windows that sort each section whole."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkpanel.operators import sections


def plain(rows, n):
    """position, rank, tied, size, ntile and qcut bucket by sorting each section in Python."""
    by, out = {}, {}
    for date, name, v in rows:
        by.setdefault(date, []).append((v, name))
    for date, members in by.items():
        have = sorted((v, name) for v, name in members if v is not None and v == v)
        values = [v for v, _ in have]
        edges = []
        for i in range(1, n):
            at = (len(have) - 1) * i / n
            k = int(at)
            edges.append(values[k] + (at - k) * (values[min(k + 1, len(have) - 1)] - values[k]) if have else None)
        q, r = divmod(len(have), n)
        tiles = [i + 1 for i in range(n) for _ in range(q + (i < r))]
        for i, (v, name) in enumerate(have):
            first = values.index(v)
            out[date, name] = (i + 1, first + 1, values.count(v), len(have), tiles[i], 1 + sum(v > e for e in edges))
        out |= {(date, name): (None, None, None, len(have), None, None) for v, name in members if v is None or v != v}
    return out


@pytest.mark.parametrize("ranges", [3, 40])
def test_places_match_a_sort_of_each_section(spark, ranges):
    rng = random.Random(5)
    rows = [(d, i, rng.choice([None, float("nan"), 0.0, 0.0, 0.0, float(rng.randrange(6)), rng.random()])) for d, k in (("a", 300), ("b", 7), (None, 40), ("c", 1)) for i in range(k)]
    rows += [("hot", i, 1.5) for i in range(200)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "date string, name int, v double")
    placed = sections.positions(df, ["date"], "v", "name", ranges=ranges)
    got = sections.qcut(placed, ["date"], "v", 4).withColumn("tile", sections.ntile(4)).collect()
    want = plain(rows, 4)
    assert len(got) == len(rows)
    for r in got:
        assert (r.position, r.rank, r.tied, r.size, r.tile, r.bucket) == want[r.date, r.name], (r, want[r.date, r.name])


def test_whole_table_descending_and_empty(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(50)) for i in range(1000)]
    df = spark.createDataFrame(rows, "name int, v int")
    got = {r.name: r.position for r in sections.positions(df, [], "v", "name", descending=True, ranges=17).collect()}
    assert got == {name: i + 1 for i, (name, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert sections.positions(df.filter("name < 0"), [], "v", "name").count() == 0
    assert sections.breakpoints(sections.positions(df.filter("name < 0"), ["name"], "v"), ["name"], "v", [0.5]).count() == 0


def test_one_section_spreads_over_tasks(spark):
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("date"), F.col("id").alias("name"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.rand(7)).alias("v"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        placed = sections.positions(df, ["date"], "v", "name")
        largest = placed.groupBy(F.spark_partition_id()).agg(F.count("position").alias("n"), F.sum("tied"), F.max("rank")).agg(F.max("n"), F.sum("n")).first()
        assert largest[1] == n
        assert placed.agg(F.count_distinct("position"), F.max("position")).first()[:] == (n, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert largest[0] <= n / 20
    w = Window.partitionBy("date").orderBy("v", "name")
    assert placed.withColumn("w", F.row_number().over(w)).filter("w <> position").count() == 0
