"""Quantiles of many columns at once against numpy, and what their plans shuffle."""

import random

import numpy as np
import pytest

from sparkpanel.operators import eda, quantiles


def test_columns_match_numpy(spark):
    rng = random.Random(2)
    n = 30_000
    made = {
        "smooth": [rng.gauss(0, 1) for _ in range(n)],
        "tied": [float(rng.choice([0, 0, 0, 1, 5])) for _ in range(n)],
        "gaps": [rng.choice([None, float("nan"), rng.random()]) for _ in range(n)],
        "one": [2.5 if i == 7 else None for i in range(n)],
        "two": [{3: 1.0, 4: 9.0}.get(i) for i in range(n)],
        "none": [None] * n,
        "whole": [rng.randrange(1000) for _ in range(n)],
    }
    kinds = ", ".join(f"{c} {'long' if c == 'whole' else 'double'}" for c in made)
    df = spark.createDataFrame(list(zip(*made.values(), strict=True)), kinds).repartition(7)
    ps = [0.0, 0.05, 0.25, 0.5, 0.7531, 1.0]
    got = {r.column: r for r in quantiles.column_quantiles(df, list(made), ps).collect()}
    assert got.keys() == made.keys()
    for c, values in made.items():
        have = [v for v in values if v is not None and v == v]
        assert got[c].n == len(have)
        assert got[c].q == ([None] * len(ps) if not have else pytest.approx(list(np.quantile(have, ps)), abs=1e-12))
    small = df.filter("smooth > 4.5 or smooth < -100")
    assert {r.column: r.n for r in quantiles.column_quantiles(small.limit(0), ["smooth", "tied"], [0.5]).collect()} == {"smooth": 0, "tied": 0}


def test_written_results_can_be_released(spark, tmp_path):
    from sparkpanel.functions import checkpoints

    df = spark.range(10)
    kept, path = checkpoints.written(df, "kept")
    other, gone = checkpoints.written(df.selectExpr("id * 2 as id"), "gone")
    df.write.parquet(f"{tmp_path}/mine")
    result = other.unionByName(spark.read.parquet(f"{tmp_path}/mine"))
    assert result.count() == 20
    checkpoints.release(result)
    assert kept.count() == 10 and spark.read.parquet(f"{tmp_path}/mine").count() == 10
    assert gone not in checkpoints._tables and path in checkpoints._tables
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        spark.read.parquet(gone).count()


def test_few_rows_match_numpy(spark):
    for n in range(1, 8):
        values = [float((i * 5) % 7) for i in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        ps = [0.1, 0.25, 0.5, 0.9]
        assert quantiles.column_quantiles(df, ["v"], ps).first().q == pytest.approx(list(np.quantile(values, ps)))


def test_box_and_histogram_edges(spark):
    df = spark.createDataFrame([(1.0, None, 3.0)] * 4 + [(2.0, None, 3.0), (50.0, None, None)], "a double, b double, c double")
    box = {r.column: r for r in eda.box_stats(df, ["a", "b", "c"]).collect()}
    assert box.keys() == {"a", "c"} and box["a"].outliers == 1 and box["a"].whisker_high == 2.0 and box["c"].outliers == 0
    bins = {(r.column, r.bin): r.n for r in eda.histogram(df, ["a", "b", "c"], 4).collect()}
    assert bins == {("a", 0): 5, ("a", 3): 1, ("c", 0): 5}
    found = {r.column: r for r in eda.analyze(df, ["a", "b", "c"], "iqr", 1.5).collect()}
    assert found["b"].missing_share == 1.0 and found["b"].unique_share == 0.0 and found["a"].outlier_share == pytest.approx(1 / 6)


def test_no_rows_are_shuffled_by_column_name(spark):
    df = spark.range(1000).selectExpr("cast(id as double) a", "cast(id % 7 as double) b").repartition(3)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        for made in (eda.describe(df, ["a", "b"]), eda.box_stats(df, ["a", "b"])):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "Expand" not in plan and "unpivot" not in plan.lower()
            # what is joined by column name are the one-row aggregates and the brackets' own counts
            assert "hashpartitioning(column" not in plan or all("Scan" not in part.split("Exchange")[0] for part in plan.split("hashpartitioning(column")[1:])
    finally:
        spark.conf.set(key, before)
