"""Pair statistics from tiles against each pair's own rows."""

import math
import random

import numpy as np
import pytest

from sparkpanel.operators import etl, tiles


@pytest.mark.parametrize("names", [2, 5, 100])
def test_moments_match_each_pair(spark, monkeypatch, names):
    monkeypatch.setattr(tiles, "TILE_TIMES", 16)
    rng = random.Random(names)
    series = {f"n{i:02d}": {t: 1000 + 10 * rng.gauss(0, 1) + 3 * math.sin(t) for t in range(60) if rng.random() < 0.7} for i in range(13)}
    series["flat"] = dict.fromkeys(range(60), 5.0)
    series["once"] = {3: 1.0}
    series["none"] = {}
    rows = [(n, t, v) for n, s in series.items() for t, v in s.items()] + [("n00", 61, None), ("n01", 61, float("nan"))]
    prices = spark.createDataFrame(rows, "name string, date int, price double")
    got = {(r.x, r.y): r for r in tiles.pair_moments(prices, names=names).collect()}
    want = {(x, y) for x in series for y in series if x > y and series[x].keys() & series[y].keys()}
    assert got.keys() == want
    for x, y in want:
        common = sorted(series[x].keys() & series[y].keys())
        a, b, r = np.array([series[x][t] for t in common]), np.array([series[y][t] for t in common]), got[x, y]
        assert r.n == len(common)
        if len(common) < 2 or np.ptp(a) == 0:
            assert r.hedge_ratio is None and r.correlation is None and r.spread_std is None
            continue
        slope = np.cov(a, b)[0, 1] / np.var(a, ddof=1)
        assert r.hedge_ratio == pytest.approx(slope, abs=1e-9) and r.intercept == pytest.approx(b.mean() - slope * a.mean(), abs=1e-6)
        assert r.spread_std == pytest.approx(np.std(b - slope * a, ddof=1), abs=1e-6)
        if np.ptp(b):
            assert r.correlation == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)


def test_chosen_pairs_have_the_rows_of_the_whole_panel(spark):
    prices = spark.createDataFrame([(n, t, float(ord(n) * t)) for n in "abcd" for t in range(4) if (n, t) != ("b", 2)], "name string, date int, price double")
    pairs = spark.createDataFrame([("c", "b"), ("d", "a")], "x string, y string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(etl.pair_panel(prices))
    assert rows(etl.pair_panel(prices, pairs=pairs)) == [r for r in whole if r[:2] in {("c", "b"), ("d", "a")}] and len(whole) > 7
    assert tiles.pair_moments(prices.filter("false")).count() == 0
