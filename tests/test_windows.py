"""Moving order statistics and moving regressions against windows that are made anew."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import research, rolling, windows


@pytest.mark.parametrize("n", [5, 5000])
def test_ecdf_and_quantiles_match_gathered_windows(spark, n):
    rng = random.Random(3)
    rows = [(name, i, rng.choice([None, float("nan"), 1.0, 1.0, rng.random(), -rng.random()])) for name, k in (("a", 9000 if n > 5 else 300), ("b", 3), (None, 40)) for i in range(k)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, date int, v double")
    got = {(r.name, r.date): r for r in windows.rolling_order(df, ["name"], "date", "v", n, (0.25, 1.0)).collect()}
    by = {}
    for name, i, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(name, []).append(v if v is not None and v == v else None)
    for name, values in by.items():
        for i in range(0, len(values), 1 if n == 5 else 700):
            have = [x for x in values[max(0, i - n + 1) : i + 1] if x is not None]
            r = got[name, i]
            assert r.seen == len(have) and r.not_above == (None if values[i] is None else sum(x <= values[i] for x in have))
            if have:
                assert r.quantiles == pytest.approx([np.quantile(have, 0.25), max(have)], abs=1e-12)


def test_ecdf_equals_the_window_expression(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(name, i, rng.random()) for name in "abc" for i in range(60)], "name string, date int, v double")
    want = df.withColumn("ecdf", rolling.rolling_ecdf("v", 12))
    assert sorted(map(tuple, windows.rolling_ecdf(df, "v", 12).collect())) == sorted(map(tuple, want.collect()))
    assert windows.rolling_ecdf(df.filter("false"), "v", 12).count() == 0


@pytest.mark.parametrize(("window", "factors", "lags"), [(36, 3, 3), (12, 1, 3), (36, 6, 5), (5, 3, 0)])
def test_moving_sums_equal_refits(window, factors, lags):
    rng = np.random.default_rng(window)
    n = 3 * research.WINDOW_BLOCK // 2 + window if factors == 1 else 200
    x = np.column_stack([np.ones(n), rng.normal(0.005, 0.05, (n, factors))])
    y = x @ rng.normal(0, 1, factors + 1) + rng.normal(0, 0.03, n)
    got = research.rolling_hac(x, y, window, lags)
    assert len(got[0]) == n - window + 1
    for i in range(0, n - window + 1, 1 if n < 500 else 37):
        want = research.hac_ols(x[i : i + window], y[i : i + window], lags)
        for a, b in zip(got, want, strict=True):
            assert np.allclose(a[i], b, rtol=1e-9, atol=1e-9)


def test_rolling_regression_with_gaps_and_short_histories(spark):
    rng = np.random.default_rng(1)
    rows = [(name, i, None if i % 7 == 3 else float(rng.normal()), float(rng.normal())) for name, k in (("a", 60), ("b", 20), ("c", 43)) for i in range(k)]
    df = spark.createDataFrame(rows, "name string, date int, y double, f double")
    got = research.rolling_factor_regression(df, ["name"], "y", ["f"], 36).collect()
    for name, k in (("a", 60), ("b", 20), ("c", 43)):
        full = [(d, y, f) for m, d, y, f in rows if m == name and y is not None]
        mine = {(r.date, r.term): (r.coefficient, r.t, r.p) for r in got if r.name == name}
        assert len(mine) == 2 * max(0, len(full) - 35)
        for end in range(36, len(full) + 1):
            part = full[end - 36 : end]
            beta, t, p = research.hac_ols(np.column_stack([np.ones(36), [f for _, _, f in part]]), np.array([y for _, y, _ in part]))
            for j, term in enumerate(("alpha", "f")):
                assert all(math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9) for u, v in zip(mine[part[-1][0], term], (beta[j], t[j], p[j]), strict=True))
    assert F.col("x") is not None


def test_histories_together_equal_each_alone(monkeypatch):
    """g10_rolling_capm_robust: many histories in one call, of several lengths and scales, in parts of a few rows."""
    monkeypatch.setattr(research, "ROWS", 150)
    rng = np.random.default_rng(9)
    sizes = np.array([60, 5, 24, 60, 0, 41, 60, 23, 1500])
    x = np.column_stack([np.ones(sizes.sum()), rng.normal(0, 0.05, (sizes.sum(), 2))])
    y = rng.normal(0, 1, sizes.sum()) * np.repeat(10.0 ** np.arange(len(sizes)), sizes)
    for window in (24, 7):  # sums, and refits
        got = research.rolling_hac_many(x, y, sizes, window)
        want = [research.rolling_hac(x[e - n : e], y[e - n : e], window) for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
        for i, each in enumerate(got):
            assert np.allclose(each, np.concatenate([w[i] for w in want]), rtol=1e-9, atol=1e-12)


def test_rolling_arrays_take_keys_and_times_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(research, "KEYS", 2)
    rows = [(None if n == 3 else f"n{n}", n % 2, t, float("nan") if t == 4 else float((t * 7 + n) % 5), float(t * t % 11)) for n in range(7) for t in range(12 + n)]
    df = spark.createDataFrame(rows, "name string, side int, date int, y double, f double")
    long = {(r.name, r.side, r.date, r.term): (r.coefficient, r.t, r.p) for r in research.rolling_factor_regression(df, ["name", "side"], "y", ["f"], 10).collect()}
    wide = research.rolling_factor_arrays(df, ["name", "side"], "y", ["f"], 10).collect()
    assert len(wide) == sum(11 + n - 9 for n in range(7)) and len(long) == 2 * len(wide)
    for r in wide:
        part = [(y, f) for m, s, t, y, f in rows if m == r.name and s == r.side and t <= r.date and t != 4][-10:]
        beta, t, p = research.hac_ols(np.column_stack([np.ones(10), [f for _, f in part]]), np.array([y for y, _ in part]))
        assert np.allclose([r.coefficient, r.t, r.p], [beta, t, p], rtol=1e-8, atol=1e-9)
        assert long[r.name, r.side, r.date, "f"] == (r.coefficient[1], r.t[1], r.p[1])
