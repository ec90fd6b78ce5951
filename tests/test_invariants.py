"""Edge panels, invariants, sources, sinks and streams of the panel operators."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import enrich, etl, forecast, pairs, portfolio, quantiles, ranking, research, rolling
from sparkpanel.plans import fixtures
from sparkpanel.sources import tables
from sparkpanel.streaming import live

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [("a", 1, 0.1, 5.0), ("a", 2, -1.0, 5.0), ("a", 3, 0.2, None), ("b", 1, None, 0.0), ("c", 1, 0.0, 5.0), ("c", 3, 0.5, 5.0)]
    return spark.createDataFrame(rows, "name string, date int, ret double, prc double")


def test_edge_panel(edge):
    got = {(r.name, r.date): r for r in rolling.features(edge, w=rolling.wealth("ret", None, 0), p=rolling.change("prc", 1, True)).collect()}
    assert got["a", 3].w == pytest.approx(1.32)  # the total loss is skipped
    assert got["b", 1].w is None and got["b", 1].p is None
    assert ranking.top_by_size(edge, "prc", 1).count() >= 0


def test_buckets_are_even_and_complete(spark):
    panel = fixtures.stock_panel(spark, DATA)
    sizes = panel.withColumn("k", ranking.ntile_rank("prc", 5)).groupBy("date", "k").count().groupBy("date").agg(F.max("count").alias("hi"), F.min("count").alias("lo"), F.sum("count").alias("n")).collect()
    assert all(r.hi - r.lo <= 1 for r in sizes) and sum(r.n for r in sizes) == panel.count()


def test_double_sort_with_one_bucket_is_the_single_sort(spark):
    panel = fixtures.stock_panel(spark, DATA)
    single = portfolio.sort_portfolios(panel, "vol", "ret", 5).select("date", "sig_rank", "r")
    double = portfolio.sort_portfolios(panel, "vol", "ret", 5, condition="prc", n_condition=1).select("date", "sig_rank", "r")
    assert single.exceptAll(double).count() == 0 and double.exceptAll(single).count() == 0


def test_p_values():
    for t, n, p in ((2.0, 10, 0.0733880), (0.0, 5, 1.0), (1.0, 1, 0.5), (12.706205, 1, 0.05)):
        assert portfolio.incomplete_beta(n / 2, 0.5, n / (n + t * t)) == pytest.approx(p, abs=1e-6)


def test_hac_reduces_to_white_and_to_least_squares():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(80), rng.normal(size=80)])
    y = x @ [1.0, 2.0] + rng.normal(size=80)
    beta, t, _ = research.hac_ols(x, y, 0)
    assert beta == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])
    e, inverse = y - x @ beta, np.linalg.inv(x.T @ x)
    assert t == pytest.approx(beta / np.sqrt(np.diag(inverse @ (x.T * e**2) @ x @ inverse)))


def test_fama_macbeth_matches_numpy(spark):
    df = fixtures.stock_panel(spark, DATA).withColumn("size", F.log("mktcap")).filter("ret is not null")
    pdf = df.select("date", "ret", "vol", "size").toPandas()
    betas = []
    for _, g in sorted(pdf.groupby("date"), key=lambda kv: kv[0]):
        if len(g) > 3:
            betas.append(np.linalg.lstsq(np.column_stack([np.ones(len(g)), g["vol"], g["size"]]), g["ret"], rcond=None)[0])
    got = {r.term: r for r in research.fama_macbeth(df, "ret", ["vol", "size"]).collect()}
    assert [got[t].coefficient for t in ("const", "vol", "size")] == pytest.approx(np.mean(betas, 0), rel=1e-4, abs=1e-8)
    d = np.array(betas)[:, 1] - np.mean(betas, 0)[1]
    v = d @ d + sum(2 * (1 - k / 6) * (d[k:] @ d[:-k]) for k in range(1, 6))
    assert got["vol"].t == pytest.approx(np.mean(betas, 0)[1] * len(d) / math.sqrt(max(v, 0)), rel=1e-3)


def test_greedy_disjoint_equals_the_scan(spark, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(2)
    names = [f"n{i:02}" for i in range(14)]
    rows = [(a, b, float(rng.integers(0, 20))) for i, a in enumerate(names) for b in names[:i]]
    used, want = set(), []
    for x, y, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if x not in used and y not in used:
            used |= {x, y}
            want.append((x, y, s))
    got = [tuple(r) for r in pairs.greedy_disjoint(spark.createDataFrame(rows, "x string, y string, score double"), 5).collect()]
    assert got == want[:5]


def test_kalman_finds_a_constant_ratio(spark):
    rows = [("x", "y", i, 1.0 + i % 7, 2.0 * (1.0 + i % 7)) for i in range(200)]
    out = pairs.kalman_hedge(spark.createDataFrame(rows, "x string, y string, date int, p_x double, p_y double")).orderBy("date").collect()
    assert out[-1].hr == pytest.approx(2.0, abs=0.01)


def test_adf_tells_noise_from_a_walk():
    rng = np.random.default_rng(1)
    assert pairs.approximate_p(pairs.adf_statistic(rng.normal(size=300)), 1) < 0.01
    assert pairs.approximate_p(pairs.adf_statistic(np.cumsum(rng.normal(size=300))), 1) > 0.05


def test_adf_takes_the_lag_of_least_aic():
    def fit(v, k, constant, first):
        rows, y = [], []
        for t in range(first + 1, len(v)):
            rows.append([v[t - 1], *[1.0] * constant, *[v[t - i] - v[t - i - 1] for i in range(1, k + 1)]])
            y.append(v[t] - v[t - 1])
        a, y = np.array(rows), np.array(y)
        q, r = np.linalg.qr(a)
        beta = np.linalg.solve(r, q.T @ y)
        ssr = ((y - a @ beta) ** 2).sum()
        return len(y) * np.log(ssr / len(y)) + 2 * a.shape[1], beta[0] / np.sqrt(ssr / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])

    rng, found = np.random.default_rng(5), set()
    for n in (30, 83, 200):
        e = rng.normal(size=n + 4)
        v = np.zeros(n + 4)
        for t in range(4, n + 4):
            v[t] = 0.5 * v[t - 1] + 0.4 * v[t - 4] + e[t]
        v = v[4:]
        most = math.ceil(12 * (n / 100) ** 0.25)
        for constant in (True, False):
            top = min(most, n // 2 - constant - 1)
            best = min(range(top + 1), key=lambda k: fit(v, k, constant, top)[0])
            found.add(best)
            assert pairs.adf_statistic(v, constant=constant) == pytest.approx(fit(v, best, constant, best)[1], rel=1e-6)
    assert found - {1}


def test_adf_p_values_meet_the_published_critical_values():
    for variables, critical in ((1, (-3.43035, -2.86154, -2.56677)), (2, (-3.89644, -3.33613, -3.04445))):
        assert [pairs.approximate_p(t, variables) for t in critical] == pytest.approx([0.01, 0.05, 0.1], abs=2e-4)
        assert pairs.approximate_p(-30, variables) == 0 and pairs.approximate_p(3, variables) == 1
    assert math.isnan(pairs.approximate_p(float("nan"), 1))


def test_walk_forward_covers_the_calendar(spark):
    """Each window's backtest starts anew: plain runs of the same backtest on each window's rows."""
    from sparkpanel.plans import pairs as plans

    out = plans.i13(spark, DATA).collect()
    assert {r.window for r in out} == {0, 1, 2, 3}
    prices = plans.panel(spark, DATA).persist()
    z = lambda v: (v - np.nanmean(v)) / np.nanstd(v, ddof=1)
    for k in range(4):  # the last one is short
        train = pairs.backtest(prices.filter(f"date >= '{1995 + k}-01-01' and date < '{1998 + k}-01-01'")).toPandas()
        trade = pairs.backtest(prices.filter(f"date >= '{1996 + k}-01-01' and date < '{1999 + k}-01-01'")).toPandas()
        stats = {key: g.sort_values("date") for key, g in train.groupby(["x", "y"])}
        s = np.array([g["r"].mean() / g["r"].std() if g["r"].std() else np.nan for g in stats.values()])
        p = np.array([pairs.approximate_p(pairs.adf_statistic(g["spread"].dropna().to_numpy()), 1) for g in stats.values()])
        score = np.nan_to_num(0.5 * z(s) - 0.5 * z(p), nan=-np.inf)
        best = {list(stats)[i] for i in np.argsort(-score, kind="stable")[:10]}
        held = trade[(trade["date"] >= f"{1998 + k}-01-01") & np.array([key in best for key in zip(trade["x"], trade["y"], strict=True)])]
        assert {r.date: pytest.approx(r.r) for r in out if r.window == k} == held.groupby("date")["r"].mean().to_dict() != {}
    prices.unpersist()


def test_kalman_filter_with_constant_is_the_textbook_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 1, 60)
    y = 2 + 1.5 * x + rng.normal(0, 0.1, 60)
    rows = [("a", "b", i, float(x[i]), float(y[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "x string, y string, date int, p_x double, p_y double")
    got = [r.hr for r in pairs.kalman_hedge(df, 0.01, 0.02, constant=True, state_mean=0.1, drift=0.001).orderBy("date").collect()]
    state, cov = np.full((2, 1), 0.1), np.full((2, 2), 0.01)
    for i in range(60):
        cov = cov + 0.001 * np.eye(2) * (i > 0)
        h = np.array([[1.0, x[i]]])
        gain = cov @ h.T / (h @ cov @ h.T + 0.02)
        state = state + gain * (y[i] - h @ state)
        cov = (np.eye(2) - gain @ h) @ cov
        assert got[i] == pytest.approx(state[1, 0])
    assert got[-1] == pytest.approx(1.5, abs=0.2)


def test_rolling_factor_alpha_is_each_window_alone(spark):
    from sparkpanel.plans import research as plans

    df = plans.excess(spark, DATA).withColumn("rf", F.lit(0.001))
    got = {(r.name, r.date): (r.coefficient, r.t) for r in research.factor_alpha(df, ["name"], "ret", "FF3", window=36).filter("term = 'alpha'").collect()}
    rows = df.filter("name = 3 and x is not null").orderBy("date").select("date", "x", "mkt_rf", "smb", "hml").toPandas().dropna()
    assert len([k for k in got if k[0] == 3]) == len(rows) - 35
    for end in (36, 50, len(rows)):
        part = rows.iloc[end - 36 : end]
        beta, t, _ = research.hac_ols(np.column_stack([np.ones(36), part[["mkt_rf", "smb", "hml"]]]), part["x"].to_numpy())
        assert got[3, rows["date"].iloc[end - 1]] == (pytest.approx(beta[0]), pytest.approx(t[0]))


def test_values_of_queries_without_sql(spark):
    """Sorts by p-value, models, searches and selections against pandas or a second way."""
    from sparkpanel.plans import forecasts, portfolios, recommendations

    ports = portfolios.single(spark, DATA).select("sig_rank", "port_r").toPandas().dropna()
    for r in portfolios.g5p(spark, DATA).collect():
        v = ports[ports["sig_rank"] == r.sig_rank]["port_r"]
        t = v.mean() / v.std() * np.sqrt(len(v))
        assert r.t == pytest.approx(t, abs=1e-6) and r.p == pytest.approx(portfolio.incomplete_beta((len(v) - 1) / 2, 0.5, (len(v) - 1) / (len(v) - 1 + t * t)), abs=1e-6)
    found = {r.sig for r in portfolios.g16_p(spark, DATA).collect()}
    assert found == {r.sig for r in portfolios._sweep(spark, DATA).filter("sig_rank = 'high_minus_low' and p <= 0.05 and abs(mean) > 0.0001").collect()}
    frame = forecasts.frame(spark, DATA).toPandas()
    assert forecasts.J.univariate_scores(forecasts.frame(spark, DATA), ["mom"], "y").first().f == pytest.approx((lambda c, n: c * c / (1 - c * c) * (n - 2))(frame["mom"].corr(frame["y"]), len(frame)))
    predicted = forecasts.j11(spark, DATA).toPandas()
    first = predicted[predicted["fold"] == 0]
    months = sorted(frame["date"].unique())
    train, test = frame[frame["date"].isin(months[:36])], frame[frame["date"].isin(months[36:48])].sort_values(["name", "date"])
    fill = train[forecasts.FEATURES].mean()
    design = lambda d: np.column_stack([np.ones(len(d)), d[forecasts.FEATURES].fillna(fill)])
    beta = np.linalg.lstsq(design(train), train["y"], rcond=None)[0]
    assert first.sort_values(["name", "date"])["prediction"].to_numpy() == pytest.approx(design(test) @ beta, rel=1e-4, abs=1e-6)
    errors = recommendations.l6(spark, DATA).collect()
    assert len(errors) == 5 and all(0 < e.mae <= e.rmse < 3 for e in errors)  # ratings run from 0.1 to 5
    importance = forecasts.j16(spark, DATA).collect()
    assert sum(r["mean"] for r in importance) == pytest.approx(1)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    values = {"a": np.round(rng.normal(size=20_001), 2), "e": rng.normal(size=826), "f": rng.normal(size=37), "b": np.zeros(50), "c": np.array([1.0]), None: rng.exponential(size=1000)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("d", None)]
    ps = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    got = {r.k: r for r in quantiles.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", ps).collect()}
    assert got.keys() == values.keys()
    for k, v in values.items():
        assert got[k].n == len(v) and got[k].q == pytest.approx(np.quantile(v, ps))


def test_running_total_over_a_whole_table(spark):
    rows = [(i, (i * 7919) % 101, i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k int, v long")
    got = {r.id: r.upto for r in ranking.running_total(df, F.col("k"), [F.col("k"), F.col("id")], F.col("v"), "upto").collect()}
    total = 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v
        assert got[i] == total


def test_null_keys_and_nan_conditions(spark):
    facts = spark.createDataFrame([(None, 5), ("a", 5)], "k string, t int")
    history = spark.createDataFrame([(None, 1, 10), ("a", 2, 20)], "k string, e int, v int")
    assert [(r.k, r.v) for r in etl.asof_join(facts, history, ["k"], "t", "e", ["v"]).collect()] == [("a", 20)]
    df = spark.createDataFrame([(n, 1, float(i), 0.1 * i, float("nan") if i == 3 else 1.0 * i) for i, n in enumerate("abcdef")], "name string, date int, s double, r double, c double")
    ports = portfolio.sort_portfolios(df, "s", "r", 1, condition="c", n_condition=1, members=True).filter("sig_rank = '1'").first()
    assert ports.n_assets == 5 and "d" not in ports.members


def test_enrichment_edges(spark):
    df = spark.createDataFrame([("x", 5.0, 0.0, "0.010", "BTCUP"), ("y", None, 2.0, None, "ETHUSDT"), (None, -1.0, -2.0, "1", "INCHUSDT")], "k string, a double, b double, tick string, s string")
    got = df.select("k", enrich.illiquidity("a", "b").alias("i"), enrich.spread_pct("a", "b").alias("p"), enrich.step_precision("tick").alias("d"), enrich.threshold_position("a", 2).alias("t")).collect()
    assert [tuple(r) for r in got] == [("x", None, -2.0, 2, 1), ("y", None, None, 0, 0), (None, -0.5, pytest.approx(0.6666666), 0, 0)]
    assert [r.base for r in enrich.symbol_filter(df, "s", "([A-Z]{2,})USDT", exclude=("ETH",), repair={"INCH": "1INCH"}).collect()] == ["1INCH"]
    assert enrich.report_date(spark.createDataFrame([("ab", None, None), ("cd", 1, None)], "key string, p int, q int"), ["p", "q"], "key", 1).collect()[0].key == "c"
    assert enrich.min_history(df, 2, ["k"]).count() == 0 and enrich.liquidity_screen(df, {"a": 0}, ("k",)).count() == 1


def test_package_works_without_its_corpus_part(tmp_path):
    """queries() and oracle_sql() in a copy without the llm folders, as someone may take it."""
    root = Path(__file__).resolve().parents[1]
    for name in ("sparkpanel", "__spark_entry__.py", "corpus_pipeline.py"):
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(s) <= set(q) and not any(n.startswith('op') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0


def test_folds_never_look_ahead(spark):
    df = fixtures.stock_panel(spark, DATA)
    rows = forecast.walk_forward_folds(df, 36, 12, 18, moving=False).collect()
    ends = {r.fold: r.to_index for r in rows if r.role == "train"}
    assert rows and all(r.from_index > ends[r.fold] for r in rows if r.role == "validate") and all(r.from_index == 0 for r in rows if r.role == "train")
    with pytest.raises(ValueError):
        forecast.train_test_split(df, -12)


def test_predictions_cover_every_month_after_the_first_training(spark):
    from sparkpanel.plans import forecasts

    df = forecasts.frame(spark, DATA)
    months = sorted(r.date for r in df.select("date").distinct().collect())
    out = forecasts.j11(spark, DATA).groupBy("date").agg(F.countDistinct("fold").alias("n")).collect()
    assert sorted(r.date for r in out) == months[36:] and {r.n for r in out} == {1}


def test_asof_never_looks_ahead(spark):
    fact = spark.createDataFrame([("a", 1, "f1"), ("a", 5, "f2"), ("a", 7, "f3"), ("b", 9, "f4")], "k string, d int, id string")
    hist = spark.createDataFrame([("a", 5, 50), ("a", 6, 60), ("a", 6, 61), ("c", 1, 10)], "k string, e int, v int")
    assert sorted((r.id, r.v) for r in etl.asof_join(fact, hist, ["k"], "d", "e", ["v"]).collect()) == [("f2", 50), ("f3", 61)]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2001), (2, None, 2002)], "ID int, Name string, year int")
    tables.write_table(df, f"{tmp_path}/t", by=["year"])
    assert tables.read_panel(spark, f"{tmp_path}/t", F.col("year") == 2001, ["ID"]).collect()[0].ID == 1
    for y in (2001, 2002):
        df.filter(F.col("year") == y).write.parquet(f"{tmp_path}/y{y}")
    assert tables.read_yearly(spark, f"{tmp_path}/y{{year}}", 2001, 2002).count() == 2
    assert tables.read_source(spark, "parquet", f"{tmp_path}/t").columns == ["id", "name", "year"]
    tables.write_csv(df, f"{tmp_path}/c", "Name")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 1
    (tmp_path / "f.csv").write_text("made by hand\nMonth, Mkt , RF\n200101, 1.5, -99.99\n 200102 ,2,0.1\n\nCopyright 2001\n")
    rows = tables.read_csv_table(spark, str(tmp_path / "f.csv"), "month int, mkt double, rf double", 2).collect()
    assert [tuple(r) for r in rows] == [(200101, 1.5, -99.99), (200102, 2.0, 0.1)]
    (tmp_path / "several").mkdir()
    for k in range(3):
        (tmp_path / "several" / f"{k}.csv").write_text(f"200{k}00,9,9\n{k},8,8\n" + "".join(f"20{k}00{i},{i},0.5\n" for i in range(1, 4)) + "end\n")
    rows = tables.read_csv_table(spark, f"{tmp_path}/several", "month int, mkt double, rf double", 2).collect()
    assert sorted((r.month, r.mkt) for r in rows) == [(200000 + 1000 * k + i, float(i)) for k in range(3) for i in range(1, 4)]
    for k in range(2):
        tables.append_result(spark, f"{tmp_path}/log", "run", {"k": k}, {"sharpe": 1.5})
    assert {r.parameters for r in spark.read.parquet(f"{tmp_path}/log").collect()} == {'{"k":"0"}', '{"k":"1"}'}


def test_csv_lines_keep_their_order(spark, tmp_path):
    """Long paths outgrow short lines; which of them is broadcast must not show in the rows."""
    for n in (1, 60, 120):
        place = tmp_path / ("x" * n)
        place.mkdir()
        (place / "f.csv").write_text("made by hand\nMonth, Mkt\n200101,1\n200102,2\n200103,3\nend\n")
        rows = tables.read_csv_table(spark, str(place / "f.csv"), "month int, mkt double", 2).collect()
        assert [tuple(x) for x in rows] == [(200101, 1.0), (200102, 2.0), (200103, 3.0)]


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, v double")
    tables.write_jdbc(df, url, "prices", driver="org.apache.derby.jdbc.EmbeddedDriver")
    got = tables.read_jdbc(spark, url, "prices", ["v"], F.col("id") >= 7, ("id", 0, 10, 2), driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted(r.v for r in got.collect()) == [7.0, 8.0, 9.0]


def test_stream_equals_its_batch_twin(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    latest: dict = {}

    def keep(batch, _):
        latest.update({(r.name, r.date): r.volume for r in batch.collect()})

    live.run_available(live.daily_volume(stream, "60 days"), keep, f"{tmp_path}/cp")
    want = {(r.name, r.date): r.volume for r in live.daily_volume(events).collect()}
    assert latest.keys() == want.keys() and all(latest[k] == pytest.approx(want[k]) for k in want)


def test_stream_of_bars_scores_each_batch(spark, tmp_path):
    panel = fixtures.stock_panel(spark, DATA).select("name", "date", "ret", "mkt")
    panel.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream, got = spark.readStream.schema(panel.schema).parquet(f"{tmp_path}/in"), []
    live.run_available(stream, lambda b, _: got.extend(live.scheduled_signal(b, "ret", "mkt", 3, 300.0).collect()), f"{tmp_path}/cp", "append")
    want = live.scheduled_signal(panel, "ret", "mkt", 3, 300.0).collect()
    assert {(r.name, r.target) for r in got} == {(r.name, r.target) for r in want}


def test_members_that_left_are_those_of_the_lists(spark):
    import random

    rng = random.Random(5)
    rows = [(t, n, rng.choice([1, 2])) for t in range(1, 9) for n in "abcdefgh" if rng.random() < 0.7 and not (t in (4, 5) and n in "ab")]
    got = {(r.sig_rank, r.date, r.name) for r in portfolio.members_that_left(spark.createDataFrame(rows, "date int, name string, sig_rank int"), ["sig_rank"]).collect()}
    want = set()
    for bucket in (1, 2):
        times = sorted({t for t, _, b in rows if b == bucket})
        for was, now in zip(times, times[1:], strict=False):
            want |= {(bucket, now, n) for t, n, b in rows if b == bucket and t == was} - {(bucket, now, n) for t, n, b in rows if b == bucket and t == now}
    assert got == want and len(want) > 5
