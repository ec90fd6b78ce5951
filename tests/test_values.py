"""Values of queries without SQL, worked out again in numpy from the same panel."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import eda, forecast
from sparkpanel.plans import fixtures, forecasts, portfolios, quality_reports, research

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    return fixtures.stock_panel(spark, DATA).toPandas()


def robust(x, y, lags=3):
    """Coefficients and Bartlett-kernel t statistics, term by term."""
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    u = x * (y - x @ beta)[:, None]
    s = sum(np.outer(u[t], u[t]) for t in range(len(y)))
    for k in range(1, lags + 1):
        s = s + (1 - k / (lags + 1)) * sum(np.outer(u[t], u[t - k]) + np.outer(u[t - k], u[t]) for t in range(k, len(y)))
    return beta, beta / np.sqrt(np.diag(inverse @ s @ inverse))


def test_uni_sort(spark):
    got = {r.sig_rank: r for r in research.h4(spark, DATA).collect()}
    ports = portfolios.single(spark, DATA).toPandas()
    market = {r.date: r.mkt_rf for r in research.factors(spark, DATA).collect()}
    assert got.keys() == set(ports.sig_rank)
    for rank, part in ports.groupby("sig_rank"):
        r = part.dropna(subset=["port_r"]).sort_values("date")
        mean, std, n = r.port_r.mean(), r.port_r.std(), len(r)
        assert got[rank].mean == pytest.approx(mean) and got[rank].t == pytest.approx(mean * math.sqrt(n) / std)
        r = r[[d in market and market[d] == market[d] for d in r.date]]
        beta, t = robust(np.column_stack([np.ones(len(r)), [market[d] for d in r.date]]), r.port_r.to_numpy())
        assert got[rank].alpha == pytest.approx(beta[0]) and got[rank].alpha_t == pytest.approx(t[0])


def test_double_sort_cross_sections(spark, panel):
    got = {(r.bucket, r.term): r for r in research.h7(spark, DATA).collect()}
    df = panel.sort_values(["name", "date"])
    df["next_r"] = df.groupby("name").ret.shift(-1)
    df["bucket"] = 1 + (df.prc > df.groupby("date").prc.transform("median")).astype(int)
    for bucket, part in df.dropna(subset=["next_r"]).groupby("bucket"):
        coefficients = []
        for _, day in sorted(part.groupby("date")):
            if len(day) > 2:
                coefficients.append(np.linalg.lstsq(np.column_stack([np.ones(len(day)), day.vol]), day.next_r.to_numpy(), rcond=None)[0])
        for j, term in enumerate(("const", "vol")):
            b = np.array([c[j] for c in coefficients])
            d = b - b.mean()
            variance = d @ d + sum(2 * (1 - k / 6) * (d[k:] @ d[:-k]) for k in range(1, 6))
            assert got[bucket, term].coefficient == pytest.approx(b.mean(), rel=1e-6)
            assert got[bucket, term].t == pytest.approx(b.mean() * len(b) / math.sqrt(variance), rel=1e-5)


@pytest.mark.parametrize("most", [0.05, 0.2, 0.4, 0.6, 0.8])
def test_correlated_columns_are_dropped_by_the_scan(spark, panel, most):
    columns, target = ["prc", "bid", "ask", "vol", "vol_d", "mktcap"], "ret"
    c = panel[[target, *columns]].astype(float).corr()
    gone = set()
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            if a not in gone and abs(c.loc[a, b]) > most:
                gone.add(a if c.loc[target, a] <= c.loc[target, b] else b)
    left = [x for x in columns if x not in gone]
    assert eda.drop_correlated(fixtures.stock_panel(spark, DATA), target, columns, most) == left
    assert most > 0.2 or gone
    if most == 0.8:
        assert quality_reports.j19_scan(spark, DATA).columns == ["name", "date", *left]


def test_family_error_keeps_features_of_small_p(spark):
    df = forecasts.frame(spark, DATA).toPandas()
    p = {}
    for f in forecasts.FEATURES:
        full = df[[f, "y"]].dropna().astype(float)
        r, k = np.corrcoef(full[f], full.y)[0, 1], len(full) - 2
        # the tail of the t distribution by its density
        t = abs(r) * math.sqrt(k / (1 - r * r))
        grid = np.linspace(t, t + 60, 600_001)
        density = np.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi) * (1 + grid * grid / k) ** (-(k + 1) / 2)
        p[f] = 2 * float(((density[1:] + density[:-1]) / 2).sum() * (grid[1] - grid[0]))
    scores = {r.feature: r for r in forecast.univariate_scores(forecasts.frame(spark, DATA), forecasts.FEATURES, "y").collect()}
    assert all(scores[f].p == pytest.approx(p[f], rel=1e-4, abs=1e-9) for f in p)
    assert set(forecasts.j20_family(spark, DATA).columns) == {"name", "date", *[f for f in p if p[f] < 0.05 / len(p)]}


def test_feature_stages(spark):
    df = forecasts.frame(spark, DATA).orderBy("name", "date")
    x = np.array([[r[f] for f in forecasts.FEATURES] for r in df.collect()], float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b, c = x.T
    expanded = np.column_stack([a, a * a, b, a * b, b * b, c, a * c, b * c, c * c])
    expanded = expanded[:, expanded.var(axis=0, ddof=1) > 1e-6]
    _, vectors = np.linalg.eigh(np.cov(expanded.T))
    want = expanded @ vectors[:, ::-1][:, :2]
    got = np.array([r.components for r in forecasts.j20(spark, DATA).orderBy("name", "date").collect()])
    for k in range(2):  # a component's sign is free
        assert np.allclose(got[:, k], want[:, k] * np.sign(got[:, k] @ want[:, k]), atol=1e-6)


def test_permutation_importance_of_what_matters_and_what_does_not(spark):
    df = forecasts.frame(spark, DATA).withColumn("noise", F.rand(5)).withColumn("y", 2 * F.col("mom") + 0.01 * F.rand(6)).persist()
    model = forecast.model_pipeline("linear", ["mom", "noise"], "y").fit(df)
    got = {r.feature: r for r in forecast.permutation_importance(model, df, ["mom", "noise"], "y", repeats=3).collect()}
    assert got["mom"].drop > 0.8 and abs(got["noise"].drop) < 0.01 and got["mom"].deviation < 0.2
    df.unpersist()


def test_equal_prices_in_any_order_of_lines(spark, tmp_path):
    """Suppliers with the same lines in another order have the same price: one bucket (f3_qcut), one value (k2_info)."""
    from pyspark.sql import types as T

    from sparkpanel.plans import registry

    prices = [0.1, 0.2, 0.3, 1e5 + 0.7, 3333.33, 2.05, 71234.56]
    lines = [(s, 2.0, p, f"1996-0{m}-01 00:00:00") for s in range(12) for m in (1, 2) for p in prices[s % 7 :] + prices[: s % 7]]
    df = spark.createDataFrame(lines, "l_suppkey long, l_quantity double, l_extendedprice double, d string").select("l_suppkey", "l_quantity", "l_extendedprice", F.col("d").cast(T.TimestampType()).alias("l_shipdate"))
    df.repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    queries = registry.queries()
    assert {r.bucket for r in queries["f3_qcut"](spark, str(tmp_path)).collect()} == {1}
    info = {r.column: r for r in queries["k2_info"](spark, str(tmp_path)).collect()}
    assert info["prc"].distinct == 1 and info["ret"].distinct == 1




@pytest.mark.parametrize("most", [1, 256])
def test_similar_items_take_common_terms_as_a_matrix(spark, monkeypatch, most):
    """l2_similar_items: texts come as lists (no row a term is shuffled), and whichever terms are in the matrix, similarities are those of all pairs."""
    from sparkpanel.operators import recommend

    monkeypatch.setattr(recommend, "DENSE_TERMS", most)
    rng = random.Random(8)
    texts = [(i, " ".join(f"w{min(int(rng.expovariate(0.15)), 40)}" for _ in range(rng.randrange(0, 30)))) for i in range(300)] + [(300, None), (301, "... a")]
    docs = spark.createDataFrame(texts, "item int, text string").repartition(3)
    lists = recommend.tfidf(docs, "item", "text", listed=True)
    weight = {}
    for r in recommend.tfidf(docs, "item", "text").collect():
        weight.setdefault(r.item, {})[r.term] = r.weight
    assert {r.item: dict(zip(r.terms, r.weights, strict=True)) for r in lists.collect() if r.terms} == weight
    queries = docs.filter("item % 50 = 0").select("item")
    got = {}
    for r in recommend.similar_items(lists, "item", queries, 4).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((round(r.similarity, 9), r["item"]))
    for q in range(0, 301, 50):
        sums = {i: sum(x * w.get(t, 0.0) for t, x in weight.get(q, {}).items()) for i, w in weight.items() if i != q}
        want = sorted((-round(v, 9), i) for i, v in sums.items() if v > 0)[:4]
        assert [i for _, i in got.get(q, [])] == [i for _, i in want] and all(abs(a + b) < 2e-9 for (a, _), (b, _) in zip(got.get(q, []), want, strict=True))


def test_similar_items_in_passes_and_ties(spark, monkeypatch):
    """A pass for each few queries and blocks of few items give what all pairs give; ties go to the smaller item, pairs are never shuffled."""
    from sparkpanel.operators import recommend

    monkeypatch.setattr(recommend, "PASS_TERMS", 5)
    rows = [(i, t, 1.0 / (1 + (i // 3 + t) % 4)) for i in range(30) for t in range(4) if (i // 3 + t) % 3]
    df = spark.createDataFrame([(i, f"t{t}", w) for i, t, w in rows], "item int, term string, weight double")
    got = {}
    for r in recommend.similar_items(df, "item", spark.createDataFrame([(0,), (7,), (29,), (99,)], "item int"), 4).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.item, round(r.similarity, 9)))
    of = {}
    for i, t, w in rows:
        of.setdefault(i, {})[t] = w
    for q in (0, 7, 29):
        dots = [(-round(sum(w * of[q].get(t, 0) for t, w in of[i].items()), 9), i) for i in of if i != q and of[q].keys() & of[i].keys()]
        assert got[q] == [(i, -s) for s, i in sorted(dots)[:4]]
    assert 99 not in got


def test_fits_read_a_written_frame(spark):
    """Models are fitted on a table of their own, not on the panel made from all lines again and again."""
    data = "/root/testdata/sf0.001"
    kept = forecasts._kept(spark, data)
    assert kept.count() == forecasts.frame(spark, data).count() and all("/frame-" in f for f in kept.inputFiles())
    assert all("/frame-" in f for f in forecasts._line(spark, data)[1].inputFiles())


def test_tfidf_of_common_and_other_terms(spark, monkeypatch):
    """l1_tfidf: the same weights with all terms, a few or none in the head; several texts of a key are one, a null text counts as a document."""
    from sparkpanel.operators import recommend

    monkeypatch.setattr(recommend, "TEXTS", 3)
    monkeypatch.setattr(recommend, "HEAD_LENGTH", 6)
    words = ["the", "Alpha", "beta", "gamma7", "x", "\u00c4rger", "elephants", "z9"]
    texts = [(i, None if i == 5 else "" if i == 6 else " ".join(words[(i * k) % len(words)] for k in range(1, 3 + i)) + f" own{i}") for i in range(12)] + [(3, "beta, beta once"), (None, "alpha lost")]
    want, tf = {}, {}
    for key, text in texts:
        for w in re.split(r"[\W_]+", (text or "").lower()):
            if len(w) >= 2 and w not in recommend.STOP_WORDS:
                tf.setdefault(key, {}).setdefault(w, 0)
                tf[key][w] += 1
    df = {w: sum(w in t for t in tf.values()) for t in tf.values() for w in t}
    for key, t in tf.items():
        each = {w: c * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, c in t.items()}
        want |= {(key, w): x / math.sqrt(sum(y * y for y in each.values())) for w, x in each.items() if key is not None}
    for head in (0, 3, 1000):
        monkeypatch.setattr(recommend, "HEAD_TERMS", head)
        for rows in (texts, [t for t in texts if t[1] is None]):
            got = recommend.tfidf(spark.createDataFrame(rows, "item long, text string"), "item", "text").collect()
            assert len({(r.item, r.term) for r in got}) == len(got)
            assert {(r.item, r.term): r.weight for r in got} == (pytest.approx(want) if rows is texts else {})
