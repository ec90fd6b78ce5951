"""Queries of asset-pricing research."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio as P
from ..operators import ranking as K
from ..operators import research as H
from ..operators import sections as C
from .fixtures import PANEL, AX, day, over, r, stock_panel, table
from .portfolios import DEPENDENT, N, _ports, momentum, single
from .registry import register


def factors(spark, sf_dir):
    """Monthly market, size and price factors of the panel."""
    df = stock_panel(spark, sf_dir)
    half = lambda c: F.ntile(2).over(AX.section().orderBy(c, "name"))
    df = df.withColumn("big", half("mktcap")).withColumn("dear", half("prc"))
    gap = lambda c: F.avg(F.when(F.col(c) == 1, F.col("ret"))) - F.avg(F.when(F.col(c) == 2, F.col("ret")))
    return df.groupBy("date").agg((F.avg("ret") - 0.001).alias("mkt_rf"), gap("big").alias("smb"), gap("dear").alias("hml")).filter("mkt_rf is not null")


def excess(spark, sf_dir):
    return stock_panel(spark, sf_dir).withColumn("x", F.col("ret") - 0.001).join(factors(spark, sf_dir), "date")


@register("h1_average_acf", f"""{PANEL}, d AS (SELECT name, date, ret-avg(ret) OVER (PARTITION BY name) AS d FROM panel WHERE ret IS NOT NULL),
 l AS (SELECT name, d, lead(d,1) OVER w AS a, lead(d,2) OVER w AS b, lead(d,3) OVER w AS c FROM d WINDOW w AS (PARTITION BY name ORDER BY date)), e AS (SELECT name, sum(d*a)/sum(d*d) AS k1, sum(d*b)/sum(d*d) AS k2, sum(d*c)/sum(d*d) AS k3 FROM l GROUP BY 1)
 SELECT 1 AS lag, round(avg(k1),6) AS acf FROM e UNION ALL SELECT 2, round(avg(k2),6) FROM e UNION ALL SELECT 3, round(avg(k3),6) FROM e""")
def h1(spark, sf_dir):
    return H.average_acf(stock_panel(spark, sf_dir), "ret", 3).select("lag", r("acf").alias("acf"))


@register("h2_summarize_signal", f"""{PANEL}, p AS (SELECT * FROM panel WHERE ret IS NOT NULL), a AS (SELECT avg(m) AS m, avg(s) AS s FROM (SELECT avg(ret) AS m, stddev_samp(ret) AS s FROM p GROUP BY date)), b AS (SELECT avg(m) AS m, avg(s) AS s FROM (SELECT avg(ret) AS m, stddev_samp(ret) AS s FROM p GROUP BY name))
 SELECT count(DISTINCT date) AS times, count(DISTINCT name) AS names, count(*) AS n, round(avg(ret),6) AS mean_pooled, round(stddev_samp(ret),6) AS std_pooled, round(quantile_cont(ret,0.25),6) AS q25, round(quantile_cont(ret,0.5),6) AS q50, round(quantile_cont(ret,0.75),6) AS q75,
 round((SELECT m FROM a),6) AS mean_section, round((SELECT s FROM a),6) AS std_section, round((SELECT m FROM b),6) AS mean_series, round((SELECT s FROM b),6) AS std_series FROM p""")
def h2(spark, sf_dir):
    out = H.summarize_signal(stock_panel(spark, sf_dir), "ret")
    return out.select(*[c if c in ("times", "names", "n") else r(c).alias(c) for c in out.columns])


@register("h3_summarize_variables", f"""{PANEL}, l AS (SELECT 'prc' AS variable, prc AS v FROM panel UNION ALL SELECT 'ret', ret FROM panel) SELECT variable, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS std, round(quantile_cont(v,0.1),6) AS q10, round(quantile_cont(v,0.9),6) AS q90 FROM l GROUP BY 1""")
def h3(spark, sf_dir):
    out = H.summarize_variables(stock_panel(spark, sf_dir), ["prc", "ret"], [0.1, 0.9])
    return out.select("variable", *[r(c).alias(c) for c in out.columns[1:]])


FACTORS = f"""{PANEL}, k AS (SELECT *, ntile(2) OVER (PARTITION BY date ORDER BY mktcap, name) AS big, ntile(2) OVER (PARTITION BY date ORDER BY prc, name) AS dear FROM panel), fa AS (SELECT date, avg(ret)-0.001 AS mkt_rf FROM k GROUP BY 1 HAVING avg(ret) IS NOT NULL)"""


@register("g7_sort_alpha")
def g7(spark, sf_dir):
    ports = single(spark, sf_dir).withColumn("x", F.col("port_r") - F.when(F.col("sig_rank") == P.LONG_SHORT, 0.0).otherwise(0.001))
    return H.factor_regression(ports.join(factors(spark, sf_dir), "date"), ["sig_rank"], "x", ["mkt_rf", "smb", "hml"])


@register("g7_sort_capm", f"""{_ports()}, k2 AS (SELECT date, avg(ret)-0.001 AS mkt_rf FROM panel GROUP BY 1 HAVING avg(ret) IS NOT NULL), x AS (SELECT sig_rank, port_r-CASE WHEN sig_rank='high_minus_low' THEN 0.0 ELSE 0.001 END AS x, mkt_rf FROM s JOIN k2 USING (date) WHERE port_r IS NOT NULL)
 SELECT sig_rank, round(regr_intercept(x, mkt_rf),6) AS alpha, round(regr_slope(x, mkt_rf),6) AS beta FROM x GROUP BY 1""")
def g7_capm(spark, sf_dir):
    """Alphas and betas of the sorts by the regression of ``g7_sort_alpha`` on the market alone."""
    ports = single(spark, sf_dir).withColumn("rf", F.when(F.col("sig_rank") == P.LONG_SHORT, 0.0).otherwise(0.001))
    out = H.factor_alpha(ports.join(factors(spark, sf_dir), "date"), ["sig_rank"], "port_r", "CAPM")
    pick = lambda t: F.max(F.when(F.col("term") == t, F.col("coefficient")))
    return out.groupBy("sig_rank").agg(r(pick("alpha")).alias("alpha"), r(pick("mkt_rf")).alias("beta"))


@register("g10_capm_alpha", f"{FACTORS} SELECT name, round(regr_intercept(ret-0.001, mkt_rf),6) AS alpha, round(regr_slope(ret-0.001, mkt_rf),6) AS beta FROM panel JOIN fa USING (date) GROUP BY 1")
def g10(spark, sf_dir):
    return excess(spark, sf_dir).groupBy("name").agg(r(F.regr_intercept("x", "mkt_rf")).alias("alpha"), r(F.regr_slope("x", "mkt_rf")).alias("beta"))


@register("g10_rolling_capm", f"{FACTORS}, j AS (SELECT name, date, ret-0.001 AS x, mkt_rf FROM panel JOIN fa USING (date)) SELECT name, strftime(date,'%Y-%m-%d') AS date, CASE WHEN count(x) {over(-23, 0)}=24 THEN round(regr_intercept(x, mkt_rf) {over(-23, 0)},6) END AS alpha FROM j")
def g10_rolling(spark, sf_dir):
    w = AX.rows(-23, 0)
    return excess(spark, sf_dir).select("name", day().alias("date"), F.when(F.count("x").over(w) == 24, r(F.regr_intercept("x", "mkt_rf").over(w))).alias("alpha"))


@register("g10_factor_alpha")
def g10_factor(spark, sf_dir):
    return H.factor_alpha(excess(spark, sf_dir).withColumn("rf", F.lit(0.001)), ["name"], "ret", "FF3")


@register("g10_rolling_factor_alpha")
def g10_rolling_factor(spark, sf_dir):
    """Alphas of the three-factor model over rolling windows of 36 months."""
    return H.factor_alpha(excess(spark, sf_dir).withColumn("rf", F.lit(0.001)), ["name"], "ret", "FF3", window=36).filter("term = 'alpha'")


@register("g10_rolling_capm_robust", f"{FACTORS}, j AS (SELECT name, date, ret-0.001 AS x, mkt_rf FROM panel JOIN fa USING (date) WHERE ret IS NOT NULL) SELECT name, strftime(date,'%Y-%m-%d') AS date, round(regr_intercept(x, mkt_rf) {over(-23, 0)},6) AS alpha, round(regr_slope(x, mkt_rf) {over(-23, 0)},6) AS beta FROM j QUALIFY count(x) {over(-23, 0)}=24")
def g10_rolling_robust(spark, sf_dir):
    """The same windows by the general rolling regression."""
    out = H.rolling_factor_arrays(excess(spark, sf_dir), ["name"], "x", list(H.MODELS["CAPM"]), 24)
    return out.select("name", day().alias("date"), *[r(F.col("coefficient")[i]).alias(c) for i, c in enumerate(("alpha", "beta"))])


@register("h4_uni_sort_alpha", f"""{_ports()}, k2 AS (SELECT date, avg(ret)-0.001 AS mkt_rf FROM panel GROUP BY 1 HAVING avg(ret) IS NOT NULL)
 SELECT sig_rank, round(avg(port_r),6) AS mean, round(avg(port_r)*sqrt(count(*))/nullif(stddev_samp(port_r),0),6) AS t, round(any_value(alpha),6) AS alpha FROM s JOIN (SELECT sig_rank, regr_intercept(port_r, mkt_rf) AS alpha FROM s JOIN k2 USING (date) WHERE port_r IS NOT NULL GROUP BY 1) a USING (sig_rank) WHERE port_r IS NOT NULL GROUP BY 1""")
def h4_alpha(spark, sf_dir):
    return h4(spark, sf_dir).select("sig_rank", *[r(c).alias(c) for c in ("mean", "t", "alpha")])


@register("h4_uni_sort")
def h4(spark, sf_dir):
    ports = single(spark, sf_dir)
    alphas = H.factor_regression(ports.join(factors(spark, sf_dir), "date"), ["sig_rank"], "port_r", ["mkt_rf"]).filter("term = 'alpha'")
    return P.sort_return(ports, 1, 12.0).select("sig_rank", "mean", "t").join(alphas.select("sig_rank", F.col("coefficient").alias("alpha"), F.col("t").alias("alpha_t")), "sig_rank")


@register("h5_double_sort_means", f"""{DEPENDENT}, b AS (SELECT cond_rank::INTEGER AS cond_rank, sig_rank, date, port_r, n_assets FROM s UNION ALL SELECT 0, sig_rank, date, avg(port_r), sum(n_assets) FROM s GROUP BY sig_rank, date)
 SELECT cond_rank, sig_rank, round(avg(port_r),6) AS mean, round(avg(port_r)*sqrt(count(*))/nullif(stddev_samp(port_r),0),6) AS t, count(*) AS n FROM b WHERE port_r IS NOT NULL GROUP BY 1,2""")
def h5_means(spark, sf_dir):
    return h5(spark, sf_dir).select(F.col("cond_rank").cast("int").alias("cond_rank"), "sig_rank", r("mean").alias("mean"), r("t").alias("t"), "n")


@register("h5_double_sort")
def h5(spark, sf_dir):
    ports = P.sort_portfolios(momentum(spark, sf_dir), "mom", "next_r", N, "mktcap", "prc", 3, dependent=True)
    both = ports.unionByName(ports.groupBy("date", "sig_rank").agg(F.avg("port_r").alias("port_r"), F.sum("n_assets").alias("n_assets")).withColumn("cond_rank", F.lit(0)), allowMissingColumns=True)
    return P.sort_return(both, 1, 12.0, keys=("cond_rank", "sig_rank"))


ONE = f"""{PANEL}, m AS (SELECT *, lead(ret) OVER (PARTITION BY name ORDER BY date) AS next_r FROM panel), c AS (SELECT date, regr_slope(next_r, vol) AS b, regr_intercept(next_r, vol) AS a FROM m WHERE next_r IS NOT NULL GROUP BY date HAVING count(*) > 2)"""


@register("h6_fama_macbeth", f"{ONE} SELECT 'vol' AS term, round(avg(b),6) AS coefficient, count(*) AS n FROM c UNION ALL SELECT 'const', round(avg(a),6), count(*) FROM c")
def h6(spark, sf_dir):
    df = stock_panel(spark, sf_dir).withColumn("next_r", F.lead("ret").over(AX.history()))
    return H.fama_macbeth(df, "next_r", ["vol"]).select("term", r("coefficient").alias("coefficient"), "n")


@register("h6_fama_macbeth_t")
def h6_t(spark, sf_dir):
    df = stock_panel(spark, sf_dir).withColumn("next_r", F.lead("ret").over(AX.history())).withColumn("size", F.log("mktcap"))
    return H.fama_macbeth(df, "next_r", ["vol", "size"])


@register("h7_double_sort_coefficients", f"""{PANEL}, m AS (SELECT *, lead(ret) OVER (PARTITION BY name ORDER BY date) AS next_r FROM panel), e AS (SELECT date, median(prc) AS q FROM panel GROUP BY date), b AS (SELECT m.*, CASE WHEN prc > q THEN 2 ELSE 1 END AS bucket FROM m JOIN e USING (date)),
 c AS (SELECT bucket, date, regr_slope(next_r, vol) AS b, regr_intercept(next_r, vol) AS a FROM b WHERE next_r IS NOT NULL GROUP BY 1,2 HAVING count(*) > 2) SELECT bucket::INTEGER AS bucket, 'vol' AS term, round(avg(b),6) AS coefficient, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT bucket, 'const', round(avg(a),6), count(*) FROM c GROUP BY 1""")
def h7_coefficients(spark, sf_dir):
    return h7(spark, sf_dir).select(F.col("bucket").cast("int").alias("bucket"), "term", r("coefficient").alias("coefficient"), "n")


@register("h7_double_sort_fm")
def h7(spark, sf_dir):
    df = K.qcut_rank(stock_panel(spark, sf_dir).withColumn("next_r", F.lead("ret").over(AX.history())), "prc", 2)
    return H.fama_macbeth(df, "next_r", ["vol"], keys=["bucket"])


@register("h8_factor_clean", "WITH f AS (SELECT ' '||strftime(o_orderdate,'%Y%m') AS d, CASE WHEN o_orderkey % 7=0 THEN -99.99 ELSE round(o_totalprice/1e5,2) END AS smb, o_orderkey FROM orders) SELECT trim(d) AS d, o_orderkey, round(smb/100,6) AS smb FROM f WHERE length(trim(d))=6 AND smb NOT IN (-99.99,-999)")
def h8(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyyMM")).alias("d"), F.when(F.col("o_orderkey") % 7 == 0, -99.99).otherwise(F.round(F.col("o_totalprice") / 1e5, 2)).alias("smb"), F.col("o_orderkey").cast("double").alias("k"))
    out = H.clean_factors(raw, "d", ["smb", "k"], 6)
    return out.select("d", F.round(F.col("k") * 100).cast("long").alias("o_orderkey"), r("smb").alias("smb"))


@register("h9_q_factor_key", "SELECT DISTINCT year(o_orderdate)::VARCHAR||lpad(month(o_orderdate)::VARCHAR,2,'0') AS ym, year(o_orderdate)::VARCHAR||lpad(quarter(o_orderdate)::VARCHAR,1,'0') AS yq FROM orders")
def h9(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(H.q_factor_key(F.year(d), F.month(d)).alias("ym"), H.q_factor_key(F.year(d), F.quarter(d), 1).alias("yq")).distinct()


@register("h10_breakpoints", f"{PANEL} SELECT strftime(date,'%Y-%m-%d') AS date, round(quantile_cont(mktcap/1e6,0.2)*1e6,2) AS p20, round(quantile_cont(mktcap/1e6,0.8)*1e6,2) AS p80 FROM panel GROUP BY 1")
def h10(spark, sf_dir):
    df = stock_panel(spark, sf_dir).withColumn("me", F.col("mktcap") / 1e6)
    return H.breakpoints(df, "me", [0.2, 0.8]).select(day().alias("date"), r("p20", 2).alias("p20"), r("p80", 2).alias("p80"))


@register("h10_breakpoints_ranges", f"{PANEL} SELECT strftime(date,'%Y-%m-%d') AS date, round(quantile_cont(mktcap,0.2),2) AS p20, round(quantile_cont(mktcap,0.8),2) AS p80 FROM panel GROUP BY 1")
def h10_ranges(spark, sf_dir):
    """Breakpoints that gather two rows of a date for each share, for dates larger than a task."""
    placed = C.positions(stock_panel(spark, sf_dir).select("name", "date", "mktcap"), ["date"], "mktcap", "name")
    return C.breakpoints(placed, ["date"], "mktcap", [0.2, 0.8]).select(day().alias("date"), r(F.col("edges")[0], 2).alias("p20"), r(F.col("edges")[1], 2).alias("p80"))


@register("h11_single_regression", f"{PANEL} SELECT round(regr_slope(ret, mkt),6) AS slope, round(regr_intercept(ret, mkt),6) AS intercept, round(regr_r2(ret, mkt),6) AS r2 FROM panel")
def h11(spark, sf_dir):
    return stock_panel(spark, sf_dir).agg(r(F.regr_slope("ret", "mkt")).alias("slope"), r(F.regr_intercept("ret", "mkt")).alias("intercept"), r(F.regr_r2("ret", "mkt")).alias("r2"))


@register("h11_linear_regression")
def h11_ml(spark, sf_dir):
    return H.linear_regression(stock_panel(spark, sf_dir), "ret", ["mkt", "vol"])
