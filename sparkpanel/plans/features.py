"""Queries of rolling and cross-sectional features on the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rolling as R
from ..operators import windows as W
from ..operators import enrich as N
from ..operators.enrich import market_breadth
from ..panel import ratio
from .fixtures import DAYS, KEYS, PANEL, AX, day, day_panel, over, r, stock_panel
from .registry import register


def _column(name: str, make, sql: str, where: str = "true") -> None:
    """One feature x of the panel, beside its SQL expression."""

    @register(name, f"{PANEL} SELECT {KEYS}, round(({sql})::DOUBLE, 6) AS x FROM panel QUALIFY {where}")
    def query(spark, sf_dir):
        out = stock_panel(spark, sf_dir)
        made = make(out)
        out = made if not hasattr(made, "over") else out.withColumn("x", made)
        return out.select("name", day().alias("date"), r("x").alias("x"))


W6, W3 = over(-5, 0), over(-2, 0)
ALL, SO_FAR = "OVER (PARTITION BY name)", over(None, 0)
LN = "CASE WHEN ret > -1 THEN ln(1+ret) END"


def _full(make):
    """The feature on rows with six returns in their frame."""
    return lambda df: df.withColumn("__n", F.count("ret").over(AX.rows(-5, 0))).withColumn("x", make(df)).filter("__n = 6")


FULL = f"count(ret) {W6} = 6"

_column("e1_full_window", lambda df: R.full_window_filter(df, -5, 0).withColumn("x", F.col("prc")), "prc", f"count(*) {W6} >= 6")
_column("e2_sum", lambda df: R.rolling_sum("vol", -5, 0), f"sum(vol) {W6}")
_column("e3_mean", lambda df: R.rolling_mean("prc", -5, 0), f"avg(prc) {W6}")
_column("e4_change", lambda df: R.change("prc", 2, True), "(prc - lag(prc,2) OVER (PARTITION BY name ORDER BY date))/nullif(lag(prc,2) OVER (PARTITION BY name ORDER BY date),0)")
_column("e6_std", _full(lambda df: R.rolling_std("ret", -5, 0)), f"stddev_samp(ret) {W6}", FULL)
_column("e7_skewness", _full(lambda df: R.rolling_skewness("ret", -5, 0)),
        f"(avg(ret*ret*ret) {W6} - 3*avg(ret) {W6}*avg(ret*ret) {W6} + 2*pow(avg(ret) {W6},3))/pow(avg(ret*ret) {W6} - pow(avg(ret) {W6},2),1.5)", FULL)
_column("e8_kurtosis", _full(lambda df: R.rolling_kurtosis("ret", -5, 0)), f"kurtosis_pop(ret) {W6}", FULL)
_column("e9_rsd", lambda df: R.rolling_rsd("prc", -5, 0), f"stddev_samp(prc) {W6}/nullif(avg(prc) {W6},0)")
_column("e10_zscore", lambda df: R.rolling_zscore("prc", -5, 0), f"(prc-avg(prc) {W6})/nullif(stddev_samp(prc) {W6},0)")
_column("e11_section_zscore", lambda df: R.section_zscore("prc"), "(prc-avg(prc) OVER (PARTITION BY date))/nullif(stddev_samp(prc) OVER (PARTITION BY date),0)")
_column("e12_every_nth", lambda df: R.every_nth_row(df, 3).withColumn("x", F.col("prc")), "prc", "row_number() OVER (PARTITION BY name ORDER BY date) % 3 = 0")
_column("e13_wealth", lambda df: R.wealth("ret", -5, 0), f"exp(sum({LN}) {W6})")
_column("e14_contract_return", lambda df: R.contract_return("prc", 1.5), "(100*prc-100*lag(prc) OVER (PARTITION BY name ORDER BY date)-3.0)/nullif(100*lag(prc) OVER (PARTITION BY name ORDER BY date),0)")
_column("e15_cumr", lambda df: R.cumulative_return("ret", -11, -1), f"exp(sum({LN}) {over(-11, -1)})-1")
_column("e17_correlation", _full(lambda df: R.rolling_correlation("ret", "mkt", -5, 0)), f"corr(ret, mkt) {W6}", FULL)
_column("e18_beta", _full(lambda df: R.rolling_beta("ret", "mkt", -5, 0)), f"regr_slope(ret, mkt) {W6}", FULL)
_column("e22_time_series_ratio", lambda df: R.time_series_ratio("vol", -5, 0), f"vol/nullif(avg(vol) {W6},0)")
_column("e27_high_52w", lambda df: ratio(F.col("prc"), R.rolling_max("prc", -12, 0)), f"prc/nullif(max(prc) {over(-12, 0)},0)")
_column("e32_growth", lambda df: R.change("mktcap", 3, True), "(mktcap - lag(mktcap,3) OVER (PARTITION BY name ORDER BY date))/nullif(lag(mktcap,3) OVER (PARTITION BY name ORDER BY date),0)")
_column("e34_pct_change", lambda df: R.change("prc", 1, True), "(prc - lag(prc) OVER (PARTITION BY name ORDER BY date))/nullif(lag(prc) OVER (PARTITION BY name ORDER BY date),0)")
_column("e35_section_weight", lambda df: R.section_weight("prc"), "(1/prc)/sum(1/prc) OVER (PARTITION BY date)")
_column("e37_rolling_ols", lambda df: R.rolling_ols("ret", "mkt", 6), f"CASE WHEN count(ret*mkt) {W6} >= 6 THEN regr_slope(ret, mkt) {W6} END")
_column("e37_rolling_ols_no_constant", lambda df: R.rolling_ols("ret", "mkt", 6, constant=False), f"CASE WHEN count(ret*mkt) {W6} >= 6 THEN sum(ret*mkt) {W6}/nullif(sum(mkt*mkt) {W6},0) END")


@register("e5_acf", f"{PANEL}, l AS (SELECT name, ret, lag(ret) OVER (PARTITION BY name ORDER BY date) AS before FROM panel) SELECT name, round(corr(ret, before), 6) AS acf FROM l GROUP BY name")
def e5(spark, sf_dir):
    df = stock_panel(spark, sf_dir).withColumn("before", F.lag("ret").over(AX.history()))
    return df.withColumn("acf", R.autocorrelation("ret", "before")).groupBy("name").agg(r(F.max("acf")).alias("acf"))


@register("e16_comovement", f"""{PANEL} SELECT {KEYS}, round(avg(CASE WHEN sign(ret)=sign(mkt) THEN 1.0 ELSE 0 END) {W6},6) AS same,
 round(avg(CASE WHEN ret>0 AND mkt>0 THEN 1.0 ELSE 0 END) {W6},6) AS up, round(avg(CASE WHEN ret<0 AND mkt<0 THEN 1.0 ELSE 0 END) {W6},6) AS down FROM panel""")
def e16(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), *[r(R.comovement("ret", "mkt", -5, 0, k)).alias(k) for k in ("same", "up", "down")])


@register("e19_max_min", f"{PANEL} SELECT {KEYS}, round(max(ret) {W6},6) AS high, round(min(ret) {W6},6) AS low FROM panel")
def e19(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), r(R.rolling_max("ret", -5, 0)).alias("high"), r(R.rolling_min("ret", -5, 0)).alias("low"))


@register("e20_average_return", f"""{PANEL} SELECT {KEYS}, round(avg(ret) {W6},6) AS avg_r, round(avg(ret*CASE WHEN ret>0 THEN 1.0 ELSE 0 END) {W6},6) AS avg_up,
 round(avg(ret*CASE WHEN ret<0 THEN 1.0 ELSE 0 END) {W6},6) AS avg_down FROM panel""")
def e20(spark, sf_dir):
    w = AX.rows(-5, 0)
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), r(F.avg("ret").over(w)).alias("avg_r"), r(F.avg(R.one_sided("ret", True)).over(w)).alias("avg_up"), r(F.avg(R.one_sided("ret", False)).over(w)).alias("avg_down"))


@register("e21_semi_deviation", f"""{PANEL} SELECT {KEYS}, round(stddev_samp(ret) {W6},6) AS std, round(stddev_samp(ret*CASE WHEN ret>0 THEN 1.0 ELSE 0 END) {W6},6) AS std_up,
 round(stddev_samp(ret*CASE WHEN ret<0 THEN 1.0 ELSE 0 END) {W6},6) AS std_down FROM panel""")
def e21(spark, sf_dir):
    w = AX.rows(-5, 0)
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), *[r(F.stddev_samp(c).over(w)).alias(n) for n, c in (("std", F.col("ret")), ("std_up", R.one_sided("ret", True)), ("std_down", R.one_sided("ret", False)))])


WEALTH = f"{PANEL}, w AS (SELECT *, exp(sum({LN}) {SO_FAR}) AS w FROM panel)"


@register("e23_drawdown", f"{WEALTH} SELECT {KEYS}, round(w/nullif(max(w) {SO_FAR},0)-1,6) AS drawdown FROM w")
def e23(spark, sf_dir):
    return R.drawdown(stock_panel(spark, sf_dir), "ret").select("name", day().alias("date"), r("drawdown").alias("drawdown"))


@register("e24_consecutive", f"""{PANEL}, a AS (SELECT *, CASE WHEN ret>=0 THEN 1 ELSE -1 END AS up FROM panel),
 b AS (SELECT *, CASE WHEN up = lag(up) OVER (PARTITION BY name ORDER BY date) THEN 0 ELSE 1 END AS fresh FROM a), c AS (SELECT *, sum(fresh) {SO_FAR} AS grp FROM b)
 SELECT {KEYS}, (row_number() OVER (PARTITION BY name, grp ORDER BY date)*up)::INTEGER AS run FROM c""")
def e24(spark, sf_dir):
    return R.consecutive(stock_panel(spark, sf_dir), "ret").select("name", day().alias("date"), F.col("run").cast("int").alias("run"))


@register("e25_new_high_low", f"""{WEALTH} SELECT {KEYS}, CASE WHEN w-1>=max(w-1) {SO_FAR} THEN 1 WHEN w-1<=min(w-1) {SO_FAR} THEN -1 ELSE 0 END AS extreme FROM w""")
def e25(spark, sf_dir):
    return R.new_high_low(stock_panel(spark, sf_dir), "ret").select("name", day().alias("date"), "extreme")


@register("e26_drawdown_speed", f"""{WEALTH}, d AS (SELECT *, w/nullif(max(w) {SO_FAR},0)-1 AS d, row_number() OVER (PARTITION BY name ORDER BY date) AS i FROM w),
 t AS (SELECT *, max(CASE WHEN d=0 THEN i END) {SO_FAR} AS top FROM d) SELECT {KEYS}, round(d/nullif(i-top,0),6) AS speed FROM t""")
def e26(spark, sf_dir):
    return R.drawdown_speed(stock_panel(spark, sf_dir), "ret").select("name", day().alias("date"), r("speed").alias("speed"))


@register("e28_forward_return", f"{PANEL} SELECT {KEYS}, round(exp(sum({LN}) {over(1, 3)})-1,6) AS f3, round(exp(sum({LN}) {over(1, 6)})-1,6) AS f6, round(exp(sum({LN}) {over(1, None)})-1,6) AS f_all FROM panel")
def e28(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), *[r(R.forward_return("ret", 1, k)).alias(n) for n, k in (("f3", 3), ("f6", 6), ("f_all", None))])


@register("e29_signal_variations", f"""{PANEL} SELECT {KEYS}, round(vol-lag(vol) OVER (PARTITION BY name ORDER BY date),6) AS diff_vol, round(avg(vol) {W3},6) AS avg_vol_3, round(vol/nullif(avg(vol) {W3},0),6) AS crossover_vol_3,
 round(avg(vol) {W6},6) AS avg_vol_6, round(vol/nullif(avg(vol) {W6},0),6) AS crossover_vol_6 FROM panel""")
def e29(spark, sf_dir):
    names = ["diff_vol", "avg_vol_3", "crossover_vol_3", "avg_vol_6", "crossover_vol_6"]
    return R.signal_variations(stock_panel(spark, sf_dir), ["vol"], [3, 6]).select("name", day().alias("date"), *[r(n).alias(n) for n in names])


@register("e30_lag_lead", f"{PANEL} SELECT {KEYS}, round(lag(prc) OVER (PARTITION BY name ORDER BY date),6) AS before, round(lead(ret) OVER (PARTITION BY name ORDER BY date),6) AS next_ret FROM panel")
def e30(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), r(F.lag("prc").over(AX.history())).alias("before"), r(F.lead("ret").over(AX.history())).alias("next_ret"))


@register("e31_forward_fill", f"{DAYS}, g AS (SELECT name, date, CASE WHEN n > 1 THEN value END AS v FROM days) SELECT {KEYS}, round(last_value(v IGNORE NULLS) {SO_FAR},6) AS filled FROM g")
def e31(spark, sf_dir):
    df = day_panel(spark, sf_dir).withColumn("v", F.when(F.col("n") > 1, F.col("value")))
    return df.select("name", day().alias("date"), r(R.forward_fill("v")).alias("filled"))


@register("e33_option_return", f"""{PANEL}, s AS (SELECT *, CASE WHEN date > TIMESTAMP '1998-06-01' THEN lead(vol) OVER (PARTITION BY name ORDER BY date) ELSE vol END AS oi FROM panel)
 SELECT {KEYS}, round((prc-lag(prc) OVER (PARTITION BY name ORDER BY date))/nullif(lag(prc) OVER (PARTITION BY name ORDER BY date),0),6) AS opt_r, round(oi-lag(oi) OVER (PARTITION BY name ORDER BY date),6) AS oi_change FROM s""")
def e33(spark, sf_dir):
    df = stock_panel(spark, sf_dir)
    df = df.withColumn("oi", N.shift_after("name", "date", "vol", "1998-06-01"))
    return df.select("name", day().alias("date"), r(R.change("prc", 1, True)).alias("opt_r"), r(R.change("oi")).alias("oi_change"))


@register("e36_rolling_ecdf", f"""{PANEL}, i AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY date) AS i FROM panel)
 SELECT a.name, strftime(a.date, '%Y-%m-%d') AS date, round(count(*) FILTER (b.prc <= a.prc)/12.0,6) AS ecdf FROM i a JOIN i b ON a.name=b.name AND b.i BETWEEN a.i-11 AND a.i GROUP BY 1,2""")
def e36(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), r(R.rolling_ecdf("prc", 12)).alias("ecdf"))


@register("e36_rolling_ecdf_sorted", f"""{PANEL}, i AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY date) AS i FROM panel)
 SELECT a.name, strftime(a.date, '%Y-%m-%d') AS date, round(count(*) FILTER (b.prc <= a.prc)/50.0,6) AS ecdf FROM i a JOIN i b ON a.name=b.name AND b.i BETWEEN a.i-49 AND a.i GROUP BY 1,2""")
def e36_sorted(spark, sf_dir):
    """The same share over 50 rows, from one sorted window that moves along each entity."""
    return W.rolling_ecdf(stock_panel(spark, sf_dir).select("name", "date", "prc"), "prc", 50).select("name", day().alias("date"), r("ecdf").alias("ecdf"))


@register("d11_market_breadth", f"{PANEL} SELECT strftime(date,'%Y-%m-%d') AS date, round(avg(CASE WHEN ret>=0 THEN 1.0 ELSE 0 END),6) AS breadth FROM panel GROUP BY 1")
def d11(spark, sf_dir):
    return market_breadth(stock_panel(spark, sf_dir)).select(day().alias("date"), r("breadth").alias("breadth"))
