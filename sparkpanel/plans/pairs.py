"""Queries of the pairs backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoints import ensure_checkpoints
from ..operators import etl, pairs as P
from ..operators.tiles import pair_moments
from ..operators.windows import spread_ecdf
from ..panel import ratio
from .fixtures import BRANDS, day, pair_prices, r
from .registry import register

W12 = "OVER (PARTITION BY x, y ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
H = "OVER (PARTITION BY x, y ORDER BY date)"
CUM = "OVER (PARTITION BY x, y ORDER BY date ROWS UNBOUNDED PRECEDING)"
PAIRS = f"""{BRANDS}, pp AS (SELECT a.name AS x, b.name AS y, a.date, a.price AS p_x, b.price AS p_y FROM prices a JOIN prices b ON a.name > b.name AND a.date=b.date),
 h AS (SELECT *, CASE WHEN count(*) {W12} >= 12 THEN regr_slope(p_y, p_x) {W12} END AS hr FROM pp), s AS (SELECT *, p_y-hr*p_x AS spread FROM h)"""
SIGNAL = f"""{PAIRS}, g AS (SELECT *, CASE WHEN count(spread) {W12} >= 12 THEN (spread-avg(spread) {W12})/nullif(stddev_samp(spread) {W12},0) END AS signal FROM s)"""
POSITION = f"""{SIGNAL}, b AS (SELECT *, lag(signal) {H} AS before FROM g),
 c AS (SELECT *, coalesce(signal > 1.5 AND before <= 1.5, false) AS up, coalesce(signal < -1.5 AND before >= -1.5, false) AS down, coalesce(signal > -0.5 AND before <= -0.5, false) AS end_long, coalesce(signal < 0.5 AND before >= 0.5, false) AS end_short FROM b),
 e AS (SELECT *, CASE WHEN down THEN 1 WHEN end_long OR up THEN 0 END AS l, CASE WHEN up THEN -1 WHEN end_short OR down THEN 0 END AS sh FROM c),
 p AS (SELECT *, coalesce(last_value(l IGNORE NULLS) {CUM},0) AS long, coalesce(last_value(sh IGNORE NULLS) {CUM},0) AS short FROM e), q AS (SELECT *, long+short AS position FROM p)"""
RETURN = f"""{POSITION}, t AS (SELECT *, coalesce(lag(position) {H},0) AS held FROM q),
 u AS (SELECT *, last_value(CASE WHEN position<>0 AND position<>held THEN hr END IGNORE NULLS) OVER (PARTITION BY x, y ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entry FROM t),
 v AS (SELECT *, CASE WHEN held=0 THEN 0.0::DOUBLE ELSE coalesce(held*((p_y-lag(p_y) {H})-entry*(p_x-lag(p_x) {H}))/nullif(CASE WHEN held>0 THEN lag(p_y) {H} ELSE lag(p_x) {H}*abs(entry) END,0),0) END AS r FROM u)"""
STATS = f"""{RETURN}, st AS (SELECT x, y, avg(r)/nullif(stddev_samp(r),0)*sqrt(12) AS sharpe, product(1+r)-1 AS cumr FROM v GROUP BY 1,2)"""
XYD = "x, y, strftime(date,'%Y-%m-%d') AS date"


def panel(spark, sf_dir):
    return etl.pair_panel(pair_prices(spark, sf_dir))


def spreads(spark, sf_dir):
    return panel(spark, sf_dir).withColumn("hr", P.hedge_ratio("OLS")).withColumn("spread", P.spread())


def returns(spark, sf_dir):
    return P.pair_return(P.positions(spreads(spark, sf_dir).withColumn("signal", P.spread_zscore()), 1.5, 0.5))


@register("i1_pair_panel", f"{PAIRS} SELECT x, y, count(*) AS n, round(avg(p_x),4) AS p_x, round(avg(p_y),4) AS p_y FROM pp GROUP BY 1,2")
def i1(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("x", "y").agg(F.count("*").alias("n"), r(F.avg("p_x"), 4).alias("p_x"), r(F.avg("p_y"), 4).alias("p_y"))


MOMENTS = f"""{BRANDS}, pp AS (SELECT a.name AS x, b.name AS y, a.date, a.price AS p_x, b.price AS p_y FROM prices a JOIN prices b ON a.date=b.date AND a.name>b.name),
 mo AS (SELECT x, y, count(*) AS n, corr(p_x, p_y) AS correlation, regr_slope(p_y, p_x) AS hedge_ratio, regr_intercept(p_y, p_x) AS intercept, sqrt((regr_syy(p_y, p_x)-regr_slope(p_y, p_x)*regr_sxy(p_y, p_x))/(count(*)-1)) AS spread_std FROM pp GROUP BY 1,2)"""


@register("i1_pair_moments", f"{MOMENTS} SELECT x, y, n, round(correlation,6) AS correlation, round(hedge_ratio,6) AS hedge_ratio, round(intercept,4) AS intercept, round(spread_std,4) AS spread_std FROM mo")
def i1_moments(spark, sf_dir):
    """Correlation, hedge ratio and spread of all pairs from block products."""
    found = pair_moments(pair_prices(spark, sf_dir))
    return found.select("x", "y", "n", r("correlation").alias("correlation"), r("hedge_ratio").alias("hedge_ratio"), r("intercept", 4).alias("intercept"), r("spread_std", 4).alias("spread_std"))


@register("i1_chosen_pairs", f"{MOMENTS}, c AS (SELECT x, y FROM mo ORDER BY round(correlation,9) DESC, x, y LIMIT 10) SELECT pp.x, pp.y, strftime(date,'%Y-%m-%d') AS date, round(p_x,6) AS p_x, round(p_y,6) AS p_y FROM pp JOIN c ON pp.x=c.x AND pp.y=c.y")
def i1_chosen(spark, sf_dir):
    """Rows of the ten most correlated pairs; the others have none."""
    prices = pair_prices(spark, sf_dir)
    best = pair_moments(prices).orderBy(F.desc(F.round("correlation", 9)), "x", "y").limit(10)
    return etl.pair_panel(prices, pairs=best).select("x", "y", day().alias("date"), r("p_x").alias("p_x"), r("p_y").alias("p_y"))


@register("i2_hedge_ratio_ols", f"{PAIRS} SELECT {XYD}, round(hr,6) AS hr FROM h")
def i2(spark, sf_dir):
    return spreads(spark, sf_dir).select("x", "y", day().alias("date"), r("hr").alias("hr"))


@register("i2_hedge_ratio_kalman")
def i2_kalman(spark, sf_dir):
    return P.kalman_hedge(panel(spark, sf_dir)).select("x", "y", "date", "hr")


@register("i2_hedge_ratio_kalman_constant")
def i2_kalman_constant(spark, sf_dir):
    return P.kalman_hedge(panel(spark, sf_dir), constant=True).select("x", "y", "date", "hr")


@register("i2_hedge_ratio_no_constant", f"{PAIRS} SELECT {XYD}, CASE WHEN count(*) {W12} >= 12 THEN round(sum(p_y*p_x) {W12}/nullif(sum(p_x*p_x) {W12},0),6) END AS hr FROM pp")
def i2_no_constant(spark, sf_dir):
    return panel(spark, sf_dir).withColumn("hr", P.hedge_ratio("OLS", constant=False)).select("x", "y", day().alias("date"), r("hr").alias("hr"))


@register("i3_spread", f"{PAIRS}, n AS (SELECT *, round_even(1000000/nullif(p_y,0),0) AS n FROM h) SELECT {XYD}, round(p_y-hr*p_x,6) AS spread, round(p_y-round_even(n*hr,0)/nullif(n,0)*p_x,6) AS spread_shares FROM n")
def i3(spark, sf_dir):
    return spreads(spark, sf_dir).select("x", "y", day().alias("date"), r("spread").alias("spread"), r(P.spread(1_000_000.0)).alias("spread_shares"))


@register("i4_spread_signal", f"{SIGNAL} SELECT {XYD}, round(signal,6) AS signal FROM g")
def i4(spark, sf_dir):
    return spreads(spark, sf_dir).select("x", "y", day().alias("date"), r(P.spread_zscore()).alias("signal"))


@register("i4_spread_ecdf", f"{PAIRS}, g AS (SELECT *, list(spread) {W12} AS seen, count(spread) {W12} AS n FROM s) SELECT {XYD}, CASE WHEN n >= 12 THEN round(len(list_filter(seen, lambda v: v <= spread))/12.0,6) END AS signal FROM g")
def i4_ecdf(spark, sf_dir):
    found = spread_ecdf(spreads(spark, sf_dir).select("x", "y", "date", "spread"), ["x", "y"])
    return found.select("x", "y", day().alias("date"), r("signal").alias("signal"))


@register("i5_positions", f"{POSITION} SELECT {XYD}, long::INTEGER AS long, short::INTEGER AS short FROM q")
def i5(spark, sf_dir):
    return returns(spark, sf_dir).select("x", "y", day().alias("date"), F.col("long").cast("int").alias("long"), F.col("short").cast("int").alias("short"))


@register("i6_pair_return", f"{RETURN} SELECT {XYD}, round(r,6) AS r FROM v")
def i6(spark, sf_dir):
    return returns(spark, sf_dir).select("x", "y", day().alias("date"), r("r").alias("r"))


@register("i6_pair_return_rebalanced", f"""{POSITION}, t AS (SELECT *, coalesce(lag(position) {H},0) AS held, lag(hr) {H} AS k FROM q)
 SELECT {XYD}, round(CASE WHEN held=0 THEN 0.0::DOUBLE ELSE coalesce(held*((p_y-lag(p_y) {H})-k*(p_x-lag(p_x) {H}))/nullif(CASE WHEN held>0 THEN lag(p_y) {H} ELSE lag(p_x) {H}*abs(k) END,0),0) END,4) AS r FROM t""")
def i6_rebalanced(spark, sf_dir):
    return P.backtest(panel(spark, sf_dir), rebalance=True).select("x", "y", day().alias("date"), r("r", 4).alias("r"))


@register("i7_pair_stats", f"{STATS} SELECT x, y, round(sharpe,6) AS sharpe, round(cumr,6) AS cumr FROM st")
def i7(spark, sf_dir):
    return P.pair_stats(returns(spark, sf_dir)).select("x", "y", r("sharpe").alias("sharpe"), r("cumr").alias("cumr"))


@register("i7_spread_adf")
def i7_adf(spark, sf_dir):
    return P.adf_of(spreads(spark, sf_dir).select("x", "y", "date", "spread"), "spread")


@register("i8_portfolio_of_pairs", f"{RETURN} SELECT strftime(date,'%Y-%m-%d') AS date, round(avg(r),6) AS r, count(*) FILTER (position>0) AS n_long, count(*) FILTER (position<0) AS n_short FROM v GROUP BY 1")
def i8(spark, sf_dir):
    side = lambda c: F.count(F.when(c, 1))
    return returns(spark, sf_dir).groupBy("date").agg(r(F.avg("r")).alias("r"), side(F.col("position") > 0).alias("n_long"), side(F.col("position") < 0).alias("n_short")).withColumn("date", day())


def scored(spark, sf_dir):
    return P.score(P.pair_stats(returns(spark, sf_dir)), {"sharpe": 1.0, "cumr": 0.5})


SCORED = f"{STATS}, sc AS (SELECT *, (sharpe-(SELECT avg(sharpe) FROM st))/nullif((SELECT stddev_samp(sharpe) FROM st),0)+0.5*(cumr-(SELECT avg(cumr) FROM st))/nullif((SELECT stddev_samp(cumr) FROM st),0) AS score FROM st)"


@register("i9_score_pairs", f"{SCORED} SELECT x, y, round(score,6) AS score FROM sc")
def i9(spark, sf_dir):
    return scored(spark, sf_dir).select("x", "y", r("score").alias("score"))


@register("i10_select_pairs", f"{SCORED} SELECT x, y, round(score,6) AS score FROM sc WHERE score IS NOT NULL ORDER BY sc.score DESC, x, y LIMIT 10")
def i10(spark, sf_dir):
    return scored(spark, sf_dir).filter("score is not null").orderBy(F.desc("score"), "x", "y").limit(10).select("x", "y", r("score").alias("score"))


@register("f17_greedy_disjoint_pairs", f"""{SCORED.replace("WITH ", "WITH RECURSIVE ", 1)}, ranked AS (SELECT x, y, score, row_number() OVER (ORDER BY score DESC, x, y) AS i FROM sc WHERE score IS NOT NULL),
 pick AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, ''::VARCHAR AS x, ''::VARCHAR AS y, 0.0::DOUBLE AS score, false AS took UNION ALL
  SELECT ranked.i, CASE WHEN list_contains(used,ranked.x) OR list_contains(used,ranked.y) THEN used ELSE list_concat(used,[ranked.x,ranked.y]) END, ranked.x, ranked.y, ranked.score, NOT (list_contains(used,ranked.x) OR list_contains(used,ranked.y)) FROM pick JOIN ranked ON ranked.i=pick.i+1)
 SELECT x, y, round(score,6) AS score FROM pick WHERE took ORDER BY pick.score DESC, x, y LIMIT 10""")
def f17(spark, sf_dir):
    ensure_checkpoints(spark)
    return P.greedy_disjoint(scored(spark, sf_dir).select("x", "y", "score"), 10).select("x", "y", r("score").alias("score"))


@register("i11_engle_granger_no_lags", f"""{BRANDS}, pp AS (SELECT a.name AS x, b.name AS y, a.date, a.price AS p_x, b.price AS p_y FROM prices a JOIN prices b ON a.date=b.date AND a.name>b.name),
 l AS (SELECT x, y, regr_slope(p_y, p_x) AS s, regr_intercept(p_y, p_x) AS c FROM pp GROUP BY 1,2), e AS (SELECT pp.x, pp.y, date, p_y-c-s*p_x AS e FROM pp JOIN l ON pp.x=l.x AND pp.y=l.y),
 d AS (SELECT x, y, e-lag(e) OVER w AS d, lag(e) OVER w AS b FROM e WINDOW w AS (PARTITION BY x, y ORDER BY date)), f AS (SELECT x, y, sum(d*b)/sum(b*b) AS beta, sum(b*b) AS bb, sum(d*d) AS dd, sum(d*b) AS db, count(d) AS n FROM d GROUP BY 1,2)
 SELECT x, y, round(beta/sqrt((dd-beta*db)/(n-1)/bb),5) AS statistic FROM f""")
def i11_plain(spark, sf_dir):
    """Dickey-Fuller statistics of the residuals of all pairs, without lagged differences."""
    return P.engle_granger(panel(spark, sf_dir), 1.0, 0).select("x", "y", r("statistic", 5).alias("statistic"))


@register("i11_engle_granger")
def i11(spark, sf_dir):
    return P.engle_granger(panel(spark, sf_dir), 0.05)


@register("i12_half_life", f"{PAIRS}, d AS (SELECT x, y, lag(spread) {H} AS b, spread-lag(spread) {H} AS d FROM s), k AS (SELECT x, y, regr_slope(d, b) AS beta FROM d GROUP BY 1,2) SELECT x, y, CASE WHEN floor(-ln(2)/nullif(beta,0))>0 THEN floor(-ln(2)/nullif(beta,0))::BIGINT END AS half_life FROM k")
def i12(spark, sf_dir):
    return P.half_life(spreads(spark, sf_dir))


#: All windows of the calendar, and SQL of a backtest that starts anew in each.
WINDOWS = """w AS (SELECT k AS win, date_trunc('month', lo) + to_months((12*k)::INTEGER) AS s, date_trunc('month', lo) + to_months((12*k+36)::INTEGER) AS cut, date_trunc('month', lo) + to_months((12*k+48)::INTEGER) AS stop
 FROM (SELECT min(date) AS lo, max(date) AS hi FROM pp), range(0, 200) t(k) WHERE date_trunc('month', lo) + to_months((12*k+36)::INTEGER) <= hi)"""


def _backtest_sql(name: str, source: str) -> str:
    """Rows of ``source`` (win, x, y, date, p_x, p_y) with their return, as the chain of the pairs queries."""
    h, cum = "OVER (PARTITION BY win, x, y ORDER BY date)", "OVER (PARTITION BY win, x, y ORDER BY date ROWS UNBOUNDED PRECEDING)"
    w = "OVER (PARTITION BY win, x, y ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
    last = "OVER (PARTITION BY win, x, y ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}1 AS (SELECT *, CASE WHEN count(*) {w} >= 12 THEN regr_slope(p_y, p_x) {w} END AS hr FROM {source}), {name}2 AS (SELECT *, p_y-hr*p_x AS spread FROM {name}1),
 {name}3 AS (SELECT *, CASE WHEN count(spread) {w} >= 12 THEN (spread-avg(spread) {w})/nullif(stddev_samp(spread) {w},0) END AS signal FROM {name}2), {name}4 AS (SELECT *, lag(signal) {h} AS before FROM {name}3),
 {name}5 AS (SELECT *, coalesce(signal > 1.5 AND before <= 1.5, false) AS up, coalesce(signal < -1.5 AND before >= -1.5, false) AS down, coalesce(signal > -0.5 AND before <= -0.5, false) AS end_long, coalesce(signal < 0.5 AND before >= 0.5, false) AS end_short FROM {name}4),
 {name}6 AS (SELECT *, CASE WHEN down THEN 1 WHEN end_long OR up THEN 0 END AS l, CASE WHEN up THEN -1 WHEN end_short OR down THEN 0 END AS sh FROM {name}5),
 {name}7 AS (SELECT *, coalesce(last_value(l IGNORE NULLS) {cum},0)+coalesce(last_value(sh IGNORE NULLS) {cum},0) AS position FROM {name}6), {name}8 AS (SELECT *, coalesce(lag(position) {h},0) AS held FROM {name}7),
 {name}9 AS (SELECT *, last_value(CASE WHEN position<>0 AND position<>held THEN hr END IGNORE NULLS) {last} AS entry FROM {name}8),
 {name} AS (SELECT *, CASE WHEN held=0 THEN 0.0::DOUBLE ELSE coalesce(held*((p_y-lag(p_y) {h})-entry*(p_x-lag(p_x) {h}))/nullif(CASE WHEN held>0 THEN lag(p_y) {h} ELSE lag(p_x) {h}*abs(entry) END,0),0) END AS r FROM {name}9)"""


WALK = f"""{PAIRS}, {WINDOWS}, tr0 AS (SELECT win, x, y, date, p_x, p_y FROM pp JOIN w ON date >= s AND date < cut), {_backtest_sql("tr", "tr0")},
 td0 AS (SELECT win, cut, x, y, date, p_x, p_y FROM pp JOIN w ON date >= cut - INTERVAL 24 MONTH AND date < stop), {_backtest_sql("td", "td0")}"""


@register("i13_walk_forward_pairs")
def i13(spark, sf_dir):
    """Train on 36 months, take the ten best pairs by p-value and Sharpe ratio, trade them for 12 months; all windows in one plan."""
    return P.walk_forward_pairs(panel(spark, sf_dir), 36, 12, 10, {"p": -0.5, "sharpe": 0.5}, warm_up=24)


@register("i13_walk_forward_sharpe", f"""{WALK}, st AS (SELECT win, x, y, avg(r)/nullif(stddev_samp(r),0)*sqrt(12) AS sharpe FROM tr GROUP BY ALL), b AS (SELECT win, x, y FROM st QUALIFY row_number() OVER (PARTITION BY win ORDER BY round(sharpe,9) DESC NULLS LAST, x, y) <= 10)
 SELECT win::INTEGER AS "window", strftime(date,'%Y-%m-%d') AS date, round(avg(r),6) AS r, count(*) AS n FROM td JOIN b USING (win, x, y) WHERE date >= cut GROUP BY 1,2""")
def i13_sharpe(spark, sf_dir):
    """The same by the Sharpe ratio alone, which SQL can check."""
    return P.walk_forward_pairs(panel(spark, sf_dir), 36, 12, 10, {"sharpe": 1.0}, warm_up=24).select("window", day().alias("date"), r("r").alias("r"), "n")


@register("i14_stock_universe", f"{BRANDS}, f AS (SELECT name FROM prices GROUP BY 1 HAVING count(*)=(SELECT count(DISTINCT date) FROM prices)) SELECT DISTINCT name FROM f")
def i14(spark, sf_dir):
    return etl.complete_series(pair_prices(spark, sf_dir)).select("name").distinct()


@register("i15_pair_persistence", f"""{RETURN}, fa AS (SELECT x, y, avg(r)/nullif(stddev_samp(r),0) AS s1 FROM v WHERE date < TIMESTAMP '1998-07-01' GROUP BY 1,2), fb AS (SELECT x, y, avg(r)/nullif(stddev_samp(r),0) AS s2 FROM v WHERE date >= TIMESTAMP '1998-07-01' GROUP BY 1,2)
 SELECT round(regr_slope(s2,s1),6) AS slope, round(regr_intercept(s2,s1),6) AS intercept, round(regr_r2(s2,s1),6) AS r2 FROM fa JOIN fb USING (x,y)""")
def i15(spark, sf_dir):
    out, cut = returns(spark, sf_dir), F.lit("1998-07-01").cast("timestamp")
    sharpe = lambda c: ratio(F.avg(F.when(c, F.col("r"))), F.stddev_samp(F.when(c, F.col("r"))))
    both = out.groupBy("x", "y").agg(sharpe(F.col("date") < cut).alias("s1"), sharpe(F.col("date") >= cut).alias("s2"))
    return both.agg(r(F.regr_slope("s2", "s1")).alias("slope"), r(F.regr_intercept("s2", "s1")).alias("intercept"), r(F.regr_r2("s2", "s1")).alias("r2"))
