"""Queries of portfolio construction and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio as P
from ..operators.enrich import equal_weight_portfolio
from ..operators.rolling import cumulative_return, rolling_mean
from ..panel import ratio
from .fixtures import KEYS, PANEL, AX, day, over, r, stock_panel
from .registry import register

N = 5
LN = "CASE WHEN ret > -1 THEN ln(1+ret) END"
#: The panel with a momentum signal and the next month's return.
MOMENTUM = f"""{PANEL}, m AS (SELECT *, exp(sum({LN}) {over(-11, -1)})-1 AS mom, lead(ret) OVER (PARTITION BY name ORDER BY date) AS next_r FROM panel)"""


def momentum(spark, sf_dir):
    df = stock_panel(spark, sf_dir)
    return df.select("*", cumulative_return("ret", -11, -1).alias("mom"), F.lead("ret").over(AX.history()).alias("next_r"))


def _ports(cond: str = "", rank: str = "ntile(5) OVER (PARTITION BY date ORDER BY mom, name)", inner: str = "") -> str:
    """Portfolio returns with long-short rows, as SQL."""
    c = f", {cond}" if cond else ""
    on = "a.date=b.date" + (f" AND a.{cond}=b.{cond}" if cond else "")
    return f"""{MOMENTUM}{inner}, k AS (SELECT *, {rank} AS sig_rank FROM {'c' if inner else 'm'} WHERE mom IS NOT NULL),
 p AS (SELECT date, sig_rank{c}, sum(next_r*mktcap)/sum(mktcap) AS r, count(next_r) AS n_assets, list_sort(list(name::VARCHAR)) AS members FROM k GROUP BY ALL),
 q AS (SELECT date, sig_rank::VARCHAR AS sig_rank{c}, r, n_assets, members FROM p UNION ALL
  SELECT a.date, 'high_minus_low'{', a.' + cond if cond else ''}, a.r-b.r, a.n_assets+b.n_assets, NULL FROM p a JOIN p b ON {on} AND a.sig_rank=5 AND b.sig_rank=1),
 s AS (SELECT *, lag(r) OVER (PARTITION BY sig_rank{c} ORDER BY date) AS port_r FROM q)"""


COND = ", c AS (SELECT *, ntile(3) OVER (PARTITION BY date ORDER BY prc, name) AS cond_rank FROM m WHERE mom IS NOT NULL)"
INDEPENDENT = _ports("cond_rank", inner=COND)
DEPENDENT = _ports("cond_rank", "ntile(5) OVER (PARTITION BY date, cond_rank ORDER BY mom, name)", COND)
OUT = "strftime(date,'%Y-%m-%d') AS date, sig_rank, round(r,6) AS r, n_assets, round(port_r,6) AS port_r"


def _shown(df, *more):
    return df.select(day().alias("date"), "sig_rank", *more, r("r").alias("r"), "n_assets", r("port_r").alias("port_r"))


def single(spark, sf_dir, members=False):
    return P.sort_portfolios(momentum(spark, sf_dir), "mom", "next_r", N, "mktcap", members=members)


@register("g1_single_sort", f"{_ports()} SELECT {OUT} FROM s")
def g1(spark, sf_dir):
    return _shown(single(spark, sf_dir))


@register("g2_independent_double_sort", f"{INDEPENDENT} SELECT cond_rank::INTEGER AS cond_rank, {OUT} FROM s")
def g2(spark, sf_dir):
    df = momentum(spark, sf_dir)
    return _shown(P.sort_portfolios(df, "mom", "next_r", N, "mktcap", "prc", 3), "cond_rank")


@register("g3_dependent_double_sort", f"{DEPENDENT} SELECT cond_rank::INTEGER AS cond_rank, {OUT} FROM s")
def g3(spark, sf_dir):
    return _shown(P.sort_portfolios(momentum(spark, sf_dir), "mom", "next_r", N, "mktcap", "prc", 3, dependent=True), "cond_rank")


@register("g4_trading_cost", f"{_ports()} SELECT strftime(date,'%Y-%m-%d') AS date, sig_rank, round(2*n_assets*0.5*0.65/nullif(n_assets*100.0,0),6) AS cost FROM s")
def g4(spark, sf_dir):
    return single(spark, sf_dir).withColumn("position", F.col("n_assets") * 100.0).select(day().alias("date"), "sig_rank", r(P.trading_cost("n_assets", 0.5, 0.65, "position")).alias("cost"))


@register("g5_sort_return", f"""{_ports()} SELECT sig_rank, round(avg(port_r),6) AS mean, round(avg(port_r)*sqrt(count(*))/nullif(stddev_samp(port_r),0),6) AS t, round(avg(port_r)/nullif(stddev_samp(port_r),0)*sqrt(12),6) AS sharpe,
 round(pow(1+avg(port_r),12)-1,6) AS annual, count(*) AS n, round(avg(n_assets),6) AS n_assets FROM s WHERE port_r IS NOT NULL GROUP BY sig_rank""")
def g5(spark, sf_dir):
    out = P.sort_return(single(spark, sf_dir), 1, 12.0)
    return out.select("sig_rank", *[r(c).alias(c) for c in ("mean", "t", "sharpe", "annual")], "n", r("n_assets").alias("n_assets"))


@register("g5_p_value")
def g5p(spark, sf_dir):
    return P.sort_return(single(spark, sf_dir), 1, 12.0).select("sig_rank", r("t").alias("t"), r("p").alias("p"))


@register("g5_sort_return_averaged", f"""{INDEPENDENT}, j AS (SELECT s.*, v.cost, v.size FROM s JOIN (SELECT date, avg(vol)/1e6 AS cost, avg(mktcap) AS size FROM panel GROUP BY 1) v ON s.date=v.date WHERE port_r IS NOT NULL),
 a AS (SELECT date, sig_rank, avg(port_r-cost) AS x, avg(n_assets) AS n_assets, avg(size) AS size FROM j GROUP BY 1,2), e AS (SELECT *, row_number() OVER (PARTITION BY sig_rank ORDER BY date)-1 AS i FROM a)
 SELECT sig_rank, round(avg(x),6) AS mean, round(avg(x)*sqrt(count(*))/nullif(stddev_samp(x),0),6) AS t, round(avg(x)/nullif(stddev_samp(x),0)*sqrt(6),6) AS sharpe, count(*) AS n, round(avg(n_assets),6) AS n_assets, round(avg(size),2) AS size_mean FROM e WHERE i % 2=0 GROUP BY 1""")
def g5_averaged(spark, sf_dir):
    """Double sort averaged over the second ranks, net of cost, with a covariate, of every second month."""
    months = stock_panel(spark, sf_dir).groupBy("date").agg((F.avg("vol") / 1e6).alias("cost"), F.avg("mktcap").alias("size"))
    ports = P.sort_portfolios(momentum(spark, sf_dir), "mom", "next_r", N, "mktcap", "prc", 3).join(months, "date")
    out = P.sort_return(ports, 2, 12.0, keys=("cond_rank", "sig_rank"), average_over="cond_rank", covariates=("size",), cost="cost")
    return out.select("sig_rank", *[r(c).alias(c) for c in ("mean", "t", "sharpe")], "n", r("n_assets").alias("n_assets"), r("size_mean", 2).alias("size_mean"))


@register("g6_turnover", f"""{_ports()}, b AS (SELECT *, lag(members) OVER (PARTITION BY sig_rank ORDER BY date) AS before FROM s WHERE sig_rank IN ('1','5')),
 t AS (SELECT *, len(list_filter(before, lambda x: NOT list_contains(members, x)))::DOUBLE/nullif(len(before),0) AS gone FROM b),
 g AS (SELECT date, max(gone) FILTER (sig_rank='5') AS h, max(gone) FILTER (sig_rank='1') AS l FROM t GROUP BY date)
 SELECT strftime(s.date,'%Y-%m-%d') AS date, round(h,6) AS turnover_high, round(l,6) AS turnover_low, round(r-0.002*(coalesce(h,0)+coalesce(l,0)),6) AS net_r FROM s JOIN g ON s.date=g.date WHERE sig_rank='high_minus_low'""")
def g6(spark, sf_dir):
    return P.turnover(single(spark, sf_dir), P.ranked_rows(momentum(spark, sf_dir), "mom", N), N).select(day().alias("date"), r("turnover_high").alias("turnover_high"), r("turnover_low").alias("turnover_low"), r("net_r").alias("net_r"))


def _stats_sql(rf: str) -> str:
    return f"""{PANEL}, x AS (SELECT name, date, ret AS r, ret-{rf} AS x FROM panel WHERE ret IS NOT NULL), w AS (SELECT *, product(1+r) {over(None, 0)} AS w FROM x),
 d AS (SELECT *, w/nullif(max(w) {over(None, 0)},0)-1 AS dd FROM w), q AS (SELECT name, quantile_cont(r,0.05) AS q5, quantile_cont(r,0.01) AS q1 FROM x GROUP BY name),
 s AS (SELECT d.name, avg(r) AS average, max(r) AS mx, min(r) AS mn, min(dd) AS mdd, stddev_samp(r) AS vol, stddev_samp(r) FILTER (r<0) AS down, any_value(q5) AS q5, any_value(q1) AS q1,
  avg(r) FILTER (r<=q5) AS es5, avg(r) FILTER (r<=q1) AS es1, product(1+r) AS g, count(*) AS n, avg(x) AS mx_x, stddev_samp(x) AS sx, avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END) AS hit, avg(CASE WHEN r<0 THEN 1.0 ELSE 0 END) AS loss,
  sum(r) FILTER (r>0) AS gp, sum(r) FILTER (r<0) AS gl, avg(r) FILTER (r>0) AS au, avg(r) FILTER (r<0) AS ad FROM d JOIN q ON d.name=q.name GROUP BY d.name)
 SELECT name, round(average,6) AS average, round(mx,6) AS max, round(mn,6) AS min, round(mdd,6) AS max_drawdown, round(vol,6) AS volatility, round(down,6) AS downside, round(q5,6) AS var95, round(q1,6) AS var99, round(es5,6) AS es95, round(es1,6) AS es99,
 round(average*12,6) AS annual_average, round(pow(g,12.0/n)-1,6) AS annual_geometric, round(vol*sqrt(12),6) AS annual_volatility, round(down*sqrt(12),6) AS annual_downside, round(mx_x/nullif(sx,0),6) AS sharpe, round(average/nullif(vol,0),6) AS naive_sharpe,
 round(mx_x/nullif(down,0),6) AS sortino, round(average/nullif(abs(mdd),0),6) AS calmar, round(mx_x/nullif(sx,0)*sqrt(12),6) AS annual_sharpe, round(mx_x/nullif(down,0)*sqrt(12),6) AS annual_sortino, round(average*12/nullif(abs(mdd),0),6) AS annual_calmar,
 round(hit,6) AS hit_rate, round(loss,6) AS loss_rate, round(gp,6) AS gross_profit, round(gl,6) AS gross_loss, round(au,6) AS average_up, round(ad,6) AS average_down, round(au/nullif(abs(ad),0),6) AS slugging, round(gp/nullif(abs(gl),0),6) AS profit_factor FROM s"""


def _rounded(df, *keys):
    return df.select(*keys, *[r(c).alias(c) for c in df.columns if c not in keys])


@register("g8_return_stats", _stats_sql("0.0"))
def g8(spark, sf_dir):
    return _rounded(P.return_stats(stock_panel(spark, sf_dir), ["name"], "ret"), "name")


@register("g9_sort_performance", _stats_sql("0.001"))
def g9(spark, sf_dir):
    return _rounded(P.return_stats(stock_panel(spark, sf_dir).withColumn("rf", F.lit(0.001)), ["name"], "ret", rf="rf"), "name")


@register("g11_wealth_curve", f"{PANEL}, w AS (SELECT *, product(1+coalesce(ret,0)) {over(None, 0)} AS w FROM panel) SELECT {KEYS}, round(w,6) AS wealth, round(w/nullif(max(w) {over(None, 0)},0)-1,6) AS drawdown FROM w")
def g11(spark, sf_dir):
    return P.wealth_curve(stock_panel(spark, sf_dir), ["name"], "ret").select("name", day().alias("date"), r("wealth").alias("wealth"), r("drawdown").alias("drawdown"))


@register("g12_active_return", f"{PANEL} SELECT {KEYS}, round(ret-0.001-mkt,6) AS active FROM panel")
def g12(spark, sf_dir):
    df = stock_panel(spark, sf_dir)
    bench = df.groupBy("date").agg(F.avg("ret").alias("bench"))
    return df.join(bench, "date").select("name", day().alias("date"), r(F.col("ret") - 0.001 - F.col("bench")).alias("active"))


@register("g13_allocate_leveraged", f"""WITH RECURSIVE {PANEL[5:]}, o AS (SELECT name, date, coalesce(ret,0) AS r, row_number() OVER (PARTITION BY name ORDER BY date) AS i FROM panel),
 a AS (SELECT name, date, i, r, 0.5::DOUBLE AS w FROM o WHERE i=1 UNION ALL SELECT o.name, o.date, o.i, o.r,
  CASE WHEN abs(a.w*(1+2*o.r)/(a.w*(1+2*o.r)+1-a.w)-0.5) >= 0.1 THEN 0.5 ELSE a.w*(1+2*o.r)/(a.w*(1+2*o.r)+1-a.w) END FROM a JOIN o ON o.name=a.name AND o.i=a.i+1)
 SELECT {KEYS}, round(w,6) AS weight, round(w*2*r,6) AS port_r FROM a""")
def g13(spark, sf_dir):
    return P.allocate_leveraged(stock_panel(spark, sf_dir), "ret", 2.0, 0.5, 0.1).select("name", day().alias("date"), r("weight").alias("weight"), r("port_r").alias("port_r"))


@register("g14_calmar_vs_benchmark", f"""{PANEL}, x AS (SELECT * FROM panel WHERE ret IS NOT NULL), w AS (SELECT *, product(1+ret) {over(None, 0)} AS w FROM x), d AS (SELECT *, w/nullif(max(w) {over(None, 0)},0)-1 AS dd FROM w)
 SELECT name, round(avg(ret)/nullif(abs(min(dd)),0),6) AS calmar, avg(ret)/nullif(stddev_samp(ret),0) > avg(mkt)/nullif(stddev_samp(mkt),0) AS beats FROM d GROUP BY name""")
def g14(spark, sf_dir):
    curve = P.wealth_curve(stock_panel(spark, sf_dir).filter("ret is not null"), ["name"], "ret")
    sharpe = lambda c: ratio(F.avg(c), F.stddev_samp(c))
    return curve.groupBy("name").agg(r(ratio(F.avg("ret"), F.abs(F.min("drawdown")))).alias("calmar"), (sharpe("ret") > sharpe("mkt")).alias("beats"))


@register("g15_factor_sweep", f"""{MOMENTUM}, f AS (SELECT *, exp(sum({LN}) {over(1, 3)})-1 AS f3 FROM m), l AS (SELECT date, name, next_r, f3, 'mom' AS sig, mom AS value FROM f WHERE mom IS NOT NULL UNION ALL SELECT date, name, next_r, f3, 'vol', vol FROM f),
 k AS (SELECT *, ntile(5) OVER (PARTITION BY date, sig ORDER BY value, name) AS rank FROM l), b AS (SELECT date, sig, rank, 'next_r' AS forward, next_r AS r FROM k UNION ALL SELECT date, sig, rank, 'f3', f3 FROM k),
 p AS (SELECT date, sig, forward, rank, avg(r) AS r FROM b GROUP BY ALL), q AS (SELECT * FROM p UNION ALL SELECT date, sig, forward, 0, max(r) FILTER (rank=5)-max(r) FILTER (rank=1) FROM p GROUP BY ALL)
 SELECT sig, forward, rank::INTEGER AS rank, round(avg(r),6) AS mean, round(avg(r)*sqrt(count(r))/nullif(stddev_samp(r),0),6) AS t, count(r) AS n FROM q GROUP BY ALL""")
def g15(spark, sf_dir):
    df = momentum(spark, sf_dir).withColumn("f3", cumulative_return("ret", 1, 3))
    out = P.factor_sweep(df, ["mom", "vol"], ["next_r", "f3"], N)
    return out.select("sig", "forward", "rank", r("mean").alias("mean"), r("t").alias("t"), "n")


def _sweep(spark, sf_dir):
    """Statistics of the single sorts by each of six signals, signal in column sig."""
    df, out = momentum(spark, sf_dir).withColumn("size", F.col("mktcap")).withColumn("spread", ratio("ask", "bid")), None
    for signal in ("mom", "prc", "vol", "size", "ret", "spread"):
        one = P.sort_return(P.sort_portfolios(df, signal, "next_r", N), 1, 12.0, r="r").withColumn("sig", F.lit(signal))
        out = one if out is None else out.unionByName(one)
    return out


def _sweep_sql(where: str, select: str) -> str:
    signals = {"mom": "mom", "prc": "prc", "vol": "vol", "size": "mktcap", "ret": "ret", "spread": "ask/nullif(bid,0)"}
    each = " UNION ALL ".join(f"SELECT '{k}' AS sig, date, name, next_r, {v} AS value FROM m" for k, v in signals.items())
    return f"""{MOMENTUM}, l AS ({each}), k AS (SELECT *, ntile(5) OVER (PARTITION BY sig, date ORDER BY value, name) AS k FROM l WHERE value IS NOT NULL), p AS (SELECT sig, date, k, sum(next_r)/count(*) AS r FROM k GROUP BY ALL),
 q AS (SELECT sig, date, max(r) FILTER (k=5)-max(r) FILTER (k=1) AS r FROM p GROUP BY ALL) SELECT {select} FROM q WHERE r IS NOT NULL GROUP BY sig HAVING {where}"""


@register("g16_significant_sorts", _sweep_sql("abs(avg(r)) > 0.0001 AND abs(avg(r)*sqrt(count(*))/nullif(stddev_samp(r),0)) >= 2.1", "sig, round(avg(r),6) AS mean, round(avg(r)*sqrt(count(*))/nullif(stddev_samp(r),0),6) AS t"))
def g16(spark, sf_dir):
    """Long-short sorts of some return and a t statistic far from chance, of all six signals."""
    return P.significant_sorts(_sweep(spark, sf_dir), 0.0001, least_t=2.1).select("sig", r("mean").alias("mean"), r("t").alias("t"))


@register("g16_significant_by_p")
def g16_p(spark, sf_dir):
    return P.significant_sorts(_sweep(spark, sf_dir), 0.0001, most_p=0.05).select("sig", "mean", "p")


def _objective(df, lookback: int, rank: int):
    """Annual Sharpe ratio, net of cost, of one bucket of the volume-ratio sort."""
    df = df.withColumn("v_ratio", ratio(F.col("vol"), rolling_mean("vol", -lookback + 1, 0)))
    ports = P.sort_portfolios(df, "v_ratio", "next_r", N)
    return P.sort_return(ports.filter(F.col("sig_rank") == str(rank)).withColumn("port_r", F.col("r") - 0.001), 1, 12.0)


@register("g17_net_sharpe", f"""{MOMENTUM}, v AS (SELECT *, vol/nullif(avg(vol) {over(-5, 0)},0) AS v FROM m), k AS (SELECT *, ntile(5) OVER (PARTITION BY date ORDER BY v, name) AS k FROM v WHERE v IS NOT NULL),
 p AS (SELECT date, avg(next_r)*count(next_r)/count(*)-0.001 AS r FROM k WHERE k=5 GROUP BY date) SELECT round(avg(r)/nullif(stddev_samp(r),0)*sqrt(12),6) AS sharpe FROM p""")
def g17(spark, sf_dir):
    return _objective(momentum(spark, sf_dir), 6, 5).select(r("sharpe").alias("sharpe"))


def _sweep_lookbacks() -> str:
    each = " UNION ALL ".join(f"SELECT {n} AS lookback, date, name, next_r, vol/nullif(avg(vol) {over(-n + 1, 0)},0) AS v FROM m" for n in (3, 6, 12))
    return f"""{MOMENTUM}, v AS ({each}), k AS (SELECT *, ntile(5) OVER (PARTITION BY lookback, date ORDER BY v, name) AS k FROM v WHERE v IS NOT NULL),
 p AS (SELECT lookback, date, avg(next_r)*count(next_r)/count(*)-0.001 AS r FROM k WHERE k=5 GROUP BY ALL) SELECT lookback::INTEGER AS lookback, round(avg(r)/nullif(stddev_samp(r),0)*sqrt(12),6) AS sharpe FROM p GROUP BY 1"""


@register("g18_param_sweep", _sweep_lookbacks())
def g18(spark, sf_dir):
    df = momentum(spark, sf_dir)
    out = P.parameter_sweep({"lookback": [3, 6, 12]}, lambda lookback: _objective(df, lookback, 5).select("sharpe"), "sharpe")
    return out.select("lookback", r("sharpe").alias("sharpe"))


@register("c10_long_short", f"{_ports()} SELECT strftime(date,'%Y-%m-%d') AS date, round(r,6) AS r, n_assets FROM s WHERE sig_rank='high_minus_low'")
def c10(spark, sf_dir):
    return single(spark, sf_dir).filter(F.col("sig_rank") == P.LONG_SHORT).select(day().alias("date"), r("r").alias("r"), "n_assets")


@register("d12_portfolio_aggregate", f"{_ports()} SELECT strftime(date,'%Y-%m-%d') AS date, sig_rank, round(r,6) AS r, array_to_string(members,',') AS members, n_assets FROM s WHERE sig_rank <> 'high_minus_low'")
def d12(spark, sf_dir):
    return single(spark, sf_dir, True).filter(F.col("sig_rank") != P.LONG_SHORT).select(day().alias("date"), "sig_rank", r("r").alias("r"), F.array_join("members", ",").alias("members"), "n_assets")


@register("d13_equal_weight", f"{PANEL} SELECT strftime(date,'%Y-%m-%d') AS date, round(avg(ret*CASE WHEN mkt>0 THEN 1 ELSE -1 END),6) AS r FROM panel GROUP BY 1")
def d13(spark, sf_dir):
    position = F.when(F.col("mkt") > 0, 1).otherwise(-1)
    return equal_weight_portfolio(stock_panel(spark, sf_dir), "ret", position).select(day().alias("date"), r("r").alias("r"))


@register("c13_membership_change", f"""{_ports()}, u AS (SELECT date, sig_rank, unnest(members) AS member FROM s WHERE sig_rank='5'), n AS (SELECT DISTINCT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM u))
 SELECT strftime(n.next_date,'%Y-%m-%d') AS date, u.member FROM u JOIN n ON u.date=n.date AND n.next_date IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.date=n.next_date AND v.member=u.member)""")
def c13(spark, sf_dir):
    top = P.ranked_rows(momentum(spark, sf_dir), "mom", N).filter(F.col("sig_rank") == N)
    return P.members_that_left(top, ["sig_rank"]).select(day().alias("date"), F.col("name").cast("string").alias("member"))
