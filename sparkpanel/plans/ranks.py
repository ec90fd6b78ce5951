"""Queries of ranks and selections on the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as N
from ..operators import ranking as K
from ..operators import sections as P
from ..panel import ratio
from .fixtures import KEYS, PANEL, day, r, stock_panel, table
from .registry import register


@register("f1_ntile", f"{PANEL} SELECT {KEYS}, ntile(5) OVER (PARTITION BY date ORDER BY prc, name)::INTEGER AS bucket FROM panel")
def f1(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), K.ntile_rank("prc", 5).cast("int").alias("bucket"))


@register("f2_pct_rank", f"{PANEL} SELECT {KEYS}, round((rank() OVER (PARTITION BY date ORDER BY vol) + (count(*) OVER (PARTITION BY date, vol)-1)/2.0)/count(*) OVER (PARTITION BY date),6) AS pct FROM panel")
def f2(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), r(K.pct_rank("vol")).alias("pct"))


@register("f3_qcut", f"""{PANEL}, e AS (SELECT date, quantile_cont(prc, [0.2,0.4,0.6,0.8]) AS q FROM panel GROUP BY date)
 SELECT p.name, strftime(p.date,'%Y-%m-%d') AS date, (1+len(list_filter(q, lambda x: p.prc > x)))::INTEGER AS bucket FROM panel p JOIN e ON p.date=e.date""")
def f3(spark, sf_dir):
    return K.qcut_rank(stock_panel(spark, sf_dir), "prc", 5).select("name", day().alias("date"), F.col("bucket").cast("int").alias("bucket"))


@register("f3_section_places", f"""{PANEL}, e AS (SELECT date, quantile_cont(vol, [0.2,0.4,0.6,0.8]) AS q, quantile_cont(mktcap, [0.2,0.8]) AS m FROM panel GROUP BY date)
 SELECT p.name, strftime(p.date,'%Y-%m-%d') AS date, ntile(5) OVER (PARTITION BY p.date ORDER BY vol, name)::INTEGER AS tile, row_number() OVER (PARTITION BY p.date ORDER BY vol, name) AS position,
 round((rank() OVER (PARTITION BY p.date ORDER BY vol) + (count(*) OVER (PARTITION BY p.date, vol)-1)/2.0)/count(*) OVER (PARTITION BY p.date),6) AS pct, (1+len(list_filter(q, lambda x: p.vol > x)))::INTEGER AS bucket FROM panel p JOIN e ON p.date=e.date""")
def f3_places(spark, sf_dir):
    """Tiles, ranks and quantile buckets by ranges of (date, value), for sections larger than a task."""
    placed = P.positions(stock_panel(spark, sf_dir).select("name", "date", "vol"), ["date"], "vol", "name")
    return P.qcut(placed, ["date"], "vol", 5).select("name", day().alias("date"), P.ntile(5).alias("tile"), "position", r(P.pct_rank()).alias("pct"), "bucket")


@register("f4_rank_spread", f"""{PANEL}, p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY vol, name)::DOUBLE/count(*) OVER (PARTITION BY date) AS p FROM panel)
 SELECT strftime(date,'%Y-%m-%d') AS date, round(avg(ret) FILTER (p > 1-1.0/5) - avg(ret) FILTER (p <= 1.0/5),6) AS port_r FROM p GROUP BY 1""")
def f4(spark, sf_dir):
    return K.rank_spread(stock_panel(spark, sf_dir), "ret", "vol", 5).select(day().alias("date"), r("port_r").alias("port_r"))


@register("f5_top_by_size", f"""{PANEL}, k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY mktcap DESC)+(count(*) OVER (PARTITION BY date, mktcap)-1)/2.0 AS k FROM panel) SELECT {KEYS}, round(mktcap,2) AS mktcap FROM k WHERE k<=4""")
def f5(spark, sf_dir):
    return K.top_by_size(stock_panel(spark, sf_dir), "mktcap", 4).select("name", day().alias("date"), r("mktcap", 2).alias("mktcap"))


@register("f6_top_n", f"{PANEL} SELECT {KEYS}, 10000.0::DOUBLE AS money, floor(10000.0/nullif(prc,0))::BIGINT AS shares FROM panel ORDER BY vol_d DESC, panel.date, name LIMIT 10")
def f6(spark, sf_dir):
    return K.top_n(stock_panel(spark, sf_dir), "vol_d", 10, 100_000.0, "prc", "date", "name").select("name", day().alias("date"), "money", "shares")


@register("f7_targets", f"""{PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY prc, name) AS l, row_number() OVER (PARTITION BY date ORDER BY prc DESC, name DESC) AS h FROM panel)
 SELECT {KEYS}, (CASE WHEN l<=3 THEN -1000.0/3 WHEN h<=3 THEN 1000.0/3 ELSE 0 END)::DOUBLE AS target FROM k""")
def f7(spark, sf_dir):
    return K.long_short_targets(stock_panel(spark, sf_dir), "prc", 3, 1000.0).select("name", day().alias("date"), "target")


@register("f8_last_row", f"{PANEL} SELECT {KEYS}, round(prc,6) AS prc FROM panel QUALIFY row_number() OVER (PARTITION BY name ORDER BY panel.date DESC)=1")
def f8(spark, sf_dir):
    return K.last_row(stock_panel(spark, sf_dir)).select("name", day().alias("date"), r("prc").alias("prc"))


@register("f13_min_history", f"{PANEL} SELECT {KEYS} FROM panel QUALIFY count(*) OVER (PARTITION BY name) >= 82")
def f13(spark, sf_dir):
    return N.min_history(stock_panel(spark, sf_dir), 82, ["name"]).select("name", day().alias("date"))


@register("f15_every_nth", f"{PANEL} SELECT {KEYS} FROM panel QUALIFY (row_number() OVER (PARTITION BY name ORDER BY panel.date)-1) % 4 = 0")
def f15(spark, sf_dir):
    return K.every_nth(stock_panel(spark, sf_dir), ["name"], "date", 4).select("name", day().alias("date"))


@register("f16_sample", """SELECT * FROM orders WHERE ('0x'||substr(md5(o_orderkey::VARCHAR),1,8))::BIGINT/4294967296.0 < 500.0/(SELECT count(*) FROM orders)""")
def f16(spark, sf_dir):
    return K.sample_rows(table(spark, sf_dir, "orders"), 500, "o_orderkey")


@register("f18_assign_slots", """WITH a AS (SELECT c_custkey AS account, c_acctbal AS value FROM customer WHERE c_acctbal > 0), s AS (SELECT account, floor(value/5000.0) AS slots FROM a),
 t AS (SELECT account, slots, sum(slots) OVER (ORDER BY account ROWS UNBOUNDED PRECEDING) AS upto FROM s), p AS (SELECT p_partkey AS name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
 SELECT account, p.name, p.rank FROM p JOIN t ON p.rank > upto-slots AND p.rank <= upto""")
def f18(spark, sf_dir):
    accounts = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("value"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), "p_retailprice")
    ranked = K.running_total(parts, -F.col("p_retailprice"), [F.desc("p_retailprice"), F.col("name")], F.lit(1).cast("long"), "rank")
    return K.assign_slots(accounts, ranked, 5000.0)


@register("b11_illiquidity", f"{PANEL} SELECT {KEYS}, round(abs(ret)/nullif(vol_d,0)*1e6,6) AS illiq FROM panel")
def b11(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), r(N.illiquidity("ret", "vol_d") * 1e6).alias("illiq"))


@register("b12_turnover", f"{PANEL} SELECT {KEYS}, round(vol/nullif(shrout,0),6) AS turnover FROM panel")
def b12(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), r(N.turnover("vol", "shrout")).alias("turnover"))


@register("b13_spread", f"{PANEL} SELECT {KEYS}, round(ask/nullif(bid,0)-1,6) AS spread FROM panel")
def b13(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), r(N.quote_spread("bid", "ask")).alias("spread"))


@register("b15_average_abs_return", f"{PANEL} SELECT {KEYS}, round((abs(ret)+abs(ask/prc-1)+abs(bid/prc-1))/3,6) AS avg_abs FROM panel")
def b15(spark, sf_dir):
    mean = N.average_absolute("ret", ratio("ask", "prc") - 1, ratio("bid", "prc") - 1)
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), r(mean).alias("avg_abs"))


@register("b16_spread_pct", f"{PANEL} SELECT {KEYS}, round((ask-bid)/nullif((ask+bid)/2,0),6) AS spread_pct FROM panel")
def b16(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), r(N.spread_pct("bid", "ask")).alias("spread_pct"))


@register("b20_threshold_position", f"""{PANEL} SELECT {KEYS}, CASE WHEN ret>0.1 THEN 1 WHEN ret < -0.1 THEN -1 ELSE 0 END AS position,
 round(CASE WHEN ret>0.1 THEN 1 WHEN ret < -0.1 THEN -1 ELSE 0 END * lead(ret) OVER (PARTITION BY name ORDER BY panel.date),6) AS r FROM panel""")
def b20(spark, sf_dir):
    return stock_panel(spark, sf_dir).select("name", day().alias("date"), N.threshold_position("ret", 0.1).alias("position"), r(N.forward_position_return("ret", 0.1)).alias("r"))


@register("b30_liquidity_screen", f"{PANEL}, z AS (SELECT *, (vol-avg(vol) OVER (PARTITION BY date))/nullif(stddev_samp(vol) OVER (PARTITION BY date),0) AS z FROM panel) SELECT {KEYS} FROM z WHERE z > 0 AND prc > 1000 AND vol_d > 100000 AND ret IS NOT NULL")
def b30(spark, sf_dir):
    from ..operators.rolling import section_zscore

    df = stock_panel(spark, sf_dir).withColumn("z", section_zscore("vol"))
    return N.liquidity_screen(df, {"z": 0, "prc": 1000, "vol_d": 100_000}, ("ret",)).select("name", day().alias("date"))
