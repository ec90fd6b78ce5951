"""Batch twins of the streaming jobs, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import live as M
from .fixtures import DAYS, PANEL, day, over, r, stock_panel, table
from .registry import register


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value")


@register("m1_live_volume_ratio", f"""{DAYS}, h AS (SELECT name, avg(value) AS average FROM days WHERE date < TIMESTAMP '2024-01-20' GROUP BY 1)
 SELECT d.name, strftime(date,'%Y-%m-%d') AS date, round(value/nullif(average,0),6) AS v_ratio FROM days d JOIN h ON d.name=h.name WHERE date >= TIMESTAMP '2024-01-20' AND value/nullif(average,0) >= 1.5""")
def m1(spark, sf_dir):
    daily = M.daily_volume(events(spark, sf_dir))
    cut = F.lit("2024-01-20").cast("timestamp")
    history = daily.filter(F.col("date") < cut).groupBy("name").agg(F.avg("volume").alias("average"))
    return M.volume_ratio(daily.filter(F.col("date") >= cut), history, 1.5).select("name", day().alias("date"), r("v_ratio").alias("v_ratio"))


@register("m1_live_top", """WITH d AS (SELECT user_id AS name, date_trunc('day', ts) AS date, count(*)::DOUBLE AS v, arg_min(value, ts) AS f, arg_max(value, ts) AS l, max(value) AS h, min(value) AS lo FROM events GROUP BY 1,2),
 q AS (SELECT name, date, v, l, v*l AS vd, (abs(h/nullif(f,0)-1)+abs(lo/nullif(f,0)-1)+abs(l/nullif(f,0)-1))/3 AS r_avg FROM d), g AS (SELECT name, avg(v) AS average FROM q WHERE date < TIMESTAMP '2024-01-20' GROUP BY 1),
 k AS (SELECT q.*, v/nullif(average,0) AS v_ratio FROM q JOIN g ON q.name=g.name WHERE date >= TIMESTAMP '2024-01-20' AND vd >= 100 AND abs(r_avg) <= 2)
 SELECT name, strftime(date,'%Y-%m-%d') AS date, round(vd,6) AS v_d_today, round(r_avg,6) AS r_avg, round(v_ratio,6) AS v_ratio FROM k ORDER BY k.v_ratio DESC, name, k.date LIMIT 50""")
def m1_top(spark, sf_dir):
    """The top of today's volume over its history, among quotes of enough value that moved little."""
    trades = events(spark, sf_dir).select("name", "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    quotes, cut = M.daily_quotes(trades), F.lit("2024-01-20").cast("timestamp")
    history = quotes.filter(F.col("date") < cut).groupBy("name").agg(F.avg("v_today").alias("average"))
    found = M.top(M.live_volume_ratio(quotes.filter(F.col("date") >= cut), history, 100.0, 2.0), "v_ratio", 50)
    return found.select("name", day().alias("date"), r("v_d_today").alias("v_d_today"), r("r_avg").alias("r_avg"), r("v_ratio").alias("v_ratio"))


W12, W6, W3 = over(-11, 0), over(-5, 0), over(-2, 0)


@register("m2_scheduled_signal", f"""{PANEL}, a AS (SELECT *, (ret-avg(ret) {W12})/nullif(stddev_samp(ret) {W12},0) AS z, avg(CASE WHEN ret<0 AND mkt<0 THEN 1.0 ELSE 0 END) {W6} AS c0 FROM panel), b AS (SELECT *, avg(c0) {W3} AS c FROM a),
 d AS (SELECT *, (c-avg(c) {W12})/nullif(stddev_samp(c) {W12},0) AS cz FROM b), e AS (SELECT name, date, coalesce(z,0)+coalesce(cz,0) AS signal FROM d QUALIFY row_number() OVER (PARTITION BY name ORDER BY date DESC)=1),
 k AS (SELECT *, row_number() OVER (ORDER BY round(signal,9), name) AS l, row_number() OVER (ORDER BY round(signal,9) DESC, name DESC) AS h FROM e) SELECT name, round(signal,6) AS signal, CASE WHEN l<=3 THEN -100.0 WHEN h<=3 THEN 100.0 ELSE 0 END::DOUBLE AS target FROM k""")
def m2(spark, sf_dir):
    return M.scheduled_signal(stock_panel(spark, sf_dir), "ret", "mkt", 3, 300.0).select("name", r("signal").alias("signal"), "target")
