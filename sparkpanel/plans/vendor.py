"""Queries of sources, cleaning, linking and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.checkpoints import scratch_path
from ..operators import enrich as N
from ..operators import etl as X
from ..operators.rolling import forward_fill
from ..panel import ratio
from ..sources import tables
from ..operators.intervals import interval_tree_join
from .fixtures import BRANDS, DAYS, HISTORY, KEYS, PANEL, day, day_panel, name_history, pair_prices, r, stock_panel, table
from .registry import register


@register("a1_read_panel", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_quantity > 45")
def a1(spark, sf_dir):
    where = (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")) & (F.col("l_quantity") > 45)
    return tables.read_panel(spark, f"{sf_dir}/lineitem.parquet", where, ["l_orderkey", "l_linenumber", "l_quantity"])


@register("a3_read_source", "SELECT r_regionkey, r_name FROM region")
def a3(spark, sf_dir):
    return tables.read_source(spark, "parquet", f"{sf_dir}/region.parquet")


def _by_year(spark, sf_dir) -> str:
    """orders as a table with one folder per year; its path."""
    path = scratch_path(spark, "orders-by-year")
    tables.write_table(table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), path, by=["year"])
    return path


@register("a2_write_table", "SELECT o_orderkey, o_totalprice, year(o_orderdate)::INTEGER AS year FROM orders")
def a2(spark, sf_dir):
    return tables.read_panel(spark, _by_year(spark, sf_dir), columns=["o_orderkey", "o_totalprice", "year"])


@register("a4_read_yearly", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def a4(spark, sf_dir):
    return tables.read_yearly(spark, f"{_by_year(spark, sf_dir)}/year={{year}}", 1996, 1998).select("o_orderkey", "o_totalprice")


@register("a8_read_csv_table", "SELECT p_partkey, p_retailprice FROM part")
def a8(spark, sf_dir):
    path = scratch_path(spark, "part-csv")
    tables.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), path, "p_partkey")
    return tables.read_csv_table(spark, path, "p_partkey long, p_retailprice double")


@register("a9_write_csv", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IS NOT NULL")
def a9(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    tables.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), path, "c_custkey")
    return spark.read.schema("c_custkey long, c_mktsegment string").option("header", True).csv(path)


@register("a10_append_result", """SELECT 'mean_price' AS name, '{"status":"'||o_orderstatus||'"}' AS parameters, '{"mean":"'||round(avg(o_totalprice),6)::VARCHAR||'"}' AS stats FROM orders GROUP BY o_orderstatus""")
def a10(spark, sf_dir):
    """Mean price by order status, logged as one record each."""
    path = scratch_path(spark, "results")
    for row in table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("mean")).orderBy("o_orderstatus").collect():
        tables.append_result(spark, path, "mean_price", {"status": row.o_orderstatus}, {"mean": round(row["mean"], 6)})
    return spark.read.parquet(path).select("name", "parameters", "stats")


DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def _database(spark, sf_dir) -> str:
    """A database with the orders of a year; an embedded one lives in one JVM, so in local mode only."""
    url = f"jdbc:derby:{scratch_path(spark, 'jdbc').removeprefix('file:')};create=true"
    rows = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == 1997).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    tables.write_jdbc(rows, url, "orders", driver=DERBY)
    return url


@register("a5_write_jdbc", "SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate,'%Y-%m-%d') AS date FROM orders WHERE year(o_orderdate)=1997")
def a5(spark, sf_dir):
    """The orders of a year, written to a database and read again."""
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    return tables.read_jdbc(spark, _database(spark, sf_dir), "orders", columns, driver=DERBY).select(*columns[:3], day("o_orderdate").alias("date"))


@register("a6_read_jdbc", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND year(o_orderdate)=1997")
def a6(spark, sf_dir):
    """Two columns from a date on, both picked by the database, read in four parts."""
    where = F.col("o_orderdate") >= F.lit("1997-07-01").cast("timestamp")
    return tables.read_jdbc(spark, _database(spark, sf_dir), "orders", ["o_orderkey", "o_totalprice"], where, ("o_custkey", 0, 10_000, 4), driver=DERBY)


@register("a7_signal_store", f"{PANEL}, a AS (SELECT name, date, ret AS sig_a FROM panel WHERE ret > 0), b AS (SELECT name, date, vol AS sig_b FROM panel WHERE vol > 100) SELECT p.name, strftime(p.date,'%Y-%m-%d') AS date, round(prc,6) AS prc, round(sig_a,6) AS sig_a, round(sig_b,6) AS sig_b FROM panel p JOIN a USING (name, date) JOIN b USING (name, date)")
def a7(spark, sf_dir):
    df = stock_panel(spark, sf_dir)
    signals = [df.filter("ret > 0").select("name", "date", F.col("ret").alias("sig_a")), df.filter("vol > 100").select("name", "date", F.col("vol").alias("sig_b"))]
    return tables.load_signal_store(df.select("name", "date", "prc"), signals, ["name", "date"]).select("name", day().alias("date"), *[r(c).alias(c) for c in ("prc", "sig_a", "sig_b")])


@register("a11_trading_days", """WITH h AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderkey % 50 = 0), d AS (SELECT x::DATE AS date FROM range(DATE '1996-01-01', DATE '1998-12-31' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(x)),
 k AS (SELECT date, row_number() OVER (ORDER BY date)-1 AS i FROM d WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM h)) SELECT strftime(date,'%Y-%m-%d') AS date FROM k WHERE i % 5 = 0""")
def a11(spark, sf_dir):
    holidays = table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select(F.to_date("o_orderdate").alias("date"))
    return X.trading_days(spark, "1996-01-01", "1998-12-31", 5, holidays).select(day().alias("date"))


MESSY = """WITH m AS (SELECT *, CASE WHEN l_linenumber=7 THEN -l_quantity WHEN l_linenumber=6 THEN 0 ELSE l_quantity END AS q, CASE WHEN l_linenumber=7 THEN -l_extendedprice ELSE l_extendedprice END AS p FROM lineitem)"""


def messy(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("*", F.when(n == 7, -F.col("l_quantity")).when(n == 6, 0.0).otherwise(F.col("l_quantity")).alias("q"), F.when(n == 7, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("p"))


@register("b1_null_if_negative", f"{MESSY} SELECT l_suppkey, count(CASE WHEN q >= 0 THEN q END) AS n_q, round(sum(CASE WHEN p >= 0 THEN p END),2) AS sum_p FROM m GROUP BY 1")
def b1(spark, sf_dir):
    return X.null_if_negative(messy(spark, sf_dir), ["q", "p"]).groupBy("l_suppkey").agg(F.count("q").alias("n_q"), r(F.sum("p"), 2).alias("sum_p"))


@register("b2_recode", "SELECT CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'R' THEN 'P' ELSE l_returnflag END AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def b2(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(X.recode("l_returnflag", {"A": "C", "R": "P"}).alias("flag")).agg(F.count("*").alias("n"))


@register("b3_cast_columns", "SELECT o_orderkey, o_totalprice::INTEGER AS o_totalprice, o_custkey::VARCHAR AS o_custkey FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice, o_custkey FROM orders)")
def b3(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("o_totalprice"), "o_custkey")
    return X.cast_columns(df, {"o_totalprice": "int", "o_custkey": "string"})


@register("b4_option_enrich", """WITH o AS (SELECT l_orderkey, l_suppkey AS optionid, l_returnflag AS symbol, l_shipdate AS date, o_orderdate AS exdate, l_extendedprice AS strike_price, l_quantity AS best_bid, l_quantity*(1+l_tax-l_discount) AS best_offer,
 (l_partkey % 100)::DOUBLE AS volume, 100.0::DOUBLE AS contract_size, 1+l_discount AS cfadj, l_linenumber::DOUBLE AS open_interest FROM lineitem JOIN orders ON l_orderkey=o_orderkey), m AS (SELECT *, (best_bid+best_offer)/2 AS mid, (best_offer-best_bid)/nullif((best_bid+best_offer)/2,0) AS wide FROM o)
 SELECT l_orderkey, optionid::VARCHAR||symbol AS unique_optionid, date_diff('day', date, exdate)::INTEGER AS exdays, round(strike_price/1000,8) AS strike_price, round(mid,8) AS opt_prc, round(CASE WHEN wide >= 0 THEN wide END,8) AS opt_spread, round(best_offer*cfadj,8) AS opt_offer_adj,
 round(best_bid*cfadj,8) AS opt_bid_adj, round(volume*contract_size/cfadj,8) AS opt_vol_adj, round(volume*contract_size*mid,6) AS opt_vold, round(mid*cfadj,8) AS opt_prc_adj, round(open_interest/cfadj,8) AS open_interest_adj FROM m""")
def b4(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    options = df.select(
        "l_orderkey", F.col("l_suppkey").alias("optionid"), F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("date"), F.col("o_orderdate").alias("exdate"), F.col("l_extendedprice").alias("strike_price"),
        F.col("l_quantity").alias("best_bid"), (F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("best_offer"), (F.col("l_partkey") % 100).cast("double").alias("volume"), F.lit(100.0).alias("contract_size"),
        (1 + F.col("l_discount")).alias("cfadj"), F.col("l_linenumber").cast("double").alias("open_interest"),
    )
    numbers = ("strike_price", "opt_prc", "opt_spread", "opt_offer_adj", "opt_bid_adj", "opt_vol_adj", "opt_prc_adj", "open_interest_adj")
    return N.option_enrich(options).select("l_orderkey", "unique_optionid", "exdays", *[r(c, 8).alias(c) for c in numbers], r("opt_vold").alias("opt_vold"))


@register("b5_stock_enrich", f"""{MESSY}, s AS (SELECT l_orderkey, p AS prc, q AS vol, l_partkey::DOUBLE AS shrout, l_tax AS ret, p*1.01 AS openprc, abs(p)*1.05 AS askhi, abs(p)*0.95 AS bidlo, 1+l_discount AS cfacshr FROM m)
 SELECT l_orderkey, abs(prc) AS prc, round(abs(prc)*vol,6) AS vol_d, shrout*1000 AS shrout, round(abs(prc)*(shrout*1000),4) AS mktcap, round((1+ret)*openprc/nullif(abs(prc),0)-1,8) AS ret_o, round((1+ret)*askhi/nullif(abs(prc),0)-1,8) AS ret_h,
 round((1+ret)*bidlo/nullif(abs(prc),0)-1,8) AS ret_l, round(vol*cfacshr,8) AS vol_adj, round(abs(prc)/nullif(cfacshr,0),8) AS prc_adj FROM s WHERE prc <> 0""")
def b5(spark, sf_dir):
    p = F.col("p")
    stocks = messy(spark, sf_dir).select(
        "l_orderkey", p.alias("prc"), F.col("q").alias("vol"), F.col("l_partkey").cast("double").alias("shrout"), F.col("l_tax").alias("ret"), (p * 1.01).alias("openprc"), (F.abs(p) * 1.05).alias("askhi"), (F.abs(p) * 0.95).alias("bidlo"),
        (1 + F.col("l_discount")).alias("cfacshr"),
    )
    numbers = ("ret_o", "ret_h", "ret_l", "vol_adj", "prc_adj")
    return N.stock_enrich(stocks).select("l_orderkey", "prc", r("vol_d").alias("vol_d"), "shrout", r("mktcap", 4).alias("mktcap"), *[r(c, 8).alias(c) for c in numbers])


@register("b6_security_filter", "SELECT p_partkey, p_size FROM part WHERE p_size IN (10,11,12,18,30,31)")
def b6(spark, sf_dir):
    return N.security_filter(table(spark, sf_dir, "part"), "p_size").select("p_partkey", "p_size")


@register("b7_link_filter", "WITH t AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS seg, c_nationkey FROM customer) SELECT c_custkey, seg FROM t WHERE c_custkey IS NOT NULL AND c_nationkey <> 3 AND seg NOT IN ('BUILDING','MACHINERY')")
def b7(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("seg", F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_mktsegment")))
    return N.link_filter(df, "c_custkey", "c_nationkey", "seg", 3, ("BUILDING", "MACHINERY")).select("c_custkey", "seg")


@register("b8_earnings_surprise", "WITH s AS (SELECT l_orderkey, max(l_extendedprice) AS actual, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1) SELECT l_orderkey, round(actual-mean,7) AS ue, round((actual-mean)/nullif(sd,0),6) AS sue FROM s")
def b8(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("actual"), F.avg("l_extendedprice").alias("meanest"), F.stddev_samp("l_extendedprice").alias("stdev"))
    return N.earnings_surprise(df).select("l_orderkey", r("ue", 7).alias("ue"), r("sue").alias("sue"))


@register("b9_report_date", "WITH d AS (SELECT o_orderkey, max(l_shipdate) FILTER (l_returnflag='A') AS a, max(l_shipdate) FILTER (l_returnflag='R') AS b, max(l_shipdate) FILTER (l_returnflag='N') AS c, any_value(o_orderpriority) AS p FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1) SELECT o_orderkey, strftime(greatest(a,b,c),'%Y-%m-%d') AS date, substr(p,1,3) AS key3 FROM d WHERE greatest(a,b,c) IS NOT NULL")
def b9(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = lambda v: F.max(F.when(F.col("l_returnflag") == v, F.col("l_shipdate")))
    out = df.groupBy("o_orderkey").agg(flag("A").alias("a"), flag("R").alias("b"), flag("N").alias("c"), F.first("o_orderpriority").alias("key3"))
    return N.report_date(out, ["a", "b", "c"], "key3", 3).select("o_orderkey", day().alias("date"), "key3")


@register("b10_fundamental_ratios", f"{PANEL} SELECT {KEYS}, round(vol*1e6/nullif(mktcap,0),6) AS bm, round(mktcap/nullif(vol*1e6,0),6) AS pb FROM panel")
def b10(spark, sf_dir):
    return N.fundamental_ratios(stock_panel(spark, sf_dir), "vol").select("name", day().alias("date"), r("bm").alias("bm"), r("pb").alias("pb"))


@register("b17_weekday_filter", "SELECT o_orderkey, strftime(o_orderdate,'%a') AS d FROM orders WHERE strftime(o_orderdate,'%a') IN ('Fri','Sat')")
def b17(spark, sf_dir):
    return N.weekday_filter(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", F.date_format("o_orderdate", "E").alias("d"))


@register("b18_year_filter", "SELECT o_orderkey FROM orders WHERE year(o_orderdate)=1997")
def b18(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").filter((d >= F.lit("1997-01-01").cast("timestamp")) & (d < F.lit("1998-01-01").cast("timestamp"))).select("o_orderkey")


@register("b19_train_test_by_date", "SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1")
def b19(spark, sf_dir):
    cut, df = F.lit("1998-01-01").cast("timestamp"), table(spark, sf_dir, "orders")
    train, test = df.filter(F.col("o_orderdate") < cut), df.filter(F.col("o_orderdate") >= cut)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@register("b21_symbol_filter", "WITH t AS (SELECT p_partkey, p_name, regexp_extract(p_name,'^([a-z]+) ',1) AS base FROM part), f AS (SELECT p_partkey, CASE base WHEN 'blue' THEN 'dark blue' ELSE base END AS base FROM t WHERE base <> '' AND NOT regexp_matches(p_name,'ring|bolt')) SELECT * FROM f WHERE base NOT IN ('red')")
def b21(spark, sf_dir):
    return N.symbol_filter(table(spark, sf_dir, "part"), "p_name", "^([a-z]+) ", ("ring", "bolt"), ("red",), {"blue": "dark blue"}).select("p_partkey", "base")


@register("b22_classify_by_pattern", "SELECT p_partkey, CASE WHEN regexp_matches(p_type,'ECO|MED') THEN 'E' WHEN regexp_matches(p_type,'STAN') THEN 'S' ELSE 'X' END AS code FROM part")
def b22(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.classify_by_pattern("p_type", {"ECO|MED": "E", "STAN": "S"}, "X").alias("code"))


@register("b23_normalize_klines", "WITH k AS (SELECT event_id, epoch_us(ts)//1000 AS ms, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE value::VARCHAR END AS v FROM events) SELECT event_id, strftime(make_timestamp(ms*1000),'%Y-%m-%d %H:%M:%S') AS open_time, TRY_CAST(v AS DOUBLE) AS open FROM k")
def b23(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    raw = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("open_time"), text.alias("open"))
    return N.normalize_klines(raw, ("open_time",), ("open",), ("event_id",)).withColumn("open_time", F.date_format("open_time", "yyyy-MM-dd HH:mm:ss"))


@register("b24_step_precision", "WITH t AS (SELECT DISTINCT l_discount::VARCHAR AS tick FROM lineitem) SELECT tick, coalesce(length(nullif(regexp_extract(tick,'^0\\.(.*[1-9])',1),'')),0)::INTEGER AS digits FROM t")
def b24(spark, sf_dir):
    ticks = table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("string").alias("tick")).distinct()
    return ticks.select("tick", N.step_precision("tick").alias("digits"))


@register("b25_size_exchange_filter", "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_type IN ('LARGE','ECONOMY')) AND p_brand <> 'Brand#1' AND p_retailprice > 950")
def b25(spark, sf_dir):
    big = (F.col("p_size") > 40) | F.col("p_type").isin("LARGE", "ECONOMY")
    return N.size_exchange_filter(table(spark, sf_dir, "part"), big, "p_brand", ("Brand#1",), F.col("p_retailprice") > 950).select("p_partkey")


@register("b26_one_hot", "SELECT o_orderkey, (o_orderstatus='O')::INTEGER AS \"o_orderstatus_O\", (o_orderstatus='P')::INTEGER AS \"o_orderstatus_P\" FROM orders")
def b26(spark, sf_dir):
    return X.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], drop_first=True).drop("o_orderstatus")


@register("b27_text_concat", "SELECT p_partkey, coalesce(p_name,'')||' '||coalesce(p_brand,'')||' '||coalesce(p_type,'') AS soup FROM part")
def b27(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.text_concat(["p_name", "p_brand", "p_type"]).alias("soup"))


@register("b28_flatten_snapshot", "WITH s AS (SELECT event_id, user_id, ts, value, (props::JSON->>'k')::INTEGER AS k FROM events) SELECT event_id, k, round(value/nullif(k,0)-1,6) AS ret FROM s WHERE ts >= TIMESTAMP '2024-01-20'")
def b28(spark, sf_dir):
    since = F.lit("2024-01-20").cast("timestamp")
    flat = N.flatten_snapshot(table(spark, sf_dir, "events"), {"last": "value", "k": "props.k"}, "k", "ts", since, "k int", "props")
    return flat.select("event_id", "k", r("r_last").alias("ret"))


@register("c2_inner_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey=n_nationkey")
def c2(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@register("c1_multi_join", f"{PANEL}, a AS (SELECT name, date, vol FROM panel WHERE vol > 50), b AS (SELECT name, date, bid FROM panel WHERE bid > 100), c AS (SELECT name, date, ask FROM panel) SELECT a.name, strftime(a.date,'%Y-%m-%d') AS date, round(vol,6) AS vol, round(bid,6) AS bid, round(ask,6) AS ask FROM a JOIN b USING (name, date) JOIN c USING (name, date)")
def c1(spark, sf_dir):
    df = stock_panel(spark, sf_dir)
    parts = [df.filter("vol > 50").select("name", "date", "vol"), df.filter("bid > 100").select("name", "date", "bid"), df.select("name", "date", "ask")]
    return X.multi_join(parts, ["name", "date"]).select("name", day().alias("date"), *[r(c).alias(c) for c in ("vol", "bid", "ask")])


@register("c3_membership_flag", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority='1-URGENT') THEN 'Y' END AS urgent FROM customer")
def c3(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return X.membership_flag(table(spark, sf_dir, "customer").select("c_custkey"), urgent, ["c_custkey"], "urgent")


@register("c4_right_join", f"{DAYS}, q AS (SELECT name, date, value AS v FROM days WHERE n > 1) SELECT d.name, strftime(d.date,'%Y-%m-%d') AS date, round(last_value(q.v IGNORE NULLS) OVER (PARTITION BY d.name ORDER BY d.date ROWS UNBOUNDED PRECEDING),6) AS v FROM q RIGHT JOIN days d ON q.name=d.name AND q.date=d.date")
def c4(spark, sf_dir):
    base = day_panel(spark, sf_dir)
    sparse = base.filter("n > 1").select("name", "date", F.col("value").alias("v"))
    return sparse.join(base.select("name", "date"), ["name", "date"], "right").select("name", day().alias("date"), r(forward_fill("v")).alias("v"))


@register("c5_full_outer_chain", "WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS a FROM lineitem WHERE l_returnflag='A' GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS b FROM lineitem WHERE l_returnflag='R' GROUP BY 1), c AS (SELECT l_partkey AS k, sum(l_quantity) AS c FROM lineitem WHERE l_returnflag='N' GROUP BY 1) SELECT k, a, b, c FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)")
def c5(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    parts = [lines.filter(F.col("l_returnflag") == v.upper()).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias(n)) for v, n in (("A", "a"), ("R", "b"), ("N", "c"))]
    return X.multi_join(parts, ["k"], "full")


@register("c6_interval_join", f"{HISTORY} SELECT o_orderkey, hist_id FROM orders o JOIN hist h ON o.o_custkey=h.o_custkey AND o_orderdate >= effect_date AND (to_date IS NULL OR o_orderdate <= to_date)")
def c6(spark, sf_dir):
    return X.interval_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), name_history(spark, sf_dir), ["o_custkey"], "o_orderdate", "effect_date", "to_date").select("o_orderkey", "hist_id")


@register("c6_interval_tree", f"""{HISTORY} SELECT o.o_orderkey, count(*) AS n, max(hist_id) AS hist_id FROM orders o JOIN hist h ON o.o_custkey=h.o_custkey AND o.o_orderdate >= h.effect_date - INTERVAL 400 DAY AND o.o_orderdate <= coalesce(h.to_date, TIMESTAMP '9999-01-01') GROUP BY 1""")
def c6_tree(spark, sf_dir):
    """Orders with all intervals, from 400 days before they took effect, that hold their date: overlapping intervals by equal bins."""
    past = name_history(spark, sf_dir).select("o_custkey", F.expr("date_sub(effect_date, 400)").alias("from_date"), F.col("to_date").cast("date").alias("to_date"), "hist_id")
    facts = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    met = interval_tree_join(facts, past, ["o_custkey"], "d", "from_date", "to_date")
    return met.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("hist_id").alias("hist_id"))


@register("c7_asof_join", f"{HISTORY} SELECT o_orderkey, hist_id FROM orders o ASOF JOIN hist h ON o.o_custkey=h.o_custkey AND o_orderdate >= effect_date")
def c7(spark, sf_dir):
    return X.asof_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), name_history(spark, sf_dir), ["o_custkey"], "o_orderdate", "effect_date", ["hist_id"]).select("o_orderkey", "hist_id")


@register("c8_benchmark_join", f"{PANEL}, b AS (SELECT date, ret AS bench FROM panel WHERE name=1) SELECT p.name, strftime(p.date,'%Y-%m-%d') AS date, round(ret-bench,6) AS active FROM panel p JOIN b ON p.date=b.date")
def c8(spark, sf_dir):
    return N.benchmark_join(stock_panel(spark, sf_dir), 1).select("name", day().alias("date"), r("active").alias("active"))


@register("c9_factor_join", f"{PANEL}, f AS (SELECT strftime(date,'%Y%m') AS ym, avg(ret)-0.001 AS mkt_rf FROM panel GROUP BY 1) SELECT name, strftime(date,'%Y%m') AS ym, round(ret-0.001-mkt_rf,6) AS excess FROM panel JOIN f ON strftime(date,'%Y%m')=ym")
def c9(spark, sf_dir):
    df = stock_panel(spark, sf_dir)
    factors = df.groupBy(F.date_format("date", "yyyyMM").alias("ym")).agg((F.avg("ret") - 0.001).alias("mkt_rf"))
    return N.factor_join(df, factors, "yyyyMM", "ym").select("name", "ym", r(F.col("ret") - 0.001 - F.col("mkt_rf")).alias("excess"))


@register("c11_pairs", f"{BRANDS} SELECT a.name AS x, b.name AS y, strftime(a.date,'%Y-%m-%d') AS date, round(a.price,8) AS p_x, round(b.price,8) AS p_y FROM prices a JOIN prices b ON a.name > b.name AND a.date=b.date")
def c11(spark, sf_dir):
    return X.pair_panel(pair_prices(spark, sf_dir)).select("x", "y", day().alias("date"), r("p_x", 8).alias("p_x"), r("p_y", 8).alias("p_y"))


@register("d14_distinct_lookup", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING')")
def d14(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return N.distinct_lookup(table(spark, sf_dir, "orders"), chosen, "o_custkey")


@register("d15_drop_duplicates", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)=1")
def d15(spark, sf_dir):
    return X.drop_duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


@register("d16_pivot", "SELECT l_suppkey, coalesce(sum(l_quantity) FILTER (l_returnflag='A'),0)::DOUBLE AS \"A\", coalesce(sum(l_quantity) FILTER (l_returnflag='N'),0)::DOUBLE AS \"N\", coalesce(sum(l_quantity) FILTER (l_returnflag='R'),0)::DOUBLE AS \"R\" FROM lineitem GROUP BY 1")
def d16(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return X.pivot_wide(long, ["l_suppkey"], "l_returnflag", "q", ["A", "N", "R"], 0.0)


@register("d17_complete_series", f"{PANEL} SELECT {KEYS} FROM panel WHERE name IN (SELECT name FROM panel GROUP BY name HAVING count(DISTINCT date)=(SELECT count(DISTINCT date) FROM panel))")
def d17(spark, sf_dir):
    return X.complete_series(stock_panel(spark, sf_dir)).select("name", day().alias("date"))


def _downsample(key: str, frequency: str, end: str) -> None:
    @register(key, f"""{DAYS}, x AS (SELECT name, date, value, n, value/nullif(lag(value) OVER (PARTITION BY name ORDER BY date),0)-1 AS ret FROM days)
 SELECT name, strftime({end},'%Y-%m-%d') AS date, round(exp(coalesce(sum(CASE WHEN ret > -1 THEN ln(1+ret) END),0))-1,6) AS ret, round(avg(value),6) AS value, sum(n)::BIGINT AS n FROM x GROUP BY 1, 2""")
    def query(spark, sf_dir):
        df = day_panel(spark, sf_dir)
        df = df.withColumn("ret", ratio(F.col("value"), F.lag("value").over(Window.partitionBy("name").orderBy("date"))) - 1)
        return X.downsample(df, "ret", ["value"], [], ["n"], frequency).select("name", day().alias("date"), r("ret").alias("ret"), r("value").alias("value"), "n")


_downsample("d18_downsample_week", "W", "date::DATE + ((12 - isodow(date)::INTEGER) % 7)::INTEGER")
_downsample("d18_downsample_month", "M", "last_day(date)")
_downsample("d18_downsample_quarter", "Q", "last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH)")
_downsample("d18_downsample_year", "Y", "last_day(date_trunc('year', date) + INTERVAL 11 MONTH)")


@register("d18_downsample_filled", f"""{DAYS}, x AS (SELECT name, date, value, n, value/nullif(lag(value) OVER (PARTITION BY name ORDER BY date),0)-1 AS ret FROM days WHERE n > 1 AND day(date) % 5 < 2), w AS (SELECT name, date::DATE + ((12 - isodow(date)::INTEGER) % 7)::INTEGER AS d, ret, value, n FROM x),
 a AS (SELECT name, d, exp(coalesce(sum(CASE WHEN ret > -1 THEN ln(1+ret) END),0))-1 AS ret, avg(value) AS value, sum(n)::BIGINT AS n FROM w GROUP BY 1,2), g AS (SELECT name, unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS d FROM a GROUP BY 1)
 SELECT g.name, strftime(g.d,'%Y-%m-%d') AS date, round(coalesce(ret,0),6) AS ret, round(value,6) AS value, coalesce(n,0)::BIGINT AS n FROM g LEFT JOIN a ON g.name=a.name AND g.d=a.d""")
def d18_filled(spark, sf_dir):
    df = day_panel(spark, sf_dir).filter("n > 1 and day(date) % 5 < 2")
    df = df.withColumn("ret", ratio(F.col("value"), F.lag("value").over(Window.partitionBy("name").orderBy("date"))) - 1)
    return X.downsample(df, "ret", ["value"], [], ["n"], "W", fill_gaps=True).select("name", day().alias("date"), r("ret").alias("ret"), r("value").alias("value"), "n")


@register("d19_fill_report", "SELECT l_suppkey AS symbol, sum(l_quantity) AS shares, round(sum(l_extendedprice)/sum(l_quantity),6) AS vwap, round(sum(l_tax),6) AS commission, round(sum(l_discount),6) AS pnl FROM lineitem GROUP BY ROLLUP (l_suppkey)")
def d19(spark, sf_dir):
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_quantity").alias("shares"), ratio("l_extendedprice", "l_quantity").alias("price"), F.col("l_tax").alias("fee"), F.col("l_discount").alias("gain"))
    return X.fill_report(fills, "symbol", "shares", "price", "fee", "gain").select("symbol", "shares", r("vwap").alias("vwap"), r("commission").alias("commission"), r("pnl").alias("pnl"))


@register("d20_count_symbols", "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY 1")
def d20(spark, sf_dir):
    return N.count_symbols_by_quote(table(spark, sf_dir, "part"), "p_brand", "p_type").withColumnRenamed("bases", "types")


@register("d21_history_average", f"{PANEL}, l AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY date DESC) AS i FROM panel) SELECT name, strftime(max(date),'%Y-%m-%d') AS date, round(avg(vol),6) AS vol FROM l WHERE i<=6 GROUP BY name HAVING count(*)=6 AND max(date)=(SELECT max(date) FROM panel)")
def d21(spark, sf_dir):
    return X.history_average(stock_panel(spark, sf_dir), "vol", 6).select("name", day().alias("date"), r("vol").alias("vol"))


@register("d22_grid_summary", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity),6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY GROUPING SETS ((l_returnflag),(l_linestatus))")
def d22(spark, sf_dir):
    return N.grid_summary(table(spark, sf_dir, "lineitem"), [["l_returnflag"], ["l_linestatus"]], "l_quantity").withColumn("mean", r("mean"))


@register("d23_quantile_threshold", f"{PANEL} SELECT {KEYS}, CASE WHEN ret > (SELECT quantile_cont(ret,0.5) FROM panel) THEN 1 ELSE 0 END AS position FROM panel")
def d23(spark, sf_dir):
    return N.quantile_threshold(stock_panel(spark, sf_dir), "ret").select("name", day().alias("date"), "position")


@register("d24_duplicates", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def d24(spark, sf_dir):
    return X.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")
