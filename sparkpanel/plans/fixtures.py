"""Panels derived from the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..panel import Axis, ratio

AX = Axis()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded double, as float sums depend on their order."""
    return F.round((F.col(column) if isinstance(column, str) else column).cast("double"), digits)


def day(column: str = "date") -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def exact_sum(column: str) -> Column:
    """Sum of numbers of up to six decimals, by whole millionths: the same in whatever order rows come."""
    return F.sum(F.round(F.col(column) * 1e6).cast("long")) / F.lit(1e6)


def stock_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly panel of suppliers: price, volume, quotes, size, return and market return."""
    lines = table(spark, sf_dir, "lineitem")
    unit = ratio("l_extendedprice", "l_quantity")
    base = lines.groupBy(F.col("l_suppkey").alias("name"), F.date_trunc("month", "l_shipdate").alias("date")).agg(
        ratio(exact_sum("l_extendedprice"), F.sum("l_quantity")).alias("prc"),
        F.sum("l_quantity").alias("vol"), F.sum("l_extendedprice").alias("vol_d"), F.min(unit).alias("bid"), F.max(unit).alias("ask"),
    )
    shares = 1000.0 * (1 + F.col("name") % 7)
    before = F.lag("prc").over(AX.history())
    base = base.select("*", shares.alias("shrout"), (F.col("prc") * shares).alias("mktcap"), (ratio("prc", before) - 1).alias("ret"))
    return base.withColumn("mkt", F.avg("ret").over(AX.section()))


#: The same panel as SQL; queries go on after it.
PANEL = """WITH base AS (SELECT l_suppkey AS name, date_trunc('month', l_shipdate) AS date, sum(l_extendedprice)/sum(l_quantity) AS prc, sum(l_quantity) AS vol,
 sum(l_extendedprice) AS vol_d, min(l_extendedprice/l_quantity) AS bid, max(l_extendedprice/l_quantity) AS ask FROM lineitem GROUP BY 1, 2),
 sized AS (SELECT *, 1000.0*(1 + name % 7) AS shrout, prc*1000.0*(1 + name % 7) AS mktcap, prc/lag(prc) OVER (PARTITION BY name ORDER BY date) - 1 AS ret FROM base),
 panel AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS mkt FROM sized)"""

KEYS = "name, strftime(date, '%Y-%m-%d') AS date"


def over(start: int | None, end: int | None) -> str:
    """SQL window of an entity's rows."""
    bound = lambda n, side: f"UNBOUNDED {side}" if n is None else "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    return f"OVER (PARTITION BY name ORDER BY date ROWS BETWEEN {bound(start, 'PRECEDING')} AND {bound(end, 'FOLLOWING')})"


def option_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly option contracts: supplier, part and call/put flag, with the supplier's price."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    price = ratio(F.sum("l_extendedprice"), F.sum("l_quantity"))
    contracts = lines.groupBy(
        F.date_trunc("month", "l_shipdate").alias("date"), F.col("l_suppkey").alias("name"), F.col("l_partkey").alias("part"),
        F.when(F.col("l_returnflag") == "A", "C").otherwise("P").alias("cp_flag"),
    ).agg(
        F.sum("l_quantity").alias("volume"), (F.avg("l_discount") * price).alias("opt_prc"), price.alias("strike"),
        (0.1 + F.avg("l_discount")).alias("iv"), (7 * F.min("l_linenumber")).cast("int").alias("exdays"),
    )
    stock = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("name"), F.date_trunc("month", "l_shipdate").alias("date")).agg(price.alias("prc"))
    out = contracts.join(stock, ["name", "date"])
    contract = F.concat_ws("-", F.col("name").cast("string"), F.col("part").cast("string"), F.col("cp_flag"))
    return out.select("*", contract.alias("id"), (F.col("volume") % 11 - 5).alias("delta"), ratio("strike", "prc").alias("ks"))


CHAIN = """WITH contracts AS (SELECT date_trunc('month', l_shipdate) AS date, l_suppkey AS name, l_partkey AS part, CASE WHEN l_returnflag='A' THEN 'C' ELSE 'P' END AS cp_flag,
 sum(l_quantity) AS volume, avg(l_discount)*(sum(l_extendedprice)/sum(l_quantity)) AS opt_prc, sum(l_extendedprice)/sum(l_quantity) AS strike, 0.1+avg(l_discount) AS iv,
 7*min(l_linenumber) AS exdays FROM lineitem WHERE l_returnflag IN ('A','R') GROUP BY 1,2,3,4),
 stock AS (SELECT l_suppkey AS name, date_trunc('month', l_shipdate) AS date, sum(l_extendedprice)/sum(l_quantity) AS prc FROM lineitem GROUP BY 1,2),
 chain AS (SELECT c.*, s.prc, c.name::VARCHAR||'-'||c.part::VARCHAR||'-'||c.cp_flag AS id, c.volume % 11 - 5 AS delta, c.strike/s.prc AS ks FROM contracts c JOIN stock s ON c.name=s.name AND c.date=s.date)"""


def pair_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly price of each brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("name", F.date_trunc("month", "l_shipdate").alias("date")).agg(ratio(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("price"))


BRANDS = """WITH prices AS (SELECT p_brand AS name, date_trunc('month', l_shipdate) AS date, sum(l_extendedprice)/sum(l_quantity) AS price FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2)"""


def name_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of each customer's urgent orders: id, customer, from and to (null while open)."""
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    days = urgent.groupBy("o_custkey", F.col("o_orderdate").alias("effect_date")).agg(F.max("o_orderkey").alias("hist_id"))
    from pyspark.sql import Window

    after = F.lead("effect_date").over(Window.partitionBy("o_custkey").orderBy("effect_date"))
    return days.select("o_custkey", "effect_date", "hist_id", (after - F.expr("INTERVAL 1 DAY")).alias("to_date"))


HISTORY = """WITH days AS (SELECT o_custkey, o_orderdate AS effect_date, max(o_orderkey) AS hist_id FROM orders WHERE o_orderpriority='1-URGENT' GROUP BY 1,2),
 hist AS (SELECT *, lead(effect_date) OVER (PARTITION BY o_custkey ORDER BY effect_date) - INTERVAL 1 DAY AS to_date FROM days)"""


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily value and count of each user's events."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("name"), F.date_trunc("day", "ts").alias("date")).agg(F.sum("value").alias("value"), F.count("*").alias("n"))


DAYS = """WITH days AS (SELECT user_id AS name, date_trunc('day', ts) AS date, sum(value) AS value, count(*) AS n FROM events GROUP BY 1,2)"""
