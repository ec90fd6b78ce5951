"""Queries of data-quality summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eda
from ..operators.ranking import sample_rows
from .fixtures import PANEL, r, stock_panel, table
from .registry import register

COLUMNS = ["prc", "vol", "ret"]
LONG = f"{PANEL}, l AS (SELECT 'prc' AS \"column\", prc::DOUBLE AS value FROM panel UNION ALL SELECT 'vol', vol FROM panel UNION ALL SELECT 'ret', ret FROM panel)"


def _shown(df, *keys):
    return df.select(*keys, *[r(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in df.dtypes if c not in keys])


_DESCRIBE = 'SELECT "column", count(value) AS count, round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS median, round(stddev_samp(value),6) AS std, round(skewness(value),6) AS skew, round(kurtosis(value),6) AS kurtosis, round(min(value),6) AS min, round(max(value),6) AS max FROM l GROUP BY 1'


@register("k1_describe", f"{LONG} {_DESCRIBE}")
def k1(spark, sf_dir):
    return _shown(eda.describe(stock_panel(spark, sf_dir), COLUMNS), "column")


@register("k2_info", f"{LONG} SELECT \"column\", 'double' AS dtype, count(DISTINCT value) AS \"distinct\", round(avg(CASE WHEN value=0 THEN 1.0 ELSE 0 END),6) AS zero_share, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END),6) AS null_share FROM l GROUP BY 1")
def k2(spark, sf_dir):
    return _shown(eda.info(stock_panel(spark, sf_dir), COLUMNS), "column", "dtype")


@register("k3_histogram", """WITH l AS (SELECT 'l_quantity' AS "column", l_quantity AS value FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem), s AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM l GROUP BY 1)
 SELECT "column", least(floor(coalesce((value-lo)*10/nullif(hi-lo,0),0)),9)::INTEGER AS bin, count(*) AS n FROM l JOIN s USING ("column") GROUP BY 1,2""")
def k3(spark, sf_dir):
    return eda.histogram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"])


@register("k3_category_counts", """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def k3_categories(spark, sf_dir):
    return eda.category_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("k4_box_stats", f"""{LONG}, q AS (SELECT "column", quantile_cont(value,0.25) AS q1, quantile_cont(value,0.5) AS median, quantile_cont(value,0.75) AS q3 FROM l GROUP BY 1), w AS (SELECT *, q1-1.5*(q3-q1) AS lo, q3+1.5*(q3-q1) AS hi FROM q)
 SELECT "column", round(any_value(q1),6) AS q1, round(any_value(median),6) AS median, round(any_value(q3),6) AS q3, round(min(value) FILTER (value BETWEEN lo AND hi),6) AS whisker_low, round(max(value) FILTER (value BETWEEN lo AND hi),6) AS whisker_high, count(*) FILTER (value NOT BETWEEN lo AND hi) AS outliers FROM l JOIN w USING ("column") WHERE value IS NOT NULL GROUP BY 1""")
def k4(spark, sf_dir):
    return _shown(eda.box_stats(stock_panel(spark, sf_dir), COLUMNS), "column")


def _analyze(key, method, distance, bound):
    @register(key, f"""WITH l AS (SELECT 'l_quantity' AS "column", l_quantity AS value FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem), b AS (SELECT "column", {bound} FROM l GROUP BY 1), c AS (SELECT "column", value, count(*) AS k FROM l GROUP BY 1,2)
 SELECT c."column", round(0.0,6)::DOUBLE AS missing_share, round(coalesce(sum(k) FILTER (value=0),0)/sum(k),6) AS zero_share, round(count(value)/sum(k),6) AS unique_share, round(max(k)/sum(k),6) AS top_share, round(coalesce(sum(k) FILTER (value < lo OR value > hi),0)/sum(k),6) AS outlier_share, min(value) AS min, max(value) AS max FROM c JOIN b ON c."column"=b."column" GROUP BY 1""")
    def query(spark, sf_dir):
        return _shown(eda.analyze(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], method, distance), "column")


_analyze("k5_analyze_std", "std", 1.6, "avg(value)-1.6*stddev_samp(value) AS lo, avg(value)+1.6*stddev_samp(value) AS hi")
_analyze("k5_analyze_iqr", "iqr", 0.4, "quantile_cont(value,0.25)-0.4*(quantile_cont(value,0.75)-quantile_cont(value,0.25)) AS lo, quantile_cont(value,0.75)+0.4*(quantile_cont(value,0.75)-quantile_cont(value,0.25)) AS hi")


SAMPLE = 'WITH s AS (SELECT * FROM lineitem WHERE (\'0x\'||substr(md5(l_orderkey::VARCHAR||\'|\'||l_linenumber::VARCHAR||\'|\'||l_partkey::VARCHAR),1,8))::BIGINT/4294967296.0 < 2000.0/(SELECT count(*) FROM lineitem)), l AS (SELECT \'l_quantity\' AS "column", l_quantity::DOUBLE AS value FROM s UNION ALL SELECT \'l_extendedprice\', l_extendedprice FROM s)'


@register("k6_profile", f"{SAMPLE} {_DESCRIBE}")
def k6(spark, sf_dir):
    """Summary of a sample, as profiling tools show it."""
    return _shown(eda.describe(sample_rows(table(spark, sf_dir, "lineitem"), 2000, "l_orderkey", "l_linenumber", "l_partkey"), ["l_quantity", "l_extendedprice"]), "column")


@register("j18_columns_by_null_share", f"{PANEL} SELECT name, strftime(date,'%Y-%m-%d') AS date, round(prc,6) AS prc FROM panel")
def j18(spark, sf_dir):
    df = stock_panel(spark, sf_dir).select("name", F.date_format("date", "yyyy-MM-dd").alias("date"), r("prc").alias("prc"), F.when(F.col("ret") > 0, F.col("ret")).alias("often_null"))
    return df.select(*eda.columns_by_null_share(df, 0.3))


@register("j19_correlation_matrix", f"{PANEL} SELECT round(corr(prc,vol),6) AS prc_vol, round(corr(prc,ret),6) AS prc_ret, round(corr(vol,ret),6) AS vol_ret FROM panel")
def j19(spark, sf_dir):
    df = stock_panel(spark, sf_dir)
    return df.agg(r(F.corr("prc", "vol")).alias("prc_vol"), r(F.corr("prc", "ret")).alias("prc_ret"), r(F.corr("vol", "ret")).alias("vol_ret"))


@register("j19_drop_correlated")
def j19_scan(spark, sf_dir):
    df = stock_panel(spark, sf_dir)
    return df.select("name", "date", *eda.drop_correlated(df, "ret", ["prc", "bid", "ask", "vol", "vol_d", "mktcap"], 0.8))
