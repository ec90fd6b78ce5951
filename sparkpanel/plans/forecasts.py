"""Queries of forecasting: folds, encoders, scorers and models on the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checkpoints import written
from ..operators import folds as A
from ..operators import forecast as J
from ..operators import portfolio as P
from ..operators.rolling import cumulative_return, rolling_std, time_series_ratio
from ..panel import ratio
from .fixtures import KEYS, PANEL, AX, day, over, r, stock_panel, table
from .registry import register

FEATURES = ["mom", "v_ratio", "risk"]


def frame(spark, sf_dir):
    """Panel with three features and the next month's return."""
    return stock_panel(spark, sf_dir).select(
        "name", "date", "ret", "prc", cumulative_return("ret", -11, -1).alias("mom"), time_series_ratio("vol", -5, 0).alias("v_ratio"), rolling_std("ret", -5, 0).alias("risk"), F.lead("ret").over(AX.history()).alias("y")
    ).filter("y is not null and mom is not null and risk is not null")


def _kept(spark, sf_dir):
    """The frame, written once: fits read it many times, and would make the panel from all lines each time."""
    return written(frame(spark, sf_dir), "frame")[0]


def folds(df):
    return J.walk_forward_folds(df, 36, 12, 18)


def prediction_folds(df):
    """Folds that step by their validation window: each month after the first training window is predicted once."""
    return J.walk_forward_folds(df, 36, 12, 12)


@register("j1_train_test_split", f"""{PANEL}, t AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM panel WHERE date <= TIMESTAMP '1999-06-01')),
 s AS (SELECT date AS start FROM t WHERE back=12) SELECT 'train' AS part, count(*) AS n FROM panel WHERE date <= TIMESTAMP '1999-06-01' UNION ALL SELECT 'test', count(*) FROM panel, s WHERE date >= start""")
def j1(spark, sf_dir):
    train, test = J.train_test_split(stock_panel(spark, sf_dir), -12, cut="1999-06-01")
    return train.select(F.lit("train").alias("part")).union(test.select(F.lit("test").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@register("j2_walk_forward_folds", f"""{PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date)-1 AS i FROM (SELECT DISTINCT date FROM panel)), n AS (SELECT count(*) AS n FROM d), f AS (SELECT k::INTEGER AS fold, k*18 AS i, n FROM n, range(0, 100) t(k) WHERE k*18+36 <= n-1),
 w AS (SELECT fold, 'train' AS role, i AS a, i+35 AS b FROM f UNION ALL SELECT fold, 'validate', i+36, least(i+47, n-1) FROM f) SELECT fold, role, count(*) AS n FROM w JOIN d ON d.i BETWEEN a AND b JOIN panel p ON p.date=d.date GROUP BY 1,2""")
def j2(spark, sf_dir):
    df = stock_panel(spark, sf_dir)
    return J.fold_rows(df, folds(df)).groupBy("fold", "role").agg(F.count("*").alias("n"))


@register("j3_preprocess", f"""{PANEL}, t AS (SELECT * FROM panel WHERE date < TIMESTAMP '1999-01-01'), m AS (SELECT avg(ret) AS m FROM t), q AS (SELECT quantile_cont(coalesce(ret,m),0.25) AS a, quantile_cont(coalesce(ret,m),0.5) AS b, quantile_cont(coalesce(ret,m),0.75) AS c FROM t, m)
 SELECT {KEYS}, round(least(greatest((coalesce(ret,m)-b)/nullif(c-a,0),-1.5),1.5),6) AS ret FROM panel, m, q""")
def j3(spark, sf_dir):
    df = stock_panel(spark, sf_dir).select("name", "date", "ret")
    return J.preprocess(df.filter(F.col("date") < F.lit("1999-01-01").cast("timestamp")), df, ["ret"]).select("name", day().alias("date"), r("ret").alias("ret"))


@register("j4_zero_count", "SELECT l_orderkey, l_linenumber, l_partkey, (l_discount=0)::INTEGER+(l_tax=0)::INTEGER AS zeros, (l_discount<>0)::INTEGER+(l_tax<>0)::INTEGER AS others FROM lineitem")
def j4(spark, sf_dir):
    c = ["l_discount", "l_tax"]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", J.zero_count(c).alias("zeros"), J.zero_count(c, False).alias("others"))


@register("j5_target_encode", "WITH m AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1) SELECT o_orderkey, round(m,4) AS encoded FROM orders LEFT JOIN m USING (o_custkey)")
def j5(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    train = df.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    return J.target_encode(train, df, "o_custkey", "o_totalprice", "encoded").select("o_orderkey", r("encoded", 4).alias("encoded"))


@register("j6_target_encode_cv", "SELECT o_orderkey, round((sum(o_totalprice) OVER (PARTITION BY o_custkey)-sum(o_totalprice) OVER (PARTITION BY o_custkey, o_orderkey%5))/nullif(count(*) OVER (PARTITION BY o_custkey)-count(*) OVER (PARTITION BY o_custkey, o_orderkey%5),0),4) AS encoded FROM orders")
def j6(spark, sf_dir):
    return J.target_encode_cv(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", F.col("o_orderkey") % 5, "encoded").select("o_orderkey", r("encoded", 4).alias("encoded"))


@register("j7_target_encode_loo", "SELECT o_orderkey, round((sum(o_totalprice) OVER (PARTITION BY o_custkey)-o_totalprice)/nullif(count(*) OVER (PARTITION BY o_custkey)-1,0),4) AS encoded FROM orders")
def j7(spark, sf_dir):
    return J.target_encode_loo(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "encoded").select("o_orderkey", r("encoded", 4).alias("encoded"))


FRAME = f"""{PANEL}, fr AS (SELECT * FROM (SELECT name, date, ret, exp(sum(CASE WHEN ret > -1 THEN ln(1+ret) END) {over(-11, -1)})-1 AS mom, vol/nullif(avg(vol) {over(-5, 0)},0) AS v_ratio, stddev_samp(ret) {over(-5, 0)} AS risk, lead(ret) OVER (PARTITION BY name ORDER BY date) AS y FROM panel) WHERE y IS NOT NULL AND mom IS NOT NULL AND risk IS NOT NULL)"""


@register("j9_weighted_average_model", f"""{FRAME}, l AS (SELECT date, y, 'mom' AS feature, mom AS v FROM fr UNION ALL SELECT date, y, 'v_ratio', v_ratio FROM fr UNION ALL SELECT date, y, 'risk', risk FROM fr), e AS (SELECT feature, date, corr(v, y) AS ic FROM l GROUP BY 1,2)
 SELECT feature, round(CASE WHEN abs(avg(ic) FILTER (NOT isnan(ic))) <= 0.01 THEN 0 ELSE avg(ic) FILTER (NOT isnan(ic)) END,6) AS coefficient FROM e GROUP BY 1""")
def j9(spark, sf_dir):
    return J.weighted_average_coefficients(frame(spark, sf_dir), FEATURES, "y", 0.01).select("feature", r("coefficient").alias("coefficient"))


@register("j9_weighted_by_sharpe", f"""{FRAME}, l AS (SELECT date, name, y, 'mom' AS feature, mom AS v FROM fr UNION ALL SELECT date, name, y, 'v_ratio', v_ratio FROM fr UNION ALL SELECT date, name, y, 'risk', risk FROM fr),
 p AS (SELECT *, row_number() OVER (PARTITION BY feature, date ORDER BY v, name)::DOUBLE/count(*) OVER (PARTITION BY feature, date) AS p FROM l WHERE v IS NOT NULL), s AS (SELECT feature, date, avg(y) FILTER (p > 1-1.0/5)-avg(y) FILTER (p <= 1.0/5) AS x FROM p GROUP BY 1,2)
 SELECT feature, round(avg(x)/nullif(stddev_samp(x),0),6) AS coefficient FROM s GROUP BY 1""")
def j9_sharpe(spark, sf_dir):
    return J.weighted_average_coefficients(frame(spark, sf_dir), FEATURES, "y", 0.0, "SR", 5).select("feature", r("coefficient").alias("coefficient"))


@register("j12_information_coefficient", f"{FRAME} SELECT name, round(CASE WHEN corr(mom,y) IS NULL OR isnan(corr(mom,y)) THEN -2 ELSE corr(mom,y) END,6) AS ic FROM fr GROUP BY 1")
def j12(spark, sf_dir):
    return frame(spark, sf_dir).groupBy("name").agg(r(J.information_coefficient("mom", "y")).alias("ic"))


@register("j13_sharpe_score", f"""{FRAME}, p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom, name)::DOUBLE/count(*) OVER (PARTITION BY date) AS p FROM fr), s AS (SELECT date, avg(y) FILTER (p > 1-1.0/5)-avg(y) FILTER (p <= 1.0/5) AS r FROM p GROUP BY 1) SELECT round(avg(r)/nullif(stddev_samp(r),0),6) AS sharpe FROM s""")
def j13(spark, sf_dir):
    return J.sharpe_score(frame(spark, sf_dir), "y", "mom", 5).select(r("sharpe").alias("sharpe"))


def _fitted(spark, sf_dir, name="forest"):
    df = _kept(spark, sf_dir)
    train = df.filter(F.col("date") < F.lit("2000-01-01").cast("timestamp"))
    return J.model_pipeline(name, FEATURES, "y", **({"numTrees": 10, "seed": 3} if name == "forest" else {})).fit(train), df


@register("j8_model_pipeline")
def j8(spark, sf_dir):
    model, df = _fitted(spark, sf_dir, "boosted")
    return model.transform(df).select("name", "date", "prediction")


LINE = f"{FRAME}, b AS (SELECT regr_slope(y, mom) AS s, regr_intercept(y, mom) AS c FROM fr WHERE date < TIMESTAMP '2000-01-01')"


def _line(spark, sf_dir):
    """A linear pipeline on one feature."""
    df = _kept(spark, sf_dir)
    return J.model_pipeline("linear", ["mom"], "y").fit(df.filter(F.col("date") < F.lit("2000-01-01").cast("timestamp"))), df


@register("j8_linear_pipeline", f"{LINE} SELECT {KEYS}, round(c+s*mom,6) AS prediction FROM fr, b")
def j8_linear(spark, sf_dir):
    model, df = _line(spark, sf_dir)
    return model.transform(df).select("name", day().alias("date"), r("prediction").alias("prediction"))


@register("j15_linear_dependence", f"{LINE} SELECT g::DOUBLE AS grid, round(c+s*g,6) AS prediction FROM b, (SELECT unnest([-0.5, -0.2, 0.0, 0.2, 0.5]) AS g)")
def j15_linear(spark, sf_dir):
    model, df = _line(spark, sf_dir)
    return J.partial_dependence(model, df, "mom", [-0.5, -0.2, 0.0, 0.2, 0.5]).select("grid", r("prediction").alias("prediction"))


@register("j10_search")
def j10(spark, sf_dir):
    df = frame(spark, sf_dir)
    return J.search(df, prediction_folds(df), {n: J.model_pipeline(n, FEATURES, "y") for n in ("linear", "elastic", "tree")}, "y")


OLS = f"""{FRAME}, d AS (SELECT date, row_number() OVER (ORDER BY date)-1 AS i FROM (SELECT DISTINCT date FROM fr)), n AS (SELECT count(*) AS n FROM d), f AS (SELECT k::INTEGER AS fold, k*12 AS i, n FROM n, range(0, 100) t(k) WHERE k*12+36 <= n-1),
 b AS (SELECT fold, regr_slope(y, mom) AS s, regr_intercept(y, mom) AS c FROM f JOIN d ON d.i BETWEEN f.i AND f.i+35 JOIN fr ON fr.date=d.date GROUP BY 1),
 p AS (SELECT f.fold, name, fr.date, y, c+s*mom AS prediction FROM f JOIN b ON b.fold=f.fold JOIN d ON d.i BETWEEN f.i+36 AND least(f.i+47, n-1) JOIN fr ON fr.date=d.date)"""


@register("j10_search_linear", f"{OLS} SELECT 'ols' AS candidate, round(avg(ic),6) AS ic FROM (SELECT fold, corr(prediction, y) AS ic FROM p GROUP BY 1)")
def j10_linear(spark, sf_dir):
    """Mean information coefficient of a regression on one feature over all folds, from sums of each month."""
    df = frame(spark, sf_dir)
    return A.search_linear(df, prediction_folds(df), {"ols": (0.0, 0.0)}, ["mom"], "y").select("candidate", r("ic").alias("ic"))


@register("j10_search_penalties")
def j10_penalties(spark, sf_dir):
    """A grid of penalties on three features, from one scan."""
    df = frame(spark, sf_dir)
    grid = {f"penalty={p}, mix={m}": (p, m) for p in (0.0, 0.001, 0.01, 0.1) for m in (0.0, 0.5, 1.0)}
    return A.search_linear(df, prediction_folds(df), grid, FEATURES, "y").select("candidate", r("ic").alias("ic"))


@register("j11_predict_linear", f"{OLS} SELECT fold, {KEYS}, round(prediction,6) AS prediction FROM p")
def j11_linear(spark, sf_dir):
    df = frame(spark, sf_dir)
    return A.predict_linear(df, prediction_folds(df), ["mom"], "y", ["name", "date"]).select("fold", "name", day().alias("date"), r("prediction").alias("prediction"))


@register("j17_linear_backtest", f"""{OLS}, k AS (SELECT *, ntile(5) OVER (PARTITION BY date ORDER BY round(prediction,12), name) AS k FROM p), a AS (SELECT date, k::VARCHAR AS sig_rank, avg(y) AS r FROM k GROUP BY 1,2),
 s AS (SELECT * FROM a UNION ALL SELECT h.date, 'high_minus_low', h.r-l.r FROM a h JOIN a l ON h.date=l.date AND h.sig_rank='5' AND l.sig_rank='1') SELECT sig_rank, round(avg(r),6) AS average, round(stddev_samp(r),6) AS volatility, round(avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END),6) AS hit_rate FROM s GROUP BY 1""")
def j17_linear(spark, sf_dir):
    """Returns of quintiles by out-of-sample predictions of a regression on one feature."""
    df = frame(spark, sf_dir)
    predicted = A.predict_linear(df, prediction_folds(df), ["mom"], "y", ["name", "date", "y"]).withColumn("prediction", F.round("prediction", 12))
    out = P.return_stats(P.sort_portfolios(predicted, "prediction", "y", 5), ["sig_rank"], "r")
    return out.select("sig_rank", *[r(c).alias(c) for c in ("average", "volatility", "hit_rate")])


@register("j10_search_grid")
def j10_grid(spark, sf_dir):
    """Three points of a grid of four, within a time budget."""
    df = _kept(spark, sf_dir)
    grid = J.candidates({"regParam": [0.001, 0.1], "elasticNetParam": [0.0, 0.5]}, lambda **o: J.model_pipeline("elastic", FEATURES, "y", **o))
    return J.search(df, prediction_folds(df), grid, "y", trials=3, seconds=600)


def _predictions(spark, sf_dir):
    df = frame(spark, sf_dir)
    return J.walk_forward_predict(df, prediction_folds(df), J.model_pipeline("linear", FEATURES, "y"), ["name", "date", "y"])


@register("j11_walk_forward_predict")
def j11(spark, sf_dir):
    return _predictions(spark, sf_dir)


@register("j14_permutation_importance")
def j14(spark, sf_dir):
    model, df = _fitted(spark, sf_dir)
    return J.permutation_importance(model, df, FEATURES, "y", repeats=2)


@register("j15_partial_dependence")
def j15(spark, sf_dir):
    model, df = _fitted(spark, sf_dir)
    return J.partial_dependence(model, df, "mom", [-0.5, -0.2, 0.0, 0.2, 0.5])


@register("j16_feature_importance")
def j16(spark, sf_dir):
    return J.feature_importance(_fitted(spark, sf_dir)[0], FEATURES)


@register("j17_forecast_backtest")
def j17(spark, sf_dir):
    ports = P.sort_portfolios(_predictions(spark, sf_dir).drop("fold").dropDuplicates(["name", "date"]), "prediction", "y", 5)
    return P.return_stats(ports, ["sig_rank"], "r")


def _scaler(key: str, make, sql: str) -> None:
    @register(key, f"{PANEL} SELECT {KEYS}, round({sql},6) AS x FROM panel WHERE ret IS NOT NULL")
    def query(spark, sf_dir):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        df = VectorAssembler(inputCols=["ret"], outputCol="v").transform(stock_panel(spark, sf_dir).filter("ret is not null").select("name", "date", "ret"))
        return make().fit(df).transform(df).select("name", day().alias("date"), r(vector_to_array("o")[0]).alias("x"))


def _feature(name: str, **options):
    def make():
        from pyspark.ml import feature

        return getattr(feature, name)(inputCol="v", outputCol="o", **options)

    return make


_scaler("j20_standard_scaler", _feature("StandardScaler", withMean=True), "(ret-avg(ret) OVER ())/stddev_samp(ret) OVER ()")
_scaler("j20_min_max_scaler", _feature("MinMaxScaler"), "(ret-min(ret) OVER ())/(max(ret) OVER ()-min(ret) OVER ())")
_scaler("j20_max_abs_scaler", _feature("MaxAbsScaler"), "ret/max(abs(ret)) OVER ()")


@register("j20_feature_stages")
def j20(spark, sf_dir):
    """Normaliser, polynomial terms, principal components and variance threshold in one pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, Normalizer, PolynomialExpansion, VarianceThresholdSelector, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = frame(spark, sf_dir)
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="a"), Normalizer(inputCol="a", outputCol="b"), PolynomialExpansion(inputCol="b", outputCol="c"),
              VarianceThresholdSelector(featuresCol="c", outputCol="d", varianceThreshold=1e-6), PCA(inputCol="d", outputCol="e", k=2)]
    return Pipeline(stages=stages).fit(df).transform(df).select("name", "date", vector_to_array("e").alias("components"))


@register("j20_univariate_scores", f"""{FRAME}, c AS (SELECT 'mom' AS feature, corr(mom, y) AS c, count(*) FILTER (mom IS NOT NULL) AS n FROM fr UNION ALL SELECT 'v_ratio', corr(v_ratio, y), count(*) FILTER (v_ratio IS NOT NULL) FROM fr UNION ALL SELECT 'risk', corr(risk, y), count(*) FILTER (risk IS NOT NULL) FROM fr)
 SELECT feature, round(c*c/(1-c*c)*(n-2),6) AS f FROM c""")
def j20_scores(spark, sf_dir):
    return J.univariate_scores(frame(spark, sf_dir), FEATURES, "y").select("feature", r("f").alias("f"))


@register("j20_select_percentile", f"""{FRAME}, c AS (SELECT abs(corr(mom, y)) AS a, abs(corr(v_ratio, y)) AS b, abs(corr(risk, y)) AS c FROM fr)
 SELECT name, strftime(date,'%Y-%m-%d') AS date, round(CASE WHEN a >= b AND a >= c THEN mom WHEN b >= c THEN v_ratio ELSE risk END,6) AS best FROM fr, c""")
def j20_percentile(spark, sf_dir):
    """The panel with the third of the features that tells most."""
    df = frame(spark, sf_dir)
    (best,) = J.select_features(J.univariate_scores(df, FEATURES, "y"), percentile=33)
    return df.select("name", day().alias("date"), r(best).alias("best"))


@register("j20_select_family_error")
def j20_family(spark, sf_dir):
    df = frame(spark, sf_dir)
    return df.select("name", "date", *J.select_features(J.univariate_scores(df, FEATURES, "y"), family_error=0.05))
