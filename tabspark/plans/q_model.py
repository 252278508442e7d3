"""Modeling queries.

The split key of these queries is a uniform number derived from the row
key with the same double arithmetic in Spark and SQL (frac(key * phi)),
so the oracle can rebuild train and test rows exactly.  Every row is in
either train or test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modeling as M
from ..schema import DatasetSchema
from .inputs import LINEITEM_NULLED_SQL, lineitem_nulled, table
from .registry import register

PHI = 0.6180339887498949


def _u(key):
    v = key.cast("double") * F.lit(PHI)
    return v - F.floor(v)


def _u_sql(key: str) -> str:
    return f"(CAST({key} AS DOUBLE) * {PHI} - FLOOR(CAST({key} AS DOUBLE) * {PHI}))"


_LI_KEY = "l_orderkey * 8 + l_linenumber"
_LI_U = _u_sql(_LI_KEY)


def _li(spark, d):
    return lineitem_nulled(spark, d)


def _li_split(spark, d, features=("l_quantity", "l_discount"), target="l_extendedprice", problem="regression"):
    df = _li(spark, d)
    cfg = M.ModelConfig(problem, target, features, split_key=_u(F.col("l_orderkey") * 8 + F.col("l_linenumber")))
    data, numeric, categorical, _, kept, classes = M.prepare_frame(df, cfg)
    return M.split(data, cfg, classes, kept), numeric, categorical, cfg


# The split rule of the library: CEIL(0.2 n) rows in all (per class by largest remainders), those with the smallest keys.
_RANKED = (
    "(SELECT b.*, ROW_NUMBER() OVER (ORDER BY u) AS rk, COUNT(*) OVER () AS nn FROM "
    f"(SELECT *, {_LI_U} AS u FROM {LINEITEM_NULLED_SQL} s WHERE l_extendedprice IS NOT NULL) b)"
)
_IS_TEST = "(rk <= LEAST(nn - 1, GREATEST(1, CEIL(0.2::DOUBLE * nn))))"
# Held-out rows per class of the orders' status.
_QUOTAS = (
    "c AS (SELECT label, COUNT(*) AS n FROM t GROUP BY 1), w AS (SELECT SUM(n) AS total, CEIL(0.2::DOUBLE * SUM(n)) AS want FROM c), "
    "s AS (SELECT label, n, FLOOR(n * want / total) AS whole, n * want / total - FLOOR(n * want / total) AS part FROM c, w), "
    "q AS (SELECT label, n, LEAST(n - 1, GREATEST(1, whole + CASE WHEN ROW_NUMBER() OVER (ORDER BY part DESC, label) <= "
    "(SELECT want FROM w) - SUM(whole) OVER () THEN 1 ELSE 0 END)) AS quota FROM s)"
)
_TRAIN = f"(SELECT * FROM {_RANKED} r WHERE NOT {_IS_TEST})"
_TEST = f"(SELECT * FROM {_RANKED} r WHERE {_IS_TEST})"


@register(
    "split_counts",
    f"SELECT 'train' AS part, COUNT(*) AS rows FROM {_TRAIN} a UNION ALL SELECT 'test', COUNT(*) FROM {_TEST} b",
)
def split_counts(spark, d):
    splitted, *_ = _li_split(spark, d)
    return splitted.groupBy(F.when(F.col("_test"), "test").otherwise("train").alias("part")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@register(
    "split_stratified",
    "WITH t AS (SELECT o_orderstatus AS label, " + _u_sql("o_orderkey") + " AS u FROM orders), " + _QUOTAS + " SELECT label, CAST(quota AS BIGINT) AS test_rows, CAST(n - quota AS BIGINT) AS train_rows FROM q",
)
def split_stratified(spark, d):
    df = table(spark, d, "orders")
    cfg = M.ModelConfig("classification", "o_orderstatus", ("o_totalprice",), split_key=_u(F.col("o_orderkey")))
    data, _, _, _, _, classes = M.prepare_frame(df, cfg)
    s = M.split(data, cfg, classes)
    return s.groupBy(F.col("_label").alias("label")).agg(
        F.count(F.when(F.col("_test"), 1)).alias("test_rows"), F.count(F.when(~F.col("_test"), 1)).alias("train_rows")
    )


def _train_prep(spark, d):
    splitted, numeric, categorical, _ = _li_split(spark, d)
    return M.Preprocessor.fit(splitted.where(~F.col("_test")), numeric, categorical)


@register(
    "impute_median",
    f"SELECT 'l_quantity' AS feature, ROUND(MEDIAN(l_quantity), 6) AS median FROM {_TRAIN} a "
    f"UNION ALL SELECT 'l_discount', ROUND(MEDIAN(l_discount), 6) FROM {_TRAIN} b",
)
def impute_median(spark, d):
    prep = _train_prep(spark, d)
    rows = [(k, float(v)) for k, v in prep.medians.items()]
    # The fitted values are derived from the table by Spark; round for the comparison.
    return spark.createDataFrame(rows, "feature string, median double").select("feature", F.round("median", 6).alias("median"))


@register(
    "standardize",
    f"WITH m AS (SELECT MEDIAN(l_quantity) AS mq FROM {_TRAIN} a), "
    f"i AS (SELECT COALESCE(l_quantity, mq) AS q, l_discount FROM {_TRAIN} b, m) "
    "SELECT 'l_quantity' AS feature, ROUND(AVG(q), 6) AS mean, ROUND(STDDEV_POP(q), 6) AS scale FROM i "
    "UNION ALL SELECT 'l_discount', ROUND(AVG(l_discount), 6), ROUND(STDDEV_POP(l_discount), 6) FROM i",
)
def standardize(spark, d):
    prep = _train_prep(spark, d)
    rows = [(c, float(prep.means[c]), float(prep.scales[c])) for c in prep.numeric]
    return spark.createDataFrame(rows, "feature string, mean double, scale double").select(
        "feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale")
    )


@register(
    "impute_mode",
    "WITH r AS (SELECT NULLIF(event_type, 'error') AS event_type, ROW_NUMBER() OVER (ORDER BY " + _u_sql("event_id") + ") AS rk, "
    "COUNT(*) OVER () AS nn FROM events WHERE value IS NOT NULL), t AS (SELECT event_type FROM r WHERE rk > CEIL(0.2::DOUBLE * nn)), "
    "c AS (SELECT event_type, COUNT(*) AS n FROM t WHERE event_type IS NOT NULL GROUP BY 1) "
    "SELECT 'event_type' AS feature, event_type AS mode FROM c ORDER BY n DESC, event_type LIMIT 1",
)
def impute_mode(spark, d):
    ev = table(spark, d, "events").select(
        "value", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"), "event_id"
    )
    cfg = M.ModelConfig("regression", "value", ("event_type",), split_key=_u(F.col("event_id")))
    data, numeric, categorical, _, kept, classes = M.prepare_frame(ev, cfg, DatasetSchema.of(ev))
    s = M.split(data, cfg, classes, kept)
    prep = M.Preprocessor.fit(s.where(~F.col("_test")), numeric, categorical)
    return spark.createDataFrame(list(prep.modes.items()), "feature string, mode string")


@register(
    "baseline_metrics",
    f"WITH m AS (SELECT AVG(l_extendedprice) AS mu FROM {_TRAIN} a), "
    f"t AS (SELECT l_extendedprice AS y FROM {_TEST} b), tm AS (SELECT AVG(y) AS ty FROM t) "
    "SELECT ROUND(AVG(abs(y - mu)), 6) AS mae, ROUND(sqrt(AVG(pow(y - mu, 2))), 6) AS rmse, "
    "ROUND(1 - SUM(pow(y - mu, 2)) / SUM(pow(y - ty, 2)), 6) AS r2 FROM t, m, tm",
)
def baseline_metrics(spark, d):
    splitted, numeric, categorical, cfg = _li_split(spark, d)
    train = splitted.where(~F.col("_test"))
    fitted = M.fit_candidate("baseline", train, numeric, categorical, cfg, [])
    m = M.regression_metrics(fitted.predict(splitted.where(F.col("_test")), "regression"))
    return spark.createDataFrame([(m["mae"], m["rmse"], m["r2"])], "mae double, rmse double, r2 double").select(
        *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")]
    )


@register(
    "ols_single",
    f"WITH m AS (SELECT MEDIAN(l_quantity) AS mq FROM {_TRAIN} a), "
    f"i AS (SELECT COALESCE(l_quantity, mq) AS x, l_extendedprice AS y FROM {_TRAIN} b, m) "
    "SELECT ROUND(REGR_SLOPE(y, x) * STDDEV_POP(x), 6) AS coefficient, ROUND(AVG(y), 6) AS intercept FROM i",
)
def ols_single(spark, d):
    splitted, numeric, categorical, cfg = _li_split(spark, d, features=("l_quantity",))
    fitted = M.fit_candidate("linear", splitted.where(~F.col("_test")), numeric, categorical, cfg, [])
    coef = float(fitted.model.coefficients[0])
    return spark.createDataFrame([(coef, float(fitted.model.intercept))], "coefficient double, intercept double").select(
        F.round("coefficient", 6).alias("coefficient"), F.round("intercept", 6).alias("intercept")
    )


_ORD_U = _u_sql("o_orderkey")
_ORD_SPLIT = (
    f"WITH t AS (SELECT o_orderstatus AS label, {_ORD_U} AS u FROM orders), "
    + _QUOTAS + ", "
    "r AS (SELECT t.label, ROW_NUMBER() OVER (PARTITION BY t.label ORDER BY u) <= q.quota AS is_test FROM t JOIN q USING (label)), "
    "mode AS (SELECT label FROM r WHERE NOT is_test GROUP BY 1 ORDER BY COUNT(*) DESC, label LIMIT 1), "
    "conf AS (SELECT r.label AS actual, mode.label AS predicted, COUNT(*) AS count FROM r, mode WHERE is_test GROUP BY 1, 2)"
)


def _orders_baseline(spark, d):
    df = table(spark, d, "orders")
    cfg = M.ModelConfig("classification", "o_orderstatus", ("o_totalprice", "o_orderpriority"),
                        split_key=_u(F.col("o_orderkey")))
    data, numeric, categorical, _, _, classes = M.prepare_frame(df, cfg)
    s = M.split(data, cfg, classes)
    fitted = M.fit_candidate("baseline", s.where(~F.col("_test")), numeric, categorical, cfg, sorted(classes))
    return fitted.predict(s.where(F.col("_test")), "classification"), sorted(classes)


@register("baseline_confusion", _ORD_SPLIT + " SELECT actual, predicted, count FROM conf")
def baseline_confusion(spark, d):
    pred, _ = _orders_baseline(spark, d)
    return M.confusion(pred)


@register(
    "baseline_class_metrics",
    _ORD_SPLIT + ", tot AS (SELECT SUM(count) AS n FROM conf), k AS (SELECT COUNT(DISTINCT label) AS k FROM t), "
    "hit AS (SELECT SUM(count) AS h FROM conf WHERE actual = predicted) "
    "SELECT ROUND(h / n, 6) AS accuracy, ROUND(1.0 / k, 6) AS balanced_accuracy, "
    "ROUND((2 * (h / n)) / ((h / n) + 1) / k, 6) AS macro_f1 FROM tot, k, hit",
)
def baseline_class_metrics(spark, d):
    pred, classes = _orders_baseline(spark, d)
    m = M.classification_metrics(pred, classes)
    return spark.createDataFrame(
        [(m["accuracy"], m["balanced_accuracy"], m["macro_f1"])], "accuracy double, balanced_accuracy double, macro_f1 double"
    ).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


@register("train_regression")
def train_regression(spark, d):
    df = table(spark, d, "orders")
    cfg = M.ModelConfig("regression", "o_totalprice", ("o_orderstatus", "o_orderpriority", "o_custkey"))
    _, frame, _ = M.train(df, cfg)
    return frame


@register("train_classification")
def train_classification(spark, d):
    df = table(spark, d, "lineitem")
    cfg = M.ModelConfig("classification", "l_linestatus", ("l_quantity", "l_discount", "l_returnflag", "l_tax"),
                        algorithms=("linear", "decision_tree"))
    _, frame, _ = M.train(df, cfg)
    return frame


@register("cv_scores")
def cv_scores(spark, d):
    df = table(spark, d, "orders")
    cfg = M.ModelConfig("regression", "o_totalprice", ("o_orderpriority", "o_custkey"), algorithms=("linear",),
                        cross_validation=True)
    _, frame, _ = M.train(df, cfg)
    return frame.select("algorithm", "cv_score", "validation_score", "test_score")


@register("model_explanation")
def model_explanation(spark, d):
    df = table(spark, d, "orders")
    cfg = M.ModelConfig("classification", "o_orderstatus", ("o_totalprice", "o_orderpriority"),
                        algorithms=("decision_tree",))
    evaluation, _, _ = M.train(df, cfg)
    rows = [(e["feature"], float(e["value"])) for e in evaluation["explanation"]]
    return spark.createDataFrame(rows, "feature string, value double")


@register(
    "model_persistence",
    "SELECT 'linear' AS algorithm, 'o_totalprice' AS target, COUNT(*) AS rows, 0 AS different FROM orders WHERE o_totalprice IS NOT NULL",
)
def model_persistence(spark, d):
    """Every row scored by the fitted and by the loaded model; the stored record names the target."""
    from ..session import work_dir

    df = table(spark, d, "orders")
    cfg = M.ModelConfig("regression", "o_totalprice", ("o_orderpriority", "o_custkey"), algorithms=("linear",), row_key=("o_orderkey",))
    evaluation, _, best = M.train(df, cfg)
    path = work_dir(spark, "model")
    M.save_model(best, path, spark, evaluation, cfg)
    loaded, record = M.load_model(path, spark), M.load_evaluation(path, spark)
    data = M.prepare_frame(df, cfg)[0].withColumn("_id", F.monotonically_increasing_id())
    both = loaded.predict(best.predict(data, "regression").select(*data.columns, F.col("prediction").alias("_fitted")), "regression")
    return both.agg(
        F.lit(loaded.algorithm).alias("algorithm"),
        F.lit(record["configuration"]["target"]).alias("target"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum((F.abs(F.col("prediction") - F.col("_fitted")) > 1e-9).cast("int")), F.lit(0)).cast("int").alias("different"),
    )


@register(
    "roc_auc",
    "WITH s AS (SELECT l_quantity AS v, l_returnflag = 'R' AS pos FROM lineitem), "
    "r AS (SELECT pos, RANK() OVER (ORDER BY v) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM s) "
    "SELECT ROUND((SUM(rk) FILTER (pos) - COUNT(*) FILTER (pos) * (COUNT(*) FILTER (pos) + 1) / 2.0) "
    "/ (COUNT(*) FILTER (pos) * CAST(COUNT(*) FILTER (NOT pos) AS DOUBLE)), 9) AS auc FROM r",
)
def roc_auc(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("_score"), (F.col("l_returnflag") == "R").cast("string").alias(M.LABEL))
    auc = M.roc_auc(rows, "true")
    return spark.createDataFrame([(auc,)], "auc double").select(F.round("auc", 9).alias("auc"))


@register(
    "one_hot",
    "SELECT 'categorical__o_orderstatus_' || o_orderstatus AS feature, CAST(COUNT(*) AS DOUBLE) AS total FROM orders GROUP BY 1 "
    "UNION ALL SELECT 'numeric__o_totalprice', 0.0",
)
def one_hot(spark, d):
    """Column sums of the assembled feature vectors: one-hot counts, and 0 for a standardized column."""
    from pyspark.ml.functions import vector_to_array

    df = table(spark, d, "orders")
    cfg = M.ModelConfig("regression", "o_custkey", ("o_totalprice", "o_orderstatus"))
    data, numeric, categorical, *_ = M.prepare_frame(df, cfg)
    prep = M.Preprocessor.fit(data, numeric, categorical)
    rows = prep.transform(data).select(F.posexplode(vector_to_array(M.FEATURES)).alias("i", "v"))
    names = spark.createDataFrame(list(enumerate(prep.feature_names())), "i int, feature string")
    sums = rows.groupBy("i").agg(F.sum("v").alias("v")).join(F.broadcast(names), "i")
    return sums.select("feature", (F.round("v", 3) + F.lit(0.0)).alias("total"))
