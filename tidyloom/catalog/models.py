"""Queries that train and score models (cross-validation, search)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidyloom.catalog.common import query, rounded, table
from tidyloom.operators.columns import append_columns
from tidyloom.plans.evaluate import cross_validate
from tidyloom.plans.preparation import apply_preparation, fit_preparation
from tidyloom.plans.presets import fallback_plan, fixed_plan
from tidyloom.plans.search import search_plans, search_preparation

_PARTS = [
    "p_partkey",
    "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS p_size",
    "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type",
    "p_brand",
    "p_retailprice",
    "CASE WHEN p_size > 35 THEN 'high' WHEN p_size > 15 THEN 'mid' ELSE 'low' END AS grade",
]


def _parts(spark, d):
    return table(spark, d, "part").selectExpr(*_PARTS)


@query(
    "model_preparation",
    f"""
    WITH t AS (SELECT {', '.join(_PARTS)} FROM part),
    m AS (SELECT quantile_cont(p_size, 0.5) AS med FROM t),
    y AS (SELECT p_type AS v FROM t WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT p_partkey, coalesce(p_size, med) AS s, p_retailprice AS r, coalesce(p_type, v) AS ty FROM t, m, y),
    z AS (SELECT avg(s) AS ms, stddev_pop(s) AS ss, avg(r) AS mr, stddev_pop(r) AS sr FROM f)
    SELECT p_partkey, round((s - ms) / ss, 6) AS size_z, round((r - mr) / sr, 6) AS price_z, ty AS hot_type FROM f, z
    """,
)
def model_preparation(spark, d):
    """Median, standard scale, mode, one-hot and assembly; read back from the vector."""
    df = _parts(spark, d).select("p_partkey", "p_size", "p_retailprice", "p_type")
    state = fit_preparation(df, {"scaling": "standard"}, ["p_partkey"])
    out = apply_preparation(df, state, ["p_partkey"]).select(
        "p_partkey", vector_to_array("features").alias("v")
    )
    flags = [
        F.when(F.col("v")[i] == 1.0, c.split("__", 1)[1])
        for i, c in enumerate(state["features"])
        if c.startswith("p_type__")
    ]
    return out.select(
        "p_partkey",
        F.round(F.col("v")[0], 6).alias("size_z"),
        F.round(F.col("v")[1], 6).alias("price_z"),
        F.coalesce(*flags).alias("hot_type"),
    )


@query(
    "preparation_arm",
    f"""
    WITH t AS (SELECT {', '.join(_PARTS)} FROM part),
    m AS (SELECT avg(p_size) AS mean FROM t),
    f AS (SELECT p_partkey, coalesce(p_size, mean) AS s, coalesce(p_type, '__missing__') AS ty FROM t, m),
    q AS (SELECT quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.75) AS q3 FROM f),
    c AS (SELECT p_partkey, least(greatest(s, q1 - 0.1 * (q3 - q1)), q3 + 0.1 * (q3 - q1)) AS s, ty FROM f, q),
    z AS (SELECT min(s) AS lo, max(s) AS hi FROM c),
    o AS (SELECT ty, row_number() OVER (ORDER BY ty) - 1 AS code FROM (SELECT DISTINCT ty FROM c)),
    w AS (SELECT min(code) AS l, max(code) AS h FROM o)
    SELECT p_partkey, round((s - lo) / (hi - lo), 6) AS size_scaled, round((code - l) / (h - l), 6) AS type_scaled
    FROM c JOIN o USING (ty) CROSS JOIN z CROSS JOIN w
    """,
)
def preparation_arm(spark, d):
    """Mean, IQR clip, ordinal codes with a missing category, min-max scale."""
    df = _parts(spark, d).select("p_partkey", "p_size", "p_type")
    config = {"missing_num": "mean", "outlier": "iqr_0.1", "scaling": "minmax", "encoding": "ordinal"}
    state = fit_preparation(df, config, ["p_partkey"])
    v = F.col("v")
    return (
        apply_preparation(df, state, ["p_partkey"])
        .select("p_partkey", vector_to_array("features").alias("v"))
        .select("p_partkey", F.round(v[0], 6).alias("size_scaled"), F.round(v[1], 6).alias("type_scaled"))
    )


@query(
    "append_columns",
    "SELECT p_partkey, p_size * 2 AS double_size, p_size + 1 AS next_size FROM part",
)
def appended(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size")
    new = {"double_size": F.col("p_size") * 2, "next_size": F.col("p_size") + 1}
    return append_columns(df, new, ["p_size"])


@query("cv_ridge")
def cv_ridge(spark, d):
    return cross_validate(_parts(spark, d).drop("grade"), "p_partkey", "p_retailprice", "regression", fixed_plan(), "ridge")


@query("cv_logistic")
def cv_logistic(spark, d):
    return cross_validate(_parts(spark, d), "p_partkey", "grade", "classification", fallback_plan(), "logreg")


@query("cv_forest")
def cv_forest(spark, d):
    return cross_validate(_parts(spark, d), "p_partkey", "grade", "classification", None, "rf")


@query("cv_forest_regression")
def cv_forest_regression(spark, d):
    df = _parts(spark, d).drop("grade")
    return cross_validate(df, "p_partkey", "p_retailprice", "regression", None, "rf")


@query("cv_boosting")
def cv_boosting(spark, d):
    df = _parts(spark, d).drop("grade")
    return cross_validate(df, "p_partkey", "p_retailprice", "regression", None, "gbm")


@query("cv_boosting_classes")
def cv_boosting_classes(spark, d):
    """Three classes; their margins become probabilities, and these a ROC AUC."""
    return cross_validate(_parts(spark, d), "p_partkey", "grade", "classification", None, "gbm")


@query("cv_nearest")
def cv_nearest(spark, d):
    return cross_validate(_parts(spark, d), "p_partkey", "grade", "classification", None, "knn")


@query("cv_nearest_regression")
def cv_nearest_regression(spark, d):
    df = _parts(spark, d).drop("grade")
    return cross_validate(df, "p_partkey", "p_retailprice", "regression", None, "knn")


@query("plan_search")
def plan_search(spark, d):
    """Three candidate plans against the raw table."""
    clip = {"actions": [{"action": "clip_outliers", "params": {"iqr_k": 3.0}}]}
    bins = {"actions": [{"action": "bin_numeric", "params": {"columns": ["p_size"]}}]}
    df = _parts(spark, d).drop("grade")
    plans = {"fixed": fixed_plan(), "clip": clip, "bins": bins}
    out = search_plans(df, plans, "p_partkey", "p_retailprice", "regression", "ridge")
    return rounded(out, value=6, sd=6, delta=6)


@query("preparation_search")
def preparation_search(spark, d):
    """The whole preparation grid, every configuration cross-validated."""
    df = _parts(spark, d).drop("grade")
    out = search_preparation(df, "p_partkey", "p_retailprice", "regression", "ridge")
    return rounded(out, value=6, sd=6, delta=6)
