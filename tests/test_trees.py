"""Trees over distinct binned rows against Spark ML's."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tidyloom.plans import evaluate, trees


@pytest.fixture(scope="module")
def table(spark):
    """Two numbers, one of many values, a category as flags, a class and a value."""
    rng = np.random.default_rng(1)
    n = 1500
    a, b, k = rng.normal(0, 1, n).round(2), rng.integers(0, 60, n), rng.integers(0, 5, n)
    y = np.where(a + rng.normal(0, 0.7, n) + (k == 2) * 1.5 > 0.8, 2.0, np.where(b + rng.normal(0, 9, n) > 30, 1.0, 0.0))
    z = 3 * a + (k == 1) * 2 + b / 20 + rng.normal(0, 1, n)
    flags = {f"k{i}": (k == i).astype(float) for i in range(5)}
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": a, "b": b.astype(float), **flags, "y": y, "z": z}))
    df = VectorAssembler(inputCols=["a", "b", *flags], outputCol="features").transform(df)
    out = df.withColumn("w", F.when(F.col("y") == 2, 2.0).otherwise(1.0)).repartition(3).persist()
    yield out
    out.unpersist()


def _sides(table, label):
    rows = table.withColumn("label", F.col(label)).select("id", "label", "features", "w")
    return rows.where("id % 5 != 0"), rows.where("id % 5 = 0").drop("w")


def _cells(table, label, weight=None):
    train, test = _sides(table, label)
    n = train.count()
    bins = trees.fit_bins(train, "id", n, weight)
    asked = trees.binned(test, bins, ["id", "label"])
    return train, test, bins, asked, trees.cells(trees.binned(train, bins, ["label"]), asked, n)


def _by_id(asked, votes):
    return {r["id"]: np.array(r["votes"]) for r in asked.join(votes, "items").select("id", "votes").collect()}


def test_tree_of_classes_is_spark_mls(spark, table):
    train, test, bins, asked, rows = _cells(table, "y", "w")
    got = _by_id(asked, trees.forest_votes(rows, bins, 1, 4, [1.0, 1.0, 2.0], bootstrap=False))
    model = DecisionTreeClassifier(maxDepth=4, weightCol="w").fit(train)
    want = model.transform(test).select("id", vector_to_array("probability").alias("p")).collect()
    assert len(want) == len(got) == 300 and model.numNodes < 31  # leaves were merged
    for r in want:
        assert got[r["id"]] == pytest.approx(r["p"], abs=1e-9)


def test_tree_of_values_is_spark_mls(spark, table, monkeypatch):
    """Cells are summed up in many batches, and their rows are not moved to the tree."""
    monkeypatch.setattr(trees, "PIECE_ROWS", 400)
    train, test, bins, asked, rows = _cells(table, "z")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = _by_id(asked, trees.bagged_votes(rows, bins, 1, 5, 0.5, bootstrap=False))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = DecisionTreeRegressor(maxDepth=5).fit(train).transform(test).collect()
    assert len(want) == len(got) == 300
    for r in want:
        assert got[r["id"]][0] == pytest.approx(r["prediction"], abs=1e-9)


def _folded(spark, n=1200):
    rng = np.random.default_rng(5)
    v, k = rng.normal(0, 1, n), rng.integers(0, 3, n)
    y = np.where(v + (k == 1) + rng.normal(0, 0.3, n) > 0.5, "hi", np.where(v + rng.normal(0, 0.3, n) < -0.7, "lo", "mid"))
    rows = [(i, float(a) if i % 9 else None, f"k{b}", str(c), float(a * 2 + b)) for i, (a, b, c) in enumerate(zip(v, k, y))]
    return spark.createDataFrame(rows, "id long, v double, k string, y string, z double")


def _without_spark_ml(monkeypatch):
    def unwanted(*args):
        raise AssertionError("a job for every few nodes")

    monkeypatch.setattr(evaluate, "build_estimator", unwanted)
    monkeypatch.setattr(evaluate, "LARGE_ROWS", 100)
    monkeypatch.setattr(trees, "PIECE_ROWS", 250)


def test_large_forest_of_classes(spark, monkeypatch):
    """Many rows are not fitted by Spark ML's jobs, and score like it."""
    df, options = _folded(spark).drop("z"), {"trees": 20}
    small = evaluate.cross_validate(df, "id", "y", "classification", None, "rf", None, options, folds=2).first()
    _without_spark_ml(monkeypatch)
    large = evaluate.cross_validate(df, "id", "y", "classification", None, "rf", None, options, folds=2).first()
    assert large.asDict().keys() == small.asDict().keys()
    for name in ("accuracy", "f1_macro", "roc_auc"):
        assert large[name] == pytest.approx(small[name], abs=0.03) and large[name] > 0.7
    monkeypatch.setattr(trees, "TASK_TREES", 20)
    again = evaluate.cross_validate(df, "id", "y", "classification", None, "rf", None, options, folds=2).first()
    assert again["roc_auc"] == pytest.approx(large["roc_auc"], abs=1e-9)  # however they are dealt


def test_large_forest_of_values(spark, monkeypatch):
    df, options = _folded(spark).drop("y"), {"trees": 20}
    small = evaluate.cross_validate(df, "id", "z", "regression", None, "rf", None, options, folds=2).first()
    _without_spark_ml(monkeypatch)
    large = evaluate.cross_validate(df, "id", "z", "regression", None, "rf", None, options, folds=2).first()
    assert large["r2"] == pytest.approx(small["r2"], abs=0.02) and large["r2"] > 0.7
    assert large["mae"] == pytest.approx(small["mae"], rel=0.1)


@pytest.mark.parametrize("n_classes", [2, 3])
def test_large_boosting_is_spark_mls(spark, monkeypatch, n_classes):
    """No draw is made here, so every probability is the same."""
    from tidyloom.operators.sampling import assign_folds

    df, options = _folded(spark, 600).drop("z"), {"rounds": 6}
    if n_classes == 2:
        df = df.withColumn("y", F.when(F.col("y") == "lo", "lo").otherwise("other"))
    placed = assign_folds(df, "id", "y", 2).persist()
    classes = evaluate.class_codes(placed, "y")
    assert classes[1] == n_classes

    def predicted():
        args = (placed, 0, "id", "y", "classification", None, "gbm", None, options, classes)
        return {r["id"]: (r["label"], r["prediction"], r["share"]) for r in evaluate.fold_predictions(*args).collect()}

    want = predicted()
    _without_spark_ml(monkeypatch)
    got = predicted()
    placed.unpersist()
    assert got.keys() == want.keys()
    for i, (label, guess, share) in want.items():
        assert got[i][:2] == (label, guess) and got[i][2] == pytest.approx(share, abs=1e-9)


def test_too_varied_tables_use_spark_ml(spark, monkeypatch):
    df, options = _folded(spark).drop("z"), {"trees": 3, "depth": 3}
    monkeypatch.setattr(evaluate, "LARGE_ROWS", 100)
    monkeypatch.setattr(trees, "MOST_CELLS", 5)
    met, build = [], evaluate.build_estimator
    monkeypatch.setattr(evaluate, "build_estimator", lambda *a: met.append(a[0]) or build(*a))
    row = evaluate.cross_validate(df, "id", "y", "classification", None, "rf", None, options, folds=2).first()
    assert met == ["rf", "rf"] and row["accuracy"] > 0.6


def test_rows_that_are_not_numbers_of_a_feature(spark):
    """Dense and sparse vectors of equal values are one cell; values beyond all cuts get the last bin."""
    from pyspark.ml.linalg import Vectors

    bins = trees.Bins([np.array([-1.5, 0.5]), np.array([0.5])])
    vectors = [Vectors.dense(0.0, 1.0), Vectors.sparse(2, {1: 1.0}), Vectors.dense(9.0, 0.0), Vectors.dense(float("nan"), 0.0), Vectors.sparse(2, {}), Vectors.dense(-2.0, 1.0)]
    df = spark.createDataFrame(list(enumerate(vectors)), ["id", "features"]).coalesce(1)
    items = [r["items"] for r in trees.binned(df, bins, ["id"]).orderBy("id").collect()]
    assert items[0] == items[1] and items[2] == items[3] and len(items[4]) == 0 and len(items[5]) == 8
    assert bins.matrix([bytes(b) for b in items]).tolist() == [[4, 5], [4, 5], [2, 5], [2, 5], [5, 5], [0, 4]]
