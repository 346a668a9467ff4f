"""Search over candidate plans and over the preparation grid."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.operators.sampling import FOLDS
from tidyloom.operators.scorecard import verdict
from tidyloom.plans.evaluate import cross_validate, place_folds
from tidyloom.plans.fold_statistics import fold_scores
from tidyloom.plans.preparation import grid

PRIMARY = {"classification": "f1_macro", "regression": "r2"}


def _score_all(df: DataFrame, candidates: list[tuple[str, dict]], parallel: int, **fixed) -> DataFrame:
    """Evaluate candidates; Spark runs the jobs of several at once."""

    def one(item):
        name, varying = item
        row = cross_validate(df, **fixed, **varying).first()
        metric = PRIMARY[fixed["task"]]
        return name, float(row[metric]), float(row[f"{metric}_std"])

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = list(pool.map(inheritable_thread_target(df.sparkSession)(one), candidates))
    return df.sparkSession.createDataFrame(rows, "name string, value double, sd double")


def _ranked(scores: DataFrame, base: float, base_sd: float) -> DataFrame:
    delta = F.col("value") - F.lit(base)
    return scores.withColumn("delta", delta).withColumn(
        "verdict", verdict(F.col("delta"), F.col("sd") + F.lit(base_sd))
    )


def search_plans(
    df: DataFrame,
    plans: dict[str, dict],
    key: str,
    target: str,
    task: str,
    model: str,
    baseline: tuple[float, float] | None = None,
    parallel: int = 2,
    **options,
) -> DataFrame:
    """Score every plan; ``best`` marks the highest, ``verdict`` compares with the baseline.

    Without a given baseline the raw table is scored first.
    """
    fixed = {"key": key, "target": target, "task": task, "model": model, **options}
    # All plans are scored on the same folds, so the rows are dealt once.
    placed = place_folds(df, key, target, task, options.get("folds", FOLDS))
    fixed["placed"] = placed
    try:
        if baseline is None:
            raw = cross_validate(df, **fixed, plan=None).first()
            baseline = (raw[PRIMARY[task]], raw[f"{PRIMARY[task]}_std"])
        scores = _score_all(df, [(n, {"plan": p}) for n, p in plans.items()], parallel, **fixed)
    finally:
        placed.unpersist()
    ranked = _ranked(scores, *baseline)
    top = ranked.agg(F.min(F.struct((-F.col("value")).alias("v"), "name")).alias("b")).first()["b"]
    return ranked.withColumn("best", F.col("name") == (top["name"] if top else None))


def search_preparation(
    df: DataFrame,
    key: str,
    target: str,
    task: str,
    model: str,
    baseline: tuple[float, float] = (0.0, 0.0),
    space: dict | None = None,
    parallel: int = 2,
    **options,
) -> DataFrame:
    """Exhaustive search over the preparation grid (108 configurations by default).

    For ridge regression all configurations are scored from statistics of the folds,
    which few jobs gather; other models are fitted for each.
    """
    configs = grid(space)
    named = [("|".join(f"{k}={v}" for k, v in c.items()), c) for c in configs]
    scores = None
    if model == "ridge" and task == "regression" and options.keys() <= {"folds"}:
        scores = fold_scores(df, key, target, configs, **options)
    if scores is None:
        fixed = {"key": key, "target": target, "task": task, "model": model, **options}
        return _ranked(_score_all(df, [(n, {"prep": c}) for n, c in named], parallel, **fixed), *baseline)
    rows = [(n, *s) for (n, _), s in zip(named, scores)]
    return _ranked(df.sparkSession.createDataFrame(rows, "name string, value double, sd double"), *baseline)
