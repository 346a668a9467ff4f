"""Model metrics from predictions, per group (fold, plan, model, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.operators.ranking import running_counts


def _by(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str], bool]:
    if by:
        return df, list(by), False
    return df.withColumn("__all", F.lit(0)), ["__all"], True


def classification_metrics(
    df: DataFrame, by: list[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Accuracy, weighted F1 and macro F1.

    One shuffle builds the confusion counts; the rest works on that small
    table. Classes are those seen as label or as prediction.
    """
    df, by, single = _by(df, by)
    confusion = df.groupBy(*by, F.col(label).alias("__y"), F.col(prediction).alias("__p")).agg(
        F.count("*").alias("n")
    )
    hit = F.col("__y").eqNullSafe(F.col("__p"))
    sides = F.array(
        F.struct(
            F.col("__y").cast("string").alias("cls"),
            F.when(hit, F.col("n")).otherwise(0).alias("tp"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
        ),
        F.struct(
            F.col("__p").cast("string").alias("cls"),
            F.lit(0).cast("bigint").alias("tp"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    per_class = (
        confusion.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, "s.cls")
        .agg(
            F.sum("s.tp").alias("tp"),
            F.sum("s.support").alias("support"),
            F.sum("s.predicted").alias("predicted"),
        )
    )
    f1 = F.coalesce(
        F.try_divide(2.0 * F.col("tp"), (F.col("support") + F.col("predicted")).cast("double")),
        F.lit(0.0),
    )
    out = per_class.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg(f1).alias("f1_macro"),
        F.sum("support").alias("n_rows"),
    )
    return out.drop("__all") if single else out


def one_vs_rest_auc(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Support-weighted one-vs-rest ROC AUC.

    ``df`` is long: one row per (row, class) with ``cls``, ``positive`` (0/1)
    and ``score``. Rows are first counted per distinct score; ties get the
    average rank through the half-count term.
    """
    df, by, single = _by(df, by)
    keys = [*by, "cls"]
    points = df.groupBy(*keys, "score").agg(
        F.sum("positive").alias("pos"), F.sum(1 - F.col("positive")).alias("neg")
    )
    ranked = running_counts(points, keys, "score", ["neg"])
    per_class = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("wins"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    auc = F.try_divide(F.col("wins"), (F.col("p") * F.col("n")).cast("double"))
    out = per_class.groupBy(*by).agg(
        F.try_divide(F.sum(auc * F.col("p")), F.sum(F.when(auc.isNotNull(), F.col("p"))).cast("double"))
        .alias("roc_auc")
    )
    return out.drop("__all") if single else out


def regression_metrics(
    df: DataFrame, by: list[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """MAE, RMSE and R2 in one aggregate."""
    df, by, single = _by(df, by)
    y, e = F.col(label).cast("double"), F.col(label) - F.col(prediction)
    out = df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1.0 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.count("*").alias("n_rows"),
    )
    return out.drop("__all") if single else out


def over_folds(df: DataFrame, metrics: list[str], by: list[str] = ()) -> DataFrame:
    """Mean and population sd of each metric over the folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
