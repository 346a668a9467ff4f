"""Questionnaire aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col
from tidyloom.operators.aggregates import long_form


def accepted(df: DataFrame, status: str, value: str) -> DataFrame:
    return df.where(col(status) == value)


def frequencies(df: DataFrame, item: str) -> DataFrame:
    """Answers of one item with count and share of all respondents."""
    counts = df.groupBy(col(item).alias("answer")).agg(F.count("*").alias("n"))
    total = df.count()
    return counts.where(F.col("answer").isNotNull()).withColumn("share", F.col("n") / F.lit(total))


def item_summary(df: DataFrame, items: list[str]) -> DataFrame:
    """Mean, sample sd and number of answers per numeric item."""
    return (
        long_form(df, items, "double")
        .groupBy(F.col("column").alias("item"))
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("sd"),
            F.count("value").alias("n"),
        )
    )


def top_box(df: DataFrame, items: list[str], positive: list[str]) -> DataFrame:
    """Answers in the positive set, out of those given, per item."""
    return (
        long_form(df, items)
        .groupBy(F.col("column").alias("item"))
        .agg(
            F.count_if(F.col("value").isin(positive)).alias("n_positive"),
            F.count("value").alias("n_answers"),
        )
        .withColumn("share", F.try_divide(F.col("n_positive"), F.col("n_answers")))
    )


def likert_crosstab(df: DataFrame, items: list[str], levels: list[str]) -> DataFrame:
    """Items by level; the level list fixes the columns, so no extra pass finds them."""
    return (
        long_form(df, items)
        .withColumnRenamed("column", "item")
        .groupBy("item")
        .pivot("value", levels)
        .count()
        .na.fill(0, subset=levels)
    )


def usability_score(df: DataFrame, items: list[str]):
    """Ten-item usability score: odd items x - 1, even items 5 - x, times 2.5."""
    terms = [col(c) - 1 if i % 2 == 0 else F.lit(5) - col(c) for i, c in enumerate(items)]
    return df.withColumn("score", sum(terms[1:], terms[0]) * F.lit(2.5))
