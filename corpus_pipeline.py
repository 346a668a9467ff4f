"""Documents to packed training sequences: toxicity, near-copies, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last keep the columns of ``documents``. A stage's result is written as Parquet
and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.catalog.common import table
from tidyloom.llm.mixing import mixed_documents
from tidyloom.llm.ngram_join import ngram_join, text_mark
from tidyloom.llm.packing import pack_documents
from tidyloom.llm.toxicity import fit_toxicity, score_toxicity, training_labels
from tidyloom.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic (0.5 or more) go; all others stay."""
    model = fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs, model, out="__score")
    return scored.where(F.col("__score") < 0.5).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near-copies one row stays: of the smallest key (NULL first).

    Rows are told apart by key and text, as keys may repeat or be NULL.
    """
    classes = ngram_join(docs, marks=True)
    chosen = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_mark") == F.col("class_mark"))
    copies = classes.where(~chosen).select(F.col("doc_id").alias("__id"), F.col("text_mark").alias("__mark"))
    marked = docs.withColumn("__text", text_mark(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__mark"))
    kept = marked.join(copies.distinct(), same, "left_anti")
    return kept.dropDuplicates(["doc_id", "__text"]).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each round in which the mix takes a document."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of balanced cost."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]
# Restoring and scoring texts, and tokenizing, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
