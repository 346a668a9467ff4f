"""Ridge regression from one pass over the rows.

A task adds up how many rows there are, the means of all features and the target
and the products of their deviations; two such sums are merged with Chan's
formula, so large values cancel nothing. They grow with the square of the
features, not with the rows. The penalty is one on the summed squared error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.scalar import col
from tidyloom.operators.gram import matrix_of

#: Features for which sums of products are kept.
RIDGE_FEATURES = 400
ALPHA = 1.0
#: Sums that come to the driver at most; more are merged before.
SALTS = 16
ROWS_AT_ONCE = 20_000


@dataclass
class Sums:
    """Rows, means, products of deviations, smallest and largest values of some columns."""

    n: float
    mean: np.ndarray
    product: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Sums:
        mean = values.mean(0)
        z = values - mean
        return cls(float(len(values)), mean, z.T @ z, values.min(0), values.max(0))

    def add(self, other: Sums) -> Sums:
        n = self.n + other.n
        d = other.mean - self.mean
        return Sums(
            n, self.mean + d * (other.n / n), self.product + other.product + np.outer(d, d) * (self.n * other.n / n),
            np.minimum(self.low, other.low), np.maximum(self.high, other.high),
        )

    def to_bytes(self) -> bytes:
        return np.vstack([np.full(len(self.mean), self.n), self.mean, self.low, self.high, self.product]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, width: int) -> Sums:
        n, mean, low, high, *product = np.frombuffer(data, float).reshape(-1, width)
        return cls(float(n[0]), mean, np.array(product), low, high)


def _checked(values: np.ndarray) -> np.ndarray:
    if not np.isfinite(values).all():
        raise ValueError("ridge regression: a feature or the target is missing or not finite")
    return values


def _sums(df: DataFrame, columns: list[str]) -> Sums | None:
    width = len(columns)

    def row(salt: int, total: Sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([total.to_bytes()], pa.binary())], ["salt", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for first in range(0, len(whole), ROWS_AT_ONCE):
                found = Sums.of(_checked(matrix_of(whole.slice(first, ROWS_AT_ONCE))))
                total = found if total is None else total.add(found)
        if total is not None:
            yield row(TaskContext.get().partitionId() % SALTS, total)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("sums").to_pylist():
                found = Sums.from_bytes(data, width)
                total = found if total is None else total.add(found)
        if total is not None:
            yield row(0, total)

    schema = "salt int, sums binary"
    parts = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)
    total = None
    for r in parts.repartition("salt").mapInArrow(merged, schema).toLocalIterator():
        found = Sums.from_bytes(r["sums"], width)
        total = found if total is None else total.add(found)
    return total


def fit_ridge(train: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, float]:
    """A weight for each feature and the intercept; constant features weigh nothing."""
    sums = _sums(train, [*features, label])
    if sums is None:
        raise ValueError("ridge regression: there are no training rows")
    varied = np.flatnonzero(sums.low[:-1] < sums.high[:-1])
    weights = np.zeros(len(features))
    if len(varied):
        inner = sums.product[np.ix_(varied, varied)] + ALPHA * np.eye(len(varied))
        weights[varied] = np.linalg.solve(inner, sums.product[varied, -1])
    return weights, float(sums.mean[-1] - sums.mean[:-1] @ weights)


def predict_ridge(df: DataFrame, fitted: tuple[np.ndarray, float], features: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``prediction``."""
    weights, intercept = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix_of(batch.select(names)) if names else np.zeros((len(batch), 0))
            if np.isnan(values).any():
                raise ValueError("ridge regression: a feature is missing")
            guess = pa.array(values @ weights + intercept)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), guess], [*kept, "prediction"])

    # Names of its own for each column, whatever the table calls them.
    kept, names = [f"k{i}" for i in range(len(keep))], [f"f{i}" for i in range(len(features))]
    rows = df.select(
        *[col(c).alias(k) for c, k in zip(keep, kept)], *[col(c).cast("double").alias(f) for c, f in zip(features, names)]
    )
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("prediction", T.DoubleType())])
    return rows.mapInArrow(run, schema).select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], "prediction")
