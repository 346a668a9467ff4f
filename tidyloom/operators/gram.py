"""Moments of pairs of columns from matrix products, one scan for any number of columns.

A task keeps matrices over all pairs: how many rows have both values, the means
of each column over those rows, their squared deviations and products. A block of
rows adds to them by products of its value and presence matrices, and two sets of
matrices are merged with Chan's formulas, so large values cancel nothing. What
tasks send on are blocks of matrix rows, which Spark brings together by block in
two steps; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col

#: Matrix rows that travel together, and first-step groups that partial results are dealt to.
BLOCK_ROWS, SALTS = 32, 16
#: Cells of a batch that are turned into matrices at a time.
BATCH_CELLS = 4_000_000
#: Deviations below this share of the mean are rounding.
ROUNDING = 1e-13
FIELDS = ("n", "mean_x", "mean_y", "square_x", "square_y", "product")


@dataclass
class PairMoments:
    """For pairs (x, y) of columns: rows with both, means, squared deviations and products of deviations."""

    n: np.ndarray
    mean_x: np.ndarray
    mean_y: np.ndarray
    square_x: np.ndarray
    square_y: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> PairMoments:
        """Of a block of rows; NaN is missing."""
        present = (~np.isnan(values)).astype(float)
        count = present.sum(0)
        filled = np.where(present > 0, values, 0.0)
        # Deviations from the block's own means, so that squares stay small.
        center = np.divide(filled.sum(0), count, out=np.zeros(len(count)), where=count > 0)
        z = np.where(present > 0, values - center, 0.0)
        n = present.T @ present
        some = np.where(n > 0, n, 1.0)
        sums = z.T @ present
        mean = sums / some
        square = np.maximum((z * z).T @ present - sums * mean, 0.0)
        product = z.T @ z - sums * mean.T
        shifted = np.where(n > 0, mean + center[:, None], 0.0)
        return cls(n, shifted, shifted.T.copy(), square, square.T.copy(), product)

    def add(self, other: PairMoments) -> PairMoments:
        n = self.n + other.n
        some = np.where(n > 0, n, 1.0)
        dx, dy = other.mean_x - self.mean_x, other.mean_y - self.mean_y
        share, both = other.n / some, self.n * other.n / some
        return PairMoments(
            n, self.mean_x + dx * share, self.mean_y + dy * share,
            self.square_x + other.square_x + dx * dx * both,
            self.square_y + other.square_y + dy * dy * both,
            self.product + other.product + dx * dy * both,
        )

    def rows(self, a: int, b: int) -> PairMoments:
        return PairMoments(*(getattr(self, f)[a:b] for f in FIELDS))

    def to_bytes(self) -> bytes:
        return np.stack([getattr(self, f) for f in FIELDS]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, width: int) -> PairMoments:
        return cls(*np.frombuffer(data, float).reshape(len(FIELDS), -1, width))


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    """The columns as doubles, NULL as NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])


def merged_by(parts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One row of moments for each value of ``keys``, read as a stream."""
    names = parts.columns
    kinds = dict(parts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        types = {"int": pa.int32(), "binary": pa.binary()}

        def row() -> pa.RecordBatch:
            values = [*now, total.to_bytes()]
            columns = [*keys, "moments"]
            return pa.RecordBatch.from_arrays([pa.array([v], types[kinds[c]]) for c, v in zip(columns, values)], columns)

        for batch in batches:
            for *key, data in zip(*(batch.column(c).to_pylist() for c in [*keys, "moments"])):
                found = PairMoments.from_bytes(data, width)
                if key == now:
                    total = total.add(found)
                else:
                    if now is not None:
                        yield row()
                    now, total = key, found
        if now is not None:
            yield row()

    ordered = parts.select(*keys, *[c for c in names if c == "moments"]).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "moments"]))


def pair_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """``block, moments``: rows ``block * BLOCK_ROWS`` and on of the matrices over ``cols``."""
    width = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        step = max(1, BATCH_CELLS // max(width, 1))
        for batch in batches:
            for at in range(0, len(batch), step):
                found = PairMoments.of(matrix_of(batch.slice(at, step)))
                total = found if total is None else total.add(found)
        if total is not None:
            salt = TaskContext.get().partitionId() % SALTS
            for block in range(0, width, BLOCK_ROWS):
                part = total.rows(block, block + BLOCK_ROWS).to_bytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block // BLOCK_ROWS], pa.int32()), pa.array([salt], pa.int32()), pa.array([part], pa.binary())],
                    ["block", "salt", "moments"],
                )

    values = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = values.mapInArrow(run, "block int, salt int, moments binary")
    return merged_by(merged_by(parts, ["block", "salt"], width), ["block"], width)


def correlations(df: DataFrame, cols: list[str], at_least: float | None = None) -> DataFrame:
    """``x, y, n, corr`` for places x < y in ``cols``: pairwise-complete, NULL without spread.

    With ``at_least`` only pairs whose correlation is above it in size are returned.
    """
    width = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(*(c.to_pylist() for c in batch.columns)):
                m = PairMoments.from_bytes(data, width)
                # What rounding leaves of equal values is no spread.
                flat_x = m.square_x <= m.n * (ROUNDING * m.mean_x) ** 2
                flat_y = m.square_y <= m.n * (ROUNDING * m.mean_y) ** 2
                spread = np.sqrt(m.square_x) * np.sqrt(m.square_y)
                known = (m.n > 0) & (spread > 0) & ~flat_x & ~flat_y
                corr = np.divide(m.product, spread, out=np.zeros_like(spread), where=known)
                x = np.arange(len(corr))[:, None] + block * BLOCK_ROWS
                wanted = x < np.arange(width)
                if at_least is not None:
                    wanted &= known & (np.abs(corr) > at_least)
                i, j = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(i + block * BLOCK_ROWS, pa.int32()), pa.array(j, pa.int32()),
                        pa.array(m.n[i, j].astype(np.int64)), pa.array(corr[i, j], mask=~known[i, j]),
                    ],
                    ["x", "y", "n", "corr"],
                )

    return pair_moments(df, cols).mapInArrow(run, "x int, y int, n bigint, corr double")
