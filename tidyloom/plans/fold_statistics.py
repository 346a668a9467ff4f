"""A whole preparation grid from statistics of folds, without a fit for each configuration.

Training rows of a fold are the rows of all others, so what they need follows from
few jobs over the table: means, medians, quartiles and value counts for every
training set at once, then one pass that adds up, for every fold, imputation and
outlier rule, the products of all prepared columns and the target. Scaling and
dropping of features only change such a matrix, never the rows. From the training
rows' matrix comes the ridge regression, from the held-out rows' matrix its error.

The matrices grow with the square of the features, not with the rows; they are
summed by Spark. A table whose categories make more than ``FEATURE_LIMIT``
features has no such way (``fold_scores`` is None), its configurations are
cross-validated one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col, is_numeric
from tidyloom.operators import neighbors
from tidyloom.operators.aggregates import exact_quantiles, one_row
from tidyloom.operators.encode import DRIVER_LIMIT
from tidyloom.operators.gram import matrix_of
from tidyloom.operators.ranking import smallest
from tidyloom.operators.sampling import FOLDS, assign_folds
from tidyloom.plans.preparation import DEFAULT, VARIANCE_FLOOR
from tidyloom.session import cut_lineage

FEATURE_LIMIT = 400
#: Numbers of matrices that a task holds before it sends them on.
HELD_CELLS = 8_000_000
ROWS_AT_ONCE = 20_000
ALPHA = 1.0


@dataclass
class Table:
    """The placed rows and what is known of every fold's training rows."""

    rows: DataFrame
    nums: list[str]
    cats: list[str]
    folds: list[int]
    centers: dict[tuple[int, str], np.ndarray] = field(default_factory=dict)
    bounds: dict[tuple[int, str, str], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    values: dict[str, list[str]] = field(default_factory=dict)
    #: For each categorical column its values' rows by fold, NULL last.
    counts: dict[str, np.ndarray] = field(default_factory=dict)
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0))
    target_shift: float = 0.0


def _placed(df: DataFrame, key: str, target: str, folds: int) -> Table:
    """Rows with ``fold``, numbers n0.., categories c0.. and the target y, checkpointed."""
    placed = assign_folds(df, key, None, folds)
    fields = [f for f in placed.schema if f.name not in (key, target, "fold")]
    nums = [f.name for f in fields if is_numeric(f.dataType)]
    cats = [f.name for f in fields if f.name not in nums]
    rows = placed.select(
        col(key).alias("key"), "fold", col(target).cast("double").alias("y"),
        *[col(c).cast("double").alias(f"n{i}") for i, c in enumerate(nums)],
        *[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cats)],
    )
    rows = cut_lineage(rows)
    met = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    return Table(rows, [f"n{i}" for i in range(len(nums))], [f"c{i}" for i in range(len(cats))], met)


def _fit_centers(t: Table) -> None:
    """Mean and median of each number over every training set: one aggregate and one search."""
    training = {f"{c}:{i}": F.when(F.col("fold") != i, F.col(c)) for c in t.nums for i in t.folds}
    wide = t.rows.select(*[x.alias(n) for n, x in training.items()])
    means = one_row(wide, {n: F.avg(col(n)) for n in training})
    medians = exact_quantiles(wide, {n: [0.5] for n in training})
    for i in t.folds:
        for how, found in (("mean", means), ("median", {n: v[0] for n, v in medians.items()})):
            t.centers[i, how] = np.array([0.0 if (x := found[f"{c}:{i}"]) is None else x for c in t.nums])


def _impute_neighbours(t: Table) -> None:
    """Add ``k<fold>:<column>``: each column with gaps, filled from the fold's training rows."""
    gaps = one_row(t.rows, {c: F.count_if(F.col(c).isNull()) for c in t.nums})
    holes = [c for c in t.nums if gaps[c]]
    rows = t.rows
    base = t.rows.select("key", *t.nums)
    for i in t.folds if holes else []:
        donors = t.rows.where(F.col("fold") != i).select("key", *t.nums)
        some = base.where(" OR ".join(f"{c} IS NULL" for c in holes))
        filled = neighbors.knn_impute(some, "key", t.nums, donors=donors)
        filled = filled.select(F.col("key").alias("__key"), *[col(c).alias(f"k{i}:{c}") for c in holes])
        rows = rows.join(filled, F.col("key").eqNullSafe(F.col("__key")), "left").drop("__key")
    t.rows = cut_lineage(rows) if holes else rows


def _imputed(t: Table, c: str, i: int, how: str):
    """The column as an expression, without gaps, for one fold."""
    at = t.nums.index(c)
    center = F.lit(float(t.centers[i, "mean" if how == "mean" else "median"][at]))
    if how == "knn" and f"k{i}:{c}" in t.rows.columns:
        return F.coalesce(F.col(c), col(f"k{i}:{c}"), center)
    return F.coalesce(F.col(c), center)


def _fit_bounds(t: Table, ways: list[str], rules: list[str]) -> None:
    """Quartiles of every training set after each imputation, all in one search."""
    clipping = [r for r in rules if r != "none"]
    if not clipping or not t.nums:
        return
    columns = {
        f"{how}:{i}:{c}": F.when(F.col("fold") != i, _imputed(t, c, i, how)) for how in ways for i in t.folds for c in t.nums
    }
    wide = t.rows.select(*[x.alias(n) for n, x in columns.items()])
    found = exact_quantiles(wide, {n: [0.25, 0.75] for n in columns})
    for how in ways:
        for i in t.folds:
            for rule in clipping:
                k = float(rule.split("_")[1])
                ends = [found[f"{how}:{i}:{c}"] for c in t.nums]
                # Without spread nothing is clipped.
                fixed = [(a - k * (b - a), b + k * (b - a)) if a is not None and b != a else (-np.inf, np.inf) for a, b in ends]
                low, high = zip(*fixed)
                t.bounds[i, how, rule] = np.array(low), np.array(high)


def _fit_categories(t: Table) -> bool:
    """Values of each category and their rows by fold; False if there are too many."""
    if not t.cats:
        return True
    per_fold = [F.count_if(F.col("fold") == i).alias(f"f{i}") for i in t.folds]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in t.cats]))
    counts = t.rows.select("fold", cells.alias("cell")).groupBy("cell.column", "cell.value").agg(*per_fold)
    found = smallest(counts, ["column"], [F.asc_nulls_first("value")], DRIVER_LIMIT + 2).collect()
    for c in t.cats:
        own = sorted((r for r in found if r["column"] == c and r["value"] is not None), key=lambda r: r["value"])
        null = [r for r in found if r["column"] == c and r["value"] is None]
        if len(own) > DRIVER_LIMIT:
            return False
        t.values[c] = [r["value"] for r in own]
        t.counts[c] = np.array([[r[f"f{i}"] for i in t.folds] for r in [*own, *null]] + ([] if null else [[0] * len(t.folds)]))
    return sum(len(v) + 2 for v in t.values.values()) + len(t.nums) <= FEATURE_LIMIT


def _fill_of(t: Table, c: str, i: int, how: str) -> str:
    """What a fold's missing category becomes: the training rows' mode, or an empty text."""
    if how == "constant":
        return ""
    at = t.folds.index(i)
    seen = t.counts[c][:-1].sum(1) - t.counts[c][:-1, at]
    return t.values[c][int(seen.argmax())] if len(seen) and seen.max() > 0 else "MISSING"


def _code_of(t: Table, c: str) -> dict[str, int]:
    """Place of each value among the features of a category; fills may add two."""
    names = [*t.values[c], *(v for v in ("", "MISSING") if v not in t.values[c])]
    return {v: at for at, v in enumerate(names)}


class Layout:
    """Where the columns of a prepared row stand: one, numbers, values of categories, the target."""

    def __init__(self, t: Table):
        self.codes = {c: _code_of(t, c) for c in t.cats}
        self.start, at = {}, 1 + len(t.nums)
        for c in t.cats:
            self.start[c] = at
            at += len(self.codes[c])
        self.y = at
        self.width = at + 1


def _matrices(t: Table, layout: Layout, ways: list[str], rules: list[str], cat_ways: list[str]) -> dict:
    """Sums of products for every (fold, imputation, rule, category fill) and held-out or not.

    Each comes with the smallest and largest of every number. Rows without a
    target count for the statistics of preparation, not for the model, so both
    matrices are kept.
    """
    nums, cats, folds, width = t.nums, t.cats, t.folds, layout.width
    p = len(nums)
    knn = {(i, j): f"k{i}:{c}" for i in folds for j, c in enumerate(nums) if f"k{i}:{c}" in t.rows.columns}
    number_columns = ["fold", "y", *nums, *dict.fromkeys(knn.values())]
    fills = {(i, cw, c): layout.codes[c][_fill_of(t, c, i, cw)] for i in folds for cw in cat_ways for c in cats}
    centers, bounds, shift, target_shift = t.centers, t.bounds, t.shift, t.target_shift
    codes, start, y_at = layout.codes, layout.start, layout.y
    kinds = [(i, how, rule, cw) for i in folds for how in ways for rule in rules for cw in cat_ways]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            keys = list(total)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.int32()), pa.array([h for _, h in keys], pa.int32()),
                 pa.array([total[k].tobytes() for k in keys], pa.binary())],
                ["kind", "part", "sums"],
            )
            total.clear()
            return out

        for whole in batches:
            for first in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                numbers = matrix_of(batch.select(number_columns))
                fold, y = numbers[:, 0], numbers[:, 1]
                raw = numbers[:, 2 : 2 + p]
                at = {c: 2 + p + k for k, c in enumerate(number_columns[2 + p :])}
                places = {c: _codes(batch.column(c), codes[c]) for c in cats}
                told = ~np.isnan(y)
                for kind, (i, how, rule, cw) in enumerate(kinds):
                    x = np.zeros((len(batch), width))
                    x[:, 0] = 1.0
                    z = raw.copy()
                    if how == "knn":
                        for j in range(p):
                            if (i, j) in knn:
                                z[:, j] = np.where(np.isnan(z[:, j]), numbers[:, at[knn[i, j]]], z[:, j])
                    z = np.where(np.isnan(z), centers[i, "mean" if how == "mean" else "median"], z)
                    if rule != "none":
                        z = np.clip(z, *bounds[i, how, rule])
                    x[:, 1 : 1 + p] = z - shift
                    for c in cats:
                        place = np.where(places[c] < 0, fills[i, cw, c], places[c])
                        x[np.arange(len(x)), start[c] + place] = 1.0
                    x[:, y_at] = np.where(told, y - target_shift, 0.0)
                    # Parts: 0 training rows, 1 those with a target, 2 held-out ones with a target.
                    for part, rows in ((0, fold != i), (1, (fold != i) & told), (2, (fold == i) & told)):
                        if not rows.any():
                            continue
                        own = x[rows]
                        block = np.full((width + 2, width), np.inf)
                        block[:width] = own.T @ own
                        block[width], block[width + 1] = own.min(0), -own.max(0)
                        old = total.get((kind, part))
                        total[kind, part] = block if old is None else _add(old, block)
                    if len(total) * width * width > HELD_CELLS:
                        yield sent()
        if total:
            yield sent()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, None
        for batch in batches:
            for *key, data in zip(*(c.to_pylist() for c in batch.columns)):
                block = np.frombuffer(data, float).reshape(width + 2, width)
                if key == now:
                    found = _add(found, block)
                else:
                    if now is not None:
                        yield row(now, found)
                    now, found = key, block
        if now is not None:
            yield row(now, found)

    def row(key: list[int], block: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["kind", "part", "sums"]
        )

    schema = "kind int, part int, sums binary"
    parts = t.rows.select(*[col(n).cast("double").alias(n) for n in number_columns], *cats).mapInArrow(run, schema)
    done = parts.repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(summed, schema)
    found = {(r["kind"], r["part"]): np.frombuffer(r["sums"], float).reshape(width + 2, width) for r in done.toLocalIterator()}
    return {(kinds[k], part): block for (k, part), block in found.items()}


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products add up; of the last two rows the smaller numbers stay."""
    out = a + b
    out[-2:] = np.minimum(a[-2:], b[-2:])
    return out


def _codes(column: pa.Array, code: dict[str, int]) -> np.ndarray:
    """The place of each value, -1 for NULL."""
    found = column.dictionary_encode()
    names = found.dictionary.to_pylist()
    table = np.array([code[v] for v in names] + [-1], np.int64)
    return table[np.where(found.is_valid().to_numpy(zero_copy_only=False), found.indices.fill_null(0).to_numpy(), len(names))]


def _score(blocks: dict, kind: tuple, scaling: str, selection: str, t: Table, layout: Layout) -> float | None:
    """R² of ridge regression on one fold's held-out rows, from the matrices alone."""
    fit, train, test = (blocks.get((kind, part)) for part in (0, 1, 2))
    if train is None or test is None:
        return None
    p, width = len(t.nums), layout.width
    n = fit[0, 0]
    mean = fit[0, :width] / n
    variance = np.maximum(np.diag(fit[:width]) / n - mean**2, 0.0)
    scale, offset = np.ones(width), np.zeros(width)
    number = slice(1, 1 + p)
    low, high = fit[width, number], -fit[width + 1, number]
    if scaling == "standard":
        scale[number], offset[number] = np.sqrt(variance[number]), mean[number]
    elif scaling == "minmax":
        scale[number], offset[number] = high - low, low
    flat = np.zeros(width, bool)
    flat[number] = high == low
    scale[flat] = 1.0
    scale[scale == 0] = 1.0
    # A feature that no training row has is none.
    features = np.flatnonzero((np.arange(width) < 1 + p) | (fit[0, :width] > 0))
    features = features[(features > 0) & (features != layout.y)]
    if selection == "variance":
        left = features[np.where(flat, 0.0, variance / scale**2)[features] > VARIANCE_FLOOR]
        features = left if len(left) else features
    move = np.zeros((width, len(features) + 2))
    move[0, 0] = move[layout.y, -1] = 1.0
    for k, f in enumerate(features, 1):
        move[f, k], move[0, k] = 1 / scale[f], -offset[f] / scale[f]
    g, h = move.T @ train[:width] @ move, move.T @ test[:width] @ move
    mean_x = g[0] / g[0, 0]
    centered = g - g[0, 0] * np.outer(mean_x, mean_x)
    inner = slice(1, -1)
    weights = np.linalg.solve(centered[inner, inner] + ALPHA * np.eye(len(features)), centered[inner, -1]) if len(features) else np.zeros(0)
    residual = np.concatenate([[-(mean_x[-1] - mean_x[inner] @ weights)], -weights, [1.0]])
    error = residual @ h @ residual
    spread = h[-1, -1] - h[0, -1] ** 2 / h[0, 0]
    return None if spread <= 0 else 1.0 - error / spread


def fold_scores(
    df: DataFrame, key: str, target: str, configs: list[dict], folds: int = FOLDS
) -> list[tuple[float | None, float | None]] | None:
    """Mean and sd of R² of ridge regression over the folds, for each configuration.

    None if the table has too many features, or a configuration encodes otherwise.
    """
    configs = [{**DEFAULT, **c} for c in configs]
    if any(c["encoding"] != "one_hot" for c in configs):
        return None
    t = _placed(df, key, target, folds)
    if not t.folds or not _fit_categories(t):
        return None
    ways = sorted({c["missing_num"] for c in configs})
    rules = sorted({c["outlier"] for c in configs})
    cat_ways = sorted({c["missing_cat"] for c in configs})
    _fit_centers(t)
    if "knn" in ways:
        _impute_neighbours(t)
    _fit_bounds(t, ways, rules)
    middle = one_row(t.rows, {c: F.avg(F.col(c)) for c in [*t.nums, "y"]})
    t.shift = np.array([middle[c] or 0.0 for c in t.nums])
    t.target_shift = middle["y"] or 0.0
    layout = Layout(t)
    blocks = _matrices(t, layout, ways, rules, cat_ways)
    out = []
    for c in configs:
        kinds = [(i, c["missing_num"], c["outlier"], c["missing_cat"]) for i in t.folds]
        found = [s for k in kinds if (s := _score(blocks, k, c["scaling"], c["feat_sel"], t, layout)) is not None]
        out.append((float(np.mean(found)), float(np.std(found))) if found else (None, None))
    return out
