"""Multivariate chained imputation from sufficient statistics.

Each numeric column is regressed on the others with Bayesian ridge regression
(MacKay, 1992; Tipping, 2001), in rounds, starting from column means. Every
update is linear, so within one missingness pattern an imputed value is an
affine function of the observed values, whatever the round. The sums of
products of the observed values per pattern - one aggregate over the table -
therefore determine all rounds exactly, and the rounds run on small matrices.

With few patterns their sums come to the driver. With very many they stay a
distributed table, made by one pass over the rows: executors take each pattern's
map through the regressions so far, and only one Gram matrix a regression comes
back. Both ways stop by the same rule, a bound on how far a round moves any
imputed value, so they give the same fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.scalar import col
from tidyloom.operators.aggregates import CHUNK, one_row
from tidyloom.operators.gram import matrix_of
from tidyloom.session import cut_lineage

MAX_PATTERNS = 512
CLOSED_FORM_PATTERNS = 32
#: Numbers of pattern sums that a task holds before it sends them on.
HELD_CELLS = 2_000_000
ROUNDS = 10
TOLERANCE = 1e-3
# The Gamma priors of the regression and its iteration limits.
_PRIOR = 1e-6
_MAX_ITER = 300
_COEF_TOL = 1e-3


def bayesian_ridge(gram: np.ndarray, y: int, xs: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from a Gram matrix whose row 0 belongs to the constant."""
    n = gram[0, 0]
    if n <= 0:
        return np.zeros(len(xs)), 0.0
    mean_x = gram[0, xs] / n
    mean_y = gram[0, y] / n
    cxx = gram[np.ix_(xs, xs)] - n * np.outer(mean_x, mean_x)
    cxy = gram[xs, y] - n * mean_x * mean_y
    cyy = max(gram[y, y] - n * mean_y**2, 0.0)
    values, vectors = np.linalg.eigh(cxx) if xs else (np.zeros(0), np.zeros((0, 0)))
    values = np.clip(values, 0.0, None)
    rotated = vectors.T @ cxy
    noise = 1.0 / (cyy / n + np.finfo(float).eps)
    weight = 1.0
    coef = np.zeros(len(xs))

    def posterior() -> np.ndarray:
        return vectors @ (rotated / (values + weight / noise))

    for step in range(_MAX_ITER):
        old, coef = coef, posterior()
        error = max(cyy - 2 * coef @ cxy + coef @ cxx @ coef, 0.0)
        gamma = np.sum(noise * values / (weight + noise * values))
        weight = (gamma + 2 * _PRIOR) / (coef @ coef + 2 * _PRIOR)
        noise = (n - gamma + 2 * _PRIOR) / (error + 2 * _PRIOR)
        if step and np.sum(np.abs(old - coef)) < _COEF_TOL:
            break
    coef = posterior()
    return coef, float(mean_y - coef @ mean_x)


def _pattern(cols: list[str]) -> Column:
    return F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in cols])


def _pattern_moments(df: DataFrame, cols: list[str], means: np.ndarray) -> dict[str, np.ndarray]:
    """Per pattern: sums of products of (1, centred values), over observed columns."""
    z = [F.lit(1.0)] + [col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, means)]
    cells = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    out: dict[str, np.ndarray] = {}
    for start in range(0, len(cells), CHUNK):
        part = cells[start : start + CHUNK]
        sums = [F.sum(z[i] * z[j]).alias(f"m{n}") for n, (i, j) in enumerate(part)]
        for row in df.groupBy(_pattern(cols).alias("__pattern")).agg(*sums).collect():
            gram = out.setdefault(row["__pattern"], np.zeros((len(z), len(z))))
            for n, (i, j) in enumerate(part):
                gram[i, j] = gram[j, i] = row[f"m{n}"] or 0.0
    return out


def _start_map(pattern: str) -> np.ndarray:
    """Affine map (1, observed) -> current row; missing cells start at the mean (0)."""
    return np.diag([1.0, *(float(flag == "0") for flag in pattern)])


def _advance(a: np.ndarray, pattern: str, steps) -> None:
    """Take the map of a pattern through some regressions."""
    for j, icept, coef in steps:
        if pattern[j - 1] == "1":
            a[j] = np.asarray(coef) @ np.delete(a, [0, j], axis=0)
            a[j, 0] += icept


def _moved(before: np.ndarray, after: np.ndarray, reach: np.ndarray) -> float:
    """No imputed value of the pattern's rows has moved further than this."""
    d = np.abs(after - before)
    return float(np.sum(d[:, 0] + d[:, 1:] @ reach))


def fit_chained(
    df: DataFrame,
    cols: list[str],
    rounds: int = ROUNDS,
    tol: float = TOLERANCE,
    max_patterns: int = MAX_PATTERNS,
) -> dict:
    """Fit on ``cols`` (none of them all-missing). The state is plain numbers."""
    exprs = {}
    for c in cols:
        x = col(c).cast("double")
        exprs |= {f"n:{c}": F.count(x), f"m:{c}": F.avg(x), f"a:{c}": F.max(F.abs(x))}
    exprs["patterns"] = F.approx_count_distinct(_pattern(cols))
    exprs["rows"] = F.count(F.lit(1))
    got = one_row(df, exprs)
    means = np.array([got[f"m:{c}"] for c in cols], dtype=float)
    widest = max((got[f"a:{c}"] for c in cols), default=0.0)
    reach = np.array([got[f"a:{c}"] for c in cols]) + np.abs(means)
    missing = [got["rows"] - got[f"n:{c}"] for c in cols]
    order = sorted(range(1, len(cols) + 1), key=lambda j: (missing[j - 1], j))
    state = {"columns": list(cols), "means": means.tolist(), "steps": [], "maps": None}
    if len(cols) == 1 or not any(missing):
        rounds = min(rounds, 1)
    # The sketch only chooses between two ways to the same numbers.
    if got["patterns"] > max_patterns:
        return _fit_many_patterns(df, state, order, rounds, tol * widest, reach)

    return _fit_patterns(state, _pattern_moments(df, cols, means), order, rounds, tol * widest, reach)


def _fit_patterns(
    state: dict, moments: dict[str, np.ndarray], order: list[int], rounds: int, enough: float, reach: np.ndarray
) -> dict:
    """The rounds on sums of products by pattern, all on small matrices."""
    width = len(state["columns"]) + 1
    maps = {m: _start_map(m) for m in moments}
    grams = {m: maps[m] @ s @ maps[m].T for m, s in moments.items()}
    for _ in range(rounds):
        before = {m: a.copy() for m, a in maps.items()}
        for j in order:
            others = [k for k in range(1, width) if k != j]
            seen = [g for m, g in grams.items() if m[j - 1] == "0"]
            coef, icept = bayesian_ridge(sum(seen), j, others)
            step = [j, icept, coef.tolist()]
            state["steps"].append(step)
            for m, a in maps.items():
                if m[j - 1] == "1":
                    _advance(a, m, [step])
                    grams[m] = a @ moments[m] @ a.T
        change = max(_moved(before[m], a, reach) for m, a in maps.items()) if maps else 0.0
        # The bound holds for every row, so stopping is never too early.
        if change < enough:
            break
    if len(maps) <= CLOSED_FORM_PATTERNS:
        state["maps"] = {m: a.tolist() for m, a in maps.items()}
    return state


def fit_one_gap(
    cols: list[str], gap: int, seen: np.ndarray, blank: np.ndarray, origin: np.ndarray, largest: np.ndarray,
    rounds: int = ROUNDS, tol: float = TOLERANCE,
) -> dict:
    """The fit for a table whose only gaps are in one column, from sums alone.

    ``seen`` and ``blank`` are the sums of products of (1, values less ``origin``) over
    the rows with and without a value there (the values as they were), ``largest`` the
    largest sizes of the values that count. The same numbers as ``fit_chained`` on the
    rows.
    """
    total = seen + blank
    off = np.where(np.arange(len(cols)) == gap, seen[0, 1:] / seen[0, 0], total[0, 1:] / total[0, 0])
    means = origin + off
    move = np.eye(len(cols) + 1)
    move[1:, 0] = -off
    moments = {"0" * len(cols): move @ seen @ move.T}
    if blank[0, 0]:
        part = move @ blank @ move.T
        part[gap + 1, :] = part[:, gap + 1] = 0.0
        moments["".join("1" if i == gap else "0" for i in range(len(cols)))] = part
    missing = [float(blank[0, 0]) if i == gap else 0.0 for i in range(len(cols))]
    order = sorted(range(1, len(cols) + 1), key=lambda j: (missing[j - 1], j))
    if len(cols) == 1 or not blank[0, 0]:
        rounds = min(rounds, 1)
    state = {"columns": list(cols), "means": means.tolist(), "steps": [], "maps": None}
    return _fit_patterns(state, moments, order, rounds, tol * float(largest.max(initial=0.0)), largest + np.abs(means))


def _pattern_table(df: DataFrame, cols: list[str], means: np.ndarray) -> DataFrame:
    """``pattern, moments`` (a flag for each column; a matrix as bytes), from one pass over the rows."""
    width = len(cols) + 1

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, np.ndarray] = {}
        for batch in batches:
            raw = matrix_of(batch) - means
            gaps = np.isnan(raw)
            z = np.column_stack([np.ones(len(raw)), np.where(gaps, 0.0, raw)])
            patterns, which = np.unique(gaps, axis=0, return_inverse=True)
            order = np.argsort(which, kind="stable")
            ends = np.searchsorted(which[order], np.arange(len(patterns) + 1))
            for i, pattern in enumerate(patterns):
                rows = z[order[ends[i] : ends[i + 1]]]
                key = pattern.astype(np.uint8).tobytes()
                found[key] = found.get(key, 0.0) + rows.T @ rows
            if len(found) * width * width > HELD_CELLS:
                yield pattern_batch(found)
                found = {}
        yield pattern_batch(found)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            done: dict[bytes, np.ndarray] = {}
            for pattern, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(data, float).reshape(width, width)
                if pattern != now:
                    if now is not None:
                        done[now] = total
                    now, total = pattern, part
                else:
                    total = total + part
            yield pattern_batch(done)
        if now is not None:
            yield pattern_batch({now: total})

    def pattern_batch(found: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        data = [m.tobytes() for m in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(data, pa.binary())], ["pattern", "moments"])

    schema = "pattern binary, moments binary"
    block = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = block.mapInArrow(grouped, schema).repartition("pattern").sortWithinPartitions("pattern")
    return cut_lineage(parts.mapInArrow(summed, schema))


def _maps_after(gaps: np.ndarray, steps) -> np.ndarray:
    """The affine maps of several patterns after some regressions."""
    width = gaps.shape[1] + 1
    maps = np.zeros((len(gaps), width, width))
    maps[:, 0, 0] = 1.0
    for j in range(1, width):
        maps[:, j, j] = ~gaps[:, j - 1]
    return _advance_all(maps, gaps, steps)


def _advance_all(maps: np.ndarray, gaps: np.ndarray, steps) -> np.ndarray:
    for j, icept, coef in steps:
        rows = np.flatnonzero(gaps[:, j - 1])
        others = np.delete(np.arange(1, maps.shape[1]), j - 1)
        maps[rows, j] = np.einsum("k,rkw->rw", np.asarray(coef), maps[np.ix_(rows, others)])
        maps[rows, j, 0] += icept
    return maps


def _fit_many_patterns(
    df: DataFrame, state: dict, order: list[int], rounds: int, enough: float, reach: np.ndarray
) -> dict:
    """The rounds on a table of patterns; only a matrix or a number returns for each."""
    cols = state["columns"]
    width = len(cols) + 1
    patterns = _pattern_table(df, cols, np.array(state["means"]))

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        gaps = np.array([np.frombuffer(p, np.uint8) for p in batch.column(0).to_pylist()], bool).reshape(-1, width - 1)
        moments = np.array([np.frombuffer(m, float) for m in batch.column(1).to_pylist()]).reshape(-1, width, width)
        return gaps, moments

    def gram_of(steps, j: int) -> np.ndarray:
        def run(batches):
            total = np.zeros((width, width))
            for batch in batches:
                gaps, moments = read(batch)
                seen = ~gaps[:, j - 1]
                maps = _maps_after(gaps[seen], steps)
                total += np.einsum("rab,rbc,rdc->ad", maps, moments[seen], maps, optimize=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width), pa.int32()), pa.array(total.ravel())], ["pos", "v"])

        rows = patterns.mapInArrow(run, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v"))
        flat = np.zeros(width * width)
        for r in rows.collect():
            flat[r["pos"]] = r["v"]
        return flat.reshape(width, width)

    def change_of(steps, done: int) -> float:
        """How far the regressions after the first ``done`` move any pattern met."""

        def run(batches):
            most = 0.0
            for batch in batches:
                gaps, _ = read(batch)
                before = _maps_after(gaps, steps[:done])
                d = np.abs(_advance_all(before.copy(), gaps, steps[done:]) - before)
                most = max(most, float((d[:, :, 0] + d[:, :, 1:] @ reach).sum(1).max(initial=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array([most])], ["v"])

        return patterns.mapInArrow(run, "v double").agg(F.max("v")).first()[0] or 0.0

    for _ in range(rounds):
        done = len(state["steps"])
        for j in order:
            others = [k for k in range(1, width) if k != j]
            coef, icept = bayesian_ridge(gram_of(list(state["steps"]), j), j, others)
            state["steps"].append([j, icept, coef.tolist()])
        if change_of(list(state["steps"]), done) < enough:
            break
    return state


def _replay(raw: np.ndarray, means: np.ndarray, steps) -> np.ndarray:
    """Run the recorded regressions over a block; returns centred, complete values."""
    x = raw - means
    gaps = np.isnan(x)
    x[gaps] = 0.0
    for j, icept, coef in steps:
        rows = gaps[:, j - 1]
        if rows.any():
            others = np.delete(x[rows], j - 1, axis=1)
            x[rows, j - 1] = icept + others @ np.asarray(coef)
    return x


def apply_chained(df: DataFrame, state: dict, closed_form: bool = False) -> DataFrame:
    """Fill missing cells.

    ``closed_form`` is for the rows the state was fitted on, whose patterns are
    all known: the fill is then a JVM expression. Other rows may show new
    patterns, so the recorded regressions are replayed per Arrow batch.
    """
    cols = [c for c in state["columns"]]
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    if len(cols) == 1:
        mean = state["means"][0] + (state["steps"][0][1] if state["steps"] else 0.0)
        return df.withColumn(cols[0], F.coalesce(col(cols[0]).cast("double"), F.lit(mean)))
    if closed_form and state["maps"] is not None:
        return _apply_maps(df, state)

    means = np.array(state["means"])
    steps = state["steps"]
    fields = [f"c{i}" for i in range(len(cols))]
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in fields])

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        raw = block.to_numpy(dtype=float)
        done = _replay(raw, means, steps) + means
        return pd.DataFrame(np.where(np.isnan(raw), done, raw), columns=fields)

    filled = F.pandas_udf(fill, schema)(
        F.struct(*[col(c).cast("double").alias(f) for c, f in zip(cols, fields)])
    )
    out = df.withColumn("__filled", filled)
    return out.withColumns({c: F.col(f"__filled.{f}") for c, f in zip(cols, fields)}).drop(
        "__filled"
    )


def _apply_maps(df: DataFrame, state: dict) -> DataFrame:
    cols, means = state["columns"], state["means"]
    centred = [F.lit(1.0)] + [
        F.coalesce(col(c).cast("double"), F.lit(float(m))) - F.lit(float(m))
        for c, m in zip(cols, means)
    ]
    out = df.withColumn("__pattern", _pattern(cols))
    new = {}
    for j, c in enumerate(cols, start=1):
        fill = None
        for m, a in state["maps"].items():
            if m[j - 1] == "0":
                continue
            terms = [F.lit(float(w)) * centred[k] for k, w in enumerate(a[j]) if w != 0.0]
            value = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
            value = value + F.lit(float(means[j - 1]))
            hit = F.col("__pattern") == m
            fill = F.when(hit, value) if fill is None else fill.when(hit, value)
        x = col(c).cast("double")
        new[c] = x if fill is None else F.coalesce(x, fill)
    return out.withColumns(new).drop("__pattern")
