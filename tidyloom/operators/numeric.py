"""Outliers, de-skewing, binning, scaling and feature filters."""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.scalar import (
    clip,
    col,
    is_numeric,
    log1p_clipped,
    numeric_columns,
    sample_skew,
    yeo_johnson,
)
from tidyloom.operators.aggregates import exact_quantiles, long_form, one_row
from tidyloom.operators.audit import Tally, columns_of, counted, settings
from tidyloom.operators.columns import append_columns
from tidyloom.operators.gram import correlations
from tidyloom.operators.ranking import smallest


# ---------------------------------------------------------------- outliers
def outlier_bounds(
    df: DataFrame, cols: list[str], method: str = "iqr", iqr_k: float = 1.5, z_thresh: float = 3.0
) -> dict[str, tuple[float, float] | None]:
    """(low, high) per column; None where nothing can be an outlier (no data, no spread)."""
    out: dict[str, tuple[float, float] | None] = {}
    if method == "iqr":
        for c, (q1, q3) in exact_quantiles(df, {c: [0.25, 0.75] for c in cols}).items():
            spread = None if q1 is None else q3 - q1
            out[c] = (q1 - iqr_k * spread, q3 + iqr_k * spread) if spread else None
    elif method == "zscore":
        exprs = {}
        for c in cols:
            exprs |= {f"m:{c}": F.avg(col(c)), f"s:{c}": F.stddev_pop(col(c))}
        got = one_row(df, exprs) if cols else {}
        for c in cols:
            m, s = got[f"m:{c}"], got[f"s:{c}"]
            out[c] = (m - z_thresh * s, m + z_thresh * s) if s else None
    else:
        raise ValueError("outlier method must be 'iqr' or 'zscore'")
    return {c: out[c] for c in cols}


def outside(c: str, bounds: tuple[float, float] | None) -> Column:
    if bounds is None:
        return F.lit(False)
    low, high = bounds
    return F.coalesce((col(c) < low) | (col(c) > high), F.lit(False))


def clip_columns(df: DataFrame, bounds: dict) -> DataFrame:
    new = {
        c: clip(col(c).cast("double"), *b) for c, b in bounds.items() if b and c in df.columns
    }
    return df.withColumns(new) if new else df


def remove_outliers(df: DataFrame, params: dict, audit: bool | Tally = True):
    """Drop outlier rows, or clip values into their bounds."""
    names = columns_of("remove_outliers", df, params, numeric=True)
    o = settings(
        "remove_outliers", params, method=(("iqr", "zscore"),), mode=("drop_rows", ("drop_rows", "clip")),
        combine=("any", ("any", "all")), iqr_k=(1.5, float), z_thresh=(3.0, float),
    )
    bounds = outlier_bounds(df, names, o["method"], o["iqr_k"], o["z_thresh"])
    outliers = {c: outside(c, bounds[c]) for c in names}
    flagged = reduce((lambda a, b: a | b) if o["combine"] == "any" else (lambda a, b: a & b), outliers.values())
    clipping = o["mode"] == "clip"
    record = {k: o[k] for k in ("method", "mode", "combine")} | {
        "columns": names,
        "bounds": {c: dict(zip(("low", "high"), b)) for c, b in bounds.items() if b},
    }
    notes = [f"{c} has no spread" for c in names if not bounds[c]]
    # As with rows: nothing is clipped unless some row is an outlier everywhere.
    idle = clipping and o["combine"] == "all" and not one_row(df, {"n": F.count_if(flagged)})["n"]

    def tell(found: dict) -> None:
        hit, rows = found["flagged"], found["rows"]
        removed = 0 if clipping else hit
        record["rows_flagged_as_outliers"] = hit
        record.update(rows_before=rows, rows_after=rows - removed, rows_removed=removed)
        clipped = {c: found[c] for c in names if clipping and hit and found[c]}
        record["values_clipped_count"] = clipped
        if not hit:
            notes.append("no value is an outlier by these bounds")

    counts = {c: F.count_if(m) for c, m in outliers.items()}
    df = counted(df, counts | {"rows": F.count(F.lit(1)), "flagged": F.count_if(flagged)}, audit, tell)
    if clipping:
        return (df if idle else clip_columns(df, bounds)), record, notes
    return df.where(~flagged), record, notes


def outlier_cells(df: DataFrame, iqr_k: float = 3.0) -> int:
    """Cells beyond ``iqr_k`` interquartile ranges, over all numeric columns."""
    cols = numeric_columns(df)
    if not cols:
        return 0
    bounds = outlier_bounds(df, cols, "iqr", iqr_k)
    got = one_row(df, {c: F.count_if(outside(c, b)) for c, b in bounds.items()})
    return sum(got.values())


# ---------------------------------------------------------------- skew
SKEW_MIN_DISTINCT = 10
SKEW_MIN_ROWS = 10


def fit_deskew(
    df: DataFrame,
    skewness_threshold: float = 1.0,
    method: str = "log1p",
    columns=None,
    exclude=(),
    model_family: str = "linear",
    target: str | None = None,
) -> dict[str, dict]:
    """Which columns to transform, and how."""
    if model_family == "tree":
        return {}
    if method not in ("log1p", "yeo-johnson"):
        raise ValueError("transform_numeric_skewed 'method' must be log1p or yeo-johnson")
    pool = columns or numeric_columns(df, [target])
    pool = [c for c in pool if c in df.columns and c not in exclude]
    if not pool:
        return {}
    exprs = {}
    for c in pool:
        exprs |= {
            f"n:{c}": F.count(col(c)),
            f"k:{c}": sample_skew(col(c)),
            f"m:{c}": F.min(col(c)).cast("double"),
        }
    got = one_row(df, exprs)
    varied = set(pool) if columns else more_distinct(df, pool, SKEW_MIN_DISTINCT)
    picked = {}
    for c in pool:
        if c not in varied:
            continue
        skew = got[f"k:{c}"]
        if got[f"n:{c}"] < SKEW_MIN_ROWS or skew is None or abs(skew) <= skewness_threshold:
            continue
        if method == "log1p" and got[f"m:{c}"] < 0:
            continue
        picked[c] = {"method": method, "skew_before": skew}
    if method == "yeo-johnson" and picked:
        for c, lam in fit_yeo_johnson(df, list(picked)).items():
            picked[c]["lambda"] = lam
    return picked


def more_distinct(df: DataFrame, cols: list[str], k: int) -> set[str]:
    """Columns with more than ``k`` distinct values, counted exactly.

    Repeated values go before the shuffle, and no more than k + 1 of a column
    are looked at.
    """
    cells = long_form(df, cols).where(F.col("value").isNotNull()).distinct()
    few = smallest(cells, ["column"], [F.asc("value")], k + 1)
    counts = few.groupBy("column").agg(F.count("*").alias("n")).collect()
    return {r["column"] for r in counts if r["n"] > k}


#: Cells for each unit of log(1 + |x|), and the power sums that a cell keeps.
CELLS, POWERS = 64, 6


def log_cells(df: DataFrame, cols: list[str]) -> dict[str, np.ndarray]:
    """Counts and moments of log(1 + |x|) in narrow cells of either sign, from one scan.

    For each column an array with a row per cell: sign, count, mean, and the central
    moments (as sums) from the second on. The cells of a column are bounded by the
    range of doubles, whatever the rows.
    """
    x = F.col("value")
    size = F.log1p(F.abs(x))
    sign = F.when(x < 0, -1).otherwise(1)
    cells = long_form(df, cols, "double").where(x.isNotNull())
    cells = cells.select("column", sign.alias("sign"), size.alias("u"), F.floor(size * CELLS).alias("cell"))
    off = F.col("u") - (F.col("cell") + 0.5) / CELLS
    power, sums = F.lit(1.0), [F.count("*").alias("s0")]
    for k in range(1, POWERS + 1):
        power = power * off
        sums.append(F.sum(power).alias(f"s{k}"))
    found: dict[str, list] = {c: [] for c in cols}
    for r in cells.groupBy("column", "sign", "cell").agg(*sums).collect():
        n = r["s0"]
        raw = [r[f"s{k}"] / n for k in range(1, POWERS + 1)]
        mean = raw[0]
        # From moments about the cell's centre to those about its mean.
        central = [
            sum(math.comb(m, j) * ([1.0, *raw][j]) * (-mean) ** (m - j) for j in range(m + 1)) for m in range(2, POWERS + 1)
        ]
        found[r["column"]].append([r["sign"], n, (r["cell"] + 0.5) / CELLS + mean, *(n * c for c in central)])
    return {c: np.array(sorted(rows), float).reshape(-1, 2 + POWERS) for c, rows in found.items()}


def yeo_johnson_likelihood(cells: np.ndarray, lam: float) -> float:
    """Log-likelihood of lambda: the transform is expanded about each cell's mean."""
    sign, n, mean = cells[:, 0], cells[:, 1], cells[:, 2]
    a = np.where(sign > 0, lam, 2.0 - lam)
    with np.errstate(over="ignore", invalid="ignore"):
        middle = sign * np.where(np.abs(a) < 1e-12, mean, np.expm1(a * mean) / np.where(np.abs(a) < 1e-12, 1.0, a))
        slope = np.exp(a * mean)
        first = np.zeros(len(a))
        second = np.zeros(len(a))
        for m in range(2, POWERS + 1):
            central = cells[:, 1 + m]
            first += a ** (m - 1) * central / math.factorial(m)
            second += a ** (m - 2) * (2.0**m - 2.0) * central / math.factorial(m)
        first, second = sign * slope * first, slope * slope * second
        total = n.sum()
        off = middle - (n @ middle + first.sum()) / total
        variance = (second + 2 * off * first + n * off * off).sum() / total
    if not math.isfinite(variance) or variance <= 0:
        return -math.inf
    return float(-0.5 * total * math.log(variance) + (lam - 1.0) * (sign * n) @ mean)


def fit_yeo_johnson(df: DataFrame, cols: list[str], widest: float = 50.0) -> dict[str, float]:
    """Maximum-likelihood lambda per column, from one scan.

    The likelihood is smooth with one maximum, and the cells give it at any lambda, so
    the maximum is bracketed and narrowed on the driver.
    """
    return {c: _likeliest(cells, widest) for c, cells in log_cells(df, cols).items()}


def _likeliest(cells: np.ndarray, widest: float) -> float:
    if not len(cells):
        return 0.0

    def score(lam: float) -> float:
        return yeo_johnson_likelihood(cells, lam)

    step, best = 0.5, max((i * 0.5 for i in range(-6, 7)), key=score)
    while abs(best) < widest and score(best) > -math.inf:
        other = max(best - step, best + step, key=score)
        if score(other) <= score(best):
            break
        best = other
    low, high = best - step, best + step
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = score(a), score(b)
    while high - low > 1e-5:
        if fa < fb:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = score(b)
        else:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = score(a)
    # Rounding hides what is left; a parabola over a wider stretch does not.
    mid, wide = (low + high) / 2, 2e-3
    left, top, right = score(mid - wide), score(mid), score(mid + wide)
    bend = left - 2 * top + right
    if math.isfinite(bend) and bend < 0:
        return mid + 0.5 * wide * (left - right) / bend
    return mid


def apply_deskew(df: DataFrame, state: dict[str, dict]) -> DataFrame:
    new = {}
    for c, how in state.items():
        if c in df.columns:
            power = how["method"] == "yeo-johnson"
            new[c] = yeo_johnson(col(c), how["lambda"]) if power else log1p_clipped(col(c))
    return df.withColumns(new) if new else df


# ---------------------------------------------------------------- bins
def fit_bins(
    df: DataFrame,
    columns: list[str],
    n_bins: int = 5,
    strategy: str = "quantile",
    encode: str = "ordinal",
    splits: dict[str, list[float]] | None = None,
) -> dict:
    """Inner bin edges per column, and the median that replaces missing values."""
    cols = [c for c in columns if c in df.columns and is_numeric(df.schema[c].dataType)]
    state = {"encode": encode, "n_bins": n_bins, "columns": {}}
    if not cols:
        return state
    medians = {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in cols}).items()}
    cols = [c for c in cols if medians[c] is not None]
    whole = df.select(
        *[F.coalesce(col(c).cast("double"), F.lit(medians[c])).alias(c) for c in cols]
    )
    if strategy == "custom":
        edges = {c: sorted(set(splits[c])) for c in cols if splits and c in splits}
    elif strategy == "quantile":
        probs = [i / n_bins for i in range(n_bins + 1)]
        edges = exact_quantiles(whole, {c: probs for c in cols})
    elif strategy in ("uniform", "kmeans"):
        edges = _uniform_edges(whole, cols, n_bins)
        if strategy == "kmeans":
            edges = _kmeans_edges(whole, edges, n_bins)
    else:
        raise ValueError("bin_numeric 'strategy': quantile, uniform, kmeans or custom")
    for c, e in edges.items():
        distinct = sorted(set(e))
        if strategy != "custom":
            if len(distinct) < 2:
                continue  # a constant column keeps its values
            distinct = distinct[1:-1]
        state["columns"][c] = {"edges": distinct, "median": medians[c]}
    return state


def _uniform_edges(df: DataFrame, cols: list[str], n_bins: int) -> dict[str, list[float]]:
    exprs = {}
    for c in cols:
        exprs |= {f"lo:{c}": F.min(col(c)), f"hi:{c}": F.max(col(c))}
    got = one_row(df, exprs)
    out = {}
    for c in cols:
        lo, hi = got[f"lo:{c}"], got[f"hi:{c}"]
        step = (hi - lo) / n_bins
        out[c] = [lo + step * i for i in range(n_bins)] + [hi]
    return out


MICRO_BINS = 2048


def _next_centres(old: list[float], clusters: list[tuple]) -> tuple[list[float], float]:
    """New centres from (count, sum, min, max) per cluster, and how far they moved.

    An empty cluster restarts at the point farthest from its own centre, which
    on a line is the end of some cluster.
    """
    stats = [[n, s] for n, s, _, _ in clusters]
    ends = sorted(
        (
            (abs(v - old[i]), v, i)
            for i, (n, _, lo, hi) in enumerate(clusters)
            if n > 1
            for v in {lo, hi}
        ),
        reverse=True,
    )
    for i, (n, _, _, _) in enumerate(clusters):
        if not n and ends:
            _, v, donor = ends.pop(0)
            stats[donor][0] -= 1
            stats[donor][1] -= v
            stats[i] = [1, v]
    new = sorted(s / n if n else c for (n, s), c in zip(stats, old))
    return new, sum((a - b) ** 2 for a, b in zip(new, old))


def _lloyd(centres: list[float], bins: list[tuple], tol: float) -> list[float]:
    """Iterations over a histogram: (mean, count) per bin, in order."""
    for _ in range(300):
        mids = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
        clusters = [[0, 0.0, math.inf, -math.inf] for _ in centres]
        for m, n in bins:
            c = clusters[bisect_right(mids, m)]
            c[:] = [c[0] + n, c[1] + m * n, min(c[2], m), max(c[3], m)]
        centres, shift = _next_centres(centres, clusters)
        if shift <= tol:
            break
    return centres


def _kmeans_edges(df: DataFrame, start: dict[str, list[float]], n_bins: int, rounds: int = 300):
    """One-dimensional k-means; edges are the midpoints between sorted centres.

    Centres start in the middle of the uniform bins. The first iterations run on
    a fine histogram of the column (one aggregate, a bounded number of bins);
    the last ones run on the table itself, all columns in one aggregate per
    round, until the centres rest.
    """
    centres = {
        c: [(a + b) / 2 for a, b in zip(e, e[1:])] for c, e in start.items() if e[0] < e[-1]
    }
    spread = one_row(df, {c: F.var_pop(col(c)) for c in centres}) if centres else {}
    if centres:
        cells = []
        for c in centres:
            lo, hi = start[c][0], start[c][-1]
            slot = F.floor((col(c) - F.lit(lo)) / F.lit((hi - lo) / MICRO_BINS)).cast("int")
            cells.append(F.struct(F.lit(c).alias("c"), slot.alias("slot"), col(c).alias("x")))
        histogram = (
            df.select(F.explode(F.array(*cells)).alias("cell"))
            .groupBy("cell.c", "cell.slot")
            .agg(F.avg("cell.x").alias("mean"), F.count("*").alias("n"))
            .collect()
        )
        for c in centres:
            bins = sorted((r["mean"], r["n"]) for r in histogram if r["c"] == c)
            centres[c] = _lloyd(centres[c], bins, 1e-4 * spread[c])
    moving = set(centres)
    for _ in range(rounds):
        if not moving:
            break
        exprs = {}
        for c in moving:
            mids = [(a + b) / 2 for a, b in zip(centres[c], centres[c][1:])]
            which = bucket_of(col(c), mids)
            for i in range(len(centres[c])):
                x = F.when(which == i, col(c))
                exprs[f"{c}|{i}"] = F.struct(F.count(x), F.sum(x), F.min(x), F.max(x))
        got = one_row(df, exprs)
        for c in list(moving):
            clusters = [tuple(got[f"{c}|{i}"]) for i in range(len(centres[c]))]
            centres[c], shift = _next_centres(centres[c], clusters)
            if shift <= 1e-4 * spread[c]:
                moving.discard(c)
    return {
        c: [e[0], *[(a + b) / 2 for a, b in zip(centres[c], centres[c][1:])], e[-1]]
        if c in centres
        else e
        for c, e in start.items()
    }


def bucket_of(c: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value: a value on an edge goes to the upper bin."""
    out = F.lit(0)
    for e in edges:
        out = out + (c >= F.lit(float(e))).cast("int")
    return out


def apply_bins(df: DataFrame, state: dict) -> DataFrame:
    cols = {c: s for c, s in state["columns"].items() if c in df.columns}
    if not cols:
        return df
    new = {}
    for c, s in cols.items():
        value = F.coalesce(col(c).cast("double"), F.lit(s["median"]))
        which = bucket_of(value, s["edges"])
        if state["encode"] == "ordinal":
            new[f"{c}__bin"] = which.cast("double")
        else:
            for i in range(len(s["edges"]) + 1):
                new[f"{c}__bin_{i}"] = (which == i).cast("double")
    return append_columns(df, new, cols)


# ---------------------------------------------------------------- scale
def fit_scale(
    df: DataFrame, columns=None, exclude=(), target: str | None = None, kind: str = "standard"
) -> dict:
    """Offset and divisor per column; a missing value counts as 0."""
    cols = columns or numeric_columns(df, [target])
    cols = [c for c in cols if c in df.columns and c not in exclude]
    if not cols:
        return {"columns": {}}
    exprs = {}
    for c in cols:
        x = F.coalesce(col(c).cast("double"), F.lit(0.0))
        if kind == "standard":
            exprs |= {f"a:{c}": F.avg(x), f"b:{c}": F.stddev_pop(x)}
        elif kind == "minmax":
            exprs |= {f"a:{c}": F.min(x), f"b:{c}": F.max(x) - F.min(x)}
        else:
            raise ValueError("scaling must be 'standard' or 'minmax'")
    got = one_row(df, exprs)
    return {
        "columns": {c: [float(got[f"a:{c}"] or 0.0), float(got[f"b:{c}"] or 0.0) or 1.0] for c in cols}
    }


def apply_scale(df: DataFrame, state: dict) -> DataFrame:
    new = {
        c: (F.coalesce(col(c).cast("double"), F.lit(0.0)) - F.lit(a)) / F.lit(b)
        for c, (a, b) in state["columns"].items()
        if c in df.columns
    }
    return df.withColumns(new) if new else df


# ---------------------------------------------------------------- feature filters
def low_variance(df: DataFrame, cols: list[str], threshold: float = 0.01) -> list[str]:
    if not cols or threshold <= 0:
        return []
    got = one_row(df, {c: F.var_samp(col(c).cast("double")) for c in cols})
    return [c for c in cols if got[c] is not None and got[c] < threshold]


def correlation_pairs(df: DataFrame, cols: list[str]) -> dict[tuple[str, str], float | None]:
    """Pairwise-complete correlations of the upper triangle, from one scan."""
    if len(cols) < 2:
        return {}
    return {(cols[r["x"]], cols[r["y"]]): r["corr"] for r in correlations(df, cols).collect()}


def correlated(df: DataFrame, cols: list[str], threshold: float = 0.95) -> list[str]:
    """The later column of every pair above the threshold (a dropped one still counts)."""
    if len(cols) < 2 or threshold >= 1.0:
        return []
    hit = {r["y"] for r in correlations(df, cols, at_least=threshold).select("y").distinct().collect()}
    return [c for i, c in enumerate(cols) if i in hit]


def select_features(
    df: DataFrame,
    drop_columns=(),
    variance_threshold: float = 0.01,
    correlation_threshold: float = 0.95,
    target: str | None = None,
) -> list[dict]:
    """Columns to drop, in order, each with the reason: explicit, variance, correlation."""
    explicit = [c for c in drop_columns if c in df.columns and c != target]
    nums = numeric_columns(df, [target, *explicit])
    flat = low_variance(df, nums, variance_threshold)
    nums = [c for c in nums if c not in flat]
    twin = correlated(df, nums, correlation_threshold)
    return (
        [{"column": c, "reason": "explicit"} for c in explicit]
        + [{"column": c, "reason": "variance"} for c in flat]
        + [{"column": c, "reason": "correlation"} for c in twin]
    )
