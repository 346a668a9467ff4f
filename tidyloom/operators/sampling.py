"""Deterministic sampling, folds and injected gaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.scalar import col
from tidyloom.operators.aggregates import exact_quantiles, missing_counts, one_row
from tidyloom.operators.chained import fit_one_gap
from tidyloom.operators.ranking import bucketed_rank, hash_bucket, hash_order
from tidyloom.session import cut_lineage

SEED = 369
FOLDS = 5


def _placed(df: DataFrame, key: str, seed: int) -> DataFrame:
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    h = hash_order(col(key) if whole else F.xxhash64(col(key)), seed)
    return df.withColumn("__h", h).withColumn("__hb", hash_bucket(F.col("__h")))


def _ranked(df: DataFrame, by: list[str], key: str, seed: int, total: str | None = None):
    placed = _placed(df, key, seed)
    return bucketed_rank(placed, by, "__hb", ["__h", col(key)], "__rank", total).drop("__h", "__hb")


def stratified_cap(df: DataFrame, target: str, key: str, cap: int, seed: int = SEED) -> DataFrame:
    """At most about ``cap`` rows: max(1, round(n_class * cap / n)) of each class.

    Rows without a class are left out, whether or not the cap applies. The quota
    needs the exact rank in a seeded order; a large class is ranked bucket by
    bucket.
    """
    n = df.count()
    classed = df.where(col(target).isNotNull())
    if n <= cap:
        return classed
    ranked = _ranked(classed, [target], key, seed, total="__class")
    quota = F.greatest(F.lit(1), F.bround(F.col("__class") * F.lit(cap) / F.lit(n)))
    return ranked.where(F.col("__rank") <= quota).drop("__rank", "__class")


def plain_cap(df: DataFrame, key: str, cap: int, seed: int = SEED) -> DataFrame:
    if df.count() <= cap:
        return df
    return _ranked(df, [], key, seed).where(F.col("__rank") <= cap).drop("__rank")


def assign_folds(
    df: DataFrame, key: str, target: str | None = None, k: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """``fold`` in 0..k-1, shuffled; with ``target`` every class is spread evenly."""
    by = []
    if target is not None:
        df = df.withColumn("__y", F.coalesce(col(target).cast("string"), F.lit("nan")))
        by = ["__y"]
    ranked = _ranked(df, by, key, seed)
    fold = F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")
    return ranked.withColumn("fold", fold).drop("__rank", "__y")


def complete_numeric(df: DataFrame, columns: list[str], k: int = 3) -> list[str]:
    """The first ``k`` numeric columns without a gap."""
    total, missing = missing_counts(df, columns)
    return [c for c in columns if missing[c] == 0][:k]


def inject_missing(
    df: DataFrame, column: str, key: str, rate: float, seed: int = SEED
) -> DataFrame:
    """Blank exactly int(n * rate) values of one column; ``__injected`` marks them."""
    k = int(df.count() * rate)
    ranked = _ranked(df, [], key, seed)
    hit = F.col("__rank") <= k
    return ranked.withColumns(
        {"__injected": hit, "__truth": col(column), column: F.when(~hit, col(column))}
    ).drop("__rank")


def imputation_error(recovered: DataFrame, column: str) -> float | None:
    """Mean absolute error over the injected cells that have a recovered value."""
    err = F.abs(col(column) - F.col("__truth"))
    return one_row(recovered, {"mae": F.avg(F.when(F.col("__injected"), err))})["mae"]


def imputation_error_by_key(
    truth: DataFrame, recovered: DataFrame, key: str, column: str, injected: DataFrame
) -> DataFrame:
    """The same for a table cleaned elsewhere: truth and recovery joined on the row key."""
    joined = (
        injected.select(key)
        .join(truth.select(key, col(column).alias("__truth")), key)
        .join(recovered.select(key, col(column).alias("__value")), key)
    )
    err = F.abs(F.col("__value") - F.col("__truth"))
    return joined.agg(F.avg(err).alias("mae"), F.count(err).alias("n_cells"))


# ---------------------------------------------------------------- errors at all rates
def nested_bands(df: DataFrame, key: str, rates: list[float], seed: int = SEED) -> DataFrame:
    """Add ``band``: 0 for rows blanked at the lowest rate, up to their number for rows never blanked.

    The ranks that ``inject_missing`` goes by are the same at every rate, so one
    ranking marks the rows of all rates.
    """
    limits = [int(df.count() * r) for r in sorted(rates)]
    ranked = _ranked(df, [], key, seed)
    band = F.lit(len(limits))
    for i in reversed(range(len(limits))):
        band = F.when(F.col("__rank") <= limits[i], i).otherwise(band)
    return cut_lineage(ranked.withColumn("band", band).drop("__rank"))


def imputation_errors(
    df: DataFrame, columns: list[str], key: str, rates: list[float], method: str = "mean", seed: int = SEED
) -> DataFrame:
    """``column, missing_rate, n_injected, mae`` for each column blanked alone at each rate.

    ``method`` is ``mean``, ``median`` or ``chained`` (from the other columns, which
    have to be complete). One ranking, one pass for what every fit needs, and one for
    the errors, however many columns and rates.
    """
    if method not in ("mean", "median", "chained"):
        raise ValueError("imputation_errors: method may be mean, median or chained")
    spark, levels = df.sparkSession, sorted(rates)
    rows = nested_bands(df.select(col(key), *[col(c).cast("double").alias(c) for c in columns]), key, levels, seed)
    cases = [(c, i) for c in columns for i in range(len(levels))]
    x = {c: col(c) for c in columns}
    fills: dict[tuple[str, int], Column] = {}
    if method == "chained":
        fills = _chained_fills(rows, columns, len(levels))
    else:
        left = rows.select(*[F.when(F.col("band") > i, x[c]).alias(f"{i}:{c}") for c, i in cases])
        if method == "mean":
            found = one_row(left, {n: F.avg(col(n)) for n in left.columns})
        else:
            found = {n: v[0] for n, v in exact_quantiles(left, {n: [0.5] for n in left.columns}).items()}
        fills = {(c, i): F.lit(found[f"{i}:{c}"]).cast("double") for c, i in cases}
    errors = {}
    for c, i in cases:
        hit = (F.col("band") <= i) & x[c].isNotNull()
        errors[c, i, "n"] = F.count_if(F.col("band") <= i)
        errors[c, i, "mae"] = F.avg(F.when(hit, F.abs(fills[c, i] - x[c])))
    got = one_row(rows, errors)
    out = [(c, r, got[c, levels.index(r), "n"], got[c, levels.index(r), "mae"]) for c in columns for r in rates]
    return spark.createDataFrame(out, "column string, missing_rate double, n_injected bigint, mae double")


def _chained_fills(rows: DataFrame, columns: list[str], levels: int) -> dict[tuple[str, int], Column]:
    """The imputed value of each column at each rate, as an affine expression of the others."""
    center = one_row(rows, {c: F.avg(col(c)) for c in columns})
    z = [F.lit(1.0), *[col(c) - F.lit(float(center[c] or 0.0)) for c in columns]]
    cells = [(a, b) for a in range(len(z)) for b in range(a, len(z))]
    sums = [F.sum(z[a] * z[b]).alias(f"m{k}") for k, (a, b) in enumerate(cells)]
    sizes = [F.max(F.abs(col(c))).alias(f"s{k}") for k, c in enumerate(columns)]
    grams, largest = np.zeros((levels + 1, len(z), len(z))), np.zeros((levels + 1, len(columns)))
    for r in rows.groupBy("band").agg(*sums, *sizes).collect():
        for k, (a, b) in enumerate(cells):
            grams[r["band"], a, b] = grams[r["band"], b, a] = r[f"m{k}"] or 0.0
        largest[r["band"]] = [r[f"s{k}"] or 0.0 for k in range(len(columns))]
    origin = np.array([center[c] or 0.0 for c in columns], float)
    fills = {}
    for gap, c in enumerate(columns):
        for i in range(levels):
            blank, seen = grams[: i + 1].sum(0), grams[i + 1 :].sum(0)
            size = largest.max(0)
            size[gap] = largest[i + 1 :, gap].max(initial=0.0)
            state = fit_one_gap(columns, gap, seen, blank, origin, size)
            pattern = "".join("1" if k == gap else "0" for k in range(len(columns)))
            row = (state["maps"] or {}).get(pattern)
            if row is None:
                fills[c, i] = F.lit(float(state["means"][gap]))
                continue
            value = F.lit(float(row[gap + 1][0] + state["means"][gap]))
            for k, other in enumerate(columns):
                if k != gap:
                    value = value + F.lit(float(row[gap + 1][k + 1])) * (col(other) - F.lit(float(state["means"][k])))
            fills[c, i] = value
    return fills
