"""Duplicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.scalar import col, is_text
from tidyloom.operators.aggregates import one_row
from tidyloom.operators.audit import Tally, columns_of, counted, settings


def _keys(df: DataFrame, subset, case_insensitive: bool):
    keys = list(subset or df.columns)
    if not (case_insensitive and subset):
        return [col(c) for c in keys]
    return [F.lower(col(c)) if is_text(df.schema[c].dataType) else col(c) for c in keys]


def _tie_break(df: DataFrame, skip) -> list[str]:
    plain = (T.MapType, T.VariantType)
    return [f.name for f in df.schema if not isinstance(f.dataType, plain) and f.name not in skip]


def keep_one(df: DataFrame, keys: list, order_by: list[str], keep: str = "first") -> DataFrame:
    """First or last row per key by ``order_by``; the other columns settle ties.

    Planned as ``row_number() = 1``, which Spark evaluates with a per-group
    limit before the shuffle: a hot key sends one row per task.
    """
    order = [*order_by, *_tie_break(df, order_by)]
    sort = [col(c).asc_nulls_first() if keep == "first" else col(c).desc_nulls_last() for c in order]
    w = Window.partitionBy(*keys).orderBy(*sort)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def keep_unique(df: DataFrame, keys: list) -> DataFrame:
    """Rows whose key occurs once: aggregated map-side, no row buffering per key."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[col(c) for c in df.columns]).alias("__row")
    return (
        df.select(*named, row)
        .groupBy(*[f"__k{i}" for i in range(len(keys))])
        .agg(F.count("*").alias("__n"), F.first("__row").alias("__row"))
        .where("__n = 1")
        .select("__row.*")
    )


def deduplicate(df: DataFrame, params: dict | None = None, audit: bool | Tally = True):
    """Remove duplicates on all columns or a subset.

    ``keep`` = first / last / none. Rows have no order of their own, so keeping
    the first or last row of a *subset* needs ``order_by``. NULL keys are equal.
    """
    params = params or {}
    keep = settings("deduplicate", params, keep=("first", ("first", "last", "none")))["keep"]
    subset, fold = params.get("subset"), bool(params.get("case_insensitive", False))
    if subset is not None:
        columns_of("deduplicate", df, {"columns": subset})
    if subset is not None and keep != "none" and not params.get("order_by"):
        raise ValueError("deduplicate: first and last on a subset need order_by")

    record = {"subset": subset, "keep": keep, "case_insensitive": fold}
    notes: list[str] = []
    plain = df

    def tell_before(found: dict) -> None:
        record["rows_before"] = found["rows"]

    def tell_after(found: dict) -> None:
        record["rows_after"] = found["rows"]
        record["rows_removed"] = record["rows_before"] - found["rows"]
        if not record["rows_removed"]:
            notes.append("every row is the only one of its key")
        elif subset:
            some = duplicate_keys(plain, subset, fold).limit(3)
            record["duplicate_key_examples"] = [r.asDict() for r in some.collect()]

    if audit and not isinstance(audit, Tally):
        got = _sizes(df, _keys(df, subset, fold))
        tell_before({"rows": got["rows"] or 0})
        tell_after({"rows": got["single"] if keep == "none" else got["groups"]})
        audit = False
    rows = {"rows": F.count(F.lit(1))}
    df = counted(df, rows, audit, tell_before)
    keys = _keys(df, subset, fold)
    if keep == "none":
        out = keep_unique(df, keys)
    elif subset is None:
        out = df.dropDuplicates()
    else:
        out = keep_one(df, keys, list(params["order_by"]), keep)
    return counted(out, rows, audit, tell_after), record, notes


def _sizes(df: DataFrame, keys: list) -> dict:
    """Rows, distinct keys and keys that occur once, in one job."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    sizes = df.select(*named).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.count("*").alias("__n"))
    return one_row(
        sizes, {"rows": F.sum("__n"), "groups": F.count("*"), "single": F.count_if(F.col("__n") == 1)}
    )


def duplicate_keys(df: DataFrame, subset: list[str], case_insensitive: bool = False) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    keys = [k.alias(c) for k, c in zip(_keys(df, subset, case_insensitive), subset)]
    return (
        df.select(*keys).groupBy(*[col(c) for c in subset]).agg(F.count("*").alias("n_rows"))
        .where("n_rows > 1")
    )


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, as a one-row frame; only digests of rows are shuffled."""
    cells = [col(c) for c in df.columns]
    gaps = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells]) if cells else F.lit("")
    # Rows are told apart by 128 bits; hashes pass over NULLs, so these are hashed too.
    marks = F.xxhash64(gaps, *cells), F.xxhash64(F.lit(1), gaps, *cells)
    sizes = df.select(marks[0].alias("h1"), marks[1].alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("__n"))
    return sizes.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def latest_wins(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row per key, the one ingested last."""
    return keep_one(df, [col(k) for k in keys], [sequence], keep="last")
