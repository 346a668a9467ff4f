"""Missing values: row filter, imputation, labels and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col, is_numeric, is_text
from tidyloom.operators.aggregates import digest_counts, exact_quantiles, missing_counts, one_row, top_values
from tidyloom.operators.audit import Tally, counted
from tidyloom.operators.chained import apply_chained, fit_chained
from tidyloom.operators.columns import resolve_names
from tidyloom.session import cut_lineage

CHAINED = ("impute", "mice", "iterative")


def fit_center(df: DataFrame, cols: list[str], strategy: str, empty=0.0) -> dict[str, float]:
    """Mean or exact median per numeric column; ``empty`` where nothing is observed."""
    if not cols:
        return {}
    if strategy == "mean":
        got = one_row(df, {c: F.avg(col(c).cast("double")) for c in cols})
    elif strategy == "median":
        got = {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in cols}).items()}
    else:
        raise ValueError(f"unknown numeric imputation strategy '{strategy}'")
    return {c: empty if got[c] is None else float(got[c]) for c in cols}


def fit_mode(df: DataFrame, cols: list[str], empty: str = "MISSING") -> dict[str, str]:
    """Most frequent value per column, ties to the smallest; counted by digest with map-side combine."""
    if not cols:
        return {}
    found = top_values(df, cut_lineage(digest_counts(df, cols)), cols)
    return {c: found[c][0] if c in found else empty for c in cols}


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Replace NULLs; whole-number columns become doubles when the fill is fractional."""
    new = {}
    for c, v in values.items():
        if c not in df.columns:
            continue
        dtype = df.schema[c].dataType
        if is_numeric(dtype):
            whole = float(v).is_integer()
            kind = dtype.simpleString() if whole else "double"
            new[c] = F.coalesce(col(c).cast(kind), F.lit(float(v)).cast(kind))
        else:
            new[c] = F.coalesce(col(c), F.lit(v).cast(dtype))
    return df.withColumns(new) if new else df


def drop_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(how="any", subset=columns)


def handle_missing(df: DataFrame, params: dict, audit: bool | Tally = True):
    """Drop incomplete rows, or impute numeric and categorical columns.

    ``impute.numeric`` is honoured: ``median``, ``mean`` or chained (default).
    """
    wanted = [c for c in params.get("columns") or [] if c in df.columns]
    strategy = params.get("strategy", "impute")
    diff: dict = {"imputation_values": {}}
    if not params.get("columns"):
        return df, diff, []
    if strategy == "drop_rows":
        whole = F.lit(True)
        for c in wanted:
            whole = whole & col(c).isNotNull()
        df = counted(df, {"dropped_rows": F.count_if(~whole)}, audit, diff.update)
        return drop_rows(df, wanted), diff, []
    if strategy not in (*CHAINED, "median", "mean"):
        raise ValueError(f"handle_missing: unknown strategy '{strategy}'")

    config = params.get("impute") or {}
    numeric = config.get("numeric", strategy if strategy in ("median", "mean") else "impute")
    constant = config.get("constant_value", 0)
    label = config.get("constant_categorical", "MISSING")
    total, missing = missing_counts(df, wanted)
    gaps = [c for c in wanted if missing[c]]
    nums = [c for c in gaps if is_numeric(df.schema[c].dataType)]
    cats = [c for c in gaps if c not in nums]
    empty = {c for c in gaps if missing[c] == total}

    blank = {c: constant for c in nums if c in empty}
    df = fill(df, blank)
    values: dict = dict(blank)
    todo = [c for c in nums if c not in empty]
    if todo and numeric in ("median", "mean"):
        centers = fit_center(df, todo, numeric)
        df = fill(df, centers)
        values |= centers
    elif todo:
        block = [*todo, *blank]
        df = apply_chained(df, fit_chained(df, block), closed_form=True)
        values |= {c: "chained" for c in todo}
    if cats:
        if config.get("categorical", "most_frequent") == "most_frequent":
            modes = fit_mode(df, cats, label)
        else:
            modes = {c: label for c in cats}
        df = fill(df, modes)
        values |= modes
    diff["imputation_values"] = values
    return df, diff, []


# ---------------------------------------------------------------- fitted forms
def fit_imputer(
    df: DataFrame,
    cols: list[str] | None,
    strategy: str = "impute",
    categorical: str = "preserve_missing",
    target: str | None = None,
) -> dict:
    if not cols:
        total, missing = missing_counts(df)
        cols = [c for c in df.columns if missing[c] and c != target]
    cols = [c for c in cols if c in df.columns and c != target]
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    cats = [c for c in cols if c not in nums]
    if strategy not in (*CHAINED, "median", "mean"):
        raise ValueError(f"handle_missing: strategy '{strategy}' cannot be fitted")
    state: dict = {"values": {}, "chained": None, "categorical": {}}
    if nums and strategy in ("median", "mean"):
        state["values"] = fit_center(df, nums, strategy)
    elif nums:
        total, missing = missing_counts(df, nums)
        state["values"] = {c: 0.0 for c in nums if missing[c] == total}
        block = [c for c in nums if missing[c] < total]
        if block:
            state["chained"] = fit_chained(df, block)
    if cats and categorical == "fill_mode":
        state["categorical"] = fit_mode(df, cats)
    return state


def apply_imputer(df: DataFrame, state: dict) -> DataFrame:
    df = fill(df, {**state["values"], **state["categorical"]})
    return apply_chained(df, state["chained"]) if state["chained"] else df


def fit_semantic_fill(
    df: DataFrame,
    fill_value: str = "None",
    column_fills: dict | None = None,
    min_na_rate: float = 0.0,
    target: str | None = None,
) -> dict[str, str]:
    """Text columns whose gaps mean something, with the label that says so."""
    texts = [f.name for f in df.schema if is_text(f.dataType) and f.name != target]
    named = resolve_names(df.columns, column_fills or {})
    fills = {named[k]: v for k, v in (column_fills or {}).items() if k in named}
    total, missing = missing_counts(df, texts) if texts else (0, {})
    out = {}
    for c in texts:
        if c in fills:
            out[c] = fills[c]
        elif missing[c] and missing[c] / total >= min_na_rate:
            out[c] = fill_value
    return out


def fit_indicators(
    df: DataFrame,
    min_na_rate: float = 0.01,
    max_indicators: int = 20,
    columns=None,
    exclude=(),
    target: str | None = None,
) -> list[str]:
    """Columns that get a ``<c>_was_missing`` flag, in column order."""
    if columns:
        named = resolve_names(df.columns, columns)
        picked = [named[c] for c in columns if c in named and named[c] not in exclude]
    else:
        total, missing = missing_counts(df)
        picked = [
            c
            for c in df.columns
            if c != target and c not in exclude and missing[c] and missing[c] / total >= min_na_rate
        ]
    return picked[:max_indicators]


def apply_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    have = set(df.columns)
    flags = {
        f"{c}_was_missing": col(c).isNull().cast("int") if c in have else F.lit(0)
        for c in columns
    }
    return df.withColumns(flags) if flags else df


# ---------------------------------------------------------------- model preparation
MISSING_TOKEN = "__missing__"


def fit_safety(df: DataFrame) -> dict:
    """Last step before a model: text -> codes, everything numeric and complete."""
    from tidyloom.operators.encode import fit_encoding

    texts = [f.name for f in df.schema if is_text(f.dataType)]
    codes = fit_encoding(df, {c: "ordinal" for c in texts}, MISSING_TOKEN) if texts else None
    nums = [c for c in df.columns if c not in texts]
    numbers = df.select(*[col(c).cast("double").alias(c) for c in nums]) if nums else df
    total, missing = missing_counts(numbers, nums) if nums else (0, {})
    gaps = [c for c in nums if missing[c]]
    return {
        "columns": list(df.columns),
        "texts": texts,
        "codes": codes,
        "medians": fit_center(numbers, gaps, "median"),
    }


def apply_safety(df: DataFrame, state: dict) -> DataFrame:
    from tidyloom.operators.encode import with_codes

    new = {}
    if state["codes"]:
        for e in state["codes"]["columns"]:
            c = e["column"]
            codes = e["categories"] if e["categories"] is not None else state["codes"]["frames"][c]
            df = with_codes(df, c, codes, f"__code_{c}", MISSING_TOKEN)
            new[c] = F.coalesce(col(f"__code_{c}"), F.lit(-1)).cast("double")
    for c in state["columns"]:
        if c not in new and c in df.columns:
            base = col(c).try_cast("double") if is_text(df.schema[c].dataType) else col(c).cast("double")
            new[c] = F.coalesce(base, F.lit(state["medians"].get(c, 0.0)), F.lit(0.0))
    return df.select(*[new.get(c, F.lit(0.0)).alias(c) for c in state["columns"]])
