"""Column names, selection, casts and row predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.scalar import col, is_numeric, is_text, relabel
from tidyloom.operators.aggregates import missing_counts, one_row
from tidyloom.operators.audit import Tally, columns_of, counted, settings


# ---------------------------------------------------------------- names
def standard_name(name: str) -> str:
    return re.sub("[ -]", "_", name.strip().lower())


def resolve_names(columns: list[str], names) -> dict[str, str]:
    """Map plan spellings to real columns: exact match first, then by standard name."""
    by_standard = {standard_name(c): c for c in columns}
    exact = set(columns)
    out = {}
    for n in names:
        real = n if n in exact else by_standard.get(standard_name(n))
        if real is not None:
            out[n] = real
    return out


def fix_column_names(df: DataFrame, params: dict | None = None, audit: bool | Tally = True):
    """Lower-case, trimmed names with ``_`` for blanks and dashes; collisions are an error."""
    names = [standard_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"fix_column_names: names collide after normalisation: {clash}")
    return df.toDF(*names), {"columns_renamed": dict(zip(df.columns, names))}, []


# ---------------------------------------------------------------- drop / align
def drop_column(df: DataFrame, params: dict, audit: bool | Tally = True):
    """Remove columns; the target only with ``allow_drop_target``, unknown ones by ``on_missing``."""
    names = columns_of("drop_column", df, params, present=False)
    absent = settings("drop_column", params, on_missing=("raise", ("raise", "skip")))["on_missing"]
    here = set(df.columns)
    gone, unknown = [c for c in names if c in here], [c for c in names if c not in here]
    target = params.get("target_column") or None
    notes = []
    if target in names:
        if not params.get("allow_drop_target"):
            raise ValueError(f"drop_column: {target} is the target and stays")
        notes += [f"the target {target} is dropped as asked"] * (target in gone)
    if unknown:
        if absent == "raise":
            raise ValueError(f"drop_column: the table has no {', '.join(unknown)}")
        notes.append(f"not in the table: {', '.join(unknown)}")
    out = df.drop(*map(col, gone))
    record = dict(zip(("requested", "dropped", "missing"), (names, gone, unknown)))
    record |= {"reason": params.get("reason"), "cols_before": len(df.columns), "cols_after": len(out.columns)}
    return out, record, notes


def drop_leakage(df: DataFrame, leakage) -> DataFrame:
    return df.drop(*[c for c in leakage if c in df.columns])


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """The fitted columns in the fitted order: absent ones are 0, others are dropped."""
    have = set(df.columns)
    return df.select([col(c) if c in have else F.lit(0).alias(c) for c in columns])


def relabel_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    return df.withColumn(column, relabel(col(column), mapping))


def append_columns(df: DataFrame, new: dict[str, Column], replaced=()) -> DataFrame:
    """Put new columns at the end and drop the ones they replace; no join involved."""
    gone = set(replaced)
    kept = [col(c) for c in df.columns if c not in gone]
    return df.select(*kept, *[e.alias(n) for n, e in new.items()])


# ---------------------------------------------------------------- casts
_TYPES = {
    "int": "bigint",
    "float": "double",
    "bool": "boolean",
    "string": "string",
    "datetime": "timestamp_ntz",
}
# Spellings accepted as booleans.
_TRUE = ("true", "1", "1.0")
_FALSE = ("false", "0", "0.0")
# Strftime directives and their Spark pattern letters.
_STRFTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
    "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%I": "hh",
    "%f": "SSSSSS",
}


def spark_datetime_pattern(fmt: str) -> str:
    """A strftime pattern as Spark's; patterns without ``%`` are taken as they are."""
    if "%" not in fmt:
        return fmt
    out = ""
    for part in re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", fmt):
        if part in _STRFTIME:
            out += _STRFTIME[part]
        elif part[0].isalpha():
            out += f"'{part}'"
        else:
            out += part
    return out


def coerced(df: DataFrame, name: str, dtype: str, fmt: str | None = None) -> Column:
    """The cast of one column with NULL for every value that cannot be cast."""
    source = df.schema[name].dataType
    c = col(name)
    if dtype == "string":
        return c.cast("string")
    if dtype == "float":
        return c.try_cast("double")
    if dtype == "int":
        if isinstance(source, T.IntegralType):
            return c.cast("bigint")
        number = c.try_cast("double")
        exact = c.try_cast("bigint")
        return F.coalesce(exact if is_text(source) else F.lit(None).cast("bigint"),
                          F.when(number == F.floor(number), number.try_cast("bigint")))
    if dtype == "bool":
        if isinstance(source, T.BooleanType):
            return c
        text = F.lower(c.cast("string"))
        return F.when(text.isin(*_TRUE), True).when(text.isin(*_FALSE), False)
    if isinstance(source, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    text = c.cast("string")
    if fmt:
        parsed = F.try_to_timestamp(text, F.lit(spark_datetime_pattern(fmt)))
        return parsed.cast("timestamp_ntz")
    return text.try_cast("timestamp_ntz")


def cast_type(df: DataFrame, params: dict, audit: bool | Tally = True):
    """Cast columns; ``errors`` is ``raise``, ``coerce`` (NULL) or ``ignore`` (leave the column)."""
    chosen = settings(
        "cast_type", params, dtype=(tuple(_TYPES),), errors=("raise", ("raise", "coerce", "ignore")),
    )
    names, dtype, errors = columns_of("cast_type", df, params), chosen["dtype"], chosen["errors"]
    casts = {c: coerced(df, c, dtype, params.get("datetime_format")) for c in names}
    losses = {c: F.count_if(col(c).isNotNull() & e.isNull()) for c, e in casts.items()}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    record: dict = {"before_dtypes": {c: kinds[c] for c in names}, "invalid_values_coerced": {}}
    notes: list[str] = []

    def tell(found: dict) -> None:
        record["invalid_values_coerced"] = {c: n for c, n in found.items() if n}
        notes.extend(f"{c}: {n} values are no {dtype} and became NULL" for c, n in found.items() if n)

    if errors == "coerce":
        df = counted(df, losses, audit, tell)
    else:
        lost = {c: n for c, n in one_row(df, losses).items() if n}
        if lost and errors == "raise":
            raise RuntimeError(f"cast_type: values that are no {dtype}: {lost}")
        casts = {c: e for c, e in casts.items() if c not in lost}
        notes += [f"{c} stays as it is: {n} values are no {dtype}" for c, n in lost.items()]
    out = df.withColumns(casts) if casts else df
    record["columns_casted"] = list(casts)
    record["after_dtypes"] = {c: out.schema[c].dataType.simpleString() for c in names}
    return out, record, notes


# ---------------------------------------------------------------- choosing columns
ENCODE_DISTINCT_LIMIT = 20


def known_columns(df: DataFrame, wanted) -> tuple[list[str], list[str]]:
    """(columns that exist, columns that do not); the token ``all`` means no restriction."""
    wanted = list(wanted or [])
    if any(str(c).lower() == "all" for c in wanted):
        return [], [c for c in wanted if str(c).lower() != "all" and c not in df.columns]
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


def choose_columns(action: str, df: DataFrame, target: str | None = None) -> list[str]:
    """Columns an action works on when the plan names none."""
    if action == "normalize_text":
        return text_like(df)
    if action == "handle_missing":
        total, missing = missing_counts(df)
        return [c for c in df.columns if missing[c] > 0]
    if action in ("remove_outliers", "clip_outliers"):
        return [f.name for f in df.schema if is_numeric(f.dataType) and f.name != target]
    if action == "encode_categorical":
        texts = [c for c in text_like(df) if c != target]
        if not texts:
            return []
        return [c for c, n in distinct_up_to(df, texts).items() if n <= ENCODE_DISTINCT_LIMIT]
    return []


def text_like(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def distinct_up_to(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Exact distinct non-NULL counts of text columns."""
    from tidyloom.operators.aggregates import value_counts

    rows = (
        value_counts(df, cols)
        .where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    return {c: 0 for c in cols} | {r["column"]: r["n"] for r in rows}


# ---------------------------------------------------------------- predicates over a profile
def problem_columns(profile: DataFrame) -> DataFrame:
    """Columns that look like identifiers or have missing values."""
    is_id = F.lower("name").rlike("id|nbr")
    return profile.where(is_id | (F.col("missing_ratio") > 0)).select(
        "name", "missing_ratio", is_id.alias("is_id_candidate")
    )


def droppable_columns(profile: DataFrame, max_missing: float = 0.40) -> DataFrame:
    """Columns the planning rule says to drop: identifiers, or too much missing."""
    is_id = F.lower("name").rlike("id|nbr")
    return profile.where(is_id | (F.col("missing_ratio") > max_missing)).select(
        "name", "missing_ratio", F.when(is_id, "id_like").otherwise("high_missing").alias("reason")
    )
