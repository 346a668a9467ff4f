"""Delimited, JSON and Parquet sources and sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col, nan_to_null, text_columns
from tidyloom.operators.aggregates import one_row
from tidyloom.operators.columns import drop_leakage, relabel_values
from tidyloom.operators.sampling import plain_cap, stratified_cap

# Cells read as missing unless the caller names others.
NA_TOKENS = ["NA", "N/A", "null", "NULL", ""]
SEPARATORS = [",", ";", "\t", "|"]
NULL_MARKER = "\\N"


def detect_separator(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The candidate that occurs equally often, and most often, in the first lines."""
    sample = spark.read.text(path).limit(lines).where(F.length("value") > 0)
    exprs = {}
    for s in SEPARATORS:
        n = F.length("value") - F.length(F.replace(F.col("value"), F.lit(s), F.lit("")))
        exprs |= {f"lo{s}": F.min(n), f"hi{s}": F.max(n)}
    got = one_row(sample, exprs)
    steady = [s for s in SEPARATORS if got[f"lo{s}"] and got[f"lo{s}"] == got[f"hi{s}"]]
    usable = steady or [s for s in SEPARATORS if got[f"lo{s}"]]
    return max(usable, key=lambda s: got[f"lo{s}"]) if usable else ","


def nullify_tokens(df: DataFrame, tokens=None) -> DataFrame:
    """Cells equal to a missing-value marker become NULL (blanks around it ignored)."""
    wanted = NA_TOKENS if tokens is None else list(tokens)
    texts = text_columns(df)
    return df.withColumns({c: F.when(~F.trim(col(c)).isin(wanted), col(c)) for c in texts})


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest type all their values fit; one aggregate decides."""
    texts = text_columns(df)
    if not texts:
        return df
    exprs = {}
    for c in texts:
        v = F.trim(col(c))
        exprs |= {
            f"n:{c}": F.count(v),
            f"i:{c}": F.count(F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("bigint"))),
            f"f:{c}": F.count(v.try_cast("double")),
            f"b:{c}": F.count(F.when(F.lower(v).isin("true", "false"), v)),
        }
    got = one_row(df, exprs)
    new = {}
    for c in texts:
        n = got[f"n:{c}"]
        for kind, dtype in (("i", "bigint"), ("f", "double"), ("b", "boolean")):
            if n and got[f"{kind}:{c}"] == n:
                new[c] = F.trim(col(c)).cast(dtype)
                break
    return df.withColumns(new) if new else df


def read_csv(
    spark: SparkSession,
    path,
    sep: str | None = None,
    encoding: str = "UTF-8",
    na_values=None,
    schema=None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header. Several missing-value markers; types given or inferred.

    With a schema the file is read once; without, one extra pass infers types.
    ``multi_line`` is for values that hold line breaks; a file is then one task.
    Blanks around a value belong to it.
    """
    if sep is None:
        sep = detect_separator(spark, path)
    reader = (
        spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
        .option("multiLine", multi_line).option("escape", '"').option("nullValue", NULL_MARKER)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )
    raw = nullify_tokens(reader.csv(path), na_values)
    if schema is None:
        return nan_to_null(infer_types(raw))
    fields = {f.name: f.dataType for f in schema}
    return nan_to_null(
        raw.select(*[col(c).try_cast(fields[c].simpleString()).alias(c) for c in raw.columns if c in fields])
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """Quotes inside values are doubled, blanks kept, NULL written as ``NULL_MARKER``.

    So NULL and an empty text stay apart; ``read_csv`` reads the marker as NULL
    whatever other markers are asked for.
    """
    writer = (
        df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
        .option("nullValue", NULL_MARKER).option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )
    writer.csv(path)


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def preview(df: DataFrame, rows: int = 500, order_by=()) -> DataFrame:
    """The first rows; with ``order_by`` they are always the same ones."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def load_raw(
    df: DataFrame,
    target: str,
    task: str,
    key: str,
    leakage=(),
    cap: int | None = None,
    label_map: dict | None = None,
) -> DataFrame:
    """Drop leaking columns, require the target, cap rows (stratified), relabel the target."""
    df = drop_leakage(df, leakage)
    if target not in df.columns:
        raise ValueError(f"Target '{target}' is not in the table")
    if cap is not None:
        df = stratified_cap(df, target, key, cap) if task == "classification" else plain_cap(df, key, cap)
    return relabel_values(df, target, label_map) if label_map is not None else df


def scan_results(
    spark: SparkSession, path, prefix: str = "results_", skip=("cv5",), name: Column | None = None
) -> DataFrame:
    """All result files under a glob, with the run tag taken from the file name.

    ``name`` replaces the file name where the tag stands elsewhere in the path.
    The file order is the ingestion order (``seq``), as later files win.
    """
    source = F.col("_metadata.file_name") if name is None else name
    tag = F.regexp_replace(F.regexp_replace(source, r"\.csv.*$", ""), f"^{prefix}", "")
    row = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    df = df.withColumn("tag", tag).withColumn("seq", F.concat_ws("/", "tag", row))
    return df.where(~F.col("tag").isin(list(skip)))


def table_digest(df: DataFrame) -> str:
    """A digest of the columns and rows of a table, in whatever order the rows come (one scan)."""
    cells = [col(c) for c in df.columns]
    gaps = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells]) if cells else F.lit("")
    sums = [F.sum(F.xxhash64(F.lit(k), gaps, *cells).cast("decimal(38,0)")) for k in (1, 2)]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return hashlib.sha256(repr((kinds, *map(str, row))).encode()).hexdigest()[:32]


def cached_table(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], refresh: bool = False, source: DataFrame | None = None
) -> DataFrame:
    """Read the Parquet table at ``path``, computing and writing it first where needed.

    With ``source``, the table that the result is made from, each content of it has a
    result of its own under ``path``: new rows are never answered by an old result.
    """
    if source is not None:
        path = f"{path}/input-{table_digest(source)}"
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
