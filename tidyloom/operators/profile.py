"""Column profiles, table overview and before/after comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.scalar import col, is_numeric, is_text, text_columns
from tidyloom.operators.aggregates import (
    digest_counts,
    exact_quantiles,
    missing_counts,
    one_row,
    smallest_values,
    top_values,
    value_figures,
)
from tidyloom.operators.dedup import duplicate_row_count
from tidyloom.operators.numeric import outlier_cells
from tidyloom.session import cut_lineage

_SIMPLE = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def profiled_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _SIMPLE)]


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """``column, n_unique``: exact through one pre-aggregated shuffle of digests, or a sketch."""
    if approx:
        got = one_row(df, {c: F.approx_count_distinct(col(c)) for c in cols})
        return df.sparkSession.createDataFrame(list(got.items()), "column string, n_unique bigint")
    return value_figures(digest_counts(df, cols)).select("column", "n_unique")


def profile_columns(df: DataFrame, max_examples: int = 5, approx: bool = False) -> DataFrame:
    """One row per column: type, missing, distinct, samples, flags and numeric summary.

    Counts and moments of all columns come from one aggregate. Distinct counts
    and the (smallest) sample values share one shuffle of pre-aggregated digests.
    """
    spark = df.sparkSession
    cols = profiled_columns(df)
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    exprs = {"*": F.count(F.lit(1))} | {f"n:{c}": F.count(col(c)) for c in cols}
    for c in nums:
        x = col(c).cast("double")
        exprs |= {f"lo:{c}": F.min(x), f"hi:{c}": F.max(x), f"avg:{c}": F.round(F.avg(x), 6)}
    got = one_row(df, exprs)
    if approx:
        half = one_row(df, {c: F.percentile_approx(col(c).cast("double"), 0.5) for c in nums})
        medians = half
    else:
        medians = {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in nums}).items()}

    total = got["*"]
    rows = []
    for i, c in enumerate(cols):
        missing = total - got[f"n:{c}"]
        dtype = df.schema[c].dataType
        num = c in nums
        rows.append(
            (
                i,
                c,
                dtype.simpleString(),
                missing,
                round(missing / total, 6) if total else 0.0,
                num,
                is_text(dtype),
                got.get(f"lo:{c}"),
                got.get(f"hi:{c}"),
                got.get(f"avg:{c}"),
                None if medians.get(c) is None else round(medians[c], 6),
            )
        )
    summary = spark.createDataFrame(
        rows,
        "position int, name string, dtype string, missing_count bigint, missing_ratio double, "
        "is_numeric boolean, is_text boolean, min double, max double, mean double, median double",
    )
    digests = cut_lineage(digest_counts(df, cols))
    distinct = distinct_counts(df, cols, approx=True) if approx else value_figures(digests).select("column", "n_unique")
    found = list(smallest_values(df, digests, cols, max_examples).items())
    samples = spark.createDataFrame(found, "column string, sample_values array<string>")
    facts = distinct.join(samples, "column", "left").withColumnRenamed("column", "name")
    n_unique = F.coalesce("n_unique", F.lit(0))
    return (
        summary.join(facts, "name", "left")
        .withColumns(
            {
                "n_unique": n_unique,
                "sample_values": F.coalesce("sample_values", F.array().cast("array<string>")),
                "is_constant": n_unique <= 1,
            }
        )
        .select(
            "position", "name", "dtype", "missing_count", "missing_ratio", "n_unique",
            "sample_values", "is_numeric", "is_text", "is_constant", "min", "max", "mean", "median",
        )
    )


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """Class counts of the target; a missing value counts as a class of its own."""
    value = F.coalesce(col(target).cast("string"), F.lit("nan"))
    return df.groupBy(value.alias("class")).agg(
        F.count("*").alias("n"), F.max(col(target).isNull()).alias("is_missing")
    )


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and share, duplicate rows, text columns - one row."""
    total, missing = missing_counts(df)
    cells = total * len(df.columns)
    gaps = sum(missing.values())
    return duplicate_row_count(df).select(
        F.lit(total).cast("bigint").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(gaps).cast("bigint").alias("missing_cells"),
        F.lit(100.0 * gaps / cells if cells else 0.0).alias("missing_pct"),
        "duplicate_rows",
        F.lit(len(text_columns(df))).alias("text_columns"),
    )


def describe(df: DataFrame) -> DataFrame:
    """``describe(include="all")``: one row per column."""
    spark = df.sparkSession
    cols = profiled_columns(df)
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    exprs = {f"n:{c}": F.count(col(c)) for c in cols}
    for c in nums:
        x = col(c).cast("double")
        exprs |= {
            f"avg:{c}": F.avg(x),
            f"sd:{c}": F.stddev_samp(x),
            f"lo:{c}": F.min(x),
            f"hi:{c}": F.max(x),
        }
    got = one_row(df, exprs)
    quart = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in nums})
    rows = [
        (i, c, got[f"n:{c}"], *[got.get(f"{s}:{c}") for s in ("avg", "sd", "lo")],
         *quart.get(c, [None] * 3), got.get(f"hi:{c}"))
        for i, c in enumerate(cols)
    ]
    numbers = spark.createDataFrame(
        rows,
        "position int, name string, count bigint, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double",
    )
    others = [c for c in cols if c not in nums]
    if not others:
        null = F.lit(None)
        return numbers.withColumns(
            {"unique": null.cast("bigint"), "top": null.cast("string"), "freq": null.cast("bigint")}
        )
    digests = cut_lineage(digest_counts(df, others))
    best = [(c, *v) for c, v in top_values(df, digests, others).items()]
    top = spark.createDataFrame(best, "name string, top string, freq bigint")
    unique = value_figures(digests).select(F.col("column").alias("name"), F.col("n_unique").alias("unique"))
    return numbers.join(unique.join(top, "name", "left"), "name", "left")


def cardinality(df: DataFrame) -> DataFrame:
    """``column, n_unique`` of every text column (0 when all its values are missing)."""
    texts = text_columns(df)
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in texts], "column string")
    if not texts:
        return names.withColumn("n_unique", F.lit(0).cast("bigint"))
    return names.join(distinct_counts(df, texts), "column", "left").select(
        "column", F.coalesce("n_unique", F.lit(0)).alias("n_unique")
    )


# ---------------------------------------------------------------- before / after
def schema_diff(before: DataFrame, after: DataFrame) -> dict:
    """Row delta and columns added or removed."""
    n0, n1 = before.count(), after.count()
    return {
        "rows_before": n0,
        "rows_after": n1,
        "row_delta": n1 - n0,
        "columns_added": [c for c in after.columns if c not in before.columns],
        "columns_removed": [c for c in before.columns if c not in after.columns],
    }


def _key_digests(rows: DataFrame, n_cols: int, side: str) -> DataFrame:
    """``h1, h2`` of the key, how many rows it has, and sums of the rows' digests."""
    cells = [F.col(f"{side}{i}") for i in range(n_cols)]
    gaps = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    row = [F.xxhash64(F.lit(k), "__k", gaps, *cells) for k in (2, 3)]
    wide = [r.cast("decimal(38,0)") for r in row]
    return rows.select("h1", "h2", wide[0].alias("r1"), wide[1].alias("r2")).groupBy("h1", "h2").agg(
        F.count("*").alias(f"{side}_n"), F.sum("r1").alias(f"{side}_r1"), F.sum("r2").alias(f"{side}_r2")
    )


def cell_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per common column: rows of the same key whose text differs.

    Both sides are compared by 128-bit digests of their keys and rows; only rows
    whose key differs, or has several rows, are joined. Equal tables move digests only.
    """
    shared = [c for c in before.columns if c in set(after.columns) and c != key]
    spark = before.sparkSession
    if not shared:
        return spark.createDataFrame([], "column string, changed_cells bigint")
    marks = [F.xxhash64("__k").alias("h1"), F.xxhash64(F.lit(1), "__k").alias("h2")]

    def side(df: DataFrame, name: str) -> DataFrame:
        cells = [col(c).cast("string").alias(f"{name}{i}") for i, c in enumerate(shared)]
        return df.select(col(key).alias("__k"), *cells).where("__k IS NOT NULL").select("*", *marks)

    a, b = side(before, "a"), side(after, "b")
    both = _key_digests(a, len(shared), "a").join(_key_digests(b, len(shared), "b"), ["h1", "h2"])
    same = (F.col("a_n") == 1) & (F.col("b_n") == 1) & (F.col("a_r1") == F.col("b_r1")) & (F.col("a_r2") == F.col("b_r2"))
    suspects = cut_lineage(both.where(~same).select("h1", "h2"))
    if suspects.isEmpty():
        return spark.createDataFrame([(c, 0) for c in shared], "column string, changed_cells bigint")
    some = [x.join(suspects, ["h1", "h2"], "left_semi").drop("h1", "h2") for x in (a, b)]
    changed = [F.count_if(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).alias(f"d{i}") for i in range(len(shared))]
    totals = some[0].join(some[1], "__k").agg(*changed)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("changed_cells")) for i, c in enumerate(shared)]
    return totals.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def quality_delta(pairs: dict[str, tuple[DataFrame, DataFrame]], spark) -> DataFrame:
    """Per dataset: missing cells and outliers before and after, fill rate, columns changed."""
    rows = []
    for name, (before, after) in pairs.items():
        shared = [c for c in before.columns if c in set(after.columns)]
        m0 = sum(missing_counts(before)[1].values())
        m1 = sum(missing_counts(after, shared)[1].values()) if shared else 0
        o0 = outlier_cells(before)
        o1 = outlier_cells(after.select(*[col(c) for c in shared]))
        rows.append(
            (
                name, m0, m1, m0 - m1, (m0 - m1) / max(m0, 1) * 100.0, o0, o1, o0 - o1,
                len([c for c in after.columns if c not in before.columns]),
                len([c for c in before.columns if c not in after.columns]),
            )
        )
    return spark.createDataFrame(
        rows,
        "dataset string, missing_before bigint, missing_after bigint, missing_filled bigint, "
        "missing_fill_rate double, outliers_before bigint, outliers_after bigint, "
        "outlier_reduction bigint, cols_added int, cols_removed int",
    )
