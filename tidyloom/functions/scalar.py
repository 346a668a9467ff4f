"""Scalar and statistical column expressions that are safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """Back-ticked column reference, so names may hold dots and blanks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType) and f.name not in exclude]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark's aggregates treat NaN as a value, so missing is always NULL here."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats})


def clip(c: Column, low: float, high: float) -> Column:
    """Clip and keep NULL (``least``/``greatest`` alone would skip it)."""
    bounded = F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))
    return F.when(c.isNotNull(), bounded)


def log1p_clipped(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c.cast("double"), F.lit(0.0))))


def yeo_johnson(c: Column, lam) -> Column:
    """Yeo-Johnson power transform (Yeo and Johnson, 2000)."""
    lam = float(lam)
    x = c.cast("double")
    up = F.greatest(x, F.lit(0.0)) + 1.0
    down = 1.0 - F.least(x, F.lit(0.0))
    pos = F.log(up) if abs(lam) < 1e-12 else (F.pow(up, F.lit(lam)) - 1.0) / lam
    rest = 2.0 - lam
    neg = -F.log(down) if abs(rest) < 1e-12 else -(F.pow(down, F.lit(rest)) - 1.0) / rest
    return F.when(x >= 0, pos).when(x < 0, neg)


def guarded_corr(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson correlation; NULL (no error) on a constant column."""
    x, y = a.cast("double"), b.cast("double")
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_pop(F.when(both, x))
    sy = F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), sx * sy)


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness (Spark's ``skewness`` is the population form)."""
    x = c.cast("double")
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.try_divide(F.sqrt(n * (n - 1.0)), n - 2.0))


def relabel(c: Column, mapping: dict) -> Column:
    """Dictionary relabelling; values without an entry keep their text form."""
    text = c.cast("string")
    out = None
    for key, value in mapping.items():
        hit = text == F.lit(str(key))
        out = F.when(hit, F.lit(str(value))) if out is None else out.when(hit, F.lit(str(value)))
    return text if out is None else out.otherwise(text)
