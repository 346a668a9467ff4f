"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.session import ensure_checkpoint_dir

LEHMER = 2147483647


def col(name: str) -> Column:
    """A column by its exact name, also with dots or blanks inside."""
    return F.col(f"`{name.replace('`', '``')}`")


def seeded(key: Column, seed: int) -> Column:
    """Seeded pseudo-random order in [0, 2^31 - 1); a NULL key counts as -1.

    Plain integer arithmetic, so that other engines can repeat it.
    """
    m = F.lit(LEHMER).cast("bigint")
    k = F.pmod(F.coalesce(key.cast("bigint"), F.lit(-1)), m)
    return F.pmod(F.pmod((k + F.lit(seed + 1)) * F.lit(48271), m) * F.lit(69621), m)


def seeded_sql(key: str, seed: int) -> str:
    """The same order as DuckDB SQL."""
    k = f"((coalesce({key}, -1) % {LEHMER} + {LEHMER}) % {LEHMER})"
    return f"((({k} + {seed + 1}) * 48271 % {LEHMER}) * 69621 % {LEHMER})"


def values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small local relation of integers (fitted parameters, one row per node)."""
    body = ", ".join("(" + ", ".join(f"{int(v)}L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again.

    Later reads need neither the executors that made it nor its inputs.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack(values: np.ndarray) -> bytes:
    """An array of numbers as compressed bytes (all first bytes, then all second ones, ...)."""
    values = np.ascontiguousarray(values)
    raw = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    """The array that ``pack`` was given."""
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
