"""Ranks and running totals that do not sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col
from tidyloom.session import cut_lineage

BUCKETS = 16384


def hash_order(key: Column, seed: int) -> Column:
    """Seeded pseudo-random order in [0, 2^31 - 1), plain integer arithmetic.

    A Lehmer step over the key. It is written without Spark's own hash so that
    the same order can be computed by any other engine.
    """
    m = F.lit(2147483647).cast("bigint")
    k = F.pmod(key.cast("bigint"), m)
    return F.pmod(F.pmod((k + F.lit(seed + 1)) * F.lit(48271), m) * F.lit(69621), m)


def hash_bucket(h: Column, buckets: int = BUCKETS) -> Column:
    """Order-preserving bucket of a ``hash_order`` value."""
    return F.floor(h / F.lit(2147483647 // buckets + 1)).cast("int")


def bucketed_rank(
    df: DataFrame,
    by: list[str],
    bucket: str,
    order: list,
    out: str,
    total: str | None = None,
) -> DataFrame:
    """``row_number() over (partition by <by> order by <order>)`` in two levels.

    ``bucket`` must be monotone in ``order``. Rows are numbered inside
    ``(by, bucket)`` and shifted by the number of rows in the earlier buckets
    of their group, so a group holding a third of the table is spread over all
    its buckets. ``by`` columns must not be NULL.
    """
    keys = [*by, bucket]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    extra = {"__shift": F.coalesce(F.sum("__size").over(before), F.lit(0))}
    if total:
        extra[total] = F.sum("__size").over(group)
    shifts = sizes.withColumns(extra).drop("__size")
    local = Window.partitionBy(*keys).orderBy(*order)
    rank = F.col("__shift") + F.row_number().over(local)
    kept = [col(c) for c in df.columns] + ([F.col(total)] if total else [])
    return df.join(shifts, keys).select(*kept, rank.alias(out))


def smallest(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The ``k`` first rows per group.

    Spark plans ``row_number() <= k`` with a limit per group before the
    shuffle, so a hot group sends at most ``k`` rows per task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def global_row_number(df: DataFrame, order: list, out: str) -> DataFrame:
    """0-based position in the global order, without one task seeing all rows.

    The frame is range-partitioned and checkpointed, which fixes its layout;
    positions are counted per partition and shifted by the earlier partitions.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    )
    numbered = bucketed_rank(placed, [], "__part", order, out)
    return numbered.withColumn(out, F.col(out) - 1).drop("__part")


def running_counts(df: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """Add ``<s>_before``: the sum of ``s`` over rows of the group with a smaller value.

    ``df`` must be pre-aggregated to one row per ``(by, value)``. The rows are
    range-partitioned, so slices come in the number that the data ask for, and
    the running window never covers more than one slice.
    """
    spread = df.repartitionByRange(*by, value).withColumn("__b", F.spark_partition_id())
    placed = cut_lineage(spread)
    slices = placed.groupBy(*by, "__b").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        *by,
        "__b",
        *[F.coalesce(F.sum(f"__t_{s}").over(earlier), F.lit(0)).alias(f"__t_{s}") for s in sums],
    )
    local = (
        Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = placed.join(slices, [*by, "__b"])
    added = {
        f"{s}_before": F.col(f"__t_{s}") + F.coalesce(F.sum(s).over(local), F.lit(0)) for s in sums
    }
    return joined.withColumns(added).drop("__b", *[f"__t_{s}" for s in sums])
