"""Shards of near equal bytes by k-d tree partitioning.

Rows are points in a few metadata dimensions. A node is split along its widest
dimension at the weighted median, which is found by narrowing histograms that
Spark aggregates over all rows; the driver sees a bounded number of bins. A
point's place is its coordinate followed by the checksum of its text, so rows of
equal text stay together as long as they fit into one leaf; a larger group is
split by a seeded order of its rows.

Only DataFrame functions are used. NULL or NaN coordinates count as the lowest
value, NULL weights as 0, an empty table gives no rows. Columns of the input pass
through; those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import col, seeded, values
from tidyloom.session import cut_lineage

GRID = 2**30
TIE = 2**31
BINS = 32_768
RANK_ROWS = 1024


@dataclass
class Node:
    """A node of the tree: the leaves below it, its bytes and how it is split."""

    first: int
    leaves: int
    weight: int = 0
    dim: int = -1
    key: int = 0
    salt: int = 0


def weighted_cut(
    rows: DataFrame, place: Column, goals: dict[int, float], heavy: float, above: dict[int, int]
) -> dict[int, tuple[int, int, float]]:
    """Per node: the place where the running weight crosses its goal.

    Returns ``{node: (place, weight at that place, weight before it)}``. ``above``
    restricts a node to one ``__key`` (for splitting a heavy group). Each round is
    one aggregate over all open nodes; a round divides the interval by the number
    of bins or more, and ends when a bin holds a single place.
    """
    spark = rows.sparkSession
    base = rows.select("__node", place.alias("__place"), "__key", "__weight")
    ends = (
        base.join(values(spark, ["__node", "__only"], [(n, above.get(n, -1)) for n in goals]), "__node")
        .where((F.col("__only") < 0) | (F.col("__only") == F.col("__key")))
    )
    span = {
        r["__node"]: (r["lo"], r["hi"])
        for r in ends.groupBy("__node").agg(F.min("__place").alias("lo"), F.max("__place").alias("hi")).collect()
    }
    before = dict.fromkeys(goals, 0.0)
    done: dict[int, tuple[int, int, float]] = {}
    while span:
        bins = max(16, BINS // len(span))
        params = [(n, lo, hi, (hi - lo) // bins + 1) for n, (lo, hi) in span.items()]
        found = (
            ends.join(values(spark, ["__node", "__lo", "__hi", "__width"], params), "__node")
            .where(F.col("__place").between(F.col("__lo"), F.col("__hi")))
            .groupBy("__node", F.expr("(__place - __lo) div __width").alias("__bin"))
            .agg(
                F.sum("__weight").alias("w"),
                F.min("__place").alias("lo"),
                F.max("__place").alias("hi"),
            )
            .collect()
        )
        per: dict[int, list] = {}
        for r in found:
            per.setdefault(r["__node"], []).append((r["__bin"], r["w"], r["lo"], r["hi"]))
        span = {}
        for n, cells in per.items():
            cells.sort()
            for i, (_, w, lo, hi) in enumerate(cells):
                if before[n] + w >= goals[n] or i + 1 == len(cells):
                    if lo == hi:
                        done[n] = (lo, w, before[n])
                    else:
                        span[n] = (lo, hi)
                    break
                before[n] += w
    return done


def kd_shards(
    df: DataFrame,
    dims: dict[str, Column],
    weight: Column,
    tie: Column,
    id_col: str = "doc_id",
    leaves: int | None = None,
    target_bytes: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """Add ``shard`` (0 .. leaves - 1, left to right in the tree) and ``slot``.

    Give ``leaves`` or ``target_bytes``. A node with k leaves passes k // 2 of them
    to its left child and the same share of its weight. ``slot`` counts the rows
    of a shard from 0 in a seeded order.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    low = F.lit(float("-inf"))
    points = cut_lineage(
        df.select(
            *[col(c) for c in kept],
            *[F.coalesce(F.nanvl(c.cast("double"), low), low).alias(f"__x{i}") for i, c in enumerate(dims.values())],
            F.coalesce(weight.cast("bigint"), F.lit(0)).alias("__weight"),
            F.pmod(F.coalesce(tie.cast("bigint"), F.lit(-1)), F.lit(TIE)).alias("__tie"),
            seeded(col(id_col), seed).alias("__salt"),
        )
    )
    n = len(dims)
    finite = [F.when(F.col(f"__x{i}") != low, F.col(f"__x{i}")) for i in range(n)]
    whole = points.agg(
        F.count("*").alias("n"), F.sum("__weight").alias("w"),
        *[f(c).alias(f"{k}{i}") for i, c in enumerate(finite) for k, f in (("a", F.min), ("b", F.max))],
    ).first()
    if not leaves:
        leaves = max(1, -(-(whole["w"] or 0) // target_bytes))
    fair = (whole["w"] or 0) / leaves
    grid = {}
    for i, c in enumerate(finite):
        a, b = whole[f"a{i}"], whole[f"b{i}"]
        wide = a is not None and b > a
        scaled = F.floor((c - F.lit(a)) / F.lit(b - a) * F.lit(GRID - 1)) if wide else F.lit(0)
        grid[f"__x{i}"] = F.coalesce(scaled, F.lit(0)).cast("bigint")
    placed = points.withColumns(grid).withColumn("__node", F.lit(0).cast("bigint"))
    nodes = {0: Node(0, leaves, whole["w"] or 0)}
    while True:
        open_ = {k: v for k, v in nodes.items() if v.leaves > 1}
        if not open_ or not whole["n"]:
            break
        ranges = {
            r["__node"]: r
            for r in placed.groupBy("__node").agg(
                F.sum("__weight").alias("w"),
                *[f(f"__x{i}").alias(f"{k}{i}") for i in range(n) for k, f in (("a", F.min), ("b", F.max))],
            ).collect()
        }
        for k, node in open_.items():
            r = ranges.get(k)
            node.weight = r["w"] if r else 0
            node.dim = max(range(n), key=lambda i: (r[f"b{i}"] - r[f"a{i}"], -i)) if r else 0
        rows = placed.join(values(spark, ["__node", "__dim"], [(k, v.dim) for k, v in open_.items()]), "__node")
        rows = rows.withColumn("__key", place_key(n))
        goals = {k: v.weight * (v.leaves // 2) / v.leaves for k, v in open_.items() if k in ranges}
        cuts = weighted_cut(rows, F.col("__key"), goals, fair, {})
        again = {k: key for k, (key, w, _) in cuts.items() if w > fair}
        salts = weighted_cut(
            rows, F.col("__salt"), {k: goals[k] - cuts[k][2] for k in again}, fair, again
        ) if again else {}
        params, grown = [], {k: v for k, v in nodes.items() if v.leaves == 1}
        for k, node in open_.items():
            key, w, before = cuts.get(k, (0, 0, 0.0))
            if k in salts:
                node.key, node.salt = key, salts[k][0] + 1
            else:  # all of the group goes to the side that comes nearer to its goal
                over = before + w - goals.get(k, 0) <= goals.get(k, 0) - before
                node.key, node.salt = (key + 1 if over else key), 0
            half = node.leaves // 2
            left, right = 2 * k + 1, 2 * k + 2
            grown[left] = Node(node.first, half)
            grown[right] = Node(node.first + half, node.leaves - half)
            params.append((k, node.dim, node.key, node.salt))
        split = values(spark, ["__node", "__dim", "__cut", "__cutsalt"], params)
        key = place_key(n)
        goes_left = (key < F.col("__cut")) | ((key == F.col("__cut")) & (F.col("__salt") < F.col("__cutsalt")))
        moved = F.when(F.col("__cut").isNull(), F.col("__node")).otherwise(
            F.when(goes_left, F.col("__node") * 2 + 1).otherwise(F.col("__node") * 2 + 2)
        )
        placed = placed.join(split, "__node", "left").withColumn("__node", moved).select(*placed.columns)
        nodes = grown
    names = values(spark, ["__node", "__shard"], [(k, v.first) for k, v in nodes.items()])
    done = placed.join(names, "__node").select(
        *[col(c) for c in kept], F.col("__shard").cast("int").alias("shard"), "__salt"
    )
    return slotted(done, whole["n"], leaves, id_col, kept)


def place_key(n: int) -> Column:
    """Coordinate along the node's dimension, then the checksum of the text."""
    x = F.lit(0).cast("bigint")
    for i in range(n):
        x = F.when(F.col("__dim") == i, F.col(f"__x{i}")).otherwise(x)
    return x * F.lit(TIE) + F.col("__tie")


def slotted(done: DataFrame, n: int, leaves: int, id_col: str, kept: list[str]) -> DataFrame:
    """Number the rows of each shard from 0 without sorting a shard in one task."""
    buckets = max(8, n // max(1, leaves) // RANK_ROWS)
    placed = done.withColumn("__b", F.floor(F.col("__salt") * F.lit(buckets) / F.lit(TIE)).cast("bigint"))
    counts = placed.groupBy("shard", "__b").agg(F.count("*").alias("__rows"))
    earlier = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("__shift", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    local = Window.partitionBy("shard", "__b").orderBy("__salt", col(id_col))
    ranked = placed.withColumn("__r", F.row_number().over(local) - 1)
    return ranked.join(shifts.drop("__rows"), ["shard", "__b"]).select(
        *[col(c) for c in kept], "shard", (F.col("__shift") + F.col("__r")).cast("bigint").alias("slot")
    )
