"""Approximate largest inner products by stable projections and a k-d tree.

A vector x gets one more component, sqrt(M² - |x|²) for the largest norm M, and a
query a zero, so that the largest inner product is the smallest distance. All are
projected on ``dims`` Gaussian (2-stable) directions. For a point at distance d
the squared projected distance over d² is chi-square distributed, so points are
taken in the order of their projected distance and verified on the whole
vectors, until the next projected distance is beyond the chi-square quantile
``confidence`` at the k-th distance found: a nearer point would by then have been
met with that probability.

The top of the k-d tree is fitted on a bounded sample (``sample_rows``) of
projections; its cells then hold every row, in blocks of at most ``block_rows``
rows, and each block is a tree of its own. A query first searches its home cell;
the k-th distance found there tells which other cells pass the test. Queries that
reach a cell are dealt in chunks of at most about ``chunk_rows``, each of which
meets the cell's blocks in tasks of its own. Of rows with the same vector only the
k + 1 smallest ids can be in an answer, and equal queries are searched once.

Vectors that are NULL, zero, of another length than most, or that hold NULL or
non-finite components take no part. Repeated ids are rows like others: a query
leaves out one row with its id and vector, itself, and rows that ask with the same
id and vector get the same answers each. A NULL id is no query unless
``is_query`` says so; as an answer it counts as the smallest. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import col, seeded, values
from tidyloom.session import cut_lineage

LEAF = 64
#: Stands for a NULL id inside.
NO_ID = -(2**63)


def chi_square(p: float, dims: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty's form)."""
    z = NormalDist().inv_cdf(p)
    a = 2 / (9 * dims)
    return dims * (1 - a + z * a**0.5) ** 3


class Tree:
    """A k-d tree over projections: splits, and the box of each leaf."""

    def __init__(self, points: np.ndarray, leaves: int):
        d = points.shape[1]
        self.dim, self.cut, self.child, self.boxes = [], [], [], []
        self.rows: list[np.ndarray] = []
        self._grow(points, np.arange(len(points)), leaves, np.full(d, -np.inf), np.full(d, np.inf))
        self.low = np.array([b[0] for b in self.boxes])
        self.high = np.array([b[1] for b in self.boxes])

    def _grow(self, points, rows, leaves, low, high) -> int:
        """Index of a node, or -1 - leaf."""
        if leaves > 1 and len(rows):
            part = points[rows]
            dim = int((part.max(0) - part.min(0)).argmax())
            cut = float(np.quantile(part[:, dim], (leaves // 2) / leaves, method="lower"))
            left = part[:, dim] <= cut
            if left.all() and part[:, dim].min() < cut:
                cut = float(part[part[:, dim] < cut, dim].max())
                left = part[:, dim] <= cut
            if not left.all():
                at = len(self.dim)
                self.dim.append(dim)
                self.cut.append(cut)
                self.child.append((0, 0))
                upper, lower = high.copy(), low.copy()
                upper[dim] = lower[dim] = cut
                a = self._grow(points, rows[left], leaves // 2, low, upper)
                b = self._grow(points, rows[~left], leaves - leaves // 2, lower, high)
                self.child[at] = (a, b)
                return at
        self.boxes.append((low, high))
        self.rows.append(rows)
        return -len(self.boxes)

    def find(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        if not self.dim:
            return np.zeros(len(points), np.int64)
        dim, cut, child = np.array(self.dim), np.array(self.cut), np.array(self.child)
        at = np.zeros(len(points), np.int64)
        while (at >= 0).any():
            live = np.flatnonzero(at >= 0)
            node = at[live]
            right = points[live, dim[node]] > cut[node]
            at[live] = child[node, right.astype(int)]
        return -1 - at

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """Squared distance from each point to each leaf's box."""
        out = np.empty((len(points), len(self.low)))
        for i, p in enumerate(points):
            gap = np.maximum(np.maximum(self.low - p, p - self.high), 0)
            out[i] = np.einsum("ij,ij->i", gap, gap)
        return out


def directions(dim: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, dims))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as doubles, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def project(x: np.ndarray, norm: float, axes: np.ndarray, query: bool) -> np.ndarray:
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(norm - np.einsum("ij,ij->i", x, x), 0))
    return x @ axes[:-1] + rest[:, None] * axes[-1]


def search_block(base: pa.Table, asked: pa.Table, k: int, norm: float, axes: np.ndarray, limit: float) -> pa.Table:
    """The k best rows of a block for each query that may be better than its bound."""
    x, ids, marks = matrix(base.column("vec")), base.column("id").to_numpy(), base.column("mark").to_numpy()
    q = matrix(asked.column("vec"))
    bound = asked.column("bound").to_numpy()
    inner = project(x, norm, axes, False)
    tree = Tree(inner, max(1, len(x) // LEAF))
    gaps = tree.nearest(project(q, norm, axes, True))
    far = np.einsum("ij,ij->i", q, q) + norm
    key, found, score, mark = [], [], [], []
    for i in range(len(q)):
        order = np.argsort(gaps[i], kind="stable")
        best_row, best = np.empty(0, np.int64), np.empty(0)
        worst, at, step = bound[i], 0, 4
        while at < len(order):
            # The distance of the k-th so far; the projected order goes on from here.
            if np.isfinite(worst) and gaps[i, order[at]] > limit * max(far[i] - 2 * worst, 0.0):
                break
            rows = np.concatenate([tree.rows[j] for j in order[at : at + step]])
            s = np.einsum("ij,j->i", x[rows], q[i])
            keep = s >= worst
            best_row, best = np.append(best_row, rows[keep]), np.append(best, s[keep])
            if len(best) > k:
                top = np.lexsort((ids[best_row], -best))[:k]
                best_row, best = best_row[top], best[top]
            if len(best) == k:
                worst = max(worst, best.min())
            at, step = at + step, step * 2
        key += [i] * len(best)
        found.append(ids[best_row])
        mark.append(marks[best_row])
        score.append(best)
    rows = pa.array(key, pa.int64())
    return pa.table({
        "h1": asked.column("h1").take(rows), "h2": asked.column("h2").take(rows),
        "id": pa.array(np.concatenate(found) if found else [], pa.int64()),
        "mark": pa.array(np.concatenate(mark) if mark else [], pa.int64()),
        "score": pa.array(np.concatenate(score) if score else [], pa.float64()),
    })


def usable(vec: Column) -> Column:
    """Neither NULL nor zero, and all components finite."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda v: v != 0)


def nearest_inner(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    dims: int = 8,
    confidence: float = 0.95,
    cell_rows: int = 4096,
    block_rows: int = 8192,
    chunk_rows: int = 2048,
    sample_rows: int = 20_000,
    seed: int = 3,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best found for each query row."""
    spark = df.sparkSession
    vectors = df.select(
        F.coalesce(col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), col(vec_col).alias("vec"), is_query.alias("asks")
    ).where(F.coalesce(usable(col("vec")), F.lit(False)))
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    lengths = vectors.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("m"))
    shape = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if shape is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, norm, n = shape["d"], shape["m"], shape["n"]
    axes, limit = directions(dim, dims, seed), chi_square(confidence, dims)
    vectors = vectors.where(F.size("vec") == dim)
    keyed = vectors.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})

    # Equal vectors tie, so only their smallest ids can be among the k and the query.
    same = Window.partitionBy("h1", "h2").orderBy("id")
    base = keyed.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    base = base.select("id", "vec", F.col("h1").alias("mark"))

    drawn = base.where(seeded(F.col("id"), seed) < int(2147483647 * min(1.0, sample_rows / n)))
    sample = drawn.select("vec").limit(2 * sample_rows).toArrow()
    points = project(matrix(sample.column("vec")), norm, axes, False) if len(sample) else np.zeros((0, dims))
    tree = Tree(points, min(max(1, n // cell_rows), max(1, len(points) // 4)))

    def locate(batches):
        for b in batches:
            if b.num_rows:
                cell = tree.find(project(matrix(b.column(1)), norm, axes, False))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["id", "vec", "mark", "cell"])

    kind = dict(base.dtypes)["vec"]
    placed = cut_lineage(base.mapInArrow(locate, f"id bigint, vec {kind}, mark bigint, cell bigint"))
    counts = placed.groupBy("cell").count().collect()
    parts = {r["cell"]: -(-r["count"] // block_rows) for r in counts}
    blocks = values(spark, ["cell", "parts"], sorted(parts.items()))
    in_blocks = placed.join(blocks, "cell").select(
        "cell", F.pmod(F.xxhash64("id", "mark"), F.col("parts")).alias("part"), "id", "mark", "vec"
    )
    queries = keyed.where("asks").groupBy("h1", "h2").agg(F.first("vec").alias("vec"))

    def visit(home: bool):
        """Cells to search: the home cell, or all others that pass the test."""

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                q = matrix(b.column(2))
                p = project(q, norm, axes, True)
                at = tree.find(p)
                gaps = tree.nearest(p)
                # An empty home cell is replaced by the nearest one with rows.
                filled = np.isin(np.arange(gaps.shape[1]), list(parts))
                nearest = np.where(filled, gaps, np.inf).argmin(1)
                at = np.where(filled[at], at, nearest)
                if home:
                    row, cell = np.arange(len(q)), at
                else:
                    bound = b.column(3).to_numpy()
                    reach = limit * np.maximum(np.einsum("ij,ij->i", q, q) + norm - 2 * bound, 0)
                    go = (gaps <= np.where(np.isfinite(bound), reach, np.inf)[:, None]) & filled
                    go[np.arange(len(q)), at] = False
                    row, cell = np.nonzero(go)
                taken = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int64))], [*b.schema.names, "cell"])

        return run

    def search(asked: DataFrame) -> DataFrame:
        asked = cut_lineage(asked)
        chunks = values(spark, ["cell", "chunks"], sorted(
            (r["cell"], -(-r["count"] // chunk_rows)) for r in asked.groupBy("cell").count().collect()
        ) or [(-1, 1)])

        def all_of(count: str) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

        routed = asked.join(blocks, "cell").join(chunks, "cell").select(
            "cell", all_of("parts").alias("part"), F.pmod(F.xxhash64("h1", "h2"), F.col("chunks")).alias("chunk"),
            "h1", "h2", "vec", "bound",
        )
        met = in_blocks.join(chunks, "cell").select("cell", "part", all_of("chunks").alias("chunk"), "id", "mark", "vec")
        keys = ("cell", "part", "chunk")
        return met.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(
            lambda left, right: search_block(left, right, k + 1, norm, axes, limit)
            if len(left) and len(right) else EMPTY, "h1 bigint, h2 bigint, id bigint, mark bigint, score double",
        )

    schema = f"h1 bigint, h2 bigint, vec {kind}, bound double"
    start = queries.withColumn("bound", F.lit(float("-inf")))
    first = cut_lineage(best(search(start.mapInArrow(visit(True), schema + ", cell bigint")), ["h1", "h2"], k + 1))
    kth = first.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    known = F.when(F.col("n") > k, F.col("low")).otherwise(float("-inf"))
    bounded = queries.join(kth, ["h1", "h2"], "left").select(
        "h1", "h2", "vec", F.coalesce(known, F.lit(float("-inf"))).alias("bound")
    )
    others = search(bounded.mapInArrow(visit(False), schema + ", cell bigint"))
    top = best(first.unionByName(others), ["h1", "h2"], k + 1)
    asked = keyed.where("asks").groupBy(F.col("id").alias("query_id"), "h1", "h2").agg(F.count("*").alias("times"))
    row = ("query_id", "h1", "h2")
    # Of the rows that equal the query one is the query itself.
    own = (F.col("query_id") == F.col("id")) & (F.col("h1") == F.col("mark"))
    copies = F.row_number().over(Window.partitionBy(*row, "own").orderBy("id"))
    answers = asked.join(top, ["h1", "h2"]).withColumn("own", own).withColumn("copy", copies)
    answers = answers.where(~F.col("own") | (F.col("copy") > 1))
    rank = F.row_number().over(Window.partitionBy(*row).orderBy(F.desc("score"), "id"))
    ranked = answers.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))
    told = F.nullif(F.col("query_id"), F.lit(NO_ID)), "rank", F.nullif(F.col("id"), F.lit(NO_ID)), "score", each
    return ranked.select(*told).toDF("query_id", "rank", "vec_id", "score", "_").drop("_")


EMPTY = pa.table({
    "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()),
    "id": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), "score": pa.array([], pa.float64()),
})


def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
