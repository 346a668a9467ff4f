"""Exact k-nearest-neighbour join.

Train rows are placed in the cells of a k-d tree fitted on a bounded sample.
Every query first searches its own cell; the k-th distance found there bounds
the answer, and only cells whose bounding box (or ball) comes that near are
visited after that. Cells are split into blocks of bounded size and the queries
of a cell into chunks, so neither a dense cell nor a vector repeated over a
third of the table lands in one task, and a block returns k rows per query,
never its pairs.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.scalar import col
from tidyloom.operators.aggregates import one_row
from tidyloom.operators.ranking import hash_order, smallest
from tidyloom.session import cut_lineage

BLOCK_ROWS = 8192
CHUNK_ROWS = 16384
MAX_CELLS = 2048
# Rows the tree is fitted on, and numbers they hold at most.
SAMPLE_ROWS = 16384
SAMPLE_NUMBERS = 2_000_000
# Numbers a worker holds at once while it compares rows with boxes, and rows it sends at once.
SLAB_NUMBERS = 1_000_000
SENT_ROWS = 4096
MOSTLY_DISTINCT = 0.9
# Joins of patterns that one column's gaps may take; with more, all pairs are compared.
PATTERN_JOINS = 16
# Rows of a cell into which a task cuts its block.
LEAF_ROWS = 256
_SLAB = 256
_SLACK = 1e-9


def features_to_vector(columns: list[str]):
    return F.array(*[col(c).cast("double") for c in columns])


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=float) if len(series) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.clip(sq, 0, None))


def _pick(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest, ties by id."""
    return np.lexsort((ids, dist))[:k]


def _top_euclidean(q: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int):
    """Per query row: positions and distances of its k nearest rows of the block, of many rows at once.

    A fast form of the squared distance shortlists a few rows; their distances
    are then taken exactly. Rows that might be missing from the shortlist (many
    near-equal distances) are searched in full.
    """
    norm_t = (t * t).sum(1)
    wide = min(len(t), 4 * k + 8)
    for start in range(0, len(q), _SLAB):
        part = q[start : start + _SLAB]
        norm_q = (part * part).sum(1)
        sq = norm_q[:, None] + norm_t[None, :] - 2 * part @ t.T
        margin = _SLACK * (norm_q + norm_t.max(initial=0.0) + 1.0)
        short = np.argpartition(sq, wide - 1, axis=1)[:, :wide]
        exact = ((t[short] - part[:, None, :]) ** 2).sum(2)
        order = np.lexsort((ids[short], exact), axis=1)[:, :k]
        rows = np.arange(len(part))[:, None]
        best, dist = short[rows, order], exact[rows, order]
        last = np.take_along_axis(sq, short, 1).max(1)
        sure = (wide == len(t)) | (dist[:, -1] + margin < last - margin)
        yield start + np.repeat(np.flatnonzero(sure), best.shape[1]), best[sure].ravel(), np.sqrt(dist[sure]).ravel()
        for i in np.flatnonzero(~sure):
            near = np.flatnonzero(sq[i] <= dist[i, -1] + margin[i])
            d = ((t[near] - part[i]) ** 2).sum(1)
            pick = _pick(d, ids[near], k)
            yield start + i, near[pick], np.sqrt(d[pick])


def _gathered(found):
    """What a search yields for one query or many as arrays sorted by query: query, position, distance."""
    rows, places, dists = [], [], []
    for i, pos, d in found:
        rows.append(np.broadcast_to(i, len(pos)))
        places.append(pos)
        dists.append(d)
    if not rows:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(places)[order], np.concatenate(dists)[order]


def _first_of(row: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their row; entries of a row lie together."""
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=int)
    size = np.diff(np.append(start, len(row)))
    return np.arange(len(row)) - np.repeat(start, size) < k


def _refined(q: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int, far: np.ndarray):
    """As ``_top_euclidean``, but rows farther than ``far`` may be left out; as arrays query, position, distance.

    A large block is cut into small cells, and a query is compared with those that
    its bound does not rule out. Where that rules out little, all pairs are compared.
    """
    tree = Cells(t, len(t) // LEAF_ROWS) if len(t) >= 4 * LEAF_ROWS and len(q) >= LEAF_ROWS else None
    if tree is None or len(tree.cell) < 2:
        return _gathered(_top_euclidean(q, t, ids, k))
    home, n_cells = tree.place(t), len(tree.cell)
    members = np.split(np.argsort(home, kind="stable"), np.cumsum(np.bincount(home, minlength=n_cells))[:-1])
    lo, hi = np.array([t[m].min(0) for m in members]), np.array([t[m].max(0) for m in members])
    radius = np.array([np.sqrt(((t[m] - tree.centre[c]) ** 2).sum(1)).max() for c, m in enumerate(members)])
    reach, found = far.astype(float), []

    def search(rows: np.ndarray, cell: int) -> None:
        if len(rows):
            m = members[cell]
            row, pos, dist = _gathered(_top_euclidean(q[rows], t[m], ids[m], k))
            found.append((rows[row], m[pos], dist))

    mine = tree.place(q)
    blind = np.isinf(reach)
    for c in range(n_cells):
        search(np.flatnonzero(blind & (mine == c)), c)
    for row, _, dist in found:
        full, last = np.unique(row, return_index=True)
        size = np.diff(np.append(last, len(row)))
        reach[full] = np.where(size >= k, np.maximum.reduceat(dist, last), np.inf)
    near = np.empty((len(q), n_cells), dtype=bool)
    slab = max(1, SLAB_NUMBERS // max(lo.size, 1))
    for a in range(0, len(q), slab):
        part = slice(a, a + slab)
        near[part] = _floors(q[part], lo, hi, tree.centre, radius) <= (reach[part] * (1 + _SLACK) + _SLACK)[:, None]
    if near.mean() > 0.5:
        return _gathered(_top_euclidean(q, t, ids, k))
    near[np.flatnonzero(blind), mine[blind]] = False
    for c in range(n_cells):
        search(np.flatnonzero(near[:, c]), c)
    if not found:
        return _gathered(())
    row, pos, dist = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids[pos], dist, row))
    order = order[_first_of(row[order], k)]
    return row[order], pos[order], dist[order]


def _top_nan_euclidean(q: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int):
    """Distance over coordinates present in both rows, scaled up to all coordinates.

    Shortlists by masked products and then takes exact distances, as above.
    """
    seen = ~np.isnan(t)
    full = np.where(seen, t, 0.0)
    mask = seen.astype(float)
    width = t.shape[1]

    def exact(row: np.ndarray, near: np.ndarray) -> np.ndarray:
        here = ~np.isnan(row)
        both = seen[near] & here
        gap = np.where(both, full[near] - np.where(here, row, 0.0), 0.0)
        return (gap**2).sum(1) * (width / both.sum(1))

    wide = min(len(t), 4 * k + 8)
    for start in range(0, len(q), _SLAB):
        part = q[start : start + _SLAB]
        here = ~np.isnan(part)
        own = np.where(here, part, 0.0)
        shared = here.astype(float) @ mask.T
        sizes = (own**2) @ mask.T + here.astype(float) @ (full**2).T
        with np.errstate(divide="ignore", invalid="ignore"):
            sq = np.where(shared > 0, (sizes - 2 * own @ full.T) * (width / shared), np.inf)
        margin = _SLACK * width * (sizes.max(1) + 1.0)
        short = np.argpartition(sq, wide - 1, axis=1)[:, :wide]
        last = np.take_along_axis(sq, short, 1).max(1)
        for i in range(len(part)):
            near = short[i][np.isfinite(sq[i, short[i]])]
            d = exact(part[i], near)
            pick = _pick(d, ids[near], k)
            if wide < len(t) and len(pick) and d[pick[-1]] + margin[i] >= last[i] - margin[i]:
                near = np.flatnonzero(sq[i] <= d[pick[-1]] + margin[i])
                d = exact(part[i], near)
                pick = _pick(d, ids[near], k)
            yield start + i, near[pick], np.sqrt(d[pick])


def _cut(part: np.ndarray) -> tuple[int, float] | None:
    """The widest dimension (of equally wide ones the most varied) and its median."""
    low, high = np.quantile(part, [0.02, 0.98], axis=0)
    spread = high - low
    if spread.max() <= 0:
        spread = part.max(0) - part.min(0)
    if spread.max() <= 0:
        return None
    wide = np.flatnonzero(spread >= spread.max() * (1 - _SLACK))
    dim = int(wide[part[:, wide].var(0).argmax()])
    values = part[:, dim]
    middle, top = float(np.median(values)), values.max()
    return dim, middle if middle < top else float(values[values < top].max())


class Cells:
    """A k-d tree over a sample, the largest cell cut first; a cell's centre is its sample's mean."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        self.nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
        held = {0: np.arange(len(sample))}
        open_nodes = [(-len(sample), 0)]
        while open_nodes and len(held) < n_cells:
            _, at = heapq.heappop(open_nodes)
            cut = _cut(sample[held[at]])
            if cut is None:
                continue
            rows, left = held.pop(at), len(self.nodes)
            right = sample[rows, cut[0]] > cut[1]
            self.nodes[at] = (*cut, left, left + 1)
            for node, part in ((left, rows[~right]), (left + 1, rows[right])):
                self.nodes.append((-1, 0.0, 0, 0))
                held[node] = part
                heapq.heappush(open_nodes, (-len(part), node))
        self.cell = {node: i for i, node in enumerate(sorted(held))}
        self.centre = np.array([sample[held[node]].mean(0) for node in sorted(held)])

    def place(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype="int32")
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            dim, threshold, left, right = self.nodes[at]
            if dim < 0:
                out[rows] = self.cell[at]
                continue
            above = x[rows, dim] > threshold
            todo += [(left, rows[~above]), (right, rows[above])]
        return out


def _boxes(placed: DataFrame, centre: np.ndarray, unpack) -> list:
    """``cell, n, lo, hi, radius`` of every cell, from all its rows."""
    schema = "cell int, n bigint, lo array<double>, hi array<double>, radius double"

    def frame(found: dict) -> pd.DataFrame:
        rows = [(c, n, list(lo), list(hi), r) for c, (n, lo, hi, r) in found.items()]
        return pd.DataFrame(rows, columns=["cell", "n", "lo", "hi", "radius"])

    def add(found: dict, cell: int, n: int, lo: np.ndarray, hi: np.ndarray, radius: float) -> None:
        if cell in found:
            m, a, b, r = found[cell]
            n, lo, hi, radius = n + m, np.minimum(lo, a), np.maximum(hi, b), max(radius, r)
        found[cell] = (n, lo, hi, radius)

    def partial(batches):
        found: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            order = np.argsort(pdf["cell"].to_numpy(), kind="stable")
            x, cell = unpack(pdf["vec"])[order], pdf["cell"].to_numpy()[order]
            cells, first, sizes = np.unique(cell, return_index=True, return_counts=True)
            radius = np.sqrt(((x - centre[cell]) ** 2).sum(1))
            groups = zip(cells, sizes, np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), np.maximum.reduceat(radius, first))
            for c, n, lo, hi, r in groups:
                add(found, int(c), int(n), lo, hi, float(r))
        yield frame(found)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict = {}
        for r in pdf.itertuples(index=False):
            add(found, int(r.cell), int(r.n), np.asarray(r.lo), np.asarray(r.hi), float(r.radius))
        return frame(found)

    return placed.mapInPandas(partial, schema).groupBy("cell").applyInPandas(merged, schema).collect()


_ENTRY = np.dtype([("at", "<i4"), ("value", "<f8")])


def _packed_rows(x: np.ndarray) -> pa.BinaryArray:
    """Rows as bytes: their places and numbers other than zero, or all numbers where that is shorter."""
    n, width = x.shape
    own = (x != 0).sum(1)
    dense = own * _ENTRY.itemsize >= width * 8
    lens = np.where(dense, width * 8, own * _ENTRY.itemsize)
    offsets = np.append(0, np.cumsum(lens))
    out = np.empty(offsets[-1], dtype=np.uint8)
    part = np.repeat(dense, lens)
    out[part] = x[dense].reshape(-1).view(np.uint8)
    row, at = np.nonzero(x[~dense])
    entries = np.empty(len(row), dtype=_ENTRY)
    entries["at"], entries["value"] = at, x[~dense][row, at]
    out[~part] = entries.view(np.uint8)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _unpacked(packed: pd.Series | pa.BinaryArray | list, width: int) -> np.ndarray:
    rows = packed if isinstance(packed, list) else packed.tolist()
    lens = np.array([len(r) for r in rows], dtype=int)
    out, dense = np.zeros((len(rows), width)), lens == width * 8
    out[dense] = np.frombuffer(b"".join(r for r, d in zip(rows, dense) if d)).reshape(-1, width)
    entries = np.frombuffer(b"".join(r for r, d in zip(rows, dense) if not d), dtype=_ENTRY)
    out[np.repeat(np.flatnonzero(~dense), lens[~dense] // _ENTRY.itemsize), entries["at"]] = entries["value"]
    return out


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of arrays, or of packed ones."""
    if pa.types.is_binary(column.type):
        return _unpacked(column, width)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


class Boxes:
    """Boxes of the nodes of a k-d tree, and of its cells also the balls, from all rows."""

    def __init__(self, tree: Cells, found: list):
        n, width = len(tree.nodes), tree.centre.shape[1]
        self.tree, self.lo, self.hi = tree, np.full((n, width), np.inf), np.full((n, width), -np.inf)
        self.radius = {r["cell"]: r["radius"] for r in found}
        node = {cell: at for at, cell in tree.cell.items()}
        for r in found:
            self.lo[node[r["cell"]]], self.hi[node[r["cell"]]] = r["lo"], r["hi"]
        for at in range(n - 1, -1, -1):  # children come after their parent
            dim, _, left, right = tree.nodes[at]
            if dim >= 0:
                self.lo[at] = np.minimum(self.lo[left], self.lo[right])
                self.hi[at] = np.maximum(self.hi[left], self.hi[right])

    def near(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and a cell that may hold rows within its reach."""
        rows, cells = [], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, some = todo.pop()
            cell = self.tree.cell.get(at)
            if not len(some) or (cell is not None and cell not in self.radius):
                continue
            part, lo, hi = x[some], self.lo[at : at + 1], self.hi[at : at + 1]
            if cell is None:
                gap = np.maximum(np.maximum(lo - part, part - hi), 0.0)
                some = some[np.sqrt(np.einsum("qw,qw->q", gap, gap)) <= reach[some] * (1 + _SLACK) + _SLACK]
                todo += [(child, some) for child in self.tree.nodes[at][2:]]
                continue
            floor = _floors(part, lo, hi, self.tree.centre[cell : cell + 1], np.array([self.radius[cell]]))[:, 0]
            some = some[floor <= reach[some] * (1 + _SLACK) + _SLACK]
            rows.append(some)
            cells.append(np.full(len(some), cell, dtype="int32"))
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, dtype=int), np.zeros(0, dtype="int32"))


def _floors(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Least distance that each row can have to the rows of each cell: by box and by ball."""
    gap = np.maximum(lo[None] - x[:, None], x[:, None] - hi[None])
    np.maximum(gap, 0.0, out=gap)
    box = np.sqrt(np.einsum("qcw,qcw->qc", gap, gap))
    size = 1.0 + np.sqrt((x * x).sum(1))[:, None] + np.sqrt((centre * centre).sum(1))[None]
    # The fast distance is rounded where both are long.
    return np.maximum(box, _distances(x, centre) - radius[None] - 1e-6 * size)


def _blocked(queries: DataFrame, train: DataFrame, k: int, payload: str, skip_self: bool, finder=None, unpack=_matrix):
    """Top-k of every (cell, block, chunk) group, then top-k per query.

    Without a ``finder`` by Euclidean distance, within the queries' ``reach`` if they have one.
    """
    schema = (
        f"qid {queries.schema['qid'].dataType.simpleString()}, "
        f"tid {train.schema['tid'].dataType.simpleString()}, distance double, "
        f"payload {train.schema[payload].dataType.simpleString()}"
    )

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "tid": [], "distance": [], "payload": []})
        q, t = unpack(left["vec"]), unpack(right["vec"])
        qid, tid = left["qid"].to_numpy(), right["tid"].to_numpy()
        load, need = right[payload].to_numpy(), k + skip_self
        if finder is None:
            far = left["reach"].fillna(np.inf).to_numpy(dtype=float) if "reach" in left else np.full(len(q), np.inf)
            row, pos, dist = _refined(q, t, tid, need, far)
        else:
            row, pos, dist = _gathered(finder(q, t, tid, need))
        if skip_self:
            other = tid[pos] != qid[row]
            row, pos, dist = row[other], pos[other], dist[other]
            first = _first_of(row, k)
            row, pos, dist = row[first], pos[first], dist[first]
        return pd.DataFrame({"qid": qid[row], "tid": tid[pos], "distance": dist, "payload": load[pos]})

    keys = ["cell", "block", "chunk"]
    # Both sides may stem from one table: give one of them attributes of its own.
    train = train.select(*[F.col(c).alias(c) for c in train.columns])
    partial = (
        queries.groupBy(*keys).cogroup(train.groupBy(*keys)).applyInPandas(nearest, schema)
    )
    return smallest(partial, ["qid"], [F.asc("distance"), F.asc("tid")], k)


def _copies(df: DataFrame, own: str, n_own, other: str, n_other, key: str) -> DataFrame:
    """Give every row its own slot and one copy per slot of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), n_own).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), n_other.cast("int") - 1))
    )


def _spread(queries: DataFrame, train: DataFrame, blocks: dict, chunks: dict):
    """Copy queries to the blocks of their cell, and train rows to its query chunks."""
    spark = train.sparkSession
    rows = [(c, blocks[c], chunks[c]) for c in blocks if chunks.get(c)]
    plan = F.broadcast(spark.createDataFrame(rows, "cell int, n_blocks int, n_chunks int"))
    n_blocks, n_chunks = F.col("n_blocks"), F.col("n_chunks")
    q = _copies(queries.join(plan, "cell"), "chunk", n_chunks, "block", n_blocks, "qid")
    t = _copies(train.join(plan, "cell"), "block", n_blocks, "chunk", n_chunks, "tid")
    return q.drop("n_blocks", "n_chunks"), t.drop("n_blocks", "n_chunks")


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    query_id: str,
    train_id: str,
    query_vector: str,
    train_vector: str,
    payload: str,
    skip_self: bool = False,
    n_pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``qid, tid, distance, payload`` for the k nearest train rows of every query.

    Euclidean distance; ties go to the smaller train id. ``skip_self`` leaves
    out the train row with the query's own id.
    """
    vector = "array<double>"
    q = queries.select(
        col(query_id).alias("qid"), col(query_vector).cast(vector).alias("vec")
    )
    t = train.select(
        col(train_id).alias("tid"),
        col(train_vector).cast(vector).alias("vec"),
        col(payload).alias("payload"),
    )
    need = k + int(skip_self)
    sizes = one_row(
        t,
        {
            "n": F.count(F.lit(1)),
            "k": F.approx_count_distinct(F.xxhash64("vec")),
            "width": F.max(F.size("vec")),
        },
    )
    n = sizes["n"]
    width = sizes["width"] or 1
    id_type = t.schema["tid"].dataType.simpleString()
    load_type = t.schema["payload"].dataType.simpleString()
    q_type = q.schema["qid"].dataType.simpleString()
    if n * MOSTLY_DISTINCT > sizes["k"]:
        # Of equal vectors only the smallest ids can ever be among the nearest;
        # the others go before anything is shuffled by cell.
        def pack(batches):
            for b in batches:
                vec = _packed_rows(_dense(b.column("vec"), width))
                yield pa.RecordBatch.from_arrays([b.column("tid"), b.column("payload"), vec], names=["tid", "payload", "vec"])

        t = t.mapInArrow(pack, f"tid {id_type}, payload {load_type}, vec binary")
        t = cut_lineage(smallest(t, ["vec"], [F.asc("tid")], need))
        n = min(n, sizes["k"] * need)
    if n_pivots is None:
        n_pivots = max(1, min(MAX_CELLS, math.isqrt(max(n, 1)) // 4))
    whole = isinstance(t.schema["tid"].dataType, T.IntegralType)
    order = hash_order(F.col("tid") if whole else F.xxhash64("tid"), 1)
    most = min(SAMPLE_ROWS, max(n_pivots, SAMPLE_NUMBERS // width))
    # The first rows in that order; those far behind need not be sorted.
    ahead = t.where(order < F.lit(int(2147483647 * min(1.0, 2.0 * most / max(n, 1)))))
    picked = ahead.orderBy(order, "tid").limit(most).select("vec").collect() if n > 2 * most else []
    if len(picked) < most:
        picked = t.orderBy(order, "tid").limit(most).select("vec").collect()
    if not picked:
        fields = [q.schema["qid"], t.schema["tid"], T.StructField("distance", T.DoubleType()), t.schema["payload"]]
        return train.sparkSession.createDataFrame([], T.StructType(fields))
    sample = [r["vec"] for r in picked]
    packed = isinstance(t.schema["vec"].dataType, T.BinaryType)
    tree = Cells(_unpacked(sample, width) if packed else np.array(sample, dtype=float), n_pivots)

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _dense(b.column("vec"), width)
            kept = [c for c in b.schema.names if c != "vec"]
            columns = [*[b.column(c) for c in kept], _packed_rows(x), pa.array(tree.place(x))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "vec", "cell"])

    def unpack(series: pd.Series) -> np.ndarray:
        return _unpacked(series, width)

    # Both are read several times.
    placed = cut_lineage(t.select("tid", "payload", "vec").mapInArrow(place, f"tid {id_type}, payload {load_type}, vec binary, cell int"))
    own = cut_lineage(q.mapInArrow(place, f"qid {q_type}, vec binary, cell int"))
    found = sorted(_boxes(placed, tree.centre, unpack))
    boxes = Boxes(tree, found)
    blocks = {r["cell"]: -(-r["n"] // block_rows) for r in found}

    def searched(visits: DataFrame) -> DataFrame:
        load = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        chunks = {c: -(-m // chunk_rows) for c, m in load.items()}
        left, right = _spread(visits, placed, blocks, chunks)
        return _blocked(left, right, k, "payload", skip_self, None, unpack)

    first = cut_lineage(searched(own))
    reach = first.groupBy(F.col("qid").alias("__q")).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("reach"))
    slab = max(1, SLAB_NUMBERS // width)

    def visit(batches):
        for pdf in batches:
            for start in range(0, len(pdf), slab):
                part = pdf.iloc[start : start + slab]
                far = part["reach"].fillna(np.inf).to_numpy(dtype=float)
                at, which = boxes.near(unpack(part["vec"]), far)
                other = part["cell"].to_numpy()[at] != which
                at, which = at[other], which[other]
                qid, vec = part["qid"].to_numpy(), part["vec"].to_numpy()
                for a in range(0, len(at), SENT_ROWS):
                    b = slice(a, a + SENT_ROWS)
                    yield pd.DataFrame({"qid": qid[at[b]], "vec": vec[at[b]], "cell": which[b], "reach": far[at[b]]})

    bounded = own.join(reach, F.col("qid").eqNullSafe(F.col("__q")), "left").drop("__q")
    second = searched(bounded.mapInPandas(visit, f"qid {q_type}, vec binary, cell int, reach double"))
    return smallest(first.unionByName(second), ["qid"], [F.asc("distance"), F.asc("tid")], k)


def knn_vote(neighbours: DataFrame) -> DataFrame:
    """Majority class of the neighbours, ties to the smaller class."""
    votes = neighbours.groupBy("qid", "payload").agg((-F.count("*")).alias("n"))
    best = votes.groupBy("qid").agg(F.min(F.struct("n", "payload")).alias("b"))
    return best.select("qid", F.col("b.payload").alias("prediction"), (-F.col("b.n")).alias("votes"))


def knn_mean(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("qid").agg(F.avg("payload").alias("prediction"))


def _pattern(vec: str):
    """One character for each coordinate: 1 where there is a value."""
    return F.array_join(F.transform(vec, lambda v: F.when(v.isNull() | F.isnan(v), "0").otherwise("1")), "")


def _shared_columns(q: DataFrame, t: DataFrame) -> dict[str, dict[str, list[str]]] | None:
    """For each pattern of the queries the donors' patterns by what both have; None if there are many."""
    met = []
    for side in (q, t):
        found = side.select(_pattern("vec").alias("p")).distinct().limit(PATTERN_JOINS + 1).collect()
        met.append(sorted(r["p"] for r in found))
    if max(len(m) for m in met) > PATTERN_JOINS:
        return None
    out: dict[str, dict[str, list[str]]] = {}
    for mine in met[0]:
        out[mine] = {}
        for other in met[1]:
            both = "".join("1" if a == b == "1" else "0" for a, b in zip(mine, other))
            if "1" in both:
                out[mine].setdefault(both, []).append(other)
    return out if sum(len(v) for v in out.values()) <= PATTERN_JOINS else None


def _by_pattern(q: DataFrame, t: DataFrame, shared: dict, k: int, width: int) -> DataFrame:
    """The k nearest under the nan-euclidean distance: a join for each set of shared columns."""
    parts = []
    for mine, groups in shared.items():
        for both, others in groups.items():
            at = [i for i, b in enumerate(both) if b == "1"]
            vec = F.array(*[F.col("vec")[i] for i in at]).alias("vec")
            found = knn_join(
                q.where(_pattern("vec") == mine).select("qid", vec),
                t.where(_pattern("vec").isin(others)).select("tid", vec, "payload"),
                k, "qid", "tid", "vec", "vec", "payload",
            )
            parts.append(found.withColumn("distance", F.col("distance") * math.sqrt(width / len(at))))
    if not parts:
        fields = [q.schema["qid"], t.schema["tid"], T.StructField("distance", T.DoubleType()), t.schema["payload"]]
        return q.sparkSession.createDataFrame([], T.StructType(fields))
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    return together if len(parts) == 1 else smallest(together, ["qid"], [F.asc("distance"), F.asc("tid")], k)


def knn_impute(
    df: DataFrame,
    key: str,
    columns: list[str],
    k: int = 5,
    donors: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Fill each gap with the mean of its k nearest donors (nan-euclidean distance).

    ``donors`` are the rows values are taken from (the training rows); by default
    the table itself. A row with nothing in common with any donor gets the
    donors' column mean. This distance obeys no triangle inequality, but between
    rows of one pattern of gaps and donors that share the same columns with it,
    it is a Euclidean distance times a constant: each such pair of groups is a
    ``knn_join``. Small tables, and those with many patterns, compare all pairs
    in bounded blocks.
    """
    from tidyloom.operators.aggregates import missing_counts

    givers = df if donors is None else donors
    total, absent = missing_counts(givers, columns)
    _, gaps = (total, absent) if donors is None else missing_counts(df, columns)
    means = one_row(givers, {c: F.avg(col(c).cast("double")) for c in columns})
    base = df.select(col(key).alias("qid"), features_to_vector(columns).alias("vec"), *[col(c) for c in columns])
    source = givers.select(
        col(key).alias("tid"), features_to_vector(columns).alias("vec"), *[col(c) for c in columns]
    )
    out = df
    for c in columns:
        if not gaps[c] or absent[c] == total:
            continue
        q = base.where(col(c).isNull()).select("qid", "vec")
        t = source.where(col(c).isNotNull()).select("tid", "vec", col(c).cast("double").alias("payload"))
        n_blocks = -(-(total - absent[c]) // block_rows)
        n_chunks = -(-gaps[c] // chunk_rows)
        shared = _shared_columns(q, t) if n_blocks * n_chunks > 1 else None
        if shared is None:
            left = _copies(q.withColumn("cell", F.lit(0)), "chunk", F.lit(n_chunks), "block", F.lit(n_blocks), "qid")
            right = _copies(t.withColumn("cell", F.lit(0)), "block", F.lit(n_blocks), "chunk", F.lit(n_chunks), "tid")
            nearest = _blocked(left, right, k, "payload", False, _top_nan_euclidean)
        else:
            nearest = _by_pattern(q, t, shared, k, len(columns))
        found = knn_mean(nearest)
        found = found.select(F.col("qid").alias("__q"), F.col("prediction").alias("__fill"))
        kept = [col(x) for x in out.columns]
        filled = F.coalesce(col(c).cast("double"), F.col("__fill"), F.lit(means[c]))
        out = (
            out.join(found, col(key) == F.col("__q"), "left")
            .select(*kept, filled.alias("__new"))
            .withColumn(c, F.col("__new"))
            .drop("__new")
        )
    return out
