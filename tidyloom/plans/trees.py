"""Forests and boosted trees over distinct binned rows.

Spark ML's trees see a row only through the bins its values fall into (32 for a
number, 2 for a flag), so rows that share all bins and the label are one cell with
a count. The trees here are of the same kind (same thresholds, impurities, depth,
random columns of a node, merged leaves), but a task grows whole trees over the
cells where Spark ML runs a job for every few thousand nodes. A bootstrap draws a
Poisson number for a cell, which is distributed as the sum of its rows' draws.
Held-out cells fall through a tree while it grows, so no model is kept. Seeds go by
tree and node: how trees are dealt to tasks does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col
from tidyloom.operators.sampling import SEED
from tidyloom.session import cut_lineage

MAX_BINS = 32
#: Rows the thresholds are taken from, as many as Spark ML takes.
FIT_ROWS = 10_000
#: Cells that one task holds; tables with more, or with more features, use Spark ML.
MOST_CELLS = 1_000_000
MOST_FEATURES = 1000
#: Rows in a piece, and trees that a task grows.
PIECE_ROWS = 25_000
TASK_TREES = 5
#: Numbers of one histogram.
SLAB = 4_000_000
_EPS = 2.0**-52
_STEP = 0.1
_BOOST_DEPTH = 3
_TASK_ROWS = "piece int, grp long, items array<binary>, x binary, y binary"


# ---------------------------------------------------------------- bins
def thresholds(values: np.ndarray, weights: np.ndarray, most: int = MAX_BINS) -> np.ndarray:
    """Between which values a numeric column is cut, by Spark ML's rule."""
    own, at = np.unique(values, return_inverse=True)
    size = np.bincount(at, weights=weights, minlength=len(own))
    middle = own[:-1] / 2 + own[1:] / 2
    if len(own) <= most:
        return middle
    stride = size.sum() / most
    out, now, aim = [], size[0], stride
    for i in range(1, len(own)):
        last, now = now, now + size[i]
        if abs(last - aim) < abs(now - aim):
            out.append(middle[i - 1])
            aim += stride
    return np.array(out)


class Bins:
    """Thresholds of every feature. A row is the numbers of its bins other than those a zero falls into."""

    def __init__(self, cuts: list[np.ndarray]):
        width = max((len(c) for c in cuts), default=0)
        self.cuts = np.full((len(cuts), max(width, 1)), np.inf)
        for f, c in enumerate(cuts):
            self.cuts[f, : len(c)] = c
        self.size = np.array([len(c) + 1 for c in cuts], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.zero = (0.0 > self.cuts).sum(1)
        # The last number, past all bins, fills up short rows.
        self.feature = np.append(np.repeat(np.arange(len(cuts)), self.size), len(cuts))
        self.bin = np.append(np.arange(self.size.sum()) - np.repeat(self.first, self.size), 0)

    def items(self, vectors: pa.StructArray) -> pa.BinaryArray:
        """The row's bins as bytes, in order of the features."""
        values, indices = vectors.field("values"), vectors.field("indices")
        lens = np.asarray(values.value_lengths().fill_null(0))
        total, row = int(lens.sum()), np.repeat(np.arange(len(lens)), lens)
        feature = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
        sparse = np.asarray(vectors.field("type")) == 0
        feature[sparse[row]] = np.asarray(indices.flatten())
        x, found = np.asarray(values.flatten()), np.zeros(total, dtype=np.int64)
        for a in range(0, total, SLAB // self.cuts.shape[1]):
            part = slice(a, a + SLAB // self.cuts.shape[1])
            found[part] = (~(x[part, None] <= self.cuts[feature[part]])).sum(1)
        found = np.minimum(found, self.size[feature] - 1)
        kept = found != self.zero[feature]
        ids = (self.first[feature] + found)[kept].astype(np.int32)
        ends = np.cumsum(np.bincount(row[kept], minlength=len(lens))) * 4
        offsets = np.append(0, ends).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])

    def matrix(self, items: list[bytes]) -> np.ndarray:
        lens = np.array([len(b) // 4 for b in items], dtype=np.int64)
        out = np.full((len(items), max(int(lens.max(initial=0)), 1)), len(self.bin) - 1, dtype=np.int32)
        out[np.arange(out.shape[1])[None] < lens[:, None]] = np.frombuffer(b"".join(items), dtype=np.int32)
        return out


def fit_bins(train: DataFrame, key: str, n_rows: int, weight: str | None) -> Bins:
    w = F.col(weight) if weight else F.lit(1.0)
    rows = train.select(vector_to_array("features").alias("x"), w.alias("w"), col(key), "label")
    got = None
    if n_rows > FIT_ROWS:
        # Rows by a hash, so how they are laid out does not matter; a table of few keys gives the first rows it has.
        some = F.pmod(F.xxhash64(F.lit(SEED), col(key), "label", "x"), F.lit(n_rows)) < FIT_ROWS
        got = rows.where(some).limit(4 * FIT_ROWS).select("x", "w").toPandas()
    if got is None or len(got) < FIT_ROWS // 2:
        got = rows.limit(FIT_ROWS).select("x", "w").toPandas()
    x, w = np.array(got["x"].tolist(), dtype=float), got["w"].to_numpy(dtype=float)
    return Bins([thresholds(x[:, f], w) for f in range(x.shape[1])])


def binned(df: DataFrame, bins: Bins, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``items``."""
    rows = df.select(*keep, F.unwrap_udt("features").alias("features"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, bins.items(b.column("features"))], names=[*keep, "items"])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(add, ", ".join([*fields, "items binary"]))


# ---------------------------------------------------------------- cells
def cells(train: DataFrame, test: DataFrame, n_rows: int) -> DataFrame:
    """``items, label, n`` of the training rows, and held-out items without a label; equal items lie together."""
    known = train.groupBy("items", "label").agg(F.count("*").alias("n"))
    asked = test.select("items").distinct().select("items", F.lit(None).cast("double").alias("label"), F.lit(0).cast("long").alias("n"))
    pieces = max(1, -(-n_rows // PIECE_ROWS))
    return known.unionByName(asked).repartition(pieces, "items").sortWithinPartitions("items", "label")


def _deal(spark, n: int) -> list[int]:
    """Numbers that ``repartition(n, ...)`` puts into a partition each."""
    found: dict[int, int] = {}
    top = 64 * n
    while len(found) < n:
        rows = spark.range(top).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
        found = {r["p"]: r["id"] for r in rows.collect()}
        top *= 4
    return [found[p] for p in range(n)]


def _impurity(s: np.ndarray, classes: bool) -> np.ndarray:
    """What splits make smaller, times the weight; sums of a regression are weight and weighted label."""
    if classes:
        total = s.sum(-1)
        return total - (s * s).sum(-1) / np.where(total > 0, total, 1.0)
    return -(s[..., 1] ** 2) / np.where(s[..., 0] > 0, s[..., 0], 1.0)


def _best(hist: np.ndarray, total: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, position and sums to the left of the best cut of every (bins, stats) histogram."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    right = total[:, None] - left
    if weights is not None:
        empty = (left.sum(-1) <= 0) | (right.sum(-1) <= 0)
        a, b, whole = left * weights, right * weights, total * weights
    else:
        empty = (left[..., 0] <= 0) | (right[..., 0] <= 0)
        a, b, whole = left, right, total
    classes = weights is not None
    gain = _impurity(whole, classes)[:, None] - _impurity(a, classes) - _impurity(b, classes)
    gain[empty] = -np.inf
    at = gain.argmax(1)
    rows = np.arange(len(at))
    return gain[rows, at], at, left[rows, at]


def _chosen(path: np.ndarray, tree: int, n_features: int, n_chosen: int) -> np.ndarray:
    """Which features each node may use: those with the smallest hashes of tree, node and feature."""
    if n_chosen >= n_features:
        return np.ones((len(path), n_features), dtype=bool)
    with np.errstate(over="ignore"):
        h = path.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree + 1) * 0x632BE59BD9B4E019 % 2**64)
        h = h + (np.arange(n_features, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[None]
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        h ^= h >> np.uint64(31)
    limit = np.partition(h, n_chosen - 1, axis=1)[:, n_chosen - 1]
    return h <= limit[:, None]


def grow(
    items: np.ndarray, stats: list[np.ndarray], label: np.ndarray | None, bins: Bins, depth: int, n_chosen: int, tree: int, weights: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of every row, and the sums of every leaf.

    ``items`` are the bins of the rows. ``stats`` are, in a classification, the
    count of each row with its class in ``label``; in a regression the weight and the
    weighted label. Rows of weight 0 only fall through. ``weights`` are of the classes.
    """
    classes = weights is not None
    k = len(weights) if classes else len(stats)
    n, n_features = len(items), len(bins.size)
    width = int(bins.size.max(initial=1))

    def sums(index: np.ndarray, length: int, rows: np.ndarray) -> np.ndarray:
        if classes:
            return np.bincount(index * k + label[rows], weights=stats[0][rows], minlength=length * k).reshape(length, k)
        return np.stack([np.bincount(index, weights=s[rows], minlength=length) for s in stats], 1)

    parents, held, count = [], [], 0

    def add(parent: np.ndarray, total: np.ndarray) -> np.ndarray:
        nonlocal count
        parents.append(parent)
        held.append(total)
        count += len(parent)
        return np.arange(count - len(parent), count)

    at = np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    top = sums(np.zeros(n, dtype=np.int64), 1, rows)
    ids, path, spread = add(np.array([-1]), top), np.ones(1, dtype=np.int64), top
    # What is less than this is a rounding error.
    least = 0.0 if classes else 1e-14 * float((stats[1] ** 2 / np.where(stats[0] > 0, stats[0], 1.0)).sum())
    loc = np.zeros(n, dtype=np.int64)  # rows are sorted by it
    for _ in range(depth):
        if not len(ids):
            break
        n_active = len(ids)
        best = np.full(n_active, -np.inf)
        feature, cut = np.full(n_active, n_features), np.zeros(n_active, dtype=np.int64)
        below = np.zeros((n_active, spread.shape[1]))
        step = max(1, SLAB // (k * max(n_features, min(n_chosen, n_features) * width)))
        for a in range(0, n_active, step):
            b = min(a + step, n_active)
            i, j = np.searchsorted(loc, [a, b])
            part, here = rows[i:j], loc[i:j] - a
            node, feat = np.nonzero(_chosen(path[a:b], tree, n_features, n_chosen))
            # Flags and features of more bins apart, so that flags take two places.
            kind = np.where(bins.size[feat] <= 2, 2, width)
            slot = np.full((b - a, n_features + 1), -1, dtype=np.int64)
            slot[node, feat] = np.cumsum(kind) - kind
            hist = np.zeros((int(kind.sum()), spread.shape[1]))
            for c in range(items.shape[1]):
                item = items[part, c]
                base = slot[here, bins.feature[item]]
                ok = base >= 0
                hist += sums(base[ok] + bins.bin[item[ok]], len(hist), part[ok])
            start, total = slot[node, feat], spread[a:b][node]
            hist[start + bins.zero[feat]] = total - np.add.reduceat(hist, start, axis=0) if len(start) else 0.0
            gain, where, lower = np.empty(len(node)), np.empty(len(node), dtype=np.int64), np.empty_like(total)
            for size in {2, width}:
                pick = np.flatnonzero(kind == size)
                if len(pick):
                    block = hist[start[pick][:, None] + np.arange(size)]
                    gain[pick], where[pick], lower[pick] = _best(block, total[pick], weights)
            order = np.lexsort((feat, -gain, node))
            first = order[np.append(True, node[order][1:] != node[order][:-1])]
            own = a + node[first]
            best[own], feature[own], cut[own], below[own] = gain[first], feat[first], where[first], lower[first]
        split = best > least
        if not split.any():
            break
        # Rows whose node ends here stay; the others go left or right.
        go = split[loc]
        rows, loc = rows[go], loc[go]
        f, found = feature[loc], bins.zero[np.minimum(feature[loc], n_features - 1)]
        for c in range(items.shape[1]):
            item = items[rows, c]
            hit = bins.feature[item] == f
            found[hit] = bins.bin[item[hit]]
        number = np.cumsum(split) - 1
        child = 2 * number[loc] + (found > cut[loc])
        low = below[split]
        spread = np.stack([low, spread[split] - low], 1).reshape(-1, low.shape[1])
        new = add(np.repeat(ids[split], 2), spread)
        at[rows] = new[child]
        path = (2 * path[split][:, None] + np.arange(2)).ravel()
        on = np.ones(len(new), dtype=bool)
        if classes:
            whole = spread * weights
            on = _impurity(whole, True) > _EPS * np.maximum(whole.sum(1), 1e-300)
        go = on[child]
        rows, child = rows[go], child[go]
        order = np.argsort(child, kind="stable")
        number = np.cumsum(on) - 1
        rows, loc = rows[order], number[child[order]]
        ids, path, spread = new[on], path[on], spread[on]
    total = np.concatenate(held)
    if classes:
        total = total * weights
        at = _merged(parents, total.argmax(1))[at]
    return at, total


def _merged(parents: list[np.ndarray], guess: np.ndarray) -> np.ndarray:
    """Where each node ends when two leaves of one parent that guess the same become one, from below up."""
    out = np.arange(len(guess))
    leaf = np.ones(len(guess), dtype=bool)
    for p in parents[1:]:
        leaf[p] = False
    starts = np.cumsum([0, *(len(p) for p in parents)])
    for level in range(len(parents) - 1, 0, -1):
        left = np.arange(starts[level], starts[level + 1], 2)  # children lie side by side
        same = leaf[left] & leaf[left + 1] & (guess[left] == guess[left + 1])
        left, above = left[same], parents[level][::2][same]
        out[left] = out[left + 1] = above
        leaf[above] = True
    for level in range(1, len(parents)):
        own = slice(starts[level], starts[level + 1])
        out[own] = out[out[own]]
    return out


# ---------------------------------------------------------------- tasks
def _packed(held: DataFrame, groups: list[int]) -> DataFrame:
    """The pieces of each task: ``piece, grp, items``, and as bytes their labels and counts."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            pdf = pd.concat(got)
            row = {"items": [pdf["items"].tolist()], "x": [pdf["label"].to_numpy(dtype=float).tobytes()], "y": [pdf["n"].to_numpy(dtype=np.int64).tobytes()]}
            for g in groups:
                yield pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "grp": [g], **row})

    rows = held.withColumn("piece", F.spark_partition_id())
    return rows.mapInPandas(pack, _TASK_ROWS).repartition(len(groups), "grp")


def _task(batches: Iterator[pd.DataFrame], bins: Bins):
    """The pieces of one task in order: bins, items, number of rows of each, and the group."""
    got = [b for b in batches if len(b)]
    if not got:
        return None
    pdf = pd.concat(got).sort_values("piece")
    parts = [bins.matrix(list(r)) for r in pdf["items"]]
    wide, fill = max(m.shape[1] for m in parts), len(bins.bin) - 1
    matrix = np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1])), constant_values=fill) for m in parts])
    items = [b for r in pdf["items"] for b in r]
    return matrix, items, pdf, [len(m) for m in parts]


def _votes(packed: DataFrame, vote, places: int) -> DataFrame:
    """``items, votes``: what the tasks say of held-out items, added up over the tasks."""
    found = packed.mapInPandas(vote, "items binary, votes array<double>")
    added = F.array(*[F.sum(F.col("votes")[i]) for i in range(places)])
    return found.groupBy("items").agg(added.alias("votes"))


def _labelled(batches, bins: Bins):
    task = _task(batches, bins)
    if task is None:
        return None
    matrix, items, pdf, sizes = task
    label = np.concatenate([np.frombuffer(b) for b in pdf["x"]])
    n = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in pdf["y"]])
    return matrix, items, label, n, pdf, sizes


def _said(items: list[bytes], asked: np.ndarray, votes: np.ndarray) -> Iterator[pd.DataFrame]:
    for a in range(0, len(asked), PIECE_ROWS):
        part = slice(a, a + PIECE_ROWS)
        yield pd.DataFrame({"items": [items[i] for i in asked[part]], "votes": list(votes[part])})


def _tree_groups(trees: int) -> list[range]:
    return [range(a, min(a + TASK_TREES, trees)) for a in range(0, trees, TASK_TREES)]


def forest_votes(held: DataFrame, bins: Bins, trees: int, depth: int, weights: list[float], bootstrap: bool = True) -> DataFrame:
    """``items, votes``: for each class the mean share of the leaves that held-out items fall into."""
    dealt = _tree_groups(trees)
    groups = _deal(held.sparkSession, len(dealt))
    own, w = dict(zip(groups, dealt)), np.array(weights)
    n_features = len(bins.size)
    n_chosen = n_features if trees == 1 else int(np.ceil(np.sqrt(n_features)))

    def vote(batches):
        task = _labelled(batches, bins)
        if task is None:
            return
        matrix, items, label, n, pdf, sizes = task
        known = ~np.isnan(label)
        asked = np.flatnonzero(~known)
        label = np.where(known, label, 0).astype(np.int64)
        votes = np.zeros((len(asked), len(w)))
        for t in own[int(pdf["grp"].iloc[0])]:
            drawn = _drawn(t, pdf["piece"], sizes, n) if bootstrap else n
            rows = np.flatnonzero(~known | (drawn > 0))
            at, total = grow(matrix[rows], [drawn[rows].astype(float)], label[rows], bins, depth, n_chosen, t, w)
            leaf = total[at[~known[rows]]]
            votes += leaf / np.maximum(leaf.sum(1, keepdims=True), 1e-300)
        yield from _said(items, asked, votes / trees)

    return _votes(_packed(held, groups), vote, len(w))


def _drawn(tree: int, pieces, sizes: list[int], n: np.ndarray) -> np.ndarray:
    """How often the rows of each cell are drawn for a tree."""
    ends = np.cumsum(sizes)
    return np.concatenate([np.random.default_rng([SEED, tree, int(p)]).poisson(n[e - s : e]) for p, s, e in zip(pieces, sizes, ends)])


def bagged_votes(held: DataFrame, bins: Bins, trees: int, depth: int, center: float, bootstrap: bool = True) -> DataFrame:
    """``items, votes``: the mean value of the leaves that held-out items fall into.

    Labels are drawn where the rows lie, in one pass for all trees; a task gets the
    sums of each cell, however many rows it has.
    """
    dealt = _tree_groups(trees)
    groups = _deal(held.sparkSession, len(dealt))
    own = dict(zip(groups, dealt))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: list[bytes] = []
        asked: set[int] = set()
        found, rng, number = [], None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            if rng is None:
                number = int(pdf["piece"].iloc[0])
                rng = np.random.default_rng([SEED, number])
            items = pdf["items"].tolist()
            new = np.array([a != b for a, b in zip(items, [names[-1] if names else None, *items])])
            cell = len(names) - 1 + np.cumsum(new)
            names += [b for b, x in zip(items, new) if x]
            label, n = pdf["label"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=np.int64)
            known = ~np.isnan(label)
            asked.update(cell[~known].tolist())
            first, size = int(cell[0]), int(cell[-1] - cell[0]) + 1
            y, at, some = label[known] - center, cell[known] - first, n[known]
            sums = np.zeros((trees, 2, size))
            for t in range(trees):
                w = rng.poisson(some) if bootstrap else some
                sums[t, 0] = np.bincount(at, weights=w, minlength=size)
                sums[t, 1] = np.bincount(at, weights=w * y, minlength=size)
            found.append((first, sums))
        if not names:
            return
        flags = np.zeros(len(names), dtype=bool)
        flags[list(asked)] = True
        for g, some in own.items():
            total = np.zeros((len(some), 2, len(names)))
            for first, sums in found:
                total[:, :, first : first + sums.shape[2]] += sums[some.start : some.stop]
            yield pd.DataFrame({"piece": [number], "grp": [g], "items": [names], "x": [flags.tobytes()], "y": [total.tobytes()]})

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = _task(batches, bins)
        if task is None:
            return
        matrix, items, pdf, sizes = task
        some = own[int(pdf["grp"].iloc[0])]
        flags = np.concatenate([np.frombuffer(b, dtype=bool) for b in pdf["x"]])
        sums = np.concatenate([np.frombuffer(b).reshape(len(some), 2, m) for b, m in zip(pdf["y"], sizes)], axis=2)
        asked = np.flatnonzero(flags)
        votes = np.zeros((len(asked), 1))
        for t, (w, wy) in zip(some, sums):
            rows = np.flatnonzero(flags | (w > 0))
            at, total = grow(matrix[rows], [w[rows], wy[rows]], None, bins, depth, len(bins.size), t, None)
            leaf = total[at[flags[rows]]]
            votes[:, 0] += center + leaf[:, 1] / np.where(leaf[:, 0] > 0, leaf[:, 0], 1.0)
        yield from _said(items, asked, votes / trees)

    rows = held.withColumn("piece", F.spark_partition_id())
    packed = rows.mapInPandas(draw, _TASK_ROWS).repartition(len(groups), "grp")
    return _votes(packed, vote, 1)


def boosted_votes(held: DataFrame, bins: Bins, rounds: int, n_classes: int) -> DataFrame:
    """``items, votes``: the margin of each class against the rest (of two classes: of the second)."""
    wanted = list(range(n_classes)) if n_classes > 2 else [1]
    groups = _deal(held.sparkSession, len(wanted))
    own = dict(zip(groups, wanted))

    def vote(batches):
        task = _labelled(batches, bins)
        if task is None:
            return
        matrix, items, label, n, pdf, _ = task
        c = own[int(pdf["grp"].iloc[0])]
        asked = np.flatnonzero(np.isnan(label))
        sign, size = np.where(label == c, 1.0, -1.0), n.astype(float)
        margin, aim = np.zeros(len(n)), sign
        for r in range(rounds):
            at, total = grow(matrix, [size, size * aim], None, bins, _BOOST_DEPTH, len(bins.size), r, None)
            margin += (total[:, 1] / np.where(total[:, 0] > 0, total[:, 0], 1.0))[at] * (_STEP if r else 1.0)
            # The loss is log(1 + exp(-2 y m)) twice.
            with np.errstate(over="ignore"):
                aim = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
        votes = np.zeros((len(asked), len(wanted)))
        votes[:, wanted.index(c)] = margin[asked]
        yield from _said(items, asked, votes)

    return _votes(_packed(held, groups), vote, len(wanted))


# ---------------------------------------------------------------- predictions
def predictions(
    train: DataFrame, test: DataFrame, key: str, model: str, n_rows: int, options: dict, mean: float, weights: list[float] | None, held: list[DataFrame]
) -> DataFrame | None:
    """``test`` with the votes of trees fitted on ``train``; None for a table that is too varied for it.

    ``weights`` are those of the classes, None in a regression; ``mean`` is that of
    a numeric label. What is persisted goes to ``held``.
    """
    bins = fit_bins(train, key, n_rows, "w" if weights and model == "rf" else None)
    if len(bins.size) > MOST_FEATURES:
        return None
    asked = binned(test, bins, [c for c in test.columns if c != "features"])
    rows = cells(binned(train, bins, ["label"]), asked, n_rows).persist()
    held.append(rows)
    if rows.select("items").distinct().count() > MOST_CELLS or (weights and rows.count() > 2 * MOST_CELLS):
        return None
    if model == "gbm":
        votes = boosted_votes(rows, bins, options["rounds"], len(weights))
    elif weights:
        votes = forest_votes(rows, bins, options["trees"], options["depth"], weights)
    else:
        votes = bagged_votes(rows, bins, options["trees"], options["depth"], mean)
    return asked.join(cut_lineage(votes), "items").drop("items")
