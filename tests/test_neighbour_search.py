"""The neighbour join's search inside a block, and its visits of cells."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidyloom.operators import neighbors


def _clustered(rng, n, brands=12):
    """Two numbers, one of few values, and flags of a category."""
    x = np.zeros((n, 2 + brands))
    x[:, 0], x[:, 1] = rng.integers(0, 40, n) / 11, rng.random(n) * 3
    x[np.arange(n), 2 + rng.integers(0, brands, n)] = 1
    return x


def _brute(q, t, ids, k):
    d = ((q[:, None] - t[None]) ** 2).sum(2)
    order = np.array([np.lexsort((ids, row))[:k] for row in d])
    return order, np.sqrt(np.take_along_axis(d, order, 1))


@pytest.mark.parametrize("bounded", [False, True])
def test_large_block_compares_few_pairs(monkeypatch, bounded):
    rng = np.random.default_rng(3)
    t, q = _clustered(rng, 6000), _clustered(rng, 1500)
    t[200:260] = t[100]  # ties go to the smaller id
    q[5] = t[100]
    ids = rng.permutation(len(t))
    pairs, real = [0], neighbors._top_euclidean

    def counted(a, b, *rest):
        pairs[0] += len(a) * len(b)
        return real(a, b, *rest)

    monkeypatch.setattr(neighbors, "_top_euclidean", counted)
    order, dist = _brute(q, t, ids, 4)
    far = dist[:, -1].copy() if bounded else np.full(len(q), np.inf)
    row, pos, d = neighbors._refined(q, t, ids, 4, far)
    assert row.tolist() == np.repeat(np.arange(len(q)), 4).tolist()
    assert pos.reshape(-1, 4).tolist() == order.tolist() and d.reshape(-1, 4) == pytest.approx(dist)
    assert pairs[0] < 0.4 * len(q) * len(t)


def test_block_without_clusters_is_compared_whole():
    rng = np.random.default_rng(4)
    t, q = rng.normal(0, 1, (2000, 40)), rng.normal(0, 1, (300, 40))
    order, dist = _brute(q, t, np.arange(2000), 3)
    row, pos, d = neighbors._refined(q, t, np.arange(2000), 3, np.full(300, np.inf))
    assert pos.reshape(-1, 3).tolist() == order.tolist() and d.reshape(-1, 3) == pytest.approx(dist)


def test_join_in_one_cell(spark):
    rng = np.random.default_rng(5)
    x = _clustered(rng, 2500)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(2500), "vec": list(x)})).withColumn("load", F.col("id") * 2)
    got = neighbors.knn_join(df, df, 3, "id", "id", "vec", "vec", "load", skip_self=True, n_pivots=1).toPandas()
    got = got.sort_values(["qid", "distance", "tid"])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.array([np.lexsort((np.arange(2500), r))[:3] for r in d])
    assert got["tid"].to_numpy().reshape(-1, 3).tolist() == want.tolist()
    assert got["distance"].to_numpy().reshape(-1, 3) == pytest.approx(np.sqrt(np.take_along_axis(d, want, 1)))
    assert (got["payload"] == 2 * got["tid"]).all()


def test_visits_by_the_tree_are_those_of_all_boxes():
    rng = np.random.default_rng(6)
    t, q = _clustered(rng, 3000), _clustered(rng, 200)
    tree = neighbors.Cells(t[:1000], 60)
    home = tree.place(t)
    found = []
    for c in np.unique(home[home != 7]):  # a cell without rows
        rows = t[home == c]
        radius = float(np.sqrt(((rows - tree.centre[c]) ** 2).sum(1)).max())
        found.append({"cell": int(c), "n": len(rows), "lo": rows.min(0), "hi": rows.max(0), "radius": radius})
    reach = rng.random(200) * 1.5
    reach[3] = np.inf
    lo, hi = np.array([r["lo"] for r in found]), np.array([r["hi"] for r in found])
    ids, radius = np.array([r["cell"] for r in found]), np.array([r["radius"] for r in found])
    near = neighbors._floors(q, lo, hi, tree.centre[ids], radius) <= (reach * (1 + 1e-9) + 1e-9)[:, None]
    want = {(int(i), int(ids[j])) for i, j in zip(*np.nonzero(near))}
    at, cell = neighbors.Boxes(tree, found).near(q, reach)
    assert len(at) == len(want) < 200 * len(found) and set(zip(at.tolist(), cell.tolist())) == want


def test_packed_rows():
    x = np.zeros((5, 6))
    x[1, 4], x[2] = -2.5, np.arange(1, 7)
    x[3, [0, 5]] = np.nan, np.inf
    packed = neighbors._packed_rows(x)
    assert [len(b) for b in packed.to_pylist()] == [0, 12, 48, 24, 0]
    for form in (packed, packed.to_pandas(), packed.to_pylist()):
        assert np.array_equal(neighbors._unpacked(form, 6), x, equal_nan=True)
    lists = pa.array(x.tolist(), pa.list_(pa.float64())).slice(1)
    assert np.array_equal(neighbors._dense(lists, 6), x[1:], equal_nan=True)
