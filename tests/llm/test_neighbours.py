import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyloom.llm.neighbours import Tree, chi_square, nearest_inner
from tidyloom.llm.queries import QUERIES


def brute(ids, x, asked, k):
    out = {}
    for i in np.flatnonzero(asked):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def answers(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_chi_square_quantiles():
    # Tabulated quantiles.
    for p, d, want in ((0.95, 8, 15.507), (0.9, 6, 10.645), (0.5, 10, 9.342)):
        assert chi_square(p, d) == pytest.approx(want, rel=0.01)


def test_tree_finds_the_leaf_of_each_row():
    x = np.random.default_rng(0).integers(0, 5, (500, 3)).astype(float)
    tree = Tree(x, 16)
    leaf = tree.find(x)
    assert sorted(np.concatenate(tree.rows)) == list(range(500))
    for i, rows in enumerate(tree.rows):
        assert (leaf[rows] == i).all()
    near = tree.nearest(x)
    assert (near[np.arange(500), leaf] == 0).all()
    assert len(Tree(np.ones((50, 3)), 4).rows) == 1


def test_query_recall(spark, tables):
    rows = spark.read.parquet(f"{tables}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, ids % 20 == 0, 20)
    got = answers(QUERIES["op1_projected_neighbours"](spark, tables).collect())
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    scores = {(q, i): s for q in got for i, s in got[q]}
    place = {int(k): i for i, k in enumerate(ids)}
    for (q, i), s in scores.items():
        assert s == pytest.approx(x[place[q]] @ x[place[i]], abs=1e-12)


def test_many_cells_other_norms_and_copies(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 3, (12, 16))
    x = centres[draw.integers(0, 12, 3000)] + draw.normal(0, 1, (3000, 16))
    x[500:1200] = x[3]
    x = x.astype(np.float32).astype(np.float64)
    ids = draw.permutation(3000)
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<float>")
    want = brute(ids, x, ids % 20 == 0, 20)
    got = answers(nearest_inner(df, F.col("vec_id") % 20 == 0, cell_rows=200, block_rows=150).collect())
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    hot = {int(i) for i in ids[500:1200]} | {int(ids[3])}
    for q in hot & set(got):  # of equal vectors the smallest ids, never the query itself
        top = [i for i, _ in got[q]]
        assert q not in top
        equal = [i for i in top if i in hot]
        assert equal == sorted(hot - {q})[: len(equal)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (40, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (6, [None, 1.0]), (7, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = answers(nearest_inner(df, F.col("vec_id") % 20 == 0).collect())
    assert got == {0: [(7, 2.0), (20, 0.5)], 20: [(7, 2.0), (0, 0.5)]}
    assert nearest_inner(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest_inner(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_null_and_repeated_ids(spark):
    big = 2**60
    rows = [
        (20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (None, [3.0, 1.0]), (None, [3.0, 1.0]), (None, None), (big + 1, [2.0, 0.5]),
        (big + 3, [2.0, 0.5]), (40, [1.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    found = nearest_inner(df, F.col("vec_id") % 20 == 0, k=4).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by.setdefault((r.query_id, r.rank), []).append((r.vec_id, r.score))
    flat = [(None, 3.0), (None, 3.0), (big + 1, 2.0), (big + 3, 2.0)]
    # Two equal rows ask as 20, another row asks as 20 with its own vector.
    for rank, answer in enumerate(flat, 1):
        tall = [(None, 2.0), (None, 2.0), (big + 1, 1.0), (big + 3, 1.0)][rank - 1]
        assert sorted(by[20, rank], key=str) == sorted([answer, answer, tall], key=str)
        assert by[40, rank] == [answer]
    assert len(found) == 16
    few = nearest_inner(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0, k=4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in few) == [
        (20, 1, 20, 0.0), (20, 1, 20, 1.0), (20, 1, 20, 1.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0)
    ]


def test_queries_in_chunks(spark):
    draw = np.random.default_rng(9)
    x = draw.normal(0, 1, (600, 6)).round(3)
    ids = np.arange(600)
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<double>")
    got = answers(nearest_inner(df, F.lit(True), k=5, cell_rows=100, block_rows=60, chunk_rows=16).collect())
    assert recall(got, brute(ids, x, np.ones(600, bool), 5)) >= 0.9 and len(got) == 600
