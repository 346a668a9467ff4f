"""The distributed forms against plain computation on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidyloom.operators.gram import correlations
from tidyloom.operators import aggregates, chained, dedup, encode, metrics, missing, neighbors, numeric, profile, ranking, sampling
from tidyloom.operators.aggregates import exact_quantiles, order_statistics


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.lognormal(0, 1, 3000), np.full(1500, 1.25)])
    pdf = pd.DataFrame({"id": np.arange(len(v)), "v": v, "w": rng.normal(size=len(v))})
    return spark.createDataFrame(pdf).repartition(5).cache(), pdf


def test_quantiles_by_narrowing(skewed):
    df, pdf = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    gathered = exact_quantiles(df, {"v": probs, "w": probs})
    narrowed = exact_quantiles(df, {"v": probs, "w": probs}, gather_limit=10)
    assert narrowed == gathered
    for c in ("v", "w"):
        assert gathered[c] == pytest.approx(list(np.quantile(pdf[c], probs)))


def test_order_statistics_gather_only_a_little(skewed):
    df, pdf = skewed
    ordered = np.sort(pdf["v"].to_numpy())
    ks = {0, 1, 999, 2222, len(ordered) - 1}
    found = order_statistics(df, {"v": ks}, {"v": len(ordered)}, gather_limit=3)
    assert {k: found["v", k] for k in ks} == {k: ordered[k] for k in ks}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert exact_quantiles(df, {"v": [0.5]}) == {"v": [None]}


def test_ranks_of_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("k"))
    folds = sampling.assign_folds(df, "id", "k")
    sizes = folds.groupBy("k", "fold").count().toPandas()
    assert sizes.groupby("k")["count"].agg(lambda s: s.max() - s.min()).max() <= 1
    again = sampling.assign_folds(df.repartition(17), "id", "k")
    assert folds.exceptAll(again).count() == 0


def test_caps(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 10, "rare").otherwise("usual").alias("k"))
    capped = sampling.stratified_cap(df, "k", "id", 100)
    assert {r["k"]: r["count"] for r in capped.groupBy("k").count().collect()} == {"rare": 1, "usual": 99}
    assert sampling.plain_cap(df, "id", 37).count() == 37
    assert sampling.plain_cap(df, "id", 5000).count() == 1000


def test_global_positions(spark):
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(777)], "v string").repartition(9)
    got = ranking.global_row_number(df, [F.asc("v")], "pos").toPandas().sort_values("v")
    assert list(got["pos"]) == list(range(777))


def test_large_vocabulary_matches_the_small_one(spark, monkeypatch):
    df = spark.range(500).select("id", F.concat(F.lit("k"), F.col("id") % 83).alias("k"))
    small = encode.apply_encoding(df, encode.fit_encoding(df, {"k": "ordinal"}))
    rare = encode.apply_rare(df, encode.fit_rare(df, ["k"], min_abs=6, min_pct=0))
    monkeypatch.setattr(encode, "DRIVER_LIMIT", 20)
    large = encode.apply_encoding(df, encode.fit_encoding(df, {"k": "ordinal"}))
    assert small.exceptAll(large).count() == 0
    assert rare.exceptAll(encode.apply_rare(df, encode.fit_rare(df, ["k"], min_abs=6, min_pct=0))).count() == 0
    wide = encode.apply_encoding(df, encode.fit_encoding(df, {"k": "one_hot"}))
    code = {r["id"]: int(r["k__ord"]) for r in small.collect()}
    assert all(list(r["k__codes"].indices) == [code[r["id"]]] for r in wide.collect())


# ---------------------------------------------------------------- chained imputation
def _gaps(n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(10, 2, n)
    data = np.column_stack([x, 3 * x + rng.normal(0, 0.5, n), rng.normal(size=n) - x, rng.normal(50, 9, n)])
    holes = rng.random(data.shape) < [0.1, 0.2, 0.05, 0.0]
    data[holes] = np.nan
    return data


def _row_by_row(data, rounds):
    """Chained rounds over the full matrix, one regression after the other."""
    means = np.nanmean(data, axis=0)
    gaps = np.isnan(data)
    x = np.where(gaps, means, data) - means
    p = data.shape[1]
    for _ in range(rounds):
        for j in sorted(range(p), key=lambda i: (gaps[:, i].sum(), i)):
            others = [i for i in range(p) if i != j]
            seen = ~gaps[:, j]
            z = np.column_stack([np.ones(seen.sum()), x[seen]])
            coef, icept = chained.bayesian_ridge(z.T @ z, j + 1, [i + 1 for i in others])
            x[gaps[:, j], j] = icept + x[np.ix_(gaps[:, j], others)] @ coef
    return x + means


def test_bayesian_ridge_on_plenty_of_data_is_least_squares():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 2))
    y = 1.5 + x @ [2.0, -3.0] + rng.normal(0, 0.1, 5000)
    z = np.column_stack([np.ones(5000), x, y])
    coef, icept = chained.bayesian_ridge(z.T @ z, 3, [1, 2])
    assert coef == pytest.approx([2.0, -3.0], abs=1e-2) and icept == pytest.approx(1.5, abs=1e-2)


@pytest.mark.parametrize("limit", [512, 0])
def test_chained_matches_the_rounds_on_rows(spark, limit):
    data = _gaps()
    cols = ["a", "b", "c", "d"]
    pdf = pd.DataFrame(data, columns=cols)
    pdf.insert(0, "id", np.arange(len(pdf)))
    df = spark.createDataFrame(pdf)
    df = df.select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols]).repartition(4)
    state = chained.fit_chained(df, cols, rounds=3, tol=0.0, max_patterns=limit)
    want = _row_by_row(data, 3)
    for closed in (True, False):
        got = chained.apply_chained(df, state, closed_form=closed).toPandas().sort_values("id")[cols]
        assert np.allclose(got.to_numpy(), want, rtol=1e-6, atol=1e-6)


def test_chained_stops_alike_on_both_ways(spark):
    data = _gaps()
    cols = ["a", "b", "c", "d"]
    pdf = pd.DataFrame(data, columns=cols)
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    for tol in (1e-3, 0.05, 1.0):
        one, other = (chained.fit_chained(df.repartition(3), cols, tol=tol, max_patterns=n) for n in (512, 0))
        assert len(one["steps"]) == len(other["steps"])
        for (j, icept, coef), (k, icept2, coef2) in zip(one["steps"], other["steps"]):
            assert j == k and icept == pytest.approx(icept2, abs=1e-9) and coef == pytest.approx(coef2, abs=1e-9)
    assert len(one["steps"]) < 40


def test_chained_reads_the_rows_once_for_many_patterns(spark):
    """Statistics and pattern sums: two passes, however many rounds and columns."""
    rng = np.random.default_rng(7)
    n, cols = 4000, [f"x{i}" for i in range(12)]
    data = rng.normal(size=(n, 3)) @ rng.normal(size=(3, 12)) + rng.normal(0, 0.1, (n, 12))
    data[rng.random((n, 12)) < 0.3] = np.nan
    assert len(np.unique(np.isnan(data), axis=0)) > 512
    df = spark.createDataFrame(pd.DataFrame(data, columns=cols))
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols]).repartition(6)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    counted = df.mapInArrow(count, df.schema)
    state = chained.fit_chained(counted, cols, rounds=2, tol=0.0)
    assert read.value == 2 * n and state["maps"] is None
    few = chained.fit_chained(df, cols, rounds=2, tol=0.0, max_patterns=100_000)
    assert len(state["steps"]) == len(few["steps"]) == 24
    for (j, icept, coef), (k, icept2, coef2) in zip(state["steps"], few["steps"]):
        assert j == k and icept == pytest.approx(icept2, abs=1e-8) and coef == pytest.approx(coef2, abs=1e-8)


def test_chained_fills_patterns_never_seen(spark):
    train = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0), (4.0, 8.1)], "a double, b double")
    state = chained.fit_chained(train, ["a", "b"])
    out = chained.apply_chained(spark.createDataFrame([(None, 6.0), (None, None)], "a double, b double"), state)
    rows = out.collect()
    assert rows[0]["a"] == pytest.approx(3.0, abs=0.3)
    assert all(v is not None for r in rows for v in r)


# ---------------------------------------------------------------- neighbours
def _brute(q, t, k, skip_self=False):
    d = np.sqrt(((q[:, None, :] - t[None, :, :]) ** 2).sum(-1))
    if skip_self:
        np.fill_diagonal(d, np.inf)
    return [list(np.lexsort((np.arange(len(t)), row))[:k]) for row in d]


@pytest.mark.parametrize("skip_self", [False, True])
def test_nearest_with_a_hot_vector(spark, skip_self):
    rng = np.random.default_rng(11)
    t = rng.normal(size=(300, 3))
    t[100:200] = t[7]  # a third of the table is one vector
    rows = [(i, list(map(float, v)), i % 4) for i, v in enumerate(t)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int").repartition(6)
    got = neighbors.knn_join(
        df, df, 4, "id", "id", "v", "v", "y", skip_self=skip_self, n_pivots=9, block_rows=25, chunk_rows=40
    ).toPandas()
    want = _brute(t, t, 4, skip_self)
    for i, ids in enumerate(want):
        mine = got[got["qid"] == i].sort_values(["distance", "tid"])
        assert list(mine["tid"]) == ids
        assert list(mine["payload"]) == [j % 4 for j in ids]


def _mixed_vectors(n):
    """Two numbers and a category of 20 values as ones and zeros, with some equal rows."""
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 20, n)
    x = np.column_stack([rng.uniform(-1.7, 1.7, (n, 2)), np.eye(20)[kind]])
    x[::50] = x[3]
    return x


def test_nearest_visits_few_cells_of_mixed_rows(spark, monkeypatch):
    x, visited, spread = _mixed_vectors(3000), [], neighbors._spread
    rows = [(i, list(map(float, v)), i % 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int").repartition(6).persist()
    train, test = df.where("id % 5 > 0"), df.where("id % 5 = 0")

    def counted(visits, *rest):
        visited.append(visits.count())
        return spread(visits, *rest)

    monkeypatch.setattr(neighbors, "_spread", counted)
    got = neighbors.knn_join(test, train, 5, "id", "id", "v", "v", "y", n_pivots=60).toPandas()
    assert sum(visited) < 600 * 60 / 4
    ids = np.array([i for i in range(3000) if i % 5])
    for i, near in enumerate(_brute(x[::5], x[ids], 5)):
        mine = got[got["qid"] == 5 * i].sort_values(["distance", "tid"])
        assert list(mine["tid"]) == list(ids[near])
    df.unpersist()


def _worker_memory(spark):
    """MB that the largest of the workers has held at once so far."""
    def peak(batches):
        import resource

        for _ in batches:
            pass
        yield pd.DataFrame({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]})

    return spark.range(0, 64, 1, 64).mapInPandas(peak, "mb double").agg(F.max("mb")).first()[0]


def test_nearest_sends_visits_in_small_pieces(spark):
    """Directions without clusters: every query visits every cell, a worker holds few of the copies."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    rows = [(i, list(map(float, v)), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int").coalesce(1).persist()
    df.count()
    before = _worker_memory(spark)
    got = neighbors.knn_join(df, df, 3, "id", "id", "v", "v", "y", skip_self=True, n_pivots=400)
    assert got.count() == 4500
    assert _worker_memory(spark) - before < 250
    df.unpersist()


def test_nearest_with_repeated_and_missing_query_keys(spark):
    t = spark.createDataFrame([(i, [float(i % 7), float(i)], i) for i in range(90)], "id long, v array<double>, y int")
    q = spark.createDataFrame([(1, [0.0, 3.0]), (1, [2.0, 70.0]), (None, [1.0, 40.0])], "id long, v array<double>")
    got = neighbors.knn_join(q, t, 3, "id", "id", "v", "v", "y", n_pivots=9, block_rows=7).toPandas()
    x = np.array([[i % 7, i] for i in range(90)], float)
    d = [np.sqrt(((x - p) ** 2).sum(1)) for p in ([0, 3], [2, 70], [1, 40])]
    for mine, want in ((got[got["qid"] == 1], np.concatenate(d[:2])), (got[got["qid"].isna()], d[2])):
        assert sorted(mine["distance"]) == pytest.approx(np.sort(want)[:3])


def test_vote_ties_take_the_smallest_class(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c")], "qid int, payload string")
    assert neighbors.knn_vote(df).collect()[0]["prediction"] == "a"


def test_knn_impute_by_patterns_of_gaps(spark, monkeypatch):
    """Groups that share columns are joined; the fills are those of all pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    x[:, :2][rng.random((400, 2)) < 0.2] = np.nan
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(4)
    want = neighbors.knn_impute(df, "id", ["a", "b", "c"]).toPandas().sort_values("id").to_numpy()

    def refused(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(neighbors, "_top_nan_euclidean", refused)
    got = neighbors.knn_impute(df, "id", ["a", "b", "c"], block_rows=50, chunk_rows=50)
    assert got.toPandas().sort_values("id").to_numpy() == pytest.approx(want)


def test_knn_impute_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    x[rng.random(x.shape) < 0.15] = np.nan
    cols = ["a", "b", "c"]
    df = spark.createDataFrame(
        [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
        "id long, a double, b double, c double",
    )
    got = neighbors.knn_impute(df, "id", cols, 5).toPandas().sort_values("id")[cols].to_numpy()
    want = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x))):
        pairs = []
        for t in np.flatnonzero(~np.isnan(x[:, j])):
            both = ~np.isnan(x[i]) & ~np.isnan(x[t])
            if both.any():
                gap = (x[i, both] - x[t, both]) ** 2
                pairs.append((math.sqrt(gap.sum() * 3 / both.sum()), t))
        near = sorted(pairs)[:5]
        want[i, j] = np.mean([x[t, j] for _, t in near]) if near else np.nanmean(x[:, j])
    assert np.allclose(got, want)


def test_held_out_rows_take_nothing_from_held_out_rows(spark):
    from tidyloom.plans.preparation import apply_preparation, fit_preparation

    train = spark.createDataFrame([(i, float(i), float(2 * i)) for i in range(30)], "id long, a double, b double")
    state = fit_preparation(train, {"missing_num": "knn"}, ["id"], "id")

    def filled(other):
        test = spark.createDataFrame([(100, 7.0, None), (101, 7.0, other)], "id long, a double, b double")
        rows = apply_preparation(test, state, ["id"]).collect()
        return {r["id"]: list(r["features"]) for r in rows}[100]

    assert filled(900.0) == filled(-900.0) == [7.0, 14.0]


# ---------------------------------------------------------------- numbers
def test_more_distinct_is_exact(spark):
    df = spark.range(500).select(F.lit(1.5).alias("one"), (F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"), "id")
    assert numeric.more_distinct(df, ["one", "ten", "eleven", "id"], 10) == {"eleven", "id"}


def test_yeo_johnson_lambda_is_the_likelihood_maximum(spark):
    rng = np.random.default_rng(4)
    v = rng.lognormal(0, 0.8, 2000) - 0.5
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    lam = numeric.fit_yeo_johnson(df, ["v"])["v"]

    def likelihood(lm):
        up, down = np.maximum(v, 0) + 1, 1 - np.minimum(v, 0)
        pos = (up**lm - 1) / lm if lm else np.log(up)
        neg = -(down ** (2 - lm) - 1) / (2 - lm) if lm != 2 else -np.log(down)
        y = np.where(v >= 0, pos, neg)
        return -len(v) / 2 * np.log(y.var()) + (lm - 1) * np.sum(np.sign(v) * np.log1p(np.abs(v)))

    grid = np.arange(lam - 0.5, lam + 0.5, 0.001)
    assert abs(grid[np.argmax([likelihood(g) for g in grid])] - lam) < 2e-3


def test_kmeans_bins_rest(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(m, 0.3, 300) for m in (0, 5, 20)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    state = numeric.fit_bins(df, ["v"], 3, "kmeans")
    low, high = state["columns"]["v"]["edges"]
    assert 1.5 < low < 3.5 and 11 < high < 14


def test_skew_matches_the_sample_form(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    from tidyloom.functions.scalar import sample_skew

    assert df.agg(sample_skew(F.col("v"))).first()[0] == pytest.approx(pd.Series([1, 2, 3, 10]).skew())


def test_correlation_filter_is_not_greedy_and_survives_constants(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("a"),
        (F.col("id") * 2.0).alias("b"),
        (F.col("id") * 3.0 + 1).alias("c"),
        F.lit(1.0).alias("flat"),
        F.when(F.col("id") > 40, F.col("id").cast("double")).alias("holes"),
    )
    assert numeric.correlated(df, df.columns) == ["b", "c", "holes"]
    drops = numeric.select_features(df, ["a"])
    assert drops[0] == {"column": "a", "reason": "explicit"}
    assert {"column": "flat", "reason": "variance"} in drops


def test_correlations_of_a_wide_table_in_one_scan(spark, tmp_path):
    """Pairwise-complete over 200 columns with gaps, large offsets and constants."""
    rng = np.random.default_rng(3)
    n, p = 500, 200
    data = rng.normal(size=(n, 8)) @ rng.normal(size=(8, p)) + rng.normal(size=(n, p))
    data = data * 10.0 ** rng.integers(-3, 4, p) + 10.0 ** rng.integers(0, 7, p)
    data[rng.random((n, p)) < 0.2] = np.nan
    data[:, 5], data[:, 6], data[3:, 7] = 0.1, np.nan, np.nan
    cols = [f"v {i}.x" for i in range(p)]
    pdf = pd.DataFrame(data, columns=cols)
    path = str(tmp_path / "wide")
    df = spark.createDataFrame(pdf)
    df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) for c in cols]).repartition(7).write.parquet(path)
    df = spark.read.parquet(path)
    found = correlations(df, cols)
    assert found._jdf.queryExecution().simpleString().count("FileScan") == 1
    got = {(r["x"], r["y"]): r for r in found.collect()}
    assert len(got) == p * (p - 1) // 2
    want, present = pdf.corr().to_numpy(), pdf.notna().to_numpy().astype(int)
    both = present.T @ present
    for (x, y), r in got.items():
        assert r["n"] == both[x, y]
        if {x, y} & {5, 6} or both[x, y] < 2:
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(want[x, y], abs=1e-7)
    near = {(r["x"], r["y"]) for r in correlations(df, cols, at_least=0.9).collect()}
    assert near == {k for k, r in got.items() if r["corr"] is not None and abs(r["corr"]) > 0.9}
    later = {cols[y] for _, y in near}
    assert numeric.correlated(df, cols, 0.9) == [c for c in cols if c in later]
    assert correlations(df.limit(0), cols).collect() == []


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    s = np.round(y * 0.3 + rng.random(400), 1)
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, s)], "cls int, positive int, score double")
    wins = sum((a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0])
    want = wins / ((y == 1).sum() * (y == 0).sum())
    assert metrics.one_vs_rest_auc(df).first()["roc_auc"] == pytest.approx(want)


def test_results_do_not_depend_on_partitioning(spark):
    pdf = pd.DataFrame({"id": range(500), "s": [f"c{i % 7}" for i in range(500)], "v": [i % 13 * 1.5 for i in range(500)]})
    one, many = (spark.createDataFrame(pdf).repartition(n) for n in (1, 17))
    for fit in (
        lambda d: missing.fit_mode(d, ["s"]),
        lambda d: numeric.outlier_bounds(d, ["v"]),
        lambda d: encode.fit_encoding(d, {"s": "ordinal"})["columns"],
        lambda d: numeric.fit_bins(d, ["v"]),
    ):
        assert fit(one) == fit(many)
    a, b = (profile.profile_columns(d) for d in (one, many))
    assert a.exceptAll(b).count() == 0


# ---------------------------------------------------------------- no size switches
def _wide(spark, n):
    return spark.range(3 * n).select(
        "id", F.concat(F.lit("word"), F.col("id") % n).alias("word"), (F.col("id") % 7).cast("double").alias("x"),
        (F.col("id") % n * 0.01 + F.col("id") % 7).alias("y"),
    )


def test_one_hot_of_a_wide_vocabulary(spark):
    from tidyloom.plans import PlanCleaner

    df = _wide(spark, 5000)
    plan = {"actions": [{"action": "encode_categorical", "params": {"method": "one_hot", "columns": ["word"]}}]}
    model = PlanCleaner(plan, carry=["id"]).fit(df)
    new = spark.createDataFrame([(1, "word17", 0.0, 0.0), (2, "never seen", 0.0, 0.0)], df.schema)
    rows = {r["id"]: r for r in model.transform(new).collect()}
    name = next(c for c in model.columns if "word" in c)
    assert rows[1][name].size == 5000 and rows[1][name].numNonzeros() == 1
    assert rows[2][name].numNonzeros() == 0


def test_cross_validation_with_a_wide_text_column(spark):
    from tidyloom.plans.evaluate import cross_validate

    row = cross_validate(_wide(spark, 1200), "id", "y", "regression", None, "ridge", folds=2).first()
    assert row["r2"] > 0.5


def test_eager_one_hot_has_no_upper_limit(spark):
    df = _wide(spark, 1010)
    out, diff, _ = encode.encode_categorical(df, {"columns": ["word"], "method": "one_hot", "max_categories": 2000}, False)
    assert len(diff["created_columns"]) == 1010 and len(out.columns) == 3 + 1010


def test_large_vocabulary_codes_with_a_hot_value(spark):
    df = _wide(spark, 1100).withColumn("word", F.when(F.col("id") % 3 == 0, "word5").otherwise(F.col("word")))
    frame = encode.code_frame(df, "word")
    got = encode.with_codes(df, "word", frame, "code")
    assert got.count() == df.count()
    want = {r["value"]: r["code"] for r in frame.collect()}
    assert all(r["code"] == want[r["word"]] for r in got.collect())


def test_only_frequent_values_of_a_vocabulary_are_dealt_out(spark):
    """Rows that the coded side brings to the join: one a value, more for a frequent one."""
    df = _wide(spark, 1100).withColumn("word", F.when(F.col("id") % 3 == 0, "word5").otherwise(F.col("word")))
    frame = encode.code_frame(df, "word")
    explodes = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            explodes.add(b.num_rows)
            yield b

    right = encode.dealt_codes(frame, "code").select("__value", "code", "__salt")
    right.mapInArrow(count, right.schema).count()
    n = frame.count()
    assert explodes.value == n - 1 + encode.SALTS
    plain = _wide(spark, 1100)
    assert encode.dealt_codes(encode.code_frame(plain, "word"), "code").count() == plain.select("word").distinct().count()


def test_findings_list_everything(spark):
    from tidyloom.operators.findings import flag_constant_features

    df = spark.range(5).select("id", *[F.lit(i).alias(f"c{i}") for i in range(30)])
    found = flag_constant_features(df, "id")
    assert "c29" in str(found)


def test_missing_classes_are_left_out_below_and_above_the_cap(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 2).alias("y"))
    for cap in (1000, 60, 30):
        assert sampling.stratified_cap(df, "y", "id", cap).where("y is null").count() == 0


def test_running_counts_over_slices(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") % 777).alias("v"), F.lit(1).alias("n"))
    points = df.groupBy("g", "v").agg(F.sum("n").alias("n"))
    rows = ranking.running_counts(points, ["g"], "v", ["n"]).collect()
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["v"]):
            assert r["n_before"] == total
            total += r["n"]
        assert total == 1000


def test_checkpoints_need_a_shared_folder_off_local():
    from types import SimpleNamespace

    from tidyloom.session import ensure_checkpoint_dir

    context = SimpleNamespace(
        getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077", setCheckpointDir=print
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context))


def test_infrastructure_errors_stop_a_plan(spark, monkeypatch):
    from tidyloom.plans import run_plan
    from tidyloom.plans.runner import EAGER

    def lost(*_):
        raise ConnectionError("executor lost")

    monkeypatch.setitem(EAGER, "deduplicate", lost)
    with pytest.raises(ConnectionError):
        run_plan(spark.range(3), {"actions": [{"action": "deduplicate"}]}, audit=False)


# ---------------------------------------------------------------- values by digest
def test_values_found_by_digest(spark, monkeypatch):
    """Long, alike, tied, unique and missing values: the same as from the values themselves."""
    monkeypatch.setattr(aggregates, "FETCH_LIMIT", 5)
    rng = np.random.default_rng(5)
    long = [f"https://example.org/a/very/long/path/{i:04d}" for i in range(60)]
    rows = []
    for i in range(400):
        rows.append((
            long[i % 60], f"row {i:05d} " * 20, ["b", "a", "é", "Ünder", "𝔄"][int(rng.integers(5))], None if i % 3 else long[i % 7],
            float(rng.integers(30)), None, "x" * 40 if i % 2 else "y" * 40, i % 2 == 0,
        ))
    df = spark.createDataFrame(rows, "url string, text string, `k.1` string, gaps string, n double, void string, two string, flag boolean")
    cols = df.columns
    digests = aggregates.digest_counts(df, cols)
    counts = {}
    for r in aggregates.value_counts(df, cols).where("value IS NOT NULL").collect():
        counts.setdefault(r["column"], {})[r["value"]] = r["n"]
    figures = {r["column"]: (r["n_unique"], r["top_count"], r["n_values"]) for r in aggregates.value_figures(digests).collect()}
    assert figures == {c: (len(v), max(v.values()), sum(v.values())) for c, v in counts.items()}
    order = lambda v: v.encode()
    for k in (1, 3, 8):
        small = aggregates.smallest_values(df, digests, cols, k)
        assert small == {c: sorted(counts.get(c, {}), key=order)[:k] for c in cols}
    top = aggregates.top_values(df, digests, cols)
    assert top == {c: min(v.items(), key=lambda x: (-x[1], order(x[0]))) for c, v in counts.items()}
    plan = spark._jvm.PythonSQLUtils.explainString(digests._jdf.queryExecution(), "formatted")
    moved = [part for part in plan.split("\n\n") if ") Exchange" in part]
    assert moved and not any("value#" in part for part in moved)


def test_duplicate_rows_by_digest(spark):
    rows = [(None, "a"), ("a", None), ("a", None), (None, None), (None, None), (None, None), ("a", "a"), ("aa", ""), ("a", "a")]
    df = spark.createDataFrame(rows, "x string, `y.z` string")
    assert dedup.duplicate_row_count(df).first()["duplicate_rows"] == 4


@pytest.mark.parametrize("method", ["mean", "median", "chained"])
def test_imputation_errors_at_all_rates(spark, method):
    """Each column and rate by itself: gaps injected, the table fitted and filled."""
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (300, 2))
    data = np.column_stack([base[:, 0] * 3 + 1e4, base @ [1, 2] + rng.normal(0, 0.1, 300), rng.exponential(2, 300)])
    pdf = pd.DataFrame(data, columns=["a", "b", "c d"])
    pdf.insert(0, "id", np.arange(300))
    df = spark.createDataFrame(pdf).repartition(5)
    cols, rates = ["a", "b", "c d"], [0.2, 0.01, 0.1]
    got = {(r["column"], r["missing_rate"]): r for r in sampling.imputation_errors(df, cols, "id", rates, method).collect()}
    assert len(got) == 9
    for c in cols:
        for rate in rates:
            gaps = sampling.inject_missing(df, c, "id", rate)
            if method == "chained":
                filled = chained.apply_chained(gaps, chained.fit_chained(gaps, cols), closed_form=True)
            else:
                filled = missing.fill(gaps, missing.fit_center(gaps, [c], method))
            assert got[c, rate]["n_injected"] == int(300 * rate)
            assert got[c, rate]["mae"] == pytest.approx(sampling.imputation_error(filled, c), rel=1e-6)
    with pytest.raises(ValueError):
        sampling.imputation_errors(df, cols, "id", rates, "guess")


def test_lambda_from_cells(spark):
    """Skewed, shifted, negative, repeated and nearly constant columns against the rows themselves, in one scan."""
    rng = np.random.default_rng(12)
    n = 3000
    data = {
        "exp": rng.exponential(5, n), "log": np.exp(rng.normal(0, 1.5, n)), "neg": -np.exp(rng.normal(1, 1, n)), "both": rng.normal(0.5, 2, n) ** 3,
        "far": 1e6 + rng.gamma(2.0, 2.0, n), "few": rng.integers(0, 4, n).astype(float) ** 3, "low": rng.beta(5, 1, n),
    }
    pdf = pd.DataFrame(data)
    df = spark.createDataFrame(pdf).repartition(6)
    df = df.withColumn("exp", F.when(F.col("few") != 1, F.col("exp")))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = numeric.fit_yeo_johnson(df.mapInArrow(count, df.schema), list(data))
    assert read.value == n

    def exact(x, lam):
        up, down = np.maximum(x, 0) + 1, 1 - np.minimum(x, 0)
        pos = np.log(up) if abs(lam) < 1e-12 else np.expm1(lam * np.log(up)) / lam
        neg = -np.log(down) if abs(2 - lam) < 1e-12 else -np.expm1((2 - lam) * np.log(down)) / (2 - lam)
        t = np.where(x >= 0, pos, neg)
        return -0.5 * len(x) * math.log(t.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    for c, x in data.items():
        x = x[data["few"] != 1] if c == "exp" else x
        cells = numeric.log_cells(df, [c])[c]
        # Far out, transforms below 0.5 differ by less than doubles can tell.
        for lam in (0.5, 1.0, 2.0, 3.1) if c == "far" else (-2.0, -0.3, 0.0, 0.5, 1.0, 2.0, 3.1):
            assert numeric.yeo_johnson_likelihood(cells, lam) == pytest.approx(exact(x, lam), rel=1e-7, abs=1e-3), (c, lam)
        if c == "far":  # its maximum is beyond what doubles can tell
            assert math.isfinite(got[c])
            continue
        slope = (exact(x, got[c] + 1e-4) - exact(x, got[c] - 1e-4)) / 2e-4
        bend = (exact(x, got[c] + 1e-2) - 2 * exact(x, got[c]) + exact(x, got[c] - 1e-2)) / 1e-4
        assert abs(slope / bend) < 2e-6, c
    assert numeric.fit_yeo_johnson(df.limit(0), ["exp"]) == {"exp": 0.0}


def test_difference_of_tables_by_digest(spark):
    rows = [(i, f"t{i % 5}", None if i % 4 else i * 1.5) for i in range(200)] + [(7, "again", 1.0), (7, "more", None), (None, "x", 1.0)]
    a = spark.createDataFrame(rows, "id long, `s.t` string, v double")
    b = a.withColumn("s.t", F.when(F.col("id") % 50 == 3, "new").otherwise(F.col("`s.t`"))).withColumn("v", F.when(F.col("id") != 8, F.col("v")))
    b = b.where("id IS NULL OR id != 20").withColumn("w", F.lit(1))

    def plain(x, y):
        both = x.alias("x").join(y.alias("y"), F.col("x.id") == F.col("y.id")).collect()
        return {"s.t": sum(r[1] != r[4] for r in both), "v": sum(r[2] != r[5] for r in both)}

    got = {r["column"]: r["changed_cells"] for r in profile.cell_diff(a, b, "id").collect()}
    assert got == plain(a, b.select("id", "`s.t`", "v")) and min(got.values()) > 0
    one = a.dropDuplicates(["id"])
    assert {r["changed_cells"] for r in profile.cell_diff(one, one, "id").collect()} == {0}
    assert profile.cell_diff(one.select("id"), one, "id").count() == 0
    assert {r["changed_cells"] for r in profile.cell_diff(one, one.where("id < 0"), "id").collect()} == {0}
