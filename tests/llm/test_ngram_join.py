import random
import re

import numpy as np
import pytest

from tidyloom.llm.ngram_join import choose_bands, components, forest, intersections, ngram_join
from tidyloom.llm.queries import QUERIES


def grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Class and number of links of each row, by all pairs."""
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    first = {}
    for i, (k, _) in enumerate(rows):
        first.setdefault(find(i), []).append(k)
    low = {r: (None if None in ks else min(ks)) for r, ks in first.items()}
    return sorted(((k, low[find(i)], links[i]) for i, (k, _) in enumerate(rows)), key=str)


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.95, 0.99)):
        bands, rows = choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128
    with pytest.raises(ValueError):
        choose_bands(0.01, 0.999)


def test_intersections():
    rnd = random.Random(0)
    sets = [np.unique(np.array([rnd.randint(0, 6000) for _ in range(rnd.randint(0, 3000))], np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = intersections(sets)
    for i in range(12):
        for j in range(12):
            if i != j:
                assert got[i, j] == want[i][j]


def test_forest_and_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    kept = forest(500, np.array(edges))
    low = {}
    for pairs in (edges, kept):
        root = list(range(500))
        for _ in range(500):
            before = list(root)
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
            if before == root:
                break
        low[len(pairs)] = root
    assert len(set(map(tuple, low.values()))) == 1
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == low[len(edges)][i] for i in range(500))


def variants(rnd, n, length=120, change=0.01):
    base = [f"w{rnd.randint(0, 999)}" for _ in range(length)]
    return [" ".join(f"x{rnd.randint(0, 999)}" if rnd.random() < change else w for w in base) for _ in range(n)]


def test_groups_copies_and_blocks(spark):
    rnd = random.Random(7)
    texts = variants(rnd, 60) + variants(rnd, 20, 40, 0.02) + ["same words in a copy"] * 25 + ["Same, words in a copy!"]
    texts += ["", None, "one", "one", "two words", " ".join(f"q{i}" for i in range(20_000))]
    rows = [(i * 3 + 5, t) for i, t in enumerate(texts)] + [(None, texts[0]), (8, texts[1]), (8, texts[1])]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, class_id int").repartition(6)
    want = brute(rows)
    for block in (256, 7):
        got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join(df, block=block).collect()), key=str)
        assert got == want


def test_keys_of_several_texts(spark):
    """Repeated and NULL keys stand for unlike texts, some of them near-copies of others."""
    rnd = random.Random(11)
    groups = [variants(rnd, 6) for _ in range(8)]
    rows = [(rnd.choice([None, None, 4, 9]), t) for g in groups for t in g] + [(k, t) for k, t in zip(range(20, 28), map(min, groups))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join(df).collect()), key=str)
    assert got == brute(rows)


def test_query_against_all_pairs(spark, tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in QUERIES["op7_ngram_join"](spark, tables).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
