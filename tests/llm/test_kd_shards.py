import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidyloom.llm.kd_shards import kd_shards
from tidyloom.llm.queries import QUERIES

SCHEMA = "doc_id long, x double, y double, w long, c long, shard string"


def points(n, seed=0, hot=0):
    rnd = random.Random(seed)
    rows = [(i, rnd.random() * 9, rnd.gauss(0, 1), rnd.randint(1, 50), rnd.randint(0, 2**31 - 1), "s") for i in range(n)]
    return rows + [(n + i, 4.0, 0.0, 20, 77, "s") for i in range(hot)]


def shards(spark, rows, leaves=8, **other):
    df = spark.createDataFrame(rows, SCHEMA)
    dims = {"x": F.col("x"), "y": F.col("y")}
    return kd_shards(df, dims, F.col("w"), F.col("c"), leaves=leaves, **other).collect()


def reference(rows, leaves, first=0):
    """Recursive weighted-median splits over a list, on the same grid."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    dim = max((0, 1), key=lambda i: (max(r[1][i] for r in rows) - min(r[1][i] for r in rows), -i))
    rows = sorted(rows, key=lambda r: (r[1][dim], r[3]))
    goal, acc, cut = sum(r[2] for r in rows) * (leaves // 2) / leaves, 0, len(rows)
    for i, r in enumerate(rows):
        if acc + r[2] >= goal:
            cut = i + 1 if acc + r[2] - goal <= goal - acc else i
            break
        acc += r[2]
    half = leaves // 2
    return {**reference(rows[:cut], half, first), **reference(rows[cut:], leaves - half, first + half)}


@pytest.mark.parametrize("leaves", [1, 5, 8])
def test_equals_recursive_medians(spark, leaves):
    rows = points(700)
    lo = [min(r[i] for r in rows) for i in (1, 2)]
    hi = [max(r[i] for r in rows) for i in (1, 2)]
    grid = [
        (r[0], [int((r[i] - lo[i - 1]) / (hi[i - 1] - lo[i - 1]) * (2**30 - 1)) for i in (1, 2)], r[3], r[4])
        for r in rows
    ]
    want = reference(grid, leaves)
    assert {r.doc_id: r.shard for r in shards(spark, rows, leaves)} == want


def test_bytes_even_slots_gapless_groups_together(spark):
    rows = points(3000, hot=60)
    got = shards(spark, rows, 16)
    weight = {r[0]: r[3] for r in rows}
    size, slots = [0] * 16, [[] for _ in range(16)]
    for r in got:
        size[r.shard] += weight[r.doc_id]
        slots[r.shard].append(r.slot)
    mean = sum(size) / 16
    assert max(size) < 1.25 * mean and min(size) > 0.75 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert len({r.shard for r in got if r.doc_id >= 3000}) == 1


def test_a_group_larger_than_a_leaf_is_split(spark):
    rows = points(1000, hot=2000)
    got = shards(spark, rows, 8)
    weight = {r[0]: r[3] for r in rows}
    size = [sum(weight[r.doc_id] for r in got if r.shard == s) for s in range(8)]
    assert max(size) < 1.2 * sum(size) / 8


def test_target_bytes(spark):
    rows = points(500)
    total = sum(r[3] for r in rows)
    got = shards(spark, rows, None, target_bytes=total // 6 + 1)
    assert {r.shard for r in got} == set(range(6))


def test_odd_rows(spark):
    rows = [(None, None, float("nan"), None, None, None), (1, 1.0, 2.0, 3, 4, "a"), (1, 1.0, 2.0, 3, 4, "a")]
    got = shards(spark, rows, 4)
    assert len(got) == 3 and all(0 <= r.shard < 4 for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert kd_shards(empty, {"x": F.col("x")}, F.col("w"), F.col("c"), leaves=4).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_on_documents(spark, sf):
    """Whole table: sizes and checksums by hand, gapless slots, equal texts together, near equal bytes."""
    folder = f"/root/testdata/sf{sf}"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op4_kd_shards"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < 16
        by_shard[r.shard].append(r)
        by_text[texts[r.doc_id]].add(r.shard)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    mean = sum(r.size for r in rows) / 16
    sizes = [sum(r.size for r in own) for own in by_shard.values()]
    assert len(sizes) == 16 and max(abs(s - mean) for s in sizes) <= max(0.1 * mean, 1.01 * max(r.size for r in rows))
    total = defaultdict(int)
    for r in rows:
        total[texts[r.doc_id]] += r.size
    assert all(len(s) == 1 for t, s in by_text.items() if total[t] <= mean)
