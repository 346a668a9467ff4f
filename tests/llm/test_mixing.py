import heapq
import random

import pytest
from pyspark.sql import functions as F

from tidyloom.llm.mixing import apportion, mix_sources, mixed_documents, source_targets, word_count


def highest_quotients(votes, seats):
    """One seat after the other, ties to the smaller party."""
    won = dict.fromkeys(votes, 0)
    heap = [(-v, p) for p, v in votes.items() if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, p = heapq.heappop(heap)
        won[p] += 1
        heapq.heappush(heap, (-votes[p] / (2 * won[p] + 1), p))
    return won


def water_fill(sizes):
    """Targets as the contract words them: cap, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**share, **capped}
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_apportion_equals_seat_by_seat(spark, seed):
    rnd = random.Random(seed)
    votes = {g: {p: rnd.choice([0, 5, rnd.randint(1, 3000)]) for p in range(rnd.randint(1, 9))} for g in "ab"}
    seats = {"a": rnd.randint(0, 6), "b": rnd.randint(50, 900)}
    rows = [(g, p, v, seats[g]) for g in votes for p, v in votes[g].items()]
    df = spark.createDataFrame(rows, "g string, p int, v long, k long")
    got = {(r.g, r.p): r.won for r in apportion(df, ["g"], ["p"], "v", "k", "won").collect()}
    for g in votes:
        want = highest_quotients(votes[g], seats[g])
        assert {p: got[g, p] for p in votes[g]} == want


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 3, None: 7}, {"a": 0, "b": 5}, {"x": 4}, {None: 0}, {"é": 5, "z": 900, "": 1, "b": 2},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(water_fill(sizes))


def documents(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot", "hot", "b", "c", None, ""]), "w " * rnd.randint(0, 90), 1, "kept") for i in range(400)]
    rows += [(3, "hot", "w w w", 1, "kept")] * 2 + [(None, "b", None, None, None), (900, "c", "x" * 50000 + " y", 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long, size string")


@pytest.mark.parametrize("narrow", [True, False])
def test_mix_keeps_quotas_and_limits(spark, narrow):
    docs = documents(spark)
    made = mix_sources(
        docs, word_count(F.col("text")), block_tokens=4, shard_tokens=3000, bucket_tokens=100, narrow=narrow
    )
    rows = made.collect()
    assert len(rows) == docs.count()
    if narrow:
        return
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and sum(r.takes) == r.taken
    assert target == pytest.approx(water_fill(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 4 * (1 + sizes[s] // 3000)
        assert {r.source_size for r in rows if r.source == s} == {sizes[s]}


def test_mix_repeats(spark):
    docs = documents(spark)
    runs = [
        sorted(map(str, mix_sources(d, word_count(F.col("text")), narrow=True).collect()))
        for d in (docs, docs.repartition(5))
    ]
    assert runs[0] == runs[1]


def test_mixed_rows_hold_the_words_taken(spark):
    docs = documents(spark)
    made = mixed_documents(docs)
    assert made.columns == docs.columns and made.dtypes == docs.dtypes
    words = made.agg(F.sum(word_count(F.col("text")))).first()[0]
    taken = mix_sources(docs, word_count(F.col("text"))).agg(F.sum("taken")).first()[0]
    assert words == taken


def test_empty_table(spark):
    assert mixed_documents(documents(spark).where("false")).count() == 0
