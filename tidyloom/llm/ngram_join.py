"""Similarity join of documents on word n-grams by MinHash banding.

A document is the set of its word 5-grams (words in lower case without marks; a
shorter text is one gram, a text without words the empty set). Bands and rows
are chosen for a target recall at the threshold. Documents with the same set are
one class member from the start. Band hashes are shuffled; a bucket of many
members is split into blocks and its pairs of blocks dealt out, so no task holds
a whole bucket. A pair is verified in the first band in which it meets, on the
full sets of 64-bit gram hashes. Only counts of links and a spanning forest leave
a task, never all pairs of a group; classes are the connected components.

NULL texts count as empty, repeated rows are members of their own, a NULL key is
kept, empty tables give no rows, other columns are ignored. Grams are taken from
whole texts; there is no limit on partners or candidates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import col
from tidyloom.session import cut_lineage

WORDS = re.compile(r"\w+")
BLOCK = 256
CHUNK = 4096
NO_KEY = -(2**63)


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """``(bands, rows)``: the most rows for which enough bands stay affordable."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall within the allowed hashes")
    return best


# --- sets and signatures -----------------------------------------------------------------


class Grams:
    """Sets of hashed word n-grams; word hashes are remembered in a worker."""

    def __init__(self, n: int, cache: int = 200_000):
        self.n, self.cache = n, cache
        self.known: dict[str, int] = {}

    def _codes(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > self.cache:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct gram hashes."""
        words = WORDS.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint64)
        code = self._codes(words)
        n = min(self.n, len(code))
        with np.errstate(over="ignore"):
            grams = np.full(len(code) - n + 1, n, np.uint64)
            for i in range(n):
                grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + code[i : len(code) - n + 1 + i])
        return np.unique(grams)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def band_hashes(grams: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band, from the minima of ``len(a)`` hash functions."""
    with np.errstate(over="ignore"):
        low = np.full(len(a), np.uint64(2**64 - 1))
        for i in range(0, len(grams), CHUNK):
            part = grams[None, i : i + CHUNK] * a[:, None]
            part += b[:, None]
            low = np.minimum(low, part.min(1))
        rows = (low >> np.uint64(16)).reshape(bands, -1)
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for r in rows.T:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + r)
    return out


_GRAMS: dict[int, Grams] = {}


def worker_grams(n: int) -> Grams:
    return _GRAMS.setdefault(n, Grams(n))


def set_id(grams: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return np.uint64(xxh3_64_intdigest(grams.tobytes())).astype(np.int64).item()


def signatures(rows: DataFrame, n: int, bands: int, per_band: int, seed: int) -> DataFrame:
    """``id, mark, sid, size, bands`` for rows of ``id, text, mark``."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 2**64, bands * per_band, np.uint64, endpoint=False) | np.uint64(1)
    b = draw.integers(0, 2**64, bands * per_band, np.uint64, endpoint=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = worker_grams(n)
        for batch in batches:
            sid, size, hashes = [], [], []
            for text in batch.column(1):
                g = grams.of(text.as_py())
                sid.append(set_id(g))
                size.append(len(g))
                hashes.append(band_hashes(g, a, b, bands).view(np.int64))
            flat = pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64))
            ends = pa.array(np.arange(0, bands * len(sid) + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sid, pa.int64()), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(ends, flat)],
                ["id", "mark", "sid", "size", "bands"],
            )

    return rows.mapInArrow(run, "id bigint, mark bigint, sid bigint, size bigint, bands array<bigint>")


def gram_sets(rows: DataFrame, n: int) -> DataFrame:
    """``sid, grams`` (little-endian 64-bit hashes) for rows of ``sid, text`` whose text has this set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = worker_grams(n)
        for batch in batches:
            sids, texts = batch.columns
            for i in range(0, len(texts), 256):
                found = [(s, grams.of(t.as_py())) for s, t in zip(sids[i : i + 256].to_pylist(), texts[i : i + 256])]
                found = [(s, g.tobytes()) for s, g in found if set_id(g) == s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in found], pa.int64()), pa.array([g for _, g in found], pa.binary())], ["sid", "grams"]
                )

    return rows.mapInArrow(run, "sid bigint, grams binary")


# --- pairs inside a block pair -----------------------------------------------------------


def owned(bands: np.ndarray, band: int) -> np.ndarray:
    """Pairs that meet in this band and in none before, as a boolean matrix."""
    m = len(bands)
    met = np.zeros((m, m), bool)
    for k in range(band):
        met |= bands[:, k][:, None] == bands[:, k][None, :]
    return ~met


def candidate_pairs(side: np.ndarray, bands: np.ndarray, band: int, same_block: bool) -> np.ndarray:
    """Upper triangle of the pairs this block pair is responsible for."""
    pairs = owned(bands, band)
    pairs &= np.tri(len(side), k=-1, dtype=bool).T
    if not same_block:  # pairs inside one block belong to that block's own pair
        pairs &= side[:, None] != side[None, :]
    return pairs


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from columns of shared grams."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    if not len(column):
        return out.astype(np.int64)
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + CHUNK, CHUNK))
    total = np.zeros((m, m), np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        if a == b:
            continue
        grid = np.zeros((m, CHUNK), np.float32)
        grid[owner[a:b], column[a:b] % CHUNK] = 1
        total += (grid @ grid.T).astype(np.int64)
    return total


def forest(m: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the linked pairs."""
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def linked(table: pa.Table, band: int, same_block: bool, threshold: float) -> pa.Table:
    """Links of a block pair: counts per member, and a spanning forest."""
    sid = table.column("sid").to_numpy()
    side = table.column("block").to_numpy()
    copies = table.column("copies").to_numpy()
    bands = matrix(table.column("bands"))
    sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
    size = np.array([len(s) for s in sets])
    wanted = candidate_pairs(side, bands, band, same_block)
    both = intersections(sets)
    either = size[:, None] + size[None, :] - both
    link = wanted & (both >= threshold * either - 1e-9) & (either > 0)
    link |= link.T
    count = link.astype(np.int64) @ copies
    edges = forest(len(sid), np.argwhere(np.triu(link)))
    hit = np.flatnonzero(count)
    u = np.concatenate([sid[hit], sid[[e[0] for e in edges]] if edges else sid[:0]])
    v = np.concatenate([sid[hit], sid[[e[1] for e in edges]] if edges else sid[:0]])
    n = np.concatenate([count[hit], np.zeros(len(edges), np.int64)])
    return pa.table({"u": u, "v": v, "links": n})


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


# --- components --------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component.

    Large-star and small-star steps in turn: every round all nodes hang
    themselves below smaller ones, so the number of rounds grows with the
    logarithm of the size. Each round is checkpointed.
    """
    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        return tuple(r)

    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut_lineage(pairs.distinct())
    last = state(now)
    while last[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.where("u <> v").distinct())
        new = state(now)
        if new == last:
            break
        last = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def text_mark(text: Column) -> Column:
    """Hash by which rows of one key are told apart."""
    return F.xxhash64(text.cast("string"))


# --- the join ----------------------------------------------------------------------------


def ngram_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8,
    recall: float = 0.999, block: int = BLOCK, seed: int = 17, marks: bool = False,
) -> DataFrame:
    """``id_col, class_id, n_links`` for each row.

    ``class_id`` is the smallest key of the row's component, ``n_links`` the number
    of other rows at least ``threshold`` similar to it. With ``marks`` come the hash
    of the row's text (``text_mark``) and that of the component's chosen row, whose
    key is ``class_id`` (``class_mark``): keys may repeat or be NULL.
    """
    bands, per_band = choose_bands(threshold, recall)
    rows = df.select(
        F.coalesce(col(id_col).cast("bigint"), F.lit(NO_KEY)).alias("id"),
        col(text_col).cast("string").alias("text"),
        text_mark(col(text_col)).alias("mark"),
    )
    signed = cut_lineage(signatures(rows, n, bands, per_band, seed))
    members = signed.groupBy("sid").agg(
        F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("copies"), F.max("bands").alias("bands")
    )
    members = cut_lineage(members)
    buckets = members.where(F.size("bands") > 0).select(
        "sid", F.posexplode("bands").alias("band", "hash")
    ).withColumn("key", F.xxhash64("band", "hash"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    cells = F.ceil(F.col("m") / block).cast("bigint")
    met = buckets.join(shared, "key").select(
        "key", "band", "sid", cells.alias("cells"), F.pmod(F.xxhash64("sid", "key"), cells).alias("block")
    )
    # Each member goes to the pairs of its block with every block of the bucket.
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1))
    dealt = met.withColumn("other", other).select(
        "key", "band", "sid", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    dealt = dealt.join(members.select("sid", "bands"), "sid")

    def choose(table: pa.Table) -> pa.Table:
        """Members of a block pair that stand in a pair first met here."""
        side = table.column("block").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        pairs = candidate_pairs(side, matrix(table.column("bands")), table.column("band")[0].as_py(), lo == hi)
        used = pairs.any(0) | pairs.any(1)
        return table.filter(pa.array(used)).select(["key", "band", "sid", "block", "lo", "hi"])

    keys = "key bigint, band int, sid bigint, block bigint, lo bigint, hi bigint"
    chosen = cut_lineage(dealt.groupBy("key", "lo", "hi").applyInArrow(choose, keys))
    # The sets of those members only, made from one document of each: found by key and
    # text, as a key may stand for several texts.
    wanted = chosen.select("sid").distinct().join(members.select("sid", "first.id", "first.mark"), "sid")
    source = rows.join(wanted, ["id", "mark"]).select("sid", "text")
    sets = gram_sets(source, n).dropDuplicates(["sid"])
    parts = chosen.join(sets, "sid").join(members.select("sid", "copies", "bands"), "sid")

    def verify(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        return linked(table, table.column("band")[0].as_py(), lo == hi, threshold)

    found = cut_lineage(parts.groupBy("key", "lo", "hi").applyInArrow(verify, "u bigint, v bigint, links bigint"))
    links = found.where("links > 0").groupBy(F.col("u").alias("sid")).agg(F.sum("links").alias("links"))
    labels = components(found.select("u", "v"))
    known = members.select("sid", "first", "copies").join(links, "sid", "left").join(
        labels.withColumnRenamed("node", "sid"), "sid", "left"
    ).withColumn("label", F.coalesce("label", "sid"))
    classes = known.groupBy("label").agg(F.min("first").alias("chosen"))
    told = known.join(classes, "label").select(
        "sid", "chosen", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    no_key = F.lit(NO_KEY)
    own = [F.col("mark").alias("text_mark"), F.col("chosen.mark").alias("class_mark")] if marks else []
    return signed.select("id", "mark", "sid").join(told, "sid").select(
        F.nullif("id", no_key).alias(id_col), F.nullif("chosen.id", no_key).alias("class_id"), "n_links", *own
    )
