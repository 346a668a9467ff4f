"""Language-model scores by context-tree weighting over bytes.

A text is its words (runs of characters other than blank and the control
characters 9 to 13, A to Z in lower case), a blank between two, and an end, so
its bytes and its tokens say the same. A byte is eight binary decisions. Each of
the 255 decisions has a context tree of its own, whose nodes are the 0 to
``depth`` bytes before: with ``a`` zeros and ``b`` ones seen there, a node holds
the Krichevsky-Trofimov probability of them, and its weighted probability is half
of that plus half of the product of its children's (a leaf's is its own). From
these follows, for a byte after a context, the mixture over all depths; its
logarithms add up to the score of a text.

How it is spread: texts are taken in shards, and what is shuffled are the
distinct strings (grams) of ``depth + 1`` bytes of each shard with their counts,
never positions. Grams with equal last three context bytes meet in one bucket,
which holds those subtrees whole; their roots are added up to the depths 2, 1 and
0 by Spark, and the weights found there come back as one affine map for each
decision. Each bucket then answers the grams of every shard. Nothing of this goes
through the driver, and the buckets grow in number with the distinct grams.

NULL texts count as empty. NULL keys are learned from (their ``held_out`` is
false). Rows that repeat are learned from and scored each. Without rows to learn
from every bit has probability one half, and every token of the base 1. An empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import col, pack, stored, unpack
from tidyloom.llm.words import WordList, blocks, listed, one_array, one_row, pieces, raw, shard_words, tokens

DEPTH = 5
#: Depth from which on subtrees lie in one bucket each.
ROOT = 3
END = b"\n"
#: Positions that are sorted at a time, and distinct grams aimed at in a bucket.
SLICE, BUCKET_GRAMS = 1 << 20, 400_000
#: One in so many grams is counted apart to tell how many distinct ones there are.
SAMPLED = 64
HALF = math.log(0.5)
U8, U16 = np.uint64(8), np.uint64(16)


# --- estimates ---------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function (Stirling's series eight places higher up)."""
    x = np.asarray(x, float)
    low = np.ones_like(x)
    for i in range(8):
        low = low * (x + i)
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(low)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def mixed(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the share of the node's own estimate in it."""
    return HALF + np.logaddexp(own, children), 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


# --- subtrees ----------------------------------------------------------------------------


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each of some sorted keys, and where each group begins."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


class Subtrees:
    """Trees below depth ``ROOT`` over sorted distinct grams and their counts.

    A gram holds its context, the nearest byte first, and then the byte itself, so
    that sorted grams have the contexts of every depth side by side.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int):
        self.depth = depth
        self.keys, self.n, self.up = {depth: grams}, {depth: n}, {}
        for d in range(depth, ROOT, -1):
            keys = self.keys[d]
            shorter = (keys >> U16 << U8) | (keys & np.uint64(255))
            self.keys[d - 1], self.up[d] = np.unique(shorter, return_inverse=True)
            self.n[d - 1] = np.bincount(self.up[d], self.n[d], len(self.keys[d - 1]))

    def decision(self, j: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """The roots ``(context, node, a, b, log weighted)`` for bit ``j``, and each gram's mixture down there."""
        shift = np.uint64(8 - j)
        kept, below = {}, None
        for d in range(self.depth, ROOT - 1, -1):
            keys = self.keys[d]
            one = ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            node, begin = groups(keys >> shift)
            a = np.bincount(node, np.where(one, 0, self.n[d]), len(begin))
            b = np.bincount(node, np.where(one, self.n[d], 0), len(begin))
            own = estimate(a, b)
            if below is None:
                weighted, share = own, np.ones(len(own))
            else:
                begin_below, weighted_below = below
                children = np.bincount(node[self.up[d + 1][begin_below]], weighted_below, len(begin))
                weighted, share = mixed(own, children)
            kept[d] = node, a, b, share
            below = begin, weighted
        one = ((self.keys[self.depth] >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        place, p = np.arange(len(one)), None
        for d in range(self.depth, ROOT - 1, -1):
            node, a, b, share = kept[d]
            at = node[place]
            krichevsky = (np.where(one, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1)
            p = krichevsky if p is None else share[at] * krichevsky + (1 - share[at]) * p
            if d > ROOT:
                place = self.up[d][place]
        begin, weighted = below
        first = self.keys[ROOT][begin]
        node = (np.uint64(1) << np.uint64(j)) | ((first & np.uint64(255)) >> shift)
        _, a, b, _ = kept[ROOT]
        return (first >> U8, node, a, b, weighted), p


def log_scores(grams: np.ndarray, n: np.ndarray, depth: int, above: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context.

    ``above`` has, for the roots' contexts and nodes (``at``, sorted), what becomes of
    a probability p there further up: ``zero + rest * p`` or ``one + rest * p``.
    """
    trees = Subtrees(grams, n, depth)
    total = np.zeros(len(grams))
    root = grams >> np.uint64(8 * (depth - ROOT + 1))
    byte = grams & np.uint64(255)
    for j in range(8):
        _, p = trees.decision(j)
        node = (np.uint64(1) << np.uint64(j)) | (byte >> np.uint64(8 - j))
        at = np.searchsorted(above["at"], (root << U8) | node)
        one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        p = np.where(one, above["one"][at], above["zero"][at]) + above["rest"][at] * p
        total += np.log10(p)
    return total


# --- texts and grams ---------------------------------------------------------------------


def plain(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Words with single blanks between them, how many each text has, and all of them."""
    words, n = tokens(pc.ascii_lower(texts))
    ends = np.concatenate([[0], np.cumsum(n)])
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words)
    return pc.binary_join(lists, " "), n, words


def grams_of(texts: pa.Array, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of the texts' grams: first and last text, the text of each gram, the grams.

    Every text is closed by an end, and begins after ``depth`` ends.
    """
    data, ends = raw(texts)
    at, count = 0, len(texts)
    while at < count:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        length = np.diff(ends[at : to + 1]) + depth + 1
        begin = np.concatenate([[0], np.cumsum(length)])
        stream = np.full(begin[-1], END[0], np.uint8)
        owner = np.repeat(np.arange(to - at), length)
        within = np.arange(begin[-1]) - begin[owner]
        inside = (within >= depth) & (within < length[owner] - 1)
        stream[inside] = data[ends[at] : ends[to]]
        wide = stream.astype(np.uint64)
        grams = wide[depth:].copy()
        for i in range(1, depth + 1):
            grams |= wide[depth - i : len(wide) - i] << np.uint64(8 * (depth + 1 - i))
        real = within[depth:] >= depth
        yield at, to, owner[depth:][real], grams[real]
        at = to


def counted(grams: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, and how often each stands in texts learned from."""
    marked = np.sort(grams << np.uint64(1) | learned)
    group, begin = groups(marked >> np.uint64(1))
    return marked[begin] >> np.uint64(1), np.bincount(group, marked & np.uint64(1), len(begin)).astype(np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    group, begin = groups(keys[order])
    n = np.concatenate([n for _, n in parts])[order]
    return keys[order][begin], np.add.reduceat(n, begin) if len(n) else n


def spread(keys: np.ndarray) -> np.ndarray:
    """Well mixed numbers of keys."""
    keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return keys ^ (keys >> np.uint64(33))


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


SHARDS = {
    "shard": "bigint", "docs": "array<struct<id: bigint, held: boolean>>", "learned": "bigint", "text": "binary",
    "size": "bigint", "words": "array<string>", "times": "array<bigint>", "grams": "binary", "counts": "binary",
    "sampled": "array<bigint>",
}


def shard_grams(rows: DataFrame, depth: int) -> DataFrame:
    """A row for each shard of ``id, held, text``: its texts, words and grams with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in blocks(batches, 2):
            held = one_array(part.column("held"), None)
            learned = ~held.to_numpy(zero_copy_only=False).astype(bool)
            words, codes, text = WordList(), [], []
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            for first, piece in pieces(part, "text"):
                texts, n, found = plain(one_array(piece.column("text")))
                codes.append(words.add(found)[np.repeat(learned[first : first + len(piece)], n)])
                text.append(END.join(texts.cast(pa.binary()).to_pylist()))
                for at, _, owner, grams in grams_of(texts, depth):
                    parts.append(counted(grams, learned[first + at + owner]))
                    while len(parts) > 1 and len(parts[-1][0]) * 2 > len(parts[-2][0]):
                        parts[-2:] = [merged(parts[-2:])]
            place, distinct = words.joined()
            times = sum(np.bincount(p[c], minlength=len(distinct)) for p, c in zip(place, codes))
            text = END.join(text)
            keys, count = merged(parts)
            sample = keys[spread(keys) % np.uint64(SAMPLED) == 0]
            docs = pa.StructArray.from_arrays([one_array(part.column("id"), None), held], ["id", "held"])
            values = [
                pa.array([shard], pa.int64()), listed(docs), pa.array([int(learned.sum())], pa.int64()),
                pa.array([pa.compress(text, "zstd", asbytes=True)], pa.binary()), pa.array([len(text)], pa.int64()),
                listed(distinct), listed(pa.array(times, pa.int64())), pa.array([pack_sorted(keys)], pa.binary()),
                pa.array([pack(count)], pa.binary()), listed(pa.array(sample.view(np.int64))),
            ]
            yield one_row(list(SHARDS), values)

    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in SHARDS.items()))


# --- model -------------------------------------------------------------------------------


def places(keys: np.ndarray, depth: int, buckets: int) -> dict[int, np.ndarray]:
    """Where the grams of each bucket stand among some sorted ones."""
    bucket = (spread(keys >> np.uint64(8 * (depth - ROOT + 1))) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    _, begin = groups(bucket[order])
    return dict(zip(bucket[order][begin].tolist(), np.split(order, begin[1:])))


def dealt(shards: DataFrame, buckets: int, depth: int) -> DataFrame:
    """``bucket, shard, grams, counts``: the grams of each shard by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, packed, counts in zip(*(c.to_pylist() for c in batch.columns)):
                keys, n = unpack_sorted(packed), unpack(counts, np.int64)
                found = places(keys, depth, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(found), pa.int64()), pa.array([shard] * len(found), pa.int64()),
                        pa.array([pack_sorted(keys[f]) for f in found.values()], pa.binary()),
                        pa.array([pack(n[f]) for f in found.values()], pa.binary()),
                    ],
                    ["bucket", "shard", "grams", "counts"],
                )

    return shards.select("shard", "grams", "counts").mapInArrow(run, "bucket bigint, shard bigint, grams binary, counts binary")


def by_bucket(rows: DataFrame, *order: str) -> DataFrame:
    """All rows of a bucket side by side in one partition."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", *order)


def merge_buckets(parts: DataFrame, depth: int) -> DataFrame:
    """One row for each bucket: its distinct grams, counts, and the roots of its subtrees."""

    def finished(bucket: int, parts: list) -> pa.RecordBatch:
        keys, n = merged(parts)
        trees = Subtrees(keys, n, depth)
        roots = [np.concatenate(x) for x in zip(*(trees.decision(j)[0] for j in range(8)))]
        fields = [pa.array(x.astype(t)) for x, t in zip(roots, (np.int64, np.int32, np.int64, np.int64, float))]
        nodes = pa.StructArray.from_arrays(fields, ["ctx", "node", "a", "b", "lw"])
        values = [pa.array([bucket], pa.int64()), pa.array([pack_sorted(keys)], pa.binary()), pa.array([pack(n)], pa.binary()), listed(nodes)]
        return one_row(["bucket", "grams", "counts", "nodes"], values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, grams, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and bucket != now:
                    yield finished(now, parts)
                    parts = []
                now = bucket
                parts.append((unpack_sorted(grams), unpack(counts, np.int64)))
                # Sizes fall from left to right, so a gram is merged a few times only.
                while len(parts) > 1 and len(parts[-1][0]) * 2 > len(parts[-2][0]):
                    parts[-2:] = [merged(parts[-2:])]
        if now is not None:
            yield finished(now, parts)

    schema = "bucket bigint, grams binary, counts binary, nodes array<struct<ctx: bigint, node: int, a: bigint, b: bigint, lw: double>>"
    return by_bucket(parts).select("bucket", "grams", "counts").mapInArrow(run, schema)


def maps_above(nodes: DataFrame) -> DataFrame:
    """For the roots of subtrees (``bucket, ctx, node, a, b, lw``) the map to the top of their trees.

    ``zero, one, rest``: a bit with probability p below has ``zero + rest * p`` (or
    ``one + rest * p``) at the top.
    """

    @F.pandas_udf("lw double, share double")
    def weigh(a: pd.Series, b: pd.Series, children: pd.Series) -> pd.DataFrame:
        weighted, share = mixed(estimate(a.to_numpy(float), b.to_numpy(float)), children.to_numpy(float))
        return pd.DataFrame({"lw": weighted, "share": share})

    levels, level = [], nodes
    for _ in range(ROOT):
        level = level.groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("children")
        )
        level = stored(level.withColumn("w", weigh("a", "b", "children")).select("ctx", "node", "a", "b", "w.lw", "w.share"))
        levels.append(level)
    total = F.col("a") + F.col("b") + 1
    zero, one = F.col("share") * (F.col("a") + 0.5) / total, F.col("share") * (F.col("b") + 0.5) / total
    above = None
    for level in reversed(levels):
        own = level.select("ctx", "node", zero.alias("zero"), one.alias("one"), (1 - F.col("share")).alias("rest"))
        if above is None:
            above = own
            continue
        up = above.select(F.col("ctx").alias("up"), "node", F.col("zero").alias("z"), F.col("one").alias("o"), F.col("rest").alias("r"))
        above = own.withColumn("up", F.shiftright("ctx", 8)).join(up, ["up", "node"]).select(
            "ctx", "node", *((F.col(x) + F.col("r") * F.col(c)).alias(c) for x, c in (("z", "zero"), ("o", "one"))),
            (F.col("r") * F.col("rest")).alias("rest"),
        )
    top = above.withColumnRenamed("ctx", "up")
    return nodes.withColumn("up", F.shiftright("ctx", 8)).join(top, ["up", "node"]).select("bucket", "ctx", "node", "zero", "one", "rest")


def bucket_count(shards: DataFrame) -> int:
    """From the number of distinct grams, which one in ``SAMPLED`` of them tell."""
    seen = shards.select(F.explode("sampled").alias("g")).agg(F.count_distinct("g")).first()[0]
    return max(1, math.ceil(seen * SAMPLED / BUCKET_GRAMS))


def fit_grams(parts: DataFrame, depth: int) -> DataFrame:
    """``bucket, grams, scores`` of all distinct grams."""
    trees = stored(merge_buckets(parts, depth))
    nodes = trees.select("bucket", F.explode("nodes").alias("n")).select("bucket", "n.*")
    above = maps_above(nodes).withColumnRenamed("bucket", "of")

    def score(key, own: pa.Table, maps: pa.Table) -> pa.Table:
        at = (maps.column("ctx").to_numpy().astype(np.uint64) << U8) | maps.column("node").to_numpy().astype(np.uint64)
        order = np.argsort(at)
        known = {"at": at[order]} | {c: maps.column(c).to_numpy()[order] for c in ("zero", "one", "rest")}
        keys = unpack_sorted(own.column("grams")[0].as_py())
        found = log_scores(keys, unpack(own.column("counts")[0].as_py(), np.int64), depth, known)
        return own.select(["bucket", "grams"]).append_column("scores", pa.array([pack(found)], pa.binary()))

    own = trees.select("bucket", "grams", "counts")
    return own.groupBy("bucket").cogroup(above.groupBy("of")).applyInArrow(score, "bucket bigint, grams binary, scores binary")


def answers(model: DataFrame, parts: DataFrame) -> DataFrame:
    """``of, at, scores``: for shard ``of`` and bucket ``at`` the scores of the shard's grams, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = scores = None
        for batch in batches:
            out = []
            for bucket, shard, grams, found in zip(*(c.to_pylist() for c in batch.columns)):
                own = unpack_sorted(grams)
                if found is not None:
                    keys, scores = own, unpack(found, np.float64)
                else:
                    out.append((shard, bucket, pack(scores[np.searchsorted(keys, own)])))
            if out:
                of, at, blobs = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of, pa.int64()), pa.array(at, pa.int64()), pa.array(blobs, pa.binary())], ["of", "at", "scores"]
                )

    asked = parts.select("bucket", "shard", "grams", F.lit(None).cast("binary").alias("scores"))
    both = model.select("bucket", F.lit(-1).cast("bigint").alias("shard"), "grams", "scores").unionByName(asked)
    return by_bucket(both, "shard").mapInArrow(run, "of bigint, at bigint, scores binary")


# --- scores ------------------------------------------------------------------------------


def ctw_scores(
    df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH
) -> DataFrame:
    """A row for each text, scored by the model of all rows that are not ``held_out``.

    ``score``: log10 of the text's probability; ``code_length``: bits for each byte
    (its end counts as one); ``base_score``: of single words with one added to each
    count; ``n_known``: tokens that occur in what is learned from. ``depth`` is 4 to 6.
    """
    if not ROOT < depth < 7:
        raise ValueError("depth has to be 4, 5 or 6")
    rows = df.select(
        col(id_col).cast("bigint").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), col(text_col).cast("string").alias("text")
    )
    shards = stored(shard_grams(rows, depth), compression="zstd")
    buckets = bucket_count(shards)
    parts = dealt(shards, buckets, depth)
    words = shard_words(shards, "times")
    counts = words.groupBy("word").agg(F.sum("times").alias("c")).where("c > 0")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    learned = shards.agg(F.coalesce(F.sum("learned"), F.lit(0))).first()[0]
    v, n = total["v"] + (learned > 0), total["n"] + learned
    known = words.join(counts, "word").select(F.col("shard").alias("of"), F.col("at").cast("bigint").alias("at"), "c")
    found = answers(fit_grams(parts, depth), parts).withColumn("c", F.lit(None).cast("bigint"))
    found = found.unionByName(known.withColumn("scores", F.lit(None).cast("binary")))

    def score(key, own: pa.Table, found: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        docs, keys = row["docs"], unpack_sorted(row["grams"])
        texts = pa.array(pa.decompress(row["text"], row["size"], "zstd", asbytes=True).split(END), pa.binary()).cast(pa.string())
        is_word = found.column("c").is_valid().to_numpy()
        at, of_bucket = found.column("at").to_numpy(), places(keys, depth, buckets)
        value = np.zeros(len(keys))
        for bucket, scores in zip(at[~is_word].tolist(), found.column("scores").filter(pa.array(~is_word)).to_pylist()):
            value[of_bucket[bucket]] = unpack(scores, np.float64)
        scores, length = np.zeros(len(docs)), np.zeros(len(docs))
        for begin, end, owner, grams in grams_of(texts, depth):
            different, each = np.unique(grams, return_inverse=True)
            scores[begin:end] = np.bincount(owner, value[np.searchsorted(keys, different)][each], end - begin)
            length[begin:end] = np.bincount(owner, minlength=end - begin)
        count = np.zeros(row["distinct"], np.int64)
        count[at[is_word]] = found.column("c").filter(pa.array(is_word)).to_numpy()
        one_end = math.log10((learned + 1) / (n + v + 1))
        words, parts, base, n_known, n_words = WordList(), [], [], [], []
        for _, piece in pieces(pa.table({"text": texts}), "text"):
            all_tokens, each = tokens(one_array(piece.column("text")))
            parts.append(words.add(all_tokens))
            n_words.append(each)
        for place, code, each in zip(words.joined()[0], parts, n_words):
            seen = count[place][code]
            owner = np.repeat(np.arange(len(each)), each)
            base.append(np.bincount(owner, np.log10((seen + 1) / (n + v + 1)), len(each)) + one_end)
            n_known.append(np.bincount(owner[seen > 0], minlength=len(each)) + (learned > 0))
        n_words = np.concatenate(n_words)
        return pa.table({
            "doc_id": pa.array([d["id"] for d in docs], pa.int64()), "held_out": pa.array([d["held"] for d in docs], pa.bool_()),
            "n_tokens": pa.array(n_words + 1, pa.int64()), "n_known": pa.array(np.concatenate(n_known), pa.int64()),
            "train_tokens": pa.array([n] * len(docs), pa.int64()), "base_score": np.concatenate(base), "score": scores,
            "code_length": -scores / math.log10(2) / length,
        })

    texts = shards.select("shard", "docs", "text", "size", "grams", F.size("words").alias("distinct"))
    return texts.groupBy("shard").cogroup(found.groupBy("of")).applyInArrow(
        score,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double, code_length double",
    )
