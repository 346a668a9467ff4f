"""Document fingerprints by winnowing.

A text is lower-cased and its white space dropped; every run of ``k`` characters
gets a rolling hash; from every window of ``window`` hashes the smallest is kept,
the rightmost one if several tie. Any two texts that share a run of at least
k + window - 1 characters therefore share a fingerprint, and its kept positions
say where. In a text of few hashes the window shrinks to a ``SHARES``-th of them,
so that it keeps several and has degrees of likeness too; what a window keeps, a
smaller one keeps as well, so the guarantee holds across lengths. A text shorter
than ``k`` is one run, an empty text has no fingerprint.

A fingerprint is a hex string with sixteen digits for each kept hash: eight of
the hash and eight of its position. Equal texts have equal fingerprints.

NULL texts count as empty, rows with equal keys are documents of their own,
empty tables give no rows, other columns are ignored. Texts are read whole; the
hashes of a long text are made in slices, so memory stays bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import col, values
from tidyloom.session import cut_lineage

K = 12
WINDOW = 16
#: A text of at least so many hashes keeps at least so many.
SHARES = 6
SLICE = 2_000_000
#: Text of a range of keys, and the most ranges whose edges are looked up (beyond it ranges grow, still read as streams).
RANGE_BYTES = 8_000_000
RANGE_LIMIT = 65_536
BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` code points, as unsigned 32-bit values.

    Runs of 2n are put together from two runs of n, so a hash takes a number of
    steps that grows with the logarithm of ``k``.
    """
    with np.errstate(over="ignore"):
        power, done, out, width, base = text.astype(np.uint64) + np.uint64(1), 0, None, 1, BASE
        rest = k
        while True:  # power holds runs of `width`, out holds runs of `done`
            if rest & 1:
                if out is None:
                    out = power
                else:
                    n = len(text) - done - width + 1
                    out = out[:n] * base + power[done : done + n]
                done += width
            rest >>= 1
            if not rest:
                break
            n = len(text) - 2 * width + 1
            power = power[:n] * base + power[width : width + n]
            width, base = 2 * width, base * base
        out = out[: len(text) - k + 1]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (out >> np.uint64(32)).astype(np.uint32)


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each window, by doubling."""
    low, width = keys, 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(keys) - window + 1], low[window - width :])


def winnow(text: str, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Kept (hash, position) pairs as a two-column array in text order."""
    plain = "".join(text.lower().split())
    if not plain:
        return np.empty((0, 2), np.uint32)
    code = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = min(k, len(code))
    total = len(code) - k + 1
    window = min(window, max(1, total // SHARES))
    kept = []
    for a in range(0, total - window + 1, SLICE):
        hashes = gram_hashes(code[a : a + SLICE + window + k - 2], k)
        place = np.arange(a, a + len(hashes), dtype=np.uint64)
        keys = (hashes.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - place)
        low = window_minima(keys, window)
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        if kept:
            new[0] = low[0] != kept[-1][-1]
        if new.any():
            kept.append(low[new])
    low = np.concatenate(kept)
    pair = np.empty((len(low), 2), np.uint32)
    pair[:, 0] = low >> np.uint64(32)
    pair[:, 1] = np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))
    return pair


def printed(pairs: np.ndarray) -> str:
    return pairs.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of kept hashes (1.0 for two empty ones)."""
    a, b = np.unique(a[:, 0]), np.unique(b[:, 0])
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW):
    """``id_col, fingerprint`` for each row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [printed(winnow(t or "", k, window)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.string())], ["id", "fingerprint"])

    rows = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def with_next(df: DataFrame, id_col: str, text_col: str, visit, schema: str) -> DataFrame:
    """``visit(id, text, next_text)`` for each row in ascending order of key and text.

    After the last row comes the first. Rows are dealt to ranges of keys, whose
    edges come from a sketch; the first row of each range is also sent to the
    range before it, so every row meets its follower, and each text is moved
    once. A range is sorted by Spark and read as a stream.
    """
    spark = df.sparkSession
    rows = df.select(
        F.coalesce(col(id_col).cast("bigint"), F.lit(-(2**63))).alias("id"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("w")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    ranges = max(1, min(RANGE_LIMIT, size["w"] // RANGE_BYTES, size["n"] // 8))
    probs = [i / ranges for i in range(1, ranges)]
    edges = rows.agg(F.percentile_approx("id", probs, 10 * ranges)).first()[0] if probs else []
    edges = np.array(sorted(set(edges)), np.int64)

    @F.pandas_udf("bigint")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "right"))

    placed = rows.withColumn("range", range_of("id"))
    firsts = sorted(placed.groupBy("range").agg(F.min("id").alias("id")).collect(), key=lambda r: r["range"])
    if len(firsts) > 1:
        to = [(firsts[i - 1]["range"], r["id"]) for i, r in enumerate(firsts)]
    else:
        to = [(firsts[0]["range"], firsts[0]["id"])]
    lead = values(spark, ["to", "id"], to)
    # The follower of the last range's last row is the very first row.
    extra = placed.join(lead, "id").select(F.col("to").alias("range"), F.lit(1).alias("after"), "id", "text")
    own = placed.select("range", F.lit(0).alias("after"), "id", "text")
    dealt = own.unionByName(extra).repartition(len(firsts), "range")
    ordered = dealt.sortWithinPartitions("range", "after", "id", "text")
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for b in batches:
            for place, after, key, text in zip(*(c.to_pylist() for c in b.columns)):
                if held is not None and held[0] == place:
                    out.append(visit(held[1], held[2], text))
                held = None if after else (place, key, text)
                if len(out) >= 500:
                    yield rows_to_batch(out, names)
                    out = []
        if out:
            yield rows_to_batch(out, names)

    return ordered.mapInArrow(run, schema)


def rows_to_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW):
    """Fingerprint of every text, of its edited form, and their likenesses.

    The edited form ends with the start of the next document instead of the last
    quarter of the code points.
    """

    last: dict[str, np.ndarray] = {}

    def marks(text: str) -> np.ndarray:
        """A follower's fingerprint is asked for again as the next row's own."""
        if text not in last:
            if len(last) > 1:
                last.clear()
            last[text] = winnow(text, k, window)
        return last[text]

    def visit(key, text, following):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        own, other, after = marks(text), winnow(edited, k, window), marks(following)
        return (
            None if key == -(2**63) else key, len(text),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            printed(own), printed(other), likeness(own, other), likeness(own, after),
        )

    return with_next(
        df, id_col, text_col, visit,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
