"""Words of texts in bounded blocks, and a dictionary over all of them.

A word is a run of characters other than blank and the control characters 9 to
13. Texts are taken in blocks (shards); a shard lists each of its words once, so
what is shuffled are distinct words of shards, never tokens, and even the most
frequent word has one row for each shard only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import stored

#: Text of a shard, in bytes: more is begun anew (a longer text is a shard by itself).
SHARD_BYTES = 32 << 20
#: Text that is split into words at a time.
PIECE_BYTES = 2 << 20


def blocks(batches: Iterator[pa.RecordBatch], text: int, limit: int = SHARD_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """Rows in shards of about ``limit`` bytes of column ``text``, each with a number of its own.

    The number holds the partition and the place in it; rows are stored next, so
    that a repeated task gives them the same numbers.
    """
    first, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for batch in batches:
        at = 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        while at < len(batch):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - done)
            at = to
            if size >= limit or at < len(batch):
                yield first + n, pa.Table.from_batches(held)
                n, held, size = n + 1, [], 0
    if held:
        yield first + n, pa.Table.from_batches(held)


def one_array(column: pa.ChunkedArray, null: str | None = "") -> pa.Array:
    array = column.combine_chunks()
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return array if null is None else pc.fill_null(array, null)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins and ends."""
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and how many each text has."""
    split = pc.ascii_split_whitespace(texts)
    flat, parent = split.flatten(), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), np.bincount(parent.filter(full).to_numpy(), minlength=len(texts))


def pieces(rows: pa.Table, text: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows in slices of about ``PIECE_BYTES`` of text, and where each begins."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column(text)), 0).to_numpy())
    at = 0
    while at < len(rows):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE_BYTES, "right")))
        yield at, rows.slice(at, to - at)
        at = to


class WordList:
    """The distinct words of a shard, gathered piece by piece."""

    def __init__(self):
        self.parts: list[pa.Array] = []

    def add(self, words: pa.Array) -> np.ndarray:
        """The place of each token among the distinct ones of this piece."""
        if not len(words):
            self.parts.append(pa.array([], pa.string()))
            return np.zeros(0, np.int32)
        found = words.dictionary_encode()
        self.parts.append(found.dictionary)
        return found.indices.to_numpy()

    def joined(self) -> tuple[list[np.ndarray], pa.Array]:
        """For each piece the places of its words in the whole list, and the list."""
        every = pa.concat_arrays(self.parts) if self.parts else pa.array([], pa.string())
        if not len(every):
            return [np.zeros(0, np.int32) for _ in self.parts], every
        found = every.dictionary_encode()
        ends = np.cumsum([len(p) for p in self.parts])
        return np.split(found.indices.to_numpy(), ends[:-1]), found.dictionary


def one_row(names: list[str], values: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(values, names)


def listed(values: pa.Array) -> pa.Array:
    """The values as the list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def shard_words(shards: DataFrame, *counts: str) -> DataFrame:
    """``shard, at, word, <counts>``: a row for each distinct word of each shard."""
    arrays = F.posexplode(F.arrays_zip("words", *counts))
    rows = shards.select("shard", arrays.alias("at", "w"))
    return rows.select("shard", "at", F.col("w.words").alias("word"), *[F.col(f"w.{c}").alias(c) for c in counts])


def numbered(words: DataFrame) -> DataFrame:
    """``word, <others>, word_id``: rows (one per word) numbered without gaps from 0.

    Each partition numbers its own rows; the sizes of the partitions, one number
    for each, shift them.
    """
    low = (1 << 33) - 1
    placed = stored(words.withColumns({
        "__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(low)
    }))
    sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    starts, total = [], 0
    for part in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(F.lit(np.array(starts, np.int64)), F.col("__part") + 1)
    return placed.withColumn("word_id", start + F.col("__at")).drop("__part", "__at")
