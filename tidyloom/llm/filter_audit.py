"""How filters of documents interact, from a sparse document-term matrix.

Texts are read once, in shards. Each distinct word of a shard goes to a
dictionary over all shards, which numbers the words without gaps; the numbers
come back to the shard and make its rows of the matrix in compressed sparse row
form: ``indptr`` (where each document's cells begin), ``indices`` (word numbers)
and ``data`` (how often). The sum of a row is the number of words, its nonzero
cells are the distinct ones. Flags that need no words (capitals, marks, equal
texts) join them, and all orders of the filters are counted from the number of
documents with each set of failures, at most 32 per part.

NULL texts count as empty. A NULL key is neither smaller nor larger than another:
such a row fails no filter on equal texts and makes no other fail. Rows that
repeat count each (rows with the smallest key of a text all pass). A NULL part
counts as the empty string. Of several label rows of a key the larger value
holds. An empty table gives no rows; other columns are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import col, pack, stored, unpack
from tidyloom.llm.words import WordList, blocks, listed, numbered, one_array, one_row, pieces, raw, shard_words, tokens

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))
MARKS = b"#$%&*|"
DOCS = "array<struct<id: bigint, part: string, digest: binary, flags: int>>"
MATRIX = "shard bigint, docs " + DOCS + ", indptr binary, indices binary, data binary"


# --- matrix ------------------------------------------------------------------------------


def text_flags(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Failures of C and D for each text."""

    def total(hit: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(hit) + 1, np.int64)
        np.cumsum(hit, out=sums[1:])
        return sums[ends[1:]] - sums[ends[:-1]]

    marked = np.zeros(256, bool)
    marked[list(MARKS)] = True
    capitals, points = total((data >= 65) & (data <= 90)), total(data & 0xC0 != 0x80)
    return np.where(100 * capitals > 10 * points, C, 0) + np.where(total(marked[data]) > 0, D, 0)


def count_cells(texts: pa.Array, words: WordList) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonzero cells of each text, their columns (by the piece's own words) and how often."""
    found, n = tokens(texts)
    code = words.add(found)
    width = int(code.max(initial=0)) + 1
    cells = np.sort(np.repeat(np.arange(len(n)) * width, n) + code)
    new = np.flatnonzero(np.diff(cells, prepend=-1))
    row, column = np.divmod(cells[new], width)
    times = np.diff(new, append=len(cells))
    return np.bincount(row, minlength=len(n)), column.astype(np.int32), times.astype(np.int32)


def shard_cells(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """A row for each shard: its documents, cells and distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in blocks(batches, 2):
            words, parts, flags, digests = WordList(), [], [], []
            for _, piece in pieces(rows, "text"):
                texts = one_array(piece.column("text"))
                parts.append(count_cells(texts, words))
                flags.append(text_flags(*raw(texts)))
                digests += [hashlib.sha256(t).digest() for t in texts.cast(pa.binary()).to_pylist()]
            place, distinct = words.joined()
            indptr = np.concatenate([[0], np.cumsum(np.concatenate([n for n, _, _ in parts]))])
            column = np.concatenate([p[c] for p, (_, c, _) in zip(place, parts)])
            times = np.concatenate([t for _, _, t in parts])
            docs = pa.StructArray.from_arrays(
                [one_array(rows.column("id"), None), one_array(rows.column("part")), pa.array(digests, pa.binary()),
                 pa.array(np.concatenate(flags), pa.int32())],
                ["id", "part", "digest", "flags"],
            )
            cells = [pack(x.astype(np.int32)) for x in (indptr, column, times)]
            values = [pa.array([shard], pa.int64()), listed(docs), *(pa.array([x], pa.binary()) for x in cells), listed(distinct)]
            yield one_row(["shard", "docs", "indptr", "indices", "data", "words"], values)

    rows = df.select(
        col(id_col).cast("bigint").alias("id"), col(part_col).cast("string").alias("part"), col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(run, MATRIX + ", words array<string>")


def term_matrix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """The matrix in shards of compressed sparse rows, and the dictionary ``word, word_id, shards``.

    ``docs`` tells the row's documents; ``indptr`` (int32), ``indices`` (int64) and
    ``data`` (int32) are read with ``unpack``.
    """
    shards = stored(shard_cells(df, id_col, text_col, part_col), compression="zstd")
    words = shard_words(shards)
    dictionary = numbered(words.groupBy("word").agg(F.count("*").alias("shards")))
    looked_up = words.join(dictionary, "word").select(F.col("shard").alias("of"), "at", "word_id")

    def place(key, cells: pa.Table, ids: pa.Table) -> pa.Table:
        number = np.zeros(len(ids), np.int64)
        number[ids.column("at").to_numpy()] = ids.column("word_id").to_numpy()
        column = unpack(cells.column("indices")[0].as_py(), np.int32)
        globally = pa.array([pack(number[column])], pa.binary())
        return cells.set_column(cells.schema.get_field_index("indices"), "indices", globally)

    cells = shards.select("shard", "docs", "indptr", "indices", "data")
    matrix = cells.groupBy("shard").cogroup(looked_up.groupBy("of")).applyInArrow(place, MATRIX)
    return matrix, dictionary


# --- audit -------------------------------------------------------------------------------


def failures(matrix: DataFrame) -> DataFrame:
    """``id, part, digest, mask`` of every document: its failures of A to D as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                indptr = unpack(batch.column("indptr")[row].as_py(), np.int32)
                data = unpack(batch.column("data")[row].as_py(), np.int32)
                sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
                total, distinct = np.diff(sums[indptr]), np.diff(indptr)
                docs = batch.column("docs")[row].values
                mask = docs.field("flags").to_numpy() + np.where(total < 100, A, 0)
                mask = mask + np.where(100 * distinct.astype(np.int64) < 80 * total, B, 0)
                yield pa.RecordBatch.from_arrays(
                    [docs.field("id"), docs.field("part"), docs.field("digest"), pa.array(mask, pa.int32())],
                    ["id", "part", "digest", "mask"],
                )

    return matrix.mapInArrow(run, "id bigint, part string, digest binary, mask int")


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Add ``good, toxic`` (booleans); NULL keys have no label and are spread."""
    told = labels.groupBy(col(id_col).cast("bigint").alias("__id")).agg(
        *(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"__{c}") for c in ("quality", "toxic"))
    ).where("__id IS NOT NULL").withColumn("__spread", F.lit(0))
    spread = F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(4096)).cast("int")).otherwise(0)
    keyed = rows.withColumns({"__id": F.coalesce("id", F.lit(0)), "__spread": spread})
    joined = keyed.join(told, ["__id", "__spread"], "left")
    flags = {"good": F.coalesce("__quality", F.lit(False)), "toxic": F.coalesce("__toxic", F.lit(False))}
    return joined.withColumns(flags).drop("__id", "__spread", "__quality", "__toxic")


def failure_counts(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``part, mask, n, good, toxic``: documents with each set of failures, E included.

    Rows are added up before each shuffle: by document, then by text and part.
    """
    same = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    cells = with_labels(same, labels, id_col).groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("keyed"),
        F.min("id").alias("low"),
        F.min_by("n", "id").alias("at_low"),
    )
    cells = stored(cells)
    first = cells.groupBy("digest").agg(F.min("low").alias("first"))
    passing = F.when(F.col("low") == F.col("first"), F.col("at_low")).otherwise(0)
    again = F.coalesce(F.col("keyed") - passing, F.lit(0))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - again).alias("n")),
        F.struct((F.col("mask") + E).alias("mask"), again.alias("n")),
    )
    split = cells.join(first, "digest").select("part", "good", "toxic", F.explode(both).alias("b"))
    n = F.col("b.n")
    return split.groupBy("part", F.col("b.mask").alias("mask")).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
    )


def orders() -> list[str]:
    found = [""]
    for _ in FILTERS:
        found = [o + f for o in found for f in FILTERS if f not in o]
    return found


def filter_audit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """A row for each part, order of the five filters and step."""
    matrix, _ = term_matrix(df, id_col, text_col, part_col)
    counts = failure_counts(failures(matrix), labels, id_col)
    names = ("n", "good", "toxic")
    by_part = counts.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names)))).alias("found")
    )
    sets = F.sequence(F.lit(0), F.lit(31))

    def passing(name: str):
        """For each set of filters the documents that pass all of them."""

        def count(s):
            return F.aggregate(
                F.map_entries("found"), F.lit(0).cast("bigint"),
                lambda acc, e: acc + F.when(e["key"].bitwiseAND(s) == 0, e["value"][name]).otherwise(0),
            )

        return F.transform(sets, count)

    wide = by_part.select("part", "found", *[passing(x).alias(x) for x in names])
    steps = wide.select("*", F.explode(F.array(*map(F.lit, orders()))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    earlier, own = F.lit(0), F.lit(0)
    for i, f in enumerate(FILTERS):
        earlier = earlier + F.when(place[f] < F.col("step"), 1 << i).otherwise(0)
        own = own + F.when(place[f] == F.col("step"), 1 << i).otherwise(0)
    steps = steps.withColumns({"__earlier": earlier, "__own": own})

    def left(name: str, s):
        return F.element_at(name, s + 1)

    before, bit = F.col("__earlier"), F.col("__own")
    gone = {x: left(x, before) - left(x, before + bit) for x in names}
    # Orders in which a set of filters stands before the one looked at: |S|! (4 - |S|)!.
    times = F.array(*map(F.lit, (24, 6, 4, 6, 24)))
    shapley = F.aggregate(
        F.filter(sets, lambda s: s.bitwiseAND(bit) == 0), F.lit(0).cast("bigint"),
        lambda acc, s: acc + F.element_at(times, F.bit_count(s) + 1) * (left("n", s) - left("n", s + bit)),
    )
    alone = F.coalesce(F.try_element_at("found", bit)["n"], F.lit(0))
    return steps.select(
        "part", "filter_order", "step",
        left("n", before + bit).alias("kept"),
        gone["n"].alias("removed"),
        (left("n", F.lit(0)) - left("n", bit) - gone["n"]).alias("redundant"),
        alone.alias("unique_fails"),
        gone["good"].alias("good_lost"),
        gone["toxic"].alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def oracle() -> str:
    """The same as DuckDB SQL."""
    letters = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(FILTERS))
    fails = {
        "A": "len(w) < 100",
        "B": "100 * len(list_distinct(w)) < 80 * len(w)",
        "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)",
        "D": "regexp_matches(t, '[#$%&*|]')",
        "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)",
    }
    mask = " + ".join(f"(CASE WHEN {x} THEN {1 << i} ELSE 0 END)" for i, x in enumerate(fails.values()))
    return f"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
masks AS (SELECT doc_id, part, {mask} AS mask FROM words),
counts AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(bad, 0)) AS t
    FROM masks LEFT JOIN told USING (doc_id) GROUP BY part, mask),
letters(f, bit) AS (VALUES {letters}),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, l.bit AS own,
    (SELECT coalesce(sum(k.bit), 0) FROM letters k WHERE instr(filter_order, k.f) < step)::INTEGER AS earlier
    FROM orders, generate_series(1, 5) AS s(step), letters l WHERE substr(filter_order, step, 1) = l.f),
found AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (earlier + own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN t ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM found"""
