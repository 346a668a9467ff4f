"""Packing token streams into sequences of balanced attention cost.

A document's cost is estimated as ``linear`` x n + n x n for n tokens. Documents
longer than a sequence are cut first. Pieces are dealt by hash to groups of about
``docs_per_group`` documents, and no more than about ``group_bytes`` of text,
which is the unit of the greedy step: a group of T
tokens opens T // max_len full sequences and, for the rest, one sequence for each
power of two in it, so that nothing is padded. Pieces go in descending order to
the lowest-cost sequence that still has room for them; where none has, the piece
is cut at the room of the lowest-cost open sequence and its rest queues again.

Tokenizing goes by blank-separated chunks and remembers words in each Python
worker; their ids do not depend on their neighbours in the word-level vocabularies
this is meant for (``chunked=False`` tokenizes whole texts). The hash takes in a
piece's key, start, ids, partition and its number among equal pieces of the
partition, so rows that repeat are spread like others, groups are bounded, and a
lost task gives the same rows again, in whatever order it reads them.

NULL and empty texts are a lone end token; rows with equal keys are packed as
separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import col

MAX_LEN = 4096
#: Words remembered in a Python worker (other operators share its memory).
CACHE_WORDS = 100_000
#: Bytes of text tokenized at once.
GATHER_BYTES = 4_000_000
#: Text of a group of the greedy step.
GROUP_BYTES = 4_000_000
#: A chunk as a word and ASCII marks after it, where word-level tokenizers always cut.
WORD_AND_MARKS = r"(?s)^(?P<w>.*?)(?P<m>[!-&(-/:-@\[-^`{-~]*)$"
#: What is left to the whole tokenizer: anything but Latin, and letters lowered by rules of their own.
UNUSUAL = r"[^\x{0}-\x{24f}]|\x{130}"
#: Weight of the linear term: about six model widths, here for a width of 1024.
LINEAR = 6144.0
PROBES = ["word", "tokenization", "é", "straße", "größe", "año", "слово", "語", "ﬁ", "ß", "zzzzqx"]


def byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


BYTE_SIGNS = byte_signs()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent(dict):
    """Results of a function, remembered while they are asked for.

    When more than ``limit`` entries are new, those not asked for since the last
    time are forgotten.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def rotate(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


class ChunkTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Texts are cut at blanks and line ends and the distinct chunks of a batch looked
    up once; the ids of all texts are then gathered from those of their chunks. A
    chunk of letters with closing marks is its word's ids and its marks' ids. A new
    word goes to the tokenizer's model directly if that gives the same ids (which
    is tried out first), anything unusual through the whole tokenizer.
    """

    def __init__(self, path: str, chunked: bool = True, cache: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunked = chunked
        self.words = Recent(self._word, cache)
        self.marks = Recent(self._ids, cache)
        self.direct = chunked and [self._model_ids(w) for w in PROBES] == [self._ids(w) for w in PROBES]

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model_ids(self, word: str) -> bytes:
        """Ids of a lower-case word of letters, straight from the model."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_SIGNS)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _word(self, word: str) -> bytes:
        plain = word.isascii() or is_normalized("NFC", word)
        return self._model_ids(word) if self.direct and plain else self._ids(word)

    def _parts(self, chunks: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Pieces of ids, and for each chunk the numbers of its two pieces (0 is empty)."""
        cut = pc.extract_regex(chunks, WORD_AND_MARKS)
        usual = pc.and_not(pc.utf8_is_alpha(cut.field("w")), pc.match_substring_regex(chunks, UNUSUAL))
        usual = usual.to_numpy(zero_copy_only=False)
        pieces, first = [b""], np.zeros((len(chunks), 2), np.int64)
        plain = pa.array(usual)
        for column, values, known in (
            (0, pc.utf8_lower(cut.field("w").filter(plain)), self.words),
            (1, cut.field("m").filter(plain), self.marks),
        ):
            coded = values.dictionary_encode()
            first[usual, column] = len(pieces) + coded.indices.to_numpy()
            pieces += [known[v] if v else b"" for v in coded.dictionary.to_pylist()]
        other = np.flatnonzero(~usual)
        first[other, 0] = len(pieces) + np.arange(len(other))
        pieces += [self._ids(c) if c else b"" for c in chunks.take(pa.array(other)).to_pylist()]
        return pieces, first

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if not self.chunked:
            yield from map(self._ids, texts)
            return
        for known in (self.words, self.marks):
            known.rotate()
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        flat = lists.flatten().dictionary_encode()
        pieces, first = self._parts(flat.dictionary.cast(pa.string()))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        begin = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(pieces), "<u4")
        met = first[flat.indices.to_numpy()]
        length = size[met]
        ends = np.concatenate([[0], np.cumsum(length.sum(1))])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        met, length = met.ravel(), length.ravel()
        some = np.flatnonzero(length)
        met, length = met[some], length[some]
        at = np.repeat(begin[met] - (np.cumsum(length) - length), length)
        ids = pool[at + np.arange(len(at))]
        for i in range(len(texts)):
            yield ids[ends[i] : ends[i + 1]].tobytes()


_TOKENIZERS: dict[tuple, ChunkTokenizer] = {}


def worker_tokenizer(path: str, chunked: bool) -> ChunkTokenizer:
    """One tokenizer for each Python worker."""
    if (path, chunked) not in _TOKENIZERS:
        _TOKENIZERS[path, chunked] = ChunkTokenizer(path, chunked)
    return _TOKENIZERS[path, chunked]


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``most`` bytes of text (column 1)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def token_pieces(
    df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, max_len: int, chunked: bool, width: int
) -> DataFrame:
    """``id, start, doc_tokens, ids, deal``: documents cut to at most ``max_len`` ids of ``width`` bytes.

    ``deal`` is a hash of the piece in which equal pieces differ.
    """

    kind = pa.from_numpy_dtype(np.int64)
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(tokenizer, chunked)
        partition = TaskContext.get().partitionId()
        met: dict[bytes, int] = {}
        end = np.asarray([end_id], f"<u{width}").tobytes()
        for batch in slices(batches, GATHER_BYTES):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            names = keys.cast(pa.string()).to_pylist()
            row, start, size, ids, deal, held = [], [], [], [], [], 0
            for i, encoded in enumerate(tok.encode([t or "" for t in texts])):
                encoded = np.frombuffer(encoded, "<u4").astype(f"<u{width}").tobytes() + end
                n = len(encoded) // width
                mark = hashlib.blake2b(repr(names[i]).encode("utf-8", "surrogatepass") + encoded, digest_size=16).digest()
                met[mark] = copy = met.get(mark, 0) + 1
                for a in range(0, n, max_len):
                    place = hashlib.blake2b(mark + b"%d %d %d" % (a, partition, copy), digest_size=8).digest()
                    deal.append(int.from_bytes(place, "little", signed=True))
                    row.append(i)
                    start.append(a)
                    size.append(n)
                    ids.append(encoded[width * a : width * (a + max_len)])
                held += len(encoded)
                if held > 16_000_000 or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(row, kind)), pa.array(start, kind), pa.array(size, kind), pa.array(ids, pa.binary()), pa.array(deal, kind)],
                        ["id", "start", "doc_tokens", "ids", "deal"],
                    )
                    row, start, size, ids, deal, held = [], [], [], [], [], 0

    narrow = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(
        run, f"id {id_type.simpleString()}, start bigint, doc_tokens bigint, ids binary, deal bigint"
    )


def assign(lengths: list[int], max_len: int = MAX_LEN, linear: float = LINEAR) -> list[tuple]:
    """Greedy placement; ``(piece, from, length, sequence, offset)`` for each part.

    Pieces of equal length keep their order in ``lengths``.
    """
    total = sum(lengths)
    rest = total % max_len
    rooms = [max_len] * (total // max_len)
    rooms += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    size = np.asarray(rooms, np.int64)
    room = size.copy()
    cost = np.zeros(len(rooms))
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out = []
    while queue:
        n, i, start = heapq.heappop(queue)
        n = -n
        fits = room >= n
        if not fits.any():
            fits = room > 0
        s = int(np.where(fits, cost, np.inf).argmin())
        part = min(n, int(room[s]))
        out.append((i, start, part, s, int(size[s] - room[s])))
        room[s] -= part
        cost[s] += linear * part + float(part) * part
        if part < n:
            heapq.heappush(queue, (part - n, i, start + part))
    return out


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    max_len: int = MAX_LEN,
    docs_per_group: int = 512,
    linear: float = LINEAR,
    chunked: bool = True,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """A row per piece: ``id_col, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit; ``sequence_id`` is the group's
    number times 2^24 plus the place in the group.
    """
    size = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(col(text_col).cast("string"))).alias("b")).first()
    groups = max(1, -(-size["n"] // docs_per_group), -(-(size["b"] or 0) // group_bytes))
    path = tokenizer or default_tokenizer()
    # Ids travel in two bytes where the vocabulary allows.
    width = 2 if worker_tokenizer(path, chunked).tokenizer.get_vocab_size() <= 65_536 else 4
    pieces = token_pieces(df, id_col, text_col, path, end_id, max_len, chunked, width)
    dealt = pieces.withColumn("grp", F.pmod("deal", F.lit(groups).cast("bigint"))).drop("deal")
    kind = dict(pieces.dtypes)["id"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["ids"].tolist()
        keys = list(zip(pdf["id"].isna(), pdf["id"].fillna(0), pdf["start"], pdf["doc_tokens"], ids))
        order = sorted(range(len(ids)), key=keys.__getitem__)
        parts = assign([len(ids[i]) // width for i in order], max_len, linear)
        piece = np.array([order[p[0]] for p in parts], np.int64)
        wide = [np.frombuffer(b, f"<u{width}").astype("<u4").tobytes() for b in ids]
        base = int(pdf["grp"].iloc[0]) << 24
        return pd.DataFrame({
            "id": pdf["id"].take(piece).array,
            "start": pdf["start"].to_numpy()[piece] + [p[1] for p in parts],
            "length": [p[2] for p in parts],
            "ids": [wide[i][4 * p[1] : 4 * (p[1] + p[2])] for i, p in zip(piece, parts)],
            "doc_tokens": pdf["doc_tokens"].to_numpy()[piece],
            "sequence_id": [base + p[3] for p in parts],
            "offset": [p[4] for p in parts],
        })

    packed = dealt.groupBy("grp").applyInPandas(
        pack,
        f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
        "sequence_id bigint, offset bigint",
    )
    return packed.withColumnRenamed("id", id_col)

