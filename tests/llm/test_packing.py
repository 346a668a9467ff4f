import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidyloom.llm.packing import ChunkTokenizer, assign, default_tokenizer, pack_documents
from tidyloom.llm.queries import QUERIES

ODD = [
    "", " ", "plain words", "it's they're  we'LL", "<|endoftext|> in<|startoftext|>side", " nbsp em\x1cfs",
    "Ünïcödé é ́lone", "a\tb\r\nc\x0bd", "数字123 和 text", "x" * 5000, "😀😀 !!! ...", "ΑΣ ΣΑΣ İ", "don 't",
]


def test_chunks_give_the_ids_of_whole_texts():
    by_chunk, whole = ChunkTokenizer(default_tokenizer(), cache=5), ChunkTokenizer(default_tokenizer(), False)
    assert by_chunk.direct
    assert list(by_chunk.encode(ODD)) == list(whole.encode(ODD))


@pytest.mark.parametrize("seed", range(5))
def test_assign_fills_every_sequence(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([0, 1, 64, rnd.randint(1, 64)]) for _ in range(rnd.randint(0, 90))]
    parts = assign(lengths, 64, 100.0)
    by_seq, by_piece = defaultdict(list), defaultdict(list)
    for piece, start, n, seq, offset in parts:
        by_seq[seq].append((offset, n))
        by_piece[piece].append((start, n))
    for spans, want in ((by_seq, None), (by_piece, lengths)):
        for k, v in spans.items():
            at = 0
            for a, n in sorted(v):
                assert a == at and n > 0
                at += n
            assert at == want[k] if want else at == 64 or at & (at - 1) == 0
    assert {i for i, n in enumerate(lengths) if n} == set(by_piece)


def test_long_documents_go_to_the_cheapest_sequence():
    # 40 goes to an empty sequence, 30 to the other; 24 and 20 fill the cheaper one with room.
    parts = assign([40, 30, 24, 20, 14], 64, 0.0)
    assert parts[:3] == [(0, 0, 40, 0, 0), (1, 0, 30, 1, 0), (2, 0, 24, 1, 30)]


def test_chunks_of_documents_give_the_ids_of_whole_texts(spark, tables):
    texts = [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    by_chunk, whole = ChunkTokenizer(default_tokenizer()), ChunkTokenizer(default_tokenizer(), False)
    assert list(by_chunk.encode(texts)) == list(whole.encode(texts))


def check(rows, texts, tokenizer):
    ids = {}
    for key, text in texts.items():
        e = tokenizer.encode(text or "", add_special_tokens=False).ids
        ids[key] = np.array([*e, 2], "<u4")
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        cut = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()
        assert (r["ids_crc32"] if "ids_crc32" in r else zlib.crc32(r["ids"])) == zlib.crc32(cut)
    assert set(pieces) == set(ids)
    for spans, full in ((pieces, ids), (seqs, None)):
        for k, v in spans.items():
            at = 0
            for a, n in sorted(v):
                assert a == at
                at += n
            assert at == len(full[k]) if full else at <= 4096
    return [sum(n for _, n in v) for v in seqs.values()]


def test_query_against_whole_texts(spark, tables):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = [r.asDict() for r in QUERIES["op8_balanced_packing"](spark, tables).collect()]
    lengths = check(rows, docs, Tokenizer.from_file(default_tokenizer()))
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in lengths)
    assert padded == 0


def test_odd_texts(spark):
    from tokenizers import Tokenizer

    texts = {i: t for i, t in enumerate([*ODD, None])}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, ids int")
    rows = [r.asDict() for r in pack_documents(df, docs_per_group=4).collect()]
    check(rows, texts, Tokenizer.from_file(default_tokenizer()))
    assert pack_documents(df.where("false")).count() == 0
    twice = pack_documents(df.where("doc_id = 2").union(df.where("doc_id = 2"))).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


def test_repeated_rows_and_long_texts_are_spread(spark):
    """A third of the rows are one NULL key with an empty text, a third one text; some texts are very long."""
    rows = [(None, "")] * 2000 + [(3, "same words again")] * 2000 + [(10 + i, f"text {i} " * 5) for i in range(2000)]
    rows += [(100_000 + i, "word " * 30_000) for i in range(4)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, ids string").repartition(6)
    got = pack_documents(df, max_len=256, group_bytes=60_000).select("doc_id", "start", "length", "sequence_id", "offset").collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.sequence_id >> 24] += 1
    mean = sum(sizes.values()) / len(sizes)
    assert len(sizes) >= 12 and max(sizes.values()) < 2 * mean
    assert sum(r.doc_id is None for r in got) == 2000 and sum(r.length for r in got if r.doc_id == 100_000) > 30_000
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    again = pack_documents(df, max_len=256, group_bytes=60_000).select("doc_id", "start", "length", "sequence_id", "offset").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
