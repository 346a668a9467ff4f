import hashlib
import random

import numpy as np
import pytest

from tidyloom.llm import fingerprints
from tidyloom.llm.fingerprints import edited_fingerprints, fingerprint, gram_hashes, likeness, winnow
from tidyloom.llm.queries import QUERIES


def plain_winnow(text, k, w):
    """Window by window: smallest hash, rightmost of ties."""
    code = np.array([ord(c) for c in "".join(text.lower().split())], np.uint32)
    if not len(code):
        return []
    k = min(k, len(code))
    h = [int(gram_hashes(code[i : i + k], k)[0]) for i in range(len(code) - k + 1)]
    w, kept = min(w, max(1, len(h) // 6)), []
    for a in range(len(h) - w + 1):
        best = min(range(a, a + w), key=lambda i: (h[i], -i))
        if not kept or kept[-1] != (h[best], best):
            kept.append((h[best], best))
    return kept


@pytest.mark.parametrize("k,w", [(1, 1), (3, 4), (5, 7), (8, 3), (24, 96)])
def test_windows(k, w):
    rnd = random.Random(k)
    for text in ["", " ", "a", "abc", "aaaaaaaaaaaaaaaaaaaa", "Ab cD" * 30, "".join(rnd.choice("ab c😀é") for _ in range(400))]:
        assert [tuple(map(int, p)) for p in winnow(text, k, w)] == plain_winnow(text, k, w)


def test_slices_change_nothing(monkeypatch):
    text = "".join(random.Random(1).choice("abcd ") for _ in range(3000))
    whole = winnow(text, 6, 9)
    monkeypatch.setattr(fingerprints, "SLICE", 37)
    assert (winnow(text, 6, 9) == whole).all()


def test_shared_passages_share_a_fingerprint():
    rnd = random.Random(2)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    for _ in range(20):
        passage = noise(12 + 16 - 1)
        a, b = winnow(noise(300) + passage + noise(50)), winnow(noise(20) + passage + noise(400))
        assert set(a[:, 0]) & set(b[:, 0])


def test_short_texts_have_degrees_of_likeness(spark):
    """Of the documents with three quarters unchanged hardly one looks like a stranger."""
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    rnd = random.Random(4)
    rows += ["".join(rnd.choice("abcdefghij klm") for _ in range(n)) for n in range(40, 300)]
    unlike, short = 0, 0
    for a, b in zip(rows, rows[1:]):
        a, q = a or "", len(a or "") // 4
        if len("".join(a.split())) < 24:
            continue
        own = winnow(a)
        assert len(own) >= 3
        unlike += likeness(own, winnow(a[: len(a) - q] + (b or "")[:q])) == 0
        short += 1
    assert unlike < 0.01 * short
    # A text and the start of it share all hashes that the start keeps, whatever their windows.
    long = "".join(rnd.choice("abcdefgh") for _ in range(2000))
    assert set(winnow(long)[:, 0]) & set(winnow(long[500:560])[:, 0])


def expected(rows):
    rows = sorted((k, t or "") for k, t in rows)
    out = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        marks = [winnow(x) for x in (t, edited, after)]
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), *[m.astype(">u4").tobytes().hex() for m in marks[:2]], likeness(marks[0], marks[1]), likeness(marks[0], marks[2])))
    return out


def test_query_against_rows(spark, tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op2_winnowing"](spark, tables).collect())
    assert got == expected(rows)


@pytest.mark.parametrize("size", [10, 10**9])
def test_odd_texts_over_many_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
    rnd = random.Random(3)
    rows = [(rnd.randint(-50, 10**12), rnd.choice(["", None, "é😀x" * rnd.randint(1, 90), "same text here"])) for _ in range(90)]
    rows += [(7, "b" * 400), (7, "a" * 400), (7, "a" * 400), (10**13, "y" * 300_000)]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    assert sorted(map(tuple, edited_fingerprints(df).collect())) == sorted(expected(rows))
    marks = {(r.doc_id, r.fingerprint) for r in fingerprint(df).collect()}
    assert marks == {(k, winnow(t or "").astype(">u4").tobytes().hex()) for k, t in rows}


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "only one text " * 20)], "doc_id long, text string")
    assert [tuple(r) for r in edited_fingerprints(df).collect()] == expected([(1, "only one text " * 20)])
    assert edited_fingerprints(df.where("false")).count() == 0
    null = spark.createDataFrame([(None, "abc"), (1, "def")], "doc_id long, text string")
    assert sorted(r.n_chars for r in edited_fingerprints(null).collect()) == [3, 3]
