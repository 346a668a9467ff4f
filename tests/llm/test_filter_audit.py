import itertools
import re

import numpy as np
import pytest

from oracle import compare, connect
from tidyloom.llm import words as W
from tidyloom.llm.common import pack, unpack
from tidyloom.llm.filter_audit import filter_audit, orders, term_matrix
from tidyloom.llm.queries import ORACLE, QUERIES

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, word string, shard int, part string"


def brute(docs, labels):
    """All counts by going through the documents once for each order and step."""
    rows = []
    for key, text, lang in docs:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in docs),
        }
        own = [x for x in labels if x[0] == key and key is not None]
        rows.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = [r for r in rows if r[0] == part and r[1][f]]
                total[part, f] = total.get((part, f), 0) + len(removed)
                out[part, order, step] = [
                    len(left), len(removed), len(failing) - len(removed),
                    sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in removed), sum(r[3] for r in removed),
                ]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def odd_documents():
    long = " ".join(f"w{i}" for i in range(150))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (1, long, "de"), (None, long, "en"), (None, long, None),
        (3, None, "en"), (4, "", None), (5, "a  b c\x0bd\x85e\x1ff\n", ""), (6, "A B C", "en"), (7, long + " #", "en"),
        (8, "x " * 400, "de"), (9, long + " É" + "A" * 120, "de"), (10, "x " * 400, "en"), (11, "w " * 300_000, "xx"),
        (12, "𝔄B" * 9, "en"), (None, "", "en"), (7, "other | text", "en"),
    ]
    return docs + [(100 + i, long + " copy", "en") for i in range(40)]


def test_odd_rows(spark, monkeypatch):
    docs = odd_documents()
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (5, None, 1), (6, 1, 1), (105, 1, 0), (999, 1, 1)]
    df = spark.createDataFrame([(*d, "w", 3, "p") for d in docs], SCHEMA).repartition(5)
    told = spark.createDataFrame([(*x, "t") for x in labels], "doc_id bigint, quality int, toxic int, text string")
    got = {
        (r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit(df, told).collect()
    }
    assert got == brute(docs, labels)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a", None, "", 1, "")], SCHEMA)
    rows = filter_audit(one, labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""}


def test_matrix_holds_all_words(spark):
    """Read back through the dictionary, the cells are the words of the texts."""
    docs = odd_documents()
    df = spark.createDataFrame([(*d, "w", 3, "p") for d in docs], SCHEMA).repartition(4)
    matrix, dictionary = term_matrix(df)
    names = {r["word_id"]: r["word"] for r in dictionary.collect()}
    assert sorted(names) == list(range(len(names))) and len(set(names.values())) == len(names)
    found = []
    for r in matrix.collect():
        indptr, column, data = unpack(r["indptr"], np.int32), unpack(r["indices"], np.int64), unpack(r["data"], np.int32)
        for i, doc in enumerate(r["docs"]):
            cells = slice(indptr[i], indptr[i + 1])
            bag = sorted((names[c], n) for c, n in zip(column[cells].tolist(), data[cells].tolist()))
            found.append((doc["id"] or -1, str(bag)))
    want = []
    for key, text, _ in docs:
        words = WORDS.findall(text or "")
        want.append((key or -1, str(sorted((w, words.count(w)) for w in set(words)) if len(words) < 1000 else [("w", 300_000)])))
    want = [(k, str([("x", 400)]) if b.startswith("[('x', 400)") else b) for k, b in want]
    assert sorted(found) == sorted(want)


def test_shards_are_bounded():
    import pyarrow as pa

    class Context:
        @staticmethod
        def partitionId():
            return 3

    class Task:
        get = staticmethod(lambda: Context)

    old, W.TaskContext = W.TaskContext, Task
    try:
        texts = ["x" * n for n in (10, 90, 100, 500, 3, 0, 99)] + [None]
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:b], pa.string())], ["text"]) for a, b in ((0, 3), (3, 8))]
        parts = list(W.blocks(iter(batches), 0, limit=100))
    finally:
        W.TaskContext = old
    assert [t for _, p in parts for t in p.column("text").to_pylist()] == texts
    assert len({n for n, _ in parts}) == len(parts) and parts[0][0] == 3 << 32
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 100 for _, p in parts)


def test_packing_numbers():
    for values in (np.zeros(0, np.int32), np.arange(1000, dtype=np.int64) * 7 - 5, np.array([2**40], np.uint64)):
        assert (unpack(pack(values), values.dtype) == values).all()


def test_orders():
    assert sorted(orders()) == sorted(map("".join, itertools.permutations("ABCDE")))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    name = "op11_filter_audit"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None
