import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidyloom.llm import context_tree as C
from tidyloom.llm.queries import QUERIES

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, score double, shard int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, held, depth):
    """Scores by the recursive definition of the weighted tree, one context and bit at a time."""
    seen = defaultdict(lambda: [0, 0])
    tokens, learned = Counter(), 0

    def steps(text):
        data = b"\n" * depth + " ".join(WORDS.findall(lower(text))).encode() + b"\n"
        for i in range(depth, len(data)):
            for j in range(8):
                yield data[i - depth : i], (1 << j) | (data[i] >> (8 - j)), data[i] >> (7 - j) & 1

    for key, text in docs:
        if not held(key):
            learned += 1
            tokens.update(WORDS.findall(lower(text)))
            for context, node, bit in steps(text):
                for d in range(depth + 1):
                    seen[context[depth - d :], node][bit] += 1
    children = defaultdict(set)
    for context, node in seen:
        if context:
            children[context[1:], node].add(context)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @cache
    def below(context, node):
        return sum(weighted(c, node) for c in children.get((context, node), ()))

    @cache
    def weighted(context, node):
        own = kt(*seen.get((context, node), (0, 0)))
        return own if len(context) == depth else math.log(0.5) + float(np.logaddexp(own, below(context, node)))

    def p(context, node, bit):
        out = None
        for d in range(depth, -1, -1):
            c = context[depth - d :]
            counts = seen.get((c, node), (0, 0))
            own = (counts[bit] + 0.5) / (sum(counts) + 1)
            if out is None:
                out = own
                continue
            share = math.exp(math.log(0.5) + kt(*counts) - weighted(c, node))
            out = share * own + (1 - share) * out
        return out

    n, v = sum(tokens.values()) + learned, len(tokens) + (learned > 0)
    found = []
    for key, text in docs:
        words = WORDS.findall(lower(text))
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words) + math.log10((learned + 1) / (n + v + 1))
        score = sum(math.log10(p(*s)) for s in steps(text))
        found.append((key, held(key), len(words) + 1, sum(tokens[w] > 0 for w in words) + (learned > 0), n, base, score))
    return found


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def compared(rows, want):
    def order(r):
        return (r[0] is None, r[0] or 0, r[2], r[3], round(r[5], 6), round(r[6], 6))

    got = sorted((tuple(r)[:7] for r in rows), key=order)
    want = sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-7)


DOCS = [
    (1, "The cat saw the cat. The CAT sat"), (2, None), (3, ""), (4, " a\x0bb \n"), (5, "émile äöü the cat's \x85 word"),
    (6, "the cat saw the cat. the cat sat"), (7, "𝔄 the the the"), (None, "the null cat"), (None, None), (1, "other text, one key"),
    (10, "unseen wörds q"), (19, "the cat saw"), (23, "zebra"), (8, "x" * 300), (9, "ab " * 200), (9, "ab " * 200),
]


@pytest.mark.parametrize("depth", [4, 5, 6])
def test_equals_the_definition(spark, depth, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_GRAMS", 100)
    assert any(held(k) for k, _ in DOCS)
    df = spark.createDataFrame([(*d, "en", 1.0, 7) for d in DOCS], SCHEMA).repartition(5)
    rows = C.ctw_scores(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, depth=depth).collect()
    compared(rows, brute(DOCS, held, depth))
    assert all(r["code_length"] > 0 for r in rows)


def test_nothing_to_learn_from(spark):
    docs = [(1, "ab c"), (2, None)]
    df = spark.createDataFrame([(*d, "en", 1.0, 7) for d in docs], SCHEMA)
    rows = {r["doc_id"]: r for r in C.ctw_scores(df, F.lit(True)).collect()}
    assert rows[1]["score"] == pytest.approx(-5 * 8 * math.log10(2)) and rows[1]["base_score"] == 0
    assert rows[2]["n_tokens"] == 1 and rows[2]["n_known"] == 0 and rows[2]["train_tokens"] == 0
    assert C.ctw_scores(df.limit(0), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        C.ctw_scores(df, F.lit(True), depth=7)


def test_probabilities_add_up_to_one():
    """After any context the 256 bytes share one."""
    depth = 4
    texts = pa.array(["the cat saw the cat", "a cat"])
    (_, _, _, grams), = C.grams_of(texts, depth)
    contexts = np.unique(grams >> np.uint64(8))
    all_bytes = (contexts[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()
    keys, n = C.merged([C.counted(grams, np.ones(len(grams), bool)), (np.sort(all_bytes), np.zeros(len(all_bytes), np.int64))])
    roots = [np.concatenate(x) for x in zip(*(C.Subtrees(keys, n, depth).decision(j)[0] for j in range(8)))]
    at = np.sort(roots[0] << np.uint64(8) | roots[1])
    half = {"at": at, "zero": np.full(len(at), 0.1), "one": np.full(len(at), 0.2), "rest": np.full(len(at), 0.7)}
    p = 10 ** C.log_scores(keys, n, depth, half)
    assert np.allclose(p.reshape(len(contexts), 256).sum(1), 1)


def test_log_gamma():
    x = np.concatenate([np.arange(1, 400) / 2, 10.0 ** np.arange(3, 10)])
    assert np.allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-11)


def test_long_texts_in_slices(monkeypatch):
    texts = pa.array(["ab" * 50, "", "c", "defg" * 100, "x"])
    whole = list(C.grams_of(texts, 5))
    monkeypatch.setattr(C, "SLICE", 64)
    parts = list(C.grams_of(texts, 5))
    assert len(parts) > 2
    assert np.concatenate([g for *_, g in parts]).tolist() == np.concatenate([g for *_, g in whole]).tolist()
    assert np.concatenate([a + o for a, _, o, _ in parts]).tolist() == np.concatenate([o for *_, o, _ in whole]).tolist()


def test_query(spark, tables):
    """Whole table: counts by hand, and unseen texts take far less than eight bits a byte."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    rows = QUERIES["op13_context_tree"](spark, tables).collect()
    tokens = Counter()
    for key, text in docs:
        if not held(key):
            tokens.update([*WORDS.findall(lower(text)), "\n"])
    n, v = sum(tokens.values()), len(tokens)
    by_key = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) == len(by_key)
    for key, text in docs:
        words = [*WORDS.findall(lower(text)), "\n"]
        r = by_key[key]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(key), len(words), n)
        assert r["n_known"] == sum(tokens[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words))
    unseen = [r for r in rows if r["held_out"]]
    long = [r["code_length"] for r in unseen if r["n_tokens"] > 100]
    assert long and max(long) < 4 and sum(long) / len(long) < 3
