import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyloom.llm.queries import QUERIES
from tidyloom.llm.toxicity import (
    CODE, Restorer, Scorer, costs, features, noise_of, count_trigrams, fit_toxicity, log_odds, logistic, readings, score_toxicity, viterbi,
)

PLAIN = "the idiot said this place is a total scum hole and every moron here seems worthless stupid trash loser clown".split()


@pytest.fixture(scope="module")
def cost(spark):
    rnd = random.Random(0)
    df = spark.createDataFrame([(" ".join(rnd.choice(PLAIN) for _ in range(40)),) for _ in range(50)], "text string")
    return costs(count_trigrams(df.union(df.limit(0))))


def test_counts(spark):
    df = spark.createDataFrame([("ab, AB\nb",), (None,), ("",)], "text string")
    cube = count_trigrams(df)
    a, b = CODE["a"], CODE["b"]
    assert cube[0, 0, a] == 2 and cube[0, a, b] == 2 and cube[a, b, 0] == 2
    assert cube[0, 0, b] == 1 and cube[0, b, 0] == 1 and cube.sum() == 8


def test_viterbi_finds_the_cheapest_reading(cost):
    for token in ["1d10t", "m0r0n", "$tup1d", "cl*wn", "aaab", "l0ser", "x-y", "tr4sh"]:
        best = None
        for path in itertools.product(*readings(token)):
            plain, noise, a, b = "", 0.0, 0, 0
            for letter, n in path:
                noise += n
                if letter:
                    noise += cost[a, b, CODE[letter]]
                    a, b, plain = b, CODE[letter], plain + letter
            total = noise + cost[a, b, 0]
            if best is None or total < best[0]:
                best = (total, plain)
        assert viterbi(token, cost)[1] == best[1]


def test_restoring(cost):
    r = Restorer(cost)
    for noisy, plain in {
        "1d10t": "idiot", "m0r0n": "moron", "$tup1d": "stupid", "stuuuupid": "stupid", "i.d.i.o.t": "idiot", "scum###": "scum",
        "tr4sh,": "trash", "w0rthl3ss": "worthless", "the": "the", "i-d-i-o-t": "idiot", "st*pid": "stupid", "(idiot)": "idiot",
    }.items():
        assert r[noisy] == plain, noisy
    assert "idiot" in r.words("You are an I D I O T today")
    assert r.words(None) == set() == r.words("  ...  ")
    assert r["4.0"] == "4.0" and r["1234"] == "1234"


def test_known_words(cost):
    assert noise_of("sc*m", "scum") < noise_of("5c*m", "scum") < float("inf") == noise_of("scum", "scam")
    assert Restorer(cost, ["scim"])["sc1m"] == "scim" and Restorer(cost * 0, ["scim"])["sc*m"] != "scim"


def test_tokens_of_any_length(cost):
    r = Restorer(cost, ["idiot", "moron", "stupid"])
    assert r["st" + "u" * 41 + "pid"] == r["st" + "u" * 5000 + "pid"] == "stupid"
    assert "stupid" in r.words(".".join("everyplaceisastupidholeandeverymoronseems"))
    assert "moron" in r.words(" ".join("every" * 20 + "moron"))
    assert r["iidiot"] == "idiot" and r["stuupid"] == "stupid" and r["loser-moron"] == "loser moron"
    assert len(viterbi("m0r0n-" * 3000, cost, split=True)[1].split()) == 3000


def test_words_set_apart_by_blanks(cost):
    r = Restorer(cost, ["idiot", "moron", "scum", "stupid"])
    for text, plain in {
        "i d i o t m o r o n": {"idiot", "moron"}, "the idi ot said": {"idiot"}, "the st u pid place": {"stupid"},
        "s c u m": {"scum"}, "every i d 1 o t.": {"idiot"}, "1d1 ot": {"idiot"}, "t h e i d i o t": {"the", "idiot"},
    }.items():
        assert plain <= r.words(text), text
    assert Restorer(cost, ["thisplace"]).words("this place") == {"this", "place"}
    assert not {"a", "as"} & Restorer(cost, ["ass"]).words("c l a s s") - {"a"}


def test_marker_finds_the_features_of_the_model(spark):
    docs, labels = corpus(spark)
    model = fit_toxicity(docs, labels)
    model.weights |= {"seem x2": 1.5, "seems x3": 2.5}
    model.stems = {"seem", "seems"}
    for words in ({"seems", "seemly", "idiot"}, {"seems1", "seems2", "seems3"}, {"x"}, set()):
        z = model.intercept + sum(model.weights.get(f, 0.0) for f in features(words))
        assert log_odds(model, words) == pytest.approx(z)


def test_logistic_is_at_its_minimum():
    draw = np.random.default_rng(0)
    x, n = draw.integers(0, 2, (40, 3)).astype(float), draw.integers(1, 9, 40).astype(float)
    y = (draw.random(40) < 0.2 + 0.6 * x[:, 0]).astype(float)
    start = np.array([1.0, 0.0, -1.0])
    w = logistic(x, y, n, start)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    slope = np.column_stack([np.ones(40), x]).T @ (n * (p - y)) + np.array([1e-6, 0.3, 0.3, 0.3]) * (w - [0, *start])
    assert np.abs(slope).max() < 1e-4
    split = logistic(np.eye(2)[[0, 1]], np.array([0.0, 1.0]), np.array([1e5, 1e5]), np.zeros(2))
    assert np.isfinite(split).all() and split[2] > 0 > split[1]


def corpus(spark, n=600):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [rnd.choice(["the", "place", "here", "seems", "said", "total", "every"]) for _ in range(30)]
        if bad:
            words[rnd.randrange(30)] = rnd.choice(["idiot", "moron", "stupid"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_obfuscated_texts_score_high(spark):
    docs, labels = corpus(spark)
    model = fit_toxicity(docs, labels)
    assert {"idiot", "moron", "stupid"} <= set(model.weights)
    odd = [(1, "said 1d1ot here"), (2, "every m o r o n"), (3, "stuuupid place"), (4, "the place"), (5, ""), (6, None),
           (7, "the " * 100_000 + "$tupid"), (8, "4.0 2,5 !!")]
    df = spark.createDataFrame([(k, t, "own") for k, t in odd], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in score_toxicity(df, model).collect()}
    assert all(got[k] > 0.5 for k in (1, 2, 3, 7)) and all(got[k] < 0.2 for k in (4, 5, 6, 8))
    assert score_toxicity(df.where("false"), model).count() == 0


def test_without_labels(spark):
    docs, labels = corpus(spark, 30)
    model = fit_toxicity(docs, labels.where("false"))
    assert all(0 <= r.score <= 1 for r in score_toxicity(docs, model).collect())


def test_query_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = QUERIES["op6_toxicity"](spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    test = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    hits = np.mean([(s >= 0.5) == t for s, t in test])
    good, bad = [s for s, t in test if not t], [s for s, t in test if t]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert hits > 0.98 and auc > 0.95


def test_equal_texts_count_once(spark):
    docs, labels = corpus(spark, 60)
    copies = docs.where("doc_id = 1").crossJoin(spark.range(1000, 1201)).select(F.col("id").alias("doc_id"), "text", "score")
    many = docs.unionByName(copies)
    more = labels.union(spark.range(1000, 1201).select("id", F.lit(1)))
    assert set(fit_toxicity(many, more).weights) <= {"idiot", "moron", "stupid"}


def test_batches_score_like_single_texts(spark):
    """Whole texts of the table and made-up ones: the same as restoring all words of each text."""
    docs, labels = corpus(spark)
    model = fit_toxicity(docs, labels)
    model.weights |= {"seem x2": 1.5, "ston x3": 2.5, "scum": 2.0, "trash": 1.0, "loser": 1.5}
    model.stems = {"seem", "ston"}
    rnd = random.Random(2)
    noise = {"i": "1!|", "o": "0", "s": "5$", "e": "3", "a": "4@", "t": "7+", "u": "*#"}

    def mask(word):
        kind = rnd.randrange(8)
        if kind == 0:
            return " ".join(word)
        if kind == 1:
            return ".".join(word)
        if kind == 2:
            return "".join(c * rnd.choice((1, 1, 2, 3, 6)) for c in word)
        if kind == 3:
            k = rnd.randrange(1, max(2, len(word)))
            return word[:k] + " " + word[k:]
        if kind == 4:
            return "(" + word + ")!!"
        return "".join(rnd.choice(noise.get(c, c) + c) for c in word)

    some = ["idiot", "moron", "stupid", "scum", "trash", "loser", "seemly", "seems", "stones", "stoning", "stone", "the", "a", "is", "I", "x-y", "№1", "idіоt", "ｍｏｒｏｎ", "Ünter"]
    texts = [" ".join(mask(rnd.choice(some)) if rnd.random() < 0.5 else rnd.choice(some) for _ in range(rnd.randrange(12))) for _ in range(400)]
    texts += [None, "", "  ", "idi", "ot", "i d i o t", "s c", "a " * 5000 + "i d i o t"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    restorer, scorer = Restorer(model.cost, model.words()), Scorer(model)
    want = [1 / (1 + np.exp(-log_odds(model, restorer.words(t)))) for t in texts]
    z = scorer.scores(texts)
    assert np.allclose(1 / (1 + np.exp(-z)), want, rtol=0, atol=1e-12)
    assert len({round(w, 6) for w in want}) > 20


def test_letters_of_other_scripts(cost):
    r = Restorer(cost, ["idiot", "moron"])
    assert r["іdiоt"] == "idiot" and r["ｍｏｒｏｎ"] == "moron" and r["mоr0n"] == "moron"
    assert r["слово"] == "слово"
