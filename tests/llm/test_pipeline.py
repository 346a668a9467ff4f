from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tidyloom.llm.mixing import mix_sources, word_count
from tidyloom.llm.toxicity import fit_toxicity, score_toxicity, training_labels


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_follow_each_other(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        made[name] = (before, docs)

    before, after = made["toxicity"]
    score = score_toxicity(before, fit_toxicity(before, training_labels(labels)))
    assert set(rows(after)) == {r.doc_id for r in score.collect() if r.score < 0.5}

    before, after = made["ngram_join"]
    text = {k: r.text for k, r in rows(before).items()}
    grams = {}
    for k, t in text.items():
        w = "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split()
        grams[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in grams}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(grams)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = grams[a], grams[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert set(rows(after)) == {k for k in keys if find(k) == k}

    before, after = made["mixing"]
    taken = {r.doc_id: r for r in mix_sources(before, word_count(F.col("text"))).collect()}
    words = Counter()
    for r in after.select("doc_id", word_count(F.col("text")).alias("n")).collect():
        words[r.doc_id] += r.n
    assert words == Counter({k: r.taken for k, r in taken.items() if r.taken})

    before, after = made["packing"]
    pieces = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.expr("if(start = 0, doc_tokens, 0)")).alias("m"))
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in before.collect()}
    sizes = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 4096 for r in sizes)


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 0


def test_odd_documents(spark):
    data = [(None, None, None, None, None, "x"), (1, "", "en", None, 0, "y"), (1, "", "en", None, 0, "y"),
            (2, "one two three four five six", "en", "s", 27, "z"), (3, "One two, three four five six!", None, "s", 29, "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size string")
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2]
    assert kept.columns == docs.columns and kept.count() == 2
    assert corpus_pipeline.mixing(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.near_copies(spark, docs.where("false"), "").count() == 0


def test_keys_of_several_texts(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in (0, 59)]
    other = " ".join(f"q{i}" for i in range(60))
    data = [(1, " ".join(base)), (5, near[0]), (5, other), (5, other), (None, "a b c d e f g"), (None, "A b c d e f g!"), (None, "A b c d e f g!"), (None, "lone")]
    for rows in (data, [*data, (None, near[1])]):
        docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string").repartition(3)
        kept = sorted(((r.doc_id, (r.text or "").lower().strip("!")) for r in corpus_pipeline.near_copies(spark, docs, "").collect()), key=str)
        first = (1, " ".join(base)) if rows is data else (None, near[1])
        assert kept == sorted([first, (5, other), (None, "a b c d e f g"), (None, "lone")], key=str)
