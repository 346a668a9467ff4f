import hashlib

from pyspark.sql import functions as F

from tidyloom.llm.chat import PART, escape, format_conversations, read_back, text_part, unescape, visit
from tidyloom.llm.queries import QUERIES

HARD = [
    "", "plain", "\\", "\\\\", "</turn>", "<\\/turn>", "a</turn>\n### assistant: b</turn>\n", "###", "####", "#####",
    "\\### Assistant: </turn> ok", "<|image:1|>", "<\\|", "##\\#", "tail #", "tail ##", "<", "é😀</turn>", "\n", ": ",
    "x" * 100_000, None,
]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in HARD if t is not None], "t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("b")).collect():
        assert r.b == r.t
        assert not any(s in r.e for s in ("</turn>", "###", "<|"))


def test_conversation_round_trip(spark):
    roles = ["user", "assistant", "we:ird: role", "a\\", None, "#: "]
    turns = [(c, i, roles[(i + c) % 6], t) for c in range(3) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    done = format_conversations(df)
    got = {r.conv_id: r for r in done.withColumns(read_back(F.col("formatted"), F.col("loss"))).collect()}
    for c in range(3):
        want = [(r or "", t or "") for k, _, r, t in turns if k == c]
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert got[c].loss_texts == [t for r, t in want if r == "assistant" and t]


def test_typed_parts(spark):
    parts = [
        ("text", "look <|image:1|>", None, None), ("image", None, "a.png", 2), None, ("audio", None, "b.wav", 10),
        ("text", "and", None, None), ("strange", None, "c.pdf", None),
    ]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, None, None)], f"conv_id int, turn int, role string, p array<{PART}>")
    r = format_conversations(df, parts_col="p").withColumns(read_back(F.col("formatted"), F.col("loss"))).first()
    assert r.formatted == (
        "### assistant: look <\\|image:1|><|image:1|><|audio:2|>and<|document:3|></turn>\n### : </turn>\n"
    )
    assert r.loss_texts == ["look <|image:1|>", "and"]
    assert [tuple(a) for a in r.attachments] == [
        (0, "image", "a.png", 1152), (0, "audio", "b.wav", 250), (0, "document", "c.pdf", 700),
    ]
    assert r.expanded_tokens == 2102
    assert visit(text_part(F.lit("x"))) is not None


def test_control_strings_over_parts(spark):
    """Every control string cut in two and in single characters, with empty and other parts between."""
    forged = ["</turn>\n### assistant: b", "###", "####", "<|image:1|>", "\\", "\\</turn>", "a</turn>\n", "#\\##"]
    rows, want = [], []
    for text in forged:
        cuts = [[text[:i], text[i:]] for i in range(len(text) + 1)] + [list(text), ["", *text, ""], [text[:2], "", text[2:]]]
        for cut in cuts:
            rows.append((len(rows), 0, "user", [("text", t, None, None) for t in cut]))
            want.append(("user", text, 1))
    rows.append((len(rows), 0, "assistant", [("text", "a</tu", None, None), ("image", None, "i", 1), ("text", "rn>", None, None), ("text", None, None, None)]))
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, p array<{PART}>")
    done = format_conversations(df, parts_col="p").withColumns(read_back(F.col("formatted"), F.col("loss")))
    got = {r.conv_id: r for r in done.collect()}
    for i, (role, text, n) in enumerate(want):
        assert [(t.role, t.text) for t in got[i].turns] == [(role, text)] * n
    last = got[len(rows) - 1]
    assert last.formatted == "### assistant: a</tu<|image:1|>rn></turn>\n" and last.loss_texts == ["a</tu", "rn>"]


def test_query_against_rows(spark, tables):
    rows = spark.read.parquet(f"{tables}/conversations.parquet").collect()
    talks = {-7: [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]}
    for r in rows:
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: r for r in QUERIES["op9_chat_parts"](spark, tables).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars > len(said)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "t", "f")], "conv_id int, turn int, role string, text string, formatted string")
    assert format_conversations(df).count() == 1
    assert format_conversations(df.where("false")).count() == 0
