"""Chat formatting of typed content parts.

A turn holds an array of parts ``(type, text, ref, units)``. A visitor over the
parts writes text escaped and every image, audio clip or document as a
placeholder numbered in order within the turn, notes its reference and the
number of tokens it expands to, and notes where loss is taken. A turn becomes

    ### <role>: <body></turn>\\n

Inside texts a backslash is doubled, and one is put into every control string
(``</turn>``, ``###``, ``<|``) and before a text that follows another, so neither
a text nor several one after the other can close a turn, open one or pass for a
placeholder; dropping the first of each backslash and its follower restores them.

Everything is DataFrame functions: turns are formatted row by row, and only the
finished segments of one conversation meet. A NULL role or text counts as empty,
NULL parts are skipped, an unknown type counts as a document; turns with equal
numbers are ordered by role, then text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import col

END = "</turn>\n"
#: Tokens for each unit of an attachment: an image tile, a second of sound, a page.
TOKENS_PER_UNIT = {"image": 576, "audio": 25, "document": 700}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    out = F.replace(out, F.lit("<|"), F.lit("<\\|"))
    return F.regexp_replace(out, "##(?=#)", r"##\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A text column as an array with one part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("ref"), null.alias("units"))).cast(f"array<{PART}>")


def kind_of(part: Column) -> Column:
    known = ["text", *TOKENS_PER_UNIT]
    return F.when(part["type"].isin(known), part["type"]).otherwise(F.lit("document"))


def visit(parts: Column) -> Column:
    """Flatten parts: an array of ``(text, is_text, kind, ref, tokens)`` in order."""
    shown = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())

    def one(p: Column, i: Column) -> Column:
        kind = kind_of(p)
        number = F.size(F.filter(F.slice(shown, F.lit(1), i + 1), lambda q: kind_of(q) != "text"))
        units = F.coalesce(p["units"], F.lit(1))
        tokens = F.lit(0).cast("bigint")
        for name, each in TOKENS_PER_UNIT.items():
            tokens = F.when(kind == name, units * each).otherwise(tokens)
        text = escape(F.coalesce(p["text"], F.lit("")))
        # A border between two texts, where a control string might come about.
        border = (i > 0) & (kind_of(F.get(shown, i - 1)) == "text") & (text != "") & ~text.startswith("\\")
        text = F.when(border, F.concat(F.lit("\\"), text)).otherwise(text)
        body = F.when(kind == "text", text).otherwise(
            F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>"))
        )
        return F.struct(
            body.alias("text"), (kind == "text").alias("is_text"), kind.alias("kind"),
            p["ref"].alias("ref"), tokens.alias("tokens"),
        )

    return F.transform(shown, one)


def format_turns(df: DataFrame, role: Column, parts: Column) -> DataFrame:
    """Add ``segment``, ``spans`` (start, length of loss text) and ``attachments``."""
    name = F.coalesce(role, F.lit(""))
    head = F.concat(F.lit("### "), F.regexp_replace(escape(name), ":", r"\\:"), F.lit(": "))
    made = df.withColumns({"__role": name, "__head": head, "__parts": visit(parts)})
    lengths = F.transform("__parts", lambda p: F.length(p["text"]))

    def span(p: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, b: a + b)
        start = F.length("__head") + before
        keep = (F.col("__role") == "assistant") & p["is_text"] & (F.length(p["text"]) > 0)
        return F.when(keep, F.struct(start.alias("start"), F.length(p["text"]).alias("length")))

    body = F.array_join(F.transform("__parts", lambda p: p["text"]), "")
    files = F.filter("__parts", lambda p: ~p["is_text"])
    return made.select(
        *[col(c) for c in df.columns],
        F.concat(F.col("__head"), body, F.lit(END)).alias("segment"),
        F.filter(F.transform("__parts", span), lambda s: s.isNotNull()).alias("spans"),
        F.transform(files, lambda p: F.struct(p["kind"], p["ref"], p["tokens"])).alias("attachments"),
    )


def format_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", parts_col: str | None = None,
) -> DataFrame:
    """A row per conversation: ``conv_col, formatted, loss, attachments, expanded_tokens``.

    ``loss`` lists ``(turn, start, length)`` of the spans under the loss mask; start
    counts code points from the turn's first. ``attachments`` lists the references
    in reading order with their turn.
    """
    parts = col(parts_col) if parts_col else text_part(col(text_col))
    turns = format_turns(
        df.select(
            col(conv_col).alias("__conv"), col(turn_col).alias("__turn"),
            col(role_col).alias("__r"), parts.alias("__p"),
        ), F.col("__r"), F.col("__p"),
    )
    row = F.struct("__turn", "segment", "spans", "attachments")
    talks = turns.groupBy("__conv").agg(F.array_sort(F.collect_list(row)).alias("t"))

    def numbered(name: str, *fields: str) -> Column:
        return F.flatten(
            F.transform("t", lambda r, i: F.transform(r[name], lambda s: F.struct(i.alias("turn"), *[s[f].alias(f) for f in fields])))
        )

    files = numbered("attachments", "kind", "ref", "tokens")
    return talks.select(
        F.col("__conv").alias(conv_col),
        F.array_join(F.transform("t", lambda r: r["segment"]), "").alias("formatted"),
        numbered("spans", "start", "length").alias("loss"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("bigint"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column, loss: Column) -> dict[str, Column]:
    """``turns`` (role, text) and ``loss_texts``, parsed from the formatted text alone."""
    cut = F.split(formatted, END)
    segments = F.slice(cut, F.lit(1), F.size(cut) - 1)
    pattern = r"(?s)^(### [^\\:]*+(?:\\.[^\\:]*+)*+: )"

    def turn(s: Column) -> Column:
        head = F.regexp_extract(s, pattern, 1)
        role = F.substring(head, F.lit(5), F.length(head) - 6)
        text = F.substring(s, F.length(head) + 1, F.length(s))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    spans = F.transform(
        loss,
        lambda p: unescape(F.substring(F.get(segments, p["turn"]), p["start"] + 1, p["length"])),
    )
    return {"turns": F.transform(segments, turn), "loss_texts": spans}
