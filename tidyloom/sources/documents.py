"""Plans and contexts stored as JSON text, and recovery of damaged JSON.

Everything works on columns, so thousands of plans are read in one job.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.functions.text import strip

CONTEXT_SCHEMA = (
    "dataset_description string, downstream_model string, column_semantics map<string,string>, "
    "redundant_features array<string>, leakage_cols array<string>, "
    "must_do array<string>, must_not_do array<string>, notes string"
)


def is_json(c: Column) -> Column:
    """True when the whole text is one JSON value.

    ``try_parse_json`` alone ignores what follows the first value; inside a
    one-element list nothing can follow.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.coalesce(F.size(boxed.cast("array<variant>")) == 1, F.lit(False))


def fenced_block(c: Column) -> Column:
    """Content of the first fenced code block, NULL when there is none."""
    fenced = F.coalesce(
        F.regexp_substr(c, F.lit("(?s)```json.*?```")), F.regexp_substr(c, F.lit("(?s)```.*?```"))
    )
    return strip(F.regexp_replace(fenced, "^```(json)?|```$", ""))


def outer_braces(c: Column) -> Column:
    hit = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(hit != "", hit)


def from_first_brace(c: Column) -> Column:
    hit = F.regexp_extract(c, r"(?s)(\{.*)$", 1)
    return F.when(hit != "", hit)


def mend_syntax(c: Column) -> Column:
    """Drop comments and trailing commas; single quotes if there are no double ones."""
    c = F.regexp_replace(c, r"//[^\n]*", "")
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    c = F.regexp_replace(c, r",(\s*[}\]])", "$1")
    quotes = c.contains("'") & ~c.contains('"')
    return F.when(quotes, F.replace(c, F.lit("'"), F.lit('"'))).otherwise(c)


_TOKENS = re.compile(r'"(?:\\.|[^"\\])*("|\\?$)|[{}\[\]]', re.DOTALL)
_CLOSER = {"{": "}", "[": "]"}


def close_brackets(text: str) -> str:
    """Close a string and the brackets a cut-off JSON text left open."""
    waiting: list[str] = []
    open_string = False
    for token in _TOKENS.finditer(text):
        mark = token.group(0)
        if mark[0] == '"':
            open_string = token.group(1) != '"'
        elif mark in _CLOSER:
            waiting.append(_CLOSER[mark])
        elif waiting and waiting[-1] == mark:
            waiting.pop()
    whole = text + '"' if open_string else text
    return re.sub(r"[,:]\s*$", "", whole.rstrip()) + "".join(reversed(waiting))


def _close_all(values: pd.Series) -> pd.Series:
    return values.map(close_brackets, na_action="ignore")


def recover_json(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the JSON text inside a noisy answer, or NULL.

    In order: the text itself, a fenced block, the outermost braces, the same
    with syntax mended, and - for what is left - with brackets closed. A text
    that is fine already is NULL to all later steps; the last one is a Python
    function, which gets those rows as NULL. Every step is a column of its own,
    used by the next ones, so no expression is repeated.
    """
    text, good = F.col("__text"), F.col("__good")
    df = df.withColumn("__text", strip(F.col(column)))
    df = df.withColumn("__good", F.when(is_json(text), text))
    df = df.withColumn("__rest", F.when(good.isNull(), text))
    df = df.withColumn("__block", fenced_block(F.col("__rest")))
    df = df.withColumn("__inner", F.coalesce("__block", "__rest"))
    df = df.withColumn("__braces", outer_braces(F.col("__inner")))
    df = df.withColumn("__mended", mend_syntax(F.col("__braces")))
    variants = F.filter(F.array("__block", "__braces", "__mended"), lambda v: is_json(v))
    df = df.withColumn("__good", F.coalesce(good, F.try_element_at(variants, F.lit(1))))
    close = F.pandas_udf(_close_all, "string")
    left = good.isNull()
    df = df.withColumn("__cut", F.when(left, mend_syntax(from_first_brace(F.col("__inner")))))
    df = df.withColumns(
        {
            "__closed": close(F.when(left, F.col("__mended"))),
            "__cut": close(F.col("__cut")),
        }
    )
    closed = F.filter(F.array("__closed", "__cut"), lambda v: is_json(v))
    df = df.withColumn(out, F.coalesce(good, F.try_element_at(closed, F.lit(1))))
    return df.drop(
        "__text", "__good", "__rest", "__block", "__inner", "__braces", "__mended", "__cut", "__closed"
    )


def tolerant_json(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the text as stored; without NUL bytes; or up to its last closing brace."""
    whole = F.col(column)
    df = df.withColumn("__good", F.when(is_json(whole), whole))
    df = df.withColumn(
        "__clean", F.when(F.col("__good").isNull(), strip(F.translate(whole, "\u0000", "")))
    )
    df = df.withColumn("__short", F.regexp_substr("__clean", F.lit("(?s)^.*\\}")))
    variants = F.filter(F.array("__clean", "__short"), lambda v: is_json(v))
    df = df.withColumn(out, F.coalesce("__good", F.try_element_at(variants, F.lit(1))))
    return df.drop("__good", "__clean", "__short")


def read_plan_files(spark: SparkSession, path) -> DataFrame:
    """``file, plan_json`` (NULL where a file cannot be read as JSON)."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), "value"
    )
    return tolerant_json(files, "value", "plan_json").drop("value")


def parse_context(c: Column) -> Column:
    """A context struct; a single outer key is unwrapped."""
    outer = F.from_json(c, "map<string,string>")
    inner = F.when(F.size(outer) == 1, F.map_values(outer)[0]).otherwise(c)
    return F.from_json(inner, CONTEXT_SCHEMA)


def read_context_files(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("name"),
        parse_context(F.col("value")).alias("context"),
    ).select("name", "context.*")
