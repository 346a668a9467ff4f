"""Text expressions. Everything but accent removal stays inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's Unicode \s leaves out the four ASCII separators that Python strips.
_SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse_whitespace(c: Column) -> Column:
    """Every whitespace run becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){_SPACE}+", " "))


@lru_cache(maxsize=1)
def _is_combining() -> np.ndarray:
    flags = np.zeros(0x110000, dtype=bool)
    for cp in range(0x300, 0x110000):
        flags[cp] = unicodedata.combining(chr(cp)) > 0
    return flags


def _without_marks(text: str) -> str:
    flags = _is_combining()
    points = np.frombuffer(unicodedata.normalize("NFKD", text).encode("utf-32-le"), dtype="<u4")
    return points[~flags[points]].tobytes().decode("utf-32-le")


def _fold_accents(values: pd.Series) -> pd.Series:
    return values.map(_without_marks, na_action="ignore")


def remove_accents(c: Column) -> Column:
    """NFKD, then drop combining marks.

    Only values with a non-ASCII character travel to Python; the rest is
    returned as it is.
    """
    fold = F.pandas_udf(_fold_accents, "string")
    foreign = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(fold(foreign), c)


def java_replacement(repl: str) -> str:
    r"""Python replacement syntax (``\1``, ``\g<name>``) as Java's (``$1``, ``${name}``)."""
    out = repl.replace("$", r"\$")
    out = re.sub(r"\\g<([A-Za-z]\w*)>", r"${\1}", out)
    out = re.sub(r"\\g<(\d+)>", r"$\1", out)
    return re.sub(r"\\(\d+)", r"$\1", out)


def java_pattern(pattern: str) -> str:
    """Python's named-group syntax as Java's; the rest is common to both."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def regex_rule(c: Column, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(c, F.lit(java_pattern(pattern)), F.lit(java_replacement(repl)))


def null_if_token(c: Column, tokens) -> Column:
    """NULL where the value equals a token, ignoring case."""
    wanted = sorted({str(t).lower() for t in tokens})
    return F.when(~F.lower(c.cast("string")).isin(wanted), c) if wanted else c


ALLOWED_OPS = ("strip", "lower", "remove_accents", "collapse_whitespace")
_OP_FUNCTIONS = {
    "strip": strip,
    "lower": F.lower,
    "remove_accents": remove_accents,
    "collapse_whitespace": collapse_whitespace,
}


def normalise(c: Column, ops) -> Column:
    """Apply the requested operations, always in the order of ``ALLOWED_OPS``."""
    for op in ALLOWED_OPS:
        if op in ops:
            c = _OP_FUNCTIONS[op](c)
    return c
