"""Text normalisation of whole columns, with an audit of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions import text as tx
from tidyloom.functions.scalar import col, is_text
from tidyloom.operators.audit import Tally, columns_of, counted, list_of, settings

DEFAULT_OPS = ["strip", "lower", "collapse_whitespace"]


def _rule(value: dict) -> dict:
    if not isinstance(value, dict) or not isinstance(value.get("pattern"), str):
        raise ValueError("each replacement has a pattern")
    return value


def _operation(value: str) -> str:
    if value not in tx.ALLOWED_OPS:
        raise ValueError(f"one of {', '.join(sorted(tx.ALLOWED_OPS))}")
    return value


def normalize_text(df: DataFrame, params: dict, audit: bool | Tally = True):
    """Strip, lower, fold accents, collapse blanks, regex rules, null-like tokens - in that order."""
    names = columns_of("normalize_text", df, params)
    chosen = settings(
        "normalize_text", params,
        ops=(DEFAULT_OPS, lambda v: [_operation(o) for o in list_of(str)(v)]),
        replace=([], lambda v: [_rule(r) for r in list_of(dict)(v)]),
        null_like_to_nan=([], list_of(str)),
        non_string_policy=("coerce_to_string", ("coerce_to_string", "skip")),
    )
    rules, tokens = chosen["replace"], chosen["null_like_to_nan"]

    new, counters = {}, {}
    for c in names:
        if chosen["non_string_policy"] == "skip" and not is_text(df.schema[c].dataType):
            if tokens:
                new[c] = tx.null_if_token(col(c), tokens)
                counters["null", c] = counters["changed", c] = F.count_if(col(c).isNotNull() & new[c].isNull())
            continue
        before = col(c).cast("string")
        stages = [tx.normalise(before, chosen["ops"])]
        for r in rules:
            stages.append(tx.regex_rule(stages[-1], r["pattern"], r.get("repl", "")))
        if rules:
            hits = [F.count_if(~a.eqNullSafe(b)) for a, b in zip(stages, stages[1:])]
            counters["rules", c] = sum(hits[1:], hits[0])
        done = stages[-1]
        if tokens:
            emptied = tx.null_if_token(done, tokens)
            counters["null", c] = F.count_if(done.isNotNull() & emptied.isNull())
            done = emptied
        counters["changed", c] = F.count_if(~before.eqNullSafe(done))
        new[c] = done

    record, notes = {"columns_normalized": names}, []

    def tell(found: dict) -> None:
        def of(kind: str) -> dict:
            return {c: n for (k, c), n in found.items() if k == kind}

        record["values_changed_count"] = {c: of("changed").get(c, 0) for c in names}
        record["null_like_converted_to_nan"] = {c: n for c, n in of("null").items() if n}
        record["replacements_applied"] = {c: n for c, n in of("rules").items() if n}
        notes.extend(f"{c} was in this form already" for c, n in record["values_changed_count"].items() if not n)

    if audit and not counters:
        tell({})
    df = counted(df, counters, audit, tell)
    return (df.withColumns(new) if new else df), record, notes
