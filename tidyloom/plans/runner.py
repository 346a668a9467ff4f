"""Run a plan step by step with an audit record for each."""

from __future__ import annotations

from pyspark.errors import (
    AnalysisException,
    ArithmeticException,
    DateTimeException,
    IllegalArgumentException,
    NumberFormatException,
    SparkRuntimeException,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.scalar import nan_to_null
from tidyloom.operators.audit import Tally, Uncounted
from tidyloom.operators.columns import (
    cast_type,
    choose_columns,
    drop_column,
    fix_column_names,
    known_columns,
    standard_name,
)
from tidyloom.operators.dedup import deduplicate
from tidyloom.operators.encode import encode_categorical
from tidyloom.operators.missing import handle_missing
from tidyloom.operators.numeric import remove_outliers
from tidyloom.operators.texts import normalize_text
from tidyloom.plans.provenance import ProvenanceLog, log_step, schema_of
from tidyloom.plans.registry import registered

# Order in which approved actions run.
CANONICAL_ORDER = [
    "fix_column_names",
    "normalize_text",
    "cast_type",
    "deduplicate",
    "handle_missing",
    "remove_outliers",
    "drop_column",
    "encode_categorical",
]
_LATER = 9

# What a step that does not fit its table raises. Anything else (a lost
# executor, a full disk) is no fault of the plan and stops the run.
BAD_STEP = (
    AnalysisException,
    ArithmeticException,
    DateTimeException,
    IllegalArgumentException,
    NumberFormatException,
    SparkRuntimeException,
    ValueError,
    TypeError,
    KeyError,
)

EAGER = {
    "fix_column_names": fix_column_names,
    "cast_type": cast_type,
    "handle_missing": handle_missing,
    "normalize_text": normalize_text,
    "deduplicate": deduplicate,
    "drop_column": drop_column,
    "encode_categorical": encode_categorical,
    "remove_outliers": remove_outliers,
    "clip_outliers": remove_outliers,
}

# Parameters an action gets when the plan leaves them out.
DEFAULTS = {
    "normalize_text": {"ops": ["strip", "collapse_whitespace"]},
    "handle_missing": {"strategy": "impute"},
    "remove_outliers": {"method": "iqr", "iqr_k": 3.0, "mode": "clip"},
    "clip_outliers": {"method": "iqr", "iqr_k": 1.5, "mode": "clip"},
    "deduplicate": {"subset": None, "keep": "first", "case_insensitive": False},
    "drop_column": {"on_missing": "skip"},
    "encode_categorical_per_column": {"column_encodings": {}, "default_method": "one_hot"},
    "select_features": {
        "variance_threshold": 0.01,
        "correlation_threshold": 0.95,
        "drop_columns": [],
    },
    "bin_numeric": {"n_bins": 5, "strategy": "quantile", "encode_bins": "ordinal"},
}


def canonical_rank(action: str) -> int:
    return CANONICAL_ORDER.index(action) if action in CANONICAL_ORDER else _LATER


def in_canonical_order(actions: list[dict]) -> list[dict]:
    return sorted(actions, key=lambda a: canonical_rank(a["action"]))


def order_actions(plan_actions: DataFrame) -> DataFrame:
    """The same for a plan table: ``rank`` orders the steps of each plan."""
    rank = F.lit(_LATER)
    for i, name in enumerate(CANONICAL_ORDER):
        rank = F.when(F.col("action") == name, i).otherwise(rank)
    return plan_actions.withColumn("rank", rank)


def complete_params(action: dict, df: DataFrame, target: str | None) -> tuple[dict, list[str]]:
    """Columns that exist, defaults for what the plan left open; and the columns it invented."""
    name = action["action"]
    good, invented = known_columns(df, action.get("target_columns"))
    params = {**DEFAULTS.get(name, {}), **(action.get("params") or {})}
    if good and not params.get("columns"):
        params["columns"] = good
    needs_columns = name in EAGER and name not in ("fix_column_names", "deduplicate")
    if needs_columns and not params.get("columns"):
        params["columns"] = choose_columns(name, df, target)
    if name == "drop_column":
        params.setdefault("target_column", target)
    return params, invented


def _execute(name: str, df: DataFrame, params: dict, target: str | None, audit: bool | Tally):
    if name in EAGER:
        return EAGER[name](df, params, audit)
    handler = registered(name)
    if handler is None:
        raise ValueError(f"unknown action '{name}'")
    state = handler.fit(df, params, params.get("columns") or [], target)
    shown = {k: v for k, v in state.items() if k != "frames"}
    return handler.apply(df, state), shown, []


def run_plan(
    df: DataFrame,
    plan: dict,
    dataset_id: str = "",
    target: str | None = None,
    reorder: bool = False,
    audit: bool = True,
) -> tuple[DataFrame, ProvenanceLog]:
    """Apply a plan; an action that does not fit its table is logged and left out.

    The records' counts are taken by one job over the finished table, which is
    stored in the checkpoint folder. If that job fails by a step's fault, or leaves
    out counters of a table that got empty, the plan is run again with counts after
    each step.
    ``audit=False`` counts nothing and keeps the frame lazy.
    """
    if not audit:
        return _run(df, plan, dataset_id, target, reorder, False)
    try:
        return _run(df, plan, dataset_id, target, reorder, Tally())
    except (Uncounted, *BAD_STEP):
        return _run(df, plan, dataset_id, target, reorder, True)


def _run(
    df: DataFrame, plan: dict, dataset_id: str, target: str | None, reorder: bool, audit: bool | Tally
) -> tuple[DataFrame, ProvenanceLog]:
    log = ProvenanceLog()
    current = nan_to_null(df)
    actions = [a for a in plan.get("actions") or [] if a and a.get("action")]
    if reorder:
        actions = in_canonical_order(actions)
    late: list[tuple[dict, list[str], list[str]]] = []
    for i, action in enumerate(actions, start=1):
        name = action["action"]
        entry = {
            "dataset_id": dataset_id,
            "step_id": i,
            "action_name": name,
            "rationale": action.get("rationale", ""),
            "before_schema": schema_of(current),
        }
        waiting = len(audit.waiting) if isinstance(audit, Tally) else 0
        notes: list[str] = []
        warned: list[str] = []
        try:
            params, invented = complete_params(action, current, target)
            notes = [f"unknown columns discarded: {invented}"] if invented else []
            entry["params"] = params
            if "columns" in params and not params["columns"] and name != "cast_type":
                entry |= {"status": "skipped", "warnings": [*notes, "no columns to work on"]}
                log.add_step(log_step(**entry))
                continue
            after, diff, warned = _execute(name, current, params, target, audit)
            entry |= {"status": "applied", "after_schema": schema_of(after), "diff_summary": diff, "warnings": notes}
            current = after
            if name == "fix_column_names" and target is not None:
                target = standard_name(target)
        except BAD_STEP as error:
            if isinstance(audit, Tally):
                # Counters of a step that is left out are never run.
                del audit.waiting[waiting:]
            entry.setdefault("params", action.get("params") or {})
            entry |= {"status": "failed", "error": str(error)}
        step = log_step(**entry)
        log.add_step(step)
        if step["status"] == "applied":
            late.append((step, notes, warned))
    if isinstance(audit, Tally):
        current = audit.settle(current)
    for step, notes, warned in late:
        step["warnings"] = notes + warned
    return current, log


def run_fixed(
    df: DataFrame, dataset_id: str = "", audit: bool = True
) -> tuple[DataFrame, ProvenanceLog]:
    """The fixed preset, eagerly: names, median/mode imputation, exact duplicates, text."""
    impute = {
        "numeric": "median",
        "categorical": "most_frequent",
        "constant_value": 0,
        "constant_categorical": "MISSING",
    }
    plan = {
        "actions": [
            {"action": "fix_column_names", "rationale": "fixed preset: names"},
            {
                "action": "handle_missing",
                "rationale": "fixed preset: imputation",
                "params": {"strategy": "impute", "impute": impute},
            },
            {"action": "deduplicate", "rationale": "fixed preset: exact duplicates"},
            {"action": "normalize_text", "rationale": "fixed preset: whitespace"},
        ]
    }
    return run_plan(df, plan, dataset_id, audit=audit)
