"""Ready-made plans."""

from __future__ import annotations

# Words in a downstream model's name that tell its family.
TREE_WORDS = ["tree", "forest", "random", "gradient", "gbm", "xgboost", "lightgbm"]
LINEAR_WORDS = ["linear", "logistic", "ridge", "lasso", "knn", "svm", "distance"]
ORDERED_WORDS = ["ordinal", "ordered"]


def _step(action: str, rationale: str, **params) -> dict:
    return {"action": action, "rationale": rationale, "target_columns": [], "params": params}


def is_tree(downstream: str | None) -> bool:
    return any(w in (downstream or "").lower() for w in TREE_WORDS)


def raw_plan() -> dict:
    return {"actions": []}


def fixed_plan() -> dict:
    """The same four steps for every table."""
    return {
        "actions": [
            _step("fix_column_names", "Standard column names."),
            _step("handle_missing", "Impute missing values.", strategy="impute"),
            _step("deduplicate", "Remove exact duplicate rows."),
            _step("normalize_text", "Strip and collapse whitespace."),
        ]
    }


def fallback_plan(context: dict | None = None, per_column: bool = False) -> dict:
    """Plan used when none could be obtained; encoding follows the model family."""
    context = context or {}
    method = "ordinal" if is_tree(context.get("downstream_model")) else "one_hot"
    if per_column:
        encodings = {
            c: "ordinal" if any(w in str(s).lower() for w in ORDERED_WORDS) else method
            for c, s in (context.get("column_semantics") or {}).items()
        }
        encode = _step(
            "encode_categorical_per_column",
            "Fallback: encoding per column.",
            column_encodings=encodings,
            default_method=method,
        )
    else:
        encode = _step("encode_categorical", "Fallback: one encoding for all.", method=method)
    return {
        "actions": [
            _step("fix_column_names", "Fallback: standard column names."),
            _step("handle_missing", "Fallback: impute missing values.", strategy="impute"),
            _step("normalize_text", "Fallback: standard strings."),
            encode,
        ]
    }
