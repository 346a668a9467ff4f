"""Actions a plan may name.

An action is a class with ``fit(df, params, columns, target) -> state`` and
``apply(df, state) -> df``. The state is plain data (plus optional DataFrames
under ``frames``), so a fitted plan can be saved and applied elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidyloom.operators import encode, missing, numeric
from tidyloom.operators.columns import (
    cast_type,
    fix_column_names,
    resolve_names,
)
from tidyloom.operators.texts import normalize_text
from tidyloom.functions.scalar import is_numeric, numeric_columns, text_columns

_ACTIONS: dict[str, type] = {}


def register_action(*names: str):
    """Class decorator: make an action available to plans under one or more names."""

    def add(cls):
        for n in names:
            _ACTIONS[n] = cls
        return cls

    return add


def registered(name: str):
    return _ACTIONS.get(name)


def action_names() -> list[str]:
    return sorted(_ACTIONS)


def _named(df: DataFrame, wanted, target) -> list[str]:
    real = resolve_names(df.columns, wanted)
    return [real[c] for c in wanted if c in real and real[c] != target]


@register_action("fix_column_names")
class FixColumnNames:
    @staticmethod
    def fit(df, params, columns, target):
        return {}

    @staticmethod
    def apply(df, state):
        return fix_column_names(df)[0]


@register_action("normalize_text")
class NormalizeText:
    @staticmethod
    def fit(df, params, columns, target):
        cols = _named(df, params.get("columns") or columns, None) or text_columns(df, [target])
        return {
            "columns": cols,
            "ops": params.get("ops", ["strip", "collapse_whitespace"]),
            "null_like_to_nan": params.get("null_like_to_nan", []),
            "replace": params.get("replace", []),
        }

    @staticmethod
    def apply(df, state):
        cols = [c for c in state["columns"] if c in df.columns]
        return normalize_text(df, {**state, "columns": cols}, audit=False)[0] if cols else df


@register_action("drop_column")
class DropColumn:
    @staticmethod
    def fit(df, params, columns, target):
        return {"columns": _named(df, params.get("columns") or columns, target)}

    @staticmethod
    def apply(df, state):
        return df.drop(*[c for c in state["columns"] if c in df.columns])


@register_action("cast_type")
class CastType:
    @staticmethod
    def fit(df, params, columns, target):
        cols = _named(df, params.get("columns") or columns, None)
        state = {**params, "columns": cols}
        if cols and params.get("errors") == "ignore":
            # Decided once, on the training rows.
            state["columns"] = cast_type(df, state)[1]["columns_casted"]
            state["errors"] = "coerce"
        return state

    @staticmethod
    def apply(df, state):
        cols = [c for c in state["columns"] if c in df.columns]
        if not cols:
            return df
        if df.isStreaming:
            state = {**state, "errors": "coerce"}
        audit = state.get("errors", "raise") != "coerce"
        return cast_type(df, {**state, "columns": cols}, audit=audit)[0]


@register_action("handle_missing")
class HandleMissing:
    @staticmethod
    def fit(df, params, columns, target):
        return missing.fit_imputer(
            df,
            _named(df, params.get("columns") or columns, target),
            params.get("strategy", "impute"),
            params.get("cat_missing_strategy", "preserve_missing"),
            target,
        )

    @staticmethod
    def apply(df, state):
        return missing.apply_imputer(df, state)


@register_action("semantic_missing_to_category")
class SemanticMissing:
    @staticmethod
    def fit(df, params, columns, target):
        return {
            "fills": missing.fit_semantic_fill(
                df,
                params.get("fill_value", "None"),
                params.get("column_fills", {}),
                float(params.get("min_na_rate", 0.0)),
                target,
            )
        }

    @staticmethod
    def apply(df, state):
        return missing.fill(df, state["fills"])


@register_action("add_missing_indicators")
class MissingIndicators:
    @staticmethod
    def fit(df, params, columns, target):
        return {
            "columns": missing.fit_indicators(
                df,
                float(params.get("min_na_rate", 0.01)),
                int(params.get("max_indicators", 20)),
                params.get("columns"),
                set(params.get("exclude_columns") or []),
                target,
            )
        }

    @staticmethod
    def apply(df, state):
        return missing.apply_indicators(df, state["columns"])


@register_action("encode_categorical")
class EncodeCategorical:
    @staticmethod
    def fit(df, params, columns, target):
        cols = _named(df, params.get("columns") or columns, target) or text_columns(df, [target])
        method = params.get("method", "one_hot")
        return encode.fit_encoding(
            df,
            {c: method for c in cols},
            params.get("missing_token", "None"),
            params.get("separator", "__"),
        )

    @staticmethod
    def apply(df, state):
        return encode.apply_encoding(df, state)


@register_action("encode_categorical_per_column")
class EncodePerColumn:
    @staticmethod
    def fit(df, params, columns, target):
        methods = encode.encoding_methods(
            df,
            params.get("column_encodings") or {},
            params.get("default_method", "one_hot"),
            _named(df, columns, target) or None,
            target,
        )
        return encode.fit_encoding(
            df, methods, params.get("missing_token", "None"), params.get("separator", "__")
        )

    @staticmethod
    def apply(df, state):
        return encode.apply_encoding(df, state)


@register_action("group_rare_categories")
class GroupRare:
    @staticmethod
    def fit(df, params, columns, target):
        cols = params.get("columns") or []
        cols = [c for c in cols if c in df.columns] or text_columns(df, [target])
        return encode.fit_rare(
            df,
            cols,
            float(params.get("min_frequency_pct", 0.01)),
            int(params.get("min_frequency_abs", 5)),
            params.get("max_categories"),
            params.get("replacement_label", "Other"),
        )

    @staticmethod
    def apply(df, state):
        return encode.apply_rare(df, state)


@register_action("remove_outliers", "clip_outliers")
class ClipOutliers:
    @staticmethod
    def fit(df, params, columns, target):
        cols = _named(df, params.get("columns") or columns, target)
        cols = [c for c in cols if is_numeric(df.schema[c].dataType)] or numeric_columns(df, [target])
        bounds = numeric.outlier_bounds(
            df,
            cols,
            params.get("method", "iqr"),
            float(params.get("iqr_k", 3.0)),
            float(params.get("z_thresh", 3.0)),
        )
        return {"bounds": {c: list(b) for c, b in bounds.items() if b}}

    @staticmethod
    def apply(df, state):
        return numeric.clip_columns(df, state["bounds"])


@register_action("transform_numeric_skewed")
class Deskew:
    @staticmethod
    def fit(df, params, columns, target):
        return {
            "columns": numeric.fit_deskew(
                df,
                float(params.get("skewness_threshold", 1.0)),
                params.get("method", "log1p"),
                params.get("columns"),
                set(params.get("exclude_columns") or []),
                params.get("model_family", "linear"),
                target,
            )
        }

    @staticmethod
    def apply(df, state):
        return numeric.apply_deskew(df, state["columns"])


@register_action("bin_numeric")
class BinNumeric:
    @staticmethod
    def fit(df, params, columns, target):
        return numeric.fit_bins(
            df,
            _named(df, params.get("columns") or columns, target),
            int(params.get("n_bins", 5)),
            params.get("strategy", "quantile"),
            params.get("encode_bins", "ordinal"),
            params.get("splits"),
        )

    @staticmethod
    def apply(df, state):
        return numeric.apply_bins(df, state)


@register_action("scale_features")
class ScaleFeatures:
    @staticmethod
    def fit(df, params, columns, target):
        return numeric.fit_scale(
            df,
            params.get("columns"),
            set(params.get("exclude_columns") or []),
            target,
            params.get("kind", "standard"),
        )

    @staticmethod
    def apply(df, state):
        return numeric.apply_scale(df, state)


@register_action("select_features")
class SelectFeatures:
    @staticmethod
    def fit(df, params, columns, target):
        drops = numeric.select_features(
            df,
            params.get("drop_columns") or [],
            float(params.get("variance_threshold", 0.01)),
            float(params.get("correlation_threshold", 0.95)),
            target,
        )
        return {"drops": drops}

    @staticmethod
    def apply(df, state):
        return df.drop(*[d["column"] for d in state["drops"] if d["column"] in df.columns])


@register_action("deduplicate")
class Deduplicate:
    """Changes the row count, so it has no part in a fitted plan: run it before fitting."""

    @staticmethod
    def fit(df, params, columns, target):
        return {}

    @staticmethod
    def apply(df, state):
        return df
