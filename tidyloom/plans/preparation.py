"""Turn a cleaned table into model input: impute, clip, scale, encode, assemble.

All statistics come from the training rows. The search arms are options of the
same preparation.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col, is_numeric
from tidyloom.operators import encode, missing, neighbors, numeric
from tidyloom.session import cut_lineage

# The exhaustive preparation grid.
GRID = {
    "missing_num": ["median", "mean", "knn"],
    "missing_cat": ["most_frequent", "constant"],
    "outlier": ["none", "iqr_3.0", "iqr_1.5"],
    "scaling": ["none", "standard", "minmax"],
    "feat_sel": ["none", "variance"],
}
DEFAULT = {
    "missing_num": "median",
    "missing_cat": "most_frequent",
    "outlier": "none",
    "scaling": "none",
    "feat_sel": "none",
    "encoding": "one_hot",
}
VARIANCE_FLOOR = 0.01
MISSING_TOKEN = "__missing__"


def vectors_of(df: DataFrame) -> set[str]:
    """Columns that hold vectors: one-hot codes of wide vocabularies."""
    return {f.name for f in df.schema if isinstance(f.dataType, VectorUDT)}


def grid(space: dict | None = None) -> list[dict]:
    space = space or GRID
    return [dict(zip(space, values)) for values in product(*space.values())]


def fit_preparation(df: DataFrame, config: dict | None = None, exclude=(), key: str | None = None) -> dict:
    """Fit on training rows; ``exclude`` names key, label and fold columns."""
    config = {**DEFAULT, **(config or {})}
    fields = [f for f in df.schema if f.name not in exclude]
    nums = [f.name for f in fields if is_numeric(f.dataType)]
    vectors = [f.name for f in fields if isinstance(f.dataType, VectorUDT)]
    cats = [f.name for f in fields if f.name not in nums and f.name not in vectors]
    state: dict = {"config": config, "nums": nums, "cats": cats, "vectors": vectors, "key": key}
    work = df.select(
        *[col(c) for c in exclude if c in df.columns],
        *[col(c).cast("double").alias(c) for c in nums],
        *[col(c).cast("string").alias(c) for c in cats],
        *[col(c) for c in vectors],
    )
    how = "mean" if config["missing_num"] == "mean" else "median"
    state["centers"] = missing.fit_center(work, nums, how)
    if config["missing_num"] == "knn":
        # Held-out rows take their values from these rows too.
        state["donors"] = cut_lineage(work.select(col(key), *[col(c) for c in nums]))
        work = neighbors.knn_impute(work, key, nums, donors=state["donors"])
    work = missing.fill(work, state["centers"])
    if config["outlier"] != "none":
        k = float(config["outlier"].split("_")[1])
        bounds = numeric.outlier_bounds(work, nums, "iqr", k)
        state["bounds"] = {c: b for c, b in bounds.items() if b}
        work = numeric.clip_columns(work, state["bounds"])
    if config["encoding"] == "ordinal":
        state["modes"] = {}
        state["codes"] = encode.fit_encoding(work, {c: "ordinal" for c in cats}, MISSING_TOKEN)
        work = encode.apply_encoding(work, state["codes"])
        scaled = [*nums, *[n for e in state["codes"]["columns"] for n in e["names"]]]
    else:
        if config["missing_cat"] == "constant":
            state["modes"] = {c: "" for c in cats}
        else:
            state["modes"] = missing.fit_mode(work, cats)
        work = missing.fill(work, state["modes"])
        state["codes"] = encode.fit_encoding(work, {c: "one_hot" for c in cats})
        work = encode.apply_encoding(work, state["codes"])
        scaled = nums
    if config["scaling"] != "none":
        state["scale"] = numeric.fit_scale(work, scaled, kind=config["scaling"]) if scaled else None
        if state["scale"]:
            work = numeric.apply_scale(work, state["scale"])
    features = [c for c in work.columns if c not in exclude]
    if config["feat_sel"] == "variance":
        # Population variance, as a threshold on the assembled matrix.
        from tidyloom.operators.aggregates import one_row

        plain = [c for c in features if c not in vectors_of(work)]
        got = one_row(work, {c: F.var_pop(col(c)) for c in plain})
        steady = {c for c in plain if (got[c] or 0.0) <= VARIANCE_FLOOR}
        features = [c for c in features if c not in steady] or features
    state["features"] = features
    return state


def apply_preparation(df: DataFrame, state: dict, keep=(), assemble: bool = True) -> DataFrame:
    """``keep`` columns plus a ``features`` vector, or without ``assemble`` a column ``f<i>`` for each feature."""
    config = state["config"]
    work = df.select(
        *[col(c) for c in keep],
        *[col(c).cast("double").alias(c) for c in state["nums"]],
        *[col(c).cast("string").alias(c) for c in state["cats"]],
        *[col(c) for c in state["vectors"]],
    )
    if config["missing_num"] == "knn":
        work = neighbors.knn_impute(work, state["key"], state["nums"], donors=state["donors"])
    work = missing.fill(work, state["centers"])
    if state.get("bounds"):
        work = numeric.clip_columns(work, state["bounds"])
    work = missing.fill(work, state["modes"])
    work = encode.apply_encoding(work, state["codes"])
    if state.get("scale"):
        work = numeric.apply_scale(work, state["scale"])
    wide = vectors_of(work)
    plain = work.select(
        *[col(c) for c in keep],
        *[
            (col(c) if c in wide else col(c).cast("double")).alias(f"f{i}")
            for i, c in enumerate(state["features"])
        ],
    )
    if not assemble:
        return plain
    names = [f"f{i}" for i in range(len(state["features"]))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(plain).drop(*names)
