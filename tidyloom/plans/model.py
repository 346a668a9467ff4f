"""Fit a cleaning plan on training rows; apply it unchanged to any others."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col, nan_to_null
from tidyloom.operators.columns import align, standard_name
from tidyloom.plans.registry import registered

_CARRY = "__carry"


def _pack(df: DataFrame, carry: list[str]) -> DataFrame:
    """Hide carried columns (keys, folds, target) in a struct no action looks into."""
    if not carry:
        return df
    rest = [col(c) for c in df.columns if c not in carry]
    return df.select(*rest, F.struct(*[col(c) for c in carry]).alias(_CARRY))


def _unpack(df: DataFrame, carry: list[str]) -> DataFrame:
    if not carry:
        return df
    back = [F.col(f"{_CARRY}.`{c}`").alias(c) for c in carry]
    return df.select(*back, *[col(c) for c in df.columns if c != _CARRY])


class PlanModel:
    """Fitted plan: a list of action states and the columns they lead to.

    ``transform`` is a chain of projections and dimension joins, so it runs on
    batch and streaming frames alike.
    """

    def __init__(self, steps: list[dict], columns: list[str], skipped: list[str], carry=()):
        self.steps = steps
        self.columns = columns
        self.skipped = skipped
        self.carry = list(carry)

    def transform(self, df: DataFrame) -> DataFrame:
        carry = [c for c in self.carry if c in df.columns]
        out = _pack(nan_to_null(df), carry)
        for step in self.steps:
            out = registered(step["action"]).apply(out, step["state"])
        kept = [_CARRY] if carry else []
        if carry:
            out = out.select(F.col(_CARRY), *[col(c) for c in out.columns if c != _CARRY])
        return _unpack(align(out, [*kept, *self.columns]), carry)

    # ------------------------------------------------------------ storage
    def save(self, spark: SparkSession, path: str) -> None:
        """State as one JSON text, large category tables as Parquet beside it."""
        steps = []
        for i, step in enumerate(self.steps):
            state = dict(step["state"])
            frames = state.pop("frames", {})
            names = sorted(frames)
            for n, c in enumerate(names):
                frames[c].write.mode("overwrite").parquet(f"{path}/frames/{i}_{n}")
            steps.append({"action": step["action"], "state": state, "frames": names})
        body = json.dumps(
            {"steps": steps, "columns": self.columns, "skipped": self.skipped, "carry": self.carry}
        )
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/model"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PlanModel:
        body = json.loads(spark.read.text(f"{path}/model", wholetext=True).first()[0])
        steps = []
        for i, s in enumerate(body["steps"]):
            state = s["state"]
            if "frames" in s:
                state["frames"] = {
                    c: spark.read.parquet(f"{path}/frames/{i}_{n}") for n, c in enumerate(s["frames"])
                }
            steps.append({"action": s["action"], "state": state})
        return cls(steps, body["columns"], body["skipped"], body["carry"])


class PlanCleaner:
    """Estimator for a plan ``{"actions": [{action, target_columns, params}, ...]}``.

    ``carry`` names columns that pass through untouched (row key, fold, label).
    """

    def __init__(self, plan: dict | None, target: str | None = None, carry=()):
        self.plan = plan or {"actions": []}
        self.target = target
        self.carry = list(carry)

    def fit(self, df: DataFrame) -> PlanModel:
        current = _pack(nan_to_null(df), [c for c in self.carry if c in df.columns])
        target = self.target
        steps, skipped = [], []
        for action in self.plan.get("actions") or []:
            name = (action or {}).get("action")
            handler = registered(name)
            if handler is None:
                skipped.append(name or "<missing>")
                continue
            params = dict(action.get("params") or {})
            columns = list(action.get("target_columns") or [])
            if any(str(c).lower() == "all" for c in columns):
                columns = []
            state = handler.fit(current, params, columns, target)
            current = handler.apply(current, state)
            if name == "fix_column_names" and target is not None:
                target = standard_name(target)
            steps.append({"action": name, "state": state})
        columns = [c for c in current.columns if c != _CARRY]
        return PlanModel(steps, columns, skipped, self.carry)
