"""Audit records of executed steps."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "timestamp timestamp_ntz, dataset_id string, step_id int, action_name string, approved boolean, "
    "status string, params string, rationale string, before_schema string, after_schema string, "
    "diff_summary string, warnings array<string>, error string"
)


def schema_of(df: DataFrame | None) -> dict | None:
    return None if df is None else {f.name: f.dataType.simpleString() for f in df.schema}


def log_step(
    *,
    dataset_id: str,
    step_id: int,
    action_name: str,
    status: str,
    params: dict,
    rationale: str = "",
    approved: bool = True,
    before_schema: dict | None = None,
    after_schema: dict | None = None,
    diff_summary: dict | None = None,
    warnings: list | None = None,
    error: str | None = None,
) -> dict:
    return {
        "timestamp": datetime.now(timezone.utc).replace(tzinfo=None).isoformat(),
        "dataset_id": dataset_id,
        "step_id": step_id,
        "action_name": action_name,
        "approved": approved,
        "status": status,
        "params": params,
        "rationale": rationale,
        "before_schema": before_schema,
        "after_schema": after_schema,
        "diff_summary": diff_summary,
        "warnings": warnings,
        "error": error,
    }


class ProvenanceLog:
    def __init__(self) -> None:
        self.steps: list[dict] = []

    def add_step(self, step: dict) -> None:
        self.steps.append(step)

    def to_dict(self) -> dict:
        return {"steps": self.steps}

    def to_frame(self, spark: SparkSession) -> DataFrame:
        def text(v):
            return None if v is None else json.dumps(v, default=str, ensure_ascii=False)

        rows = []
        for s in self.steps:
            rows.append(
                (
                    datetime.fromisoformat(s["timestamp"]),
                    s["dataset_id"],
                    s["step_id"],
                    s["action_name"],
                    s["approved"],
                    s["status"],
                    text(s["params"]),
                    s["rationale"],
                    text(s["before_schema"]),
                    text(s["after_schema"]),
                    text(s["diff_summary"]),
                    s["warnings"],
                    s["error"],
                )
            )
        return spark.createDataFrame(rows, SCHEMA)


# ---------------------------------------------------------------- plan quality
# The bookkeeping step that is not an action, and the sign of a
# plan that only stands in for a failed one.
PARSE_STEP = "llm_plan_parse"
FALLBACK_WORD = "fallback"


def plan_quality(
    actions: DataFrame, steps: DataFrame, keys: list[str], latency: DataFrame | None = None
) -> DataFrame:
    """Per plan: actions proposed, applied, skipped, failed; rejection rate; types; latency.

    ``actions`` has a row per proposed action, ``steps`` a row per audited step.
    Both are aggregated per plan before they meet.
    """
    typed = actions.groupBy(*keys, "action").agg(
        F.count("*").alias("n"),
        F.count_if(F.lower(F.coalesce("rationale", F.lit(""))).contains(FALLBACK_WORD)).alias("n_fb"),
    )
    label = F.concat_ws(":", "action", F.col("n").cast("string"))
    proposed = typed.groupBy(*keys).agg(
        F.sum("n").alias("n_actions_proposed"),
        F.array_join(F.array_sort(F.collect_list(label)), ";").alias("distinct_action_types"),
        F.coalesce(
            F.sum(F.when((F.col("action") == "fix_column_names"), F.col("n_fb"))), F.lit(0)
        ).alias("__fb"),
    )
    real = F.col("action_name") != PARSE_STEP
    done = steps.groupBy(*keys).agg(
        *[
            F.count_if(real & (F.col("status") == s)).alias(f"n_actions_{s}")
            for s in ("applied", "skipped", "failed")
        ]
    )
    out = proposed.join(done, keys, "left").na.fill(
        0, subset=["n_actions_applied", "n_actions_skipped", "n_actions_failed"]
    )
    lost = F.col("n_actions_skipped") + F.col("n_actions_failed")
    most = F.greatest(F.col("n_actions_proposed"), F.col("n_actions_applied") + lost)
    fallback = (F.col("n_actions_proposed") == 1) & (F.col("__fb") == 1)
    out = out.select(
        *keys, "n_actions_proposed", "n_actions_applied", "n_actions_skipped", "n_actions_failed",
        F.round(F.try_divide(lost, most), 4).alias("rejection_rate"),
        (~fallback).alias("structurally_valid"),
        fallback.alias("fallback_triggered"),
        "distinct_action_types",
    )
    if latency is None:
        return out.withColumn("latency_seconds", F.lit(None).cast("double"))
    return out.join(latency.select(*keys, "latency_seconds"), keys, "left")
