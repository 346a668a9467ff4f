"""Bring loosely structured plan JSON into the plan schema, over many plans at once.

The ``_outer`` explodes matter: for the plain ones Spark adds a filter on the
exploded list and pushes it down, which would repeat the parsing below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOP = (
    "dataset_summary string, reasoning_steps string, actions string, diagnostics string, "
    "prognostics string, assumptions string"
)
_ITEM = (
    "action string, name string, code string, rationale string, description string, message string, "
    "observation string, severity string, evidence string, target_columns string, params string"
)


def _items(raw: Column) -> Column:
    """A JSON value as a list of JSON texts; a single value is a list of one."""
    is_list = F.ltrim(raw).startswith("[")
    return F.when(is_list, F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))


def _filled(*cols) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in cols])


def _is_object(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).startswith("{"), F.lit(False))


def plan_actions(plans: DataFrame, plan_id: str = "plan_id", body: str = "plan_json") -> DataFrame:
    """One row per action: alternative keys resolved, defaults set, stray text left out."""
    listed = plans.select(
        F.col(plan_id).alias("plan_id"), F.from_json(F.col(body), _TOP)["actions"].alias("actions")
    )
    rows = listed.select(
        "plan_id", F.posexplode_outer(_items(F.col("actions"))).alias("step", "raw")
    ).where(_is_object(F.col("raw")))
    item = rows.withColumn("a", F.from_json("raw", _ITEM))
    names = F.when(F.ltrim("a.target_columns").startswith("["), F.col("a.target_columns"))
    params = F.when(_is_object(F.col("a.params")), F.col("a.params"))
    return item.select(
        "plan_id",
        (F.col("step") + 1).alias("step"),
        _filled(F.col("a.action"), F.col("a.name"), F.col("a.code")).alias("action"),
        F.coalesce(
            _filled(F.col("a.rationale"), F.col("a.description"), F.col("a.message")),
            F.lit("No rationale."),
        ).alias("rationale"),
        F.coalesce(F.from_json(names, "array<string>"), F.array().cast("array<string>")).alias(
            "target_columns"
        ),
        F.coalesce(
            F.from_json(params, "map<string,string>"), F.create_map().cast("map<string,string>")
        ).alias("params"),
    ).where(F.col("action").isNotNull())


def plan_notes(
    plans: DataFrame, kind: str = "diagnostics", plan_id: str = "plan_id", body: str = "plan_json"
) -> DataFrame:
    """Diagnostics or prognostics as rows; a bare string is a note."""
    listed = plans.select(
        F.col(plan_id).alias("plan_id"), F.from_json(F.col(body), _TOP)[kind].alias("notes")
    )
    rows = listed.select(
        "plan_id", F.posexplode_outer(_items(F.col("notes"))).alias("position", "raw")
    ).where(F.col("raw").isNotNull()).withColumn("a", F.from_json("raw", _ITEM))
    a = F.col("a")
    obj = _is_object(F.col("raw"))
    named = [a["code"]] if kind == "diagnostics" else [a["code"], a["name"]]
    bare_code = F.lit("note") if kind == "diagnostics" else F.col("raw")
    bare_text = F.col("raw") if kind == "diagnostics" else F.lit("Flag/check suggested by the plan.")
    return rows.select(
        "plan_id",
        "position",
        F.when(obj, F.coalesce(_filled(*named), F.lit("unknown"))).otherwise(bare_code).alias("code"),
        F.when(obj, F.coalesce(_filled(a["severity"]), F.lit("info")))
        .otherwise(F.lit("info"))
        .alias("severity"),
        F.when(obj, F.coalesce(_filled(a["message"], a["observation"]), F.lit("No message.")))
        .otherwise(bare_text)
        .alias("message"),
        F.when(obj, F.coalesce(a["evidence"], F.lit("{}"))).otherwise(F.lit("{}")).alias("evidence"),
    )


def column_encodings(actions: DataFrame) -> DataFrame:
    """Long form of the ``column_encodings`` parameter."""
    pairs = F.from_json(F.col("params")["column_encodings"], "map<string,string>")
    return actions.select("plan_id", "step", F.explode(pairs).alias("column", "method"))
