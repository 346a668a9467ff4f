"""Policy rules over plan tables.

Tables
------
plans      plan_id, step, action, rationale, target_columns array<string>,
           params map<string,string>
encodings  plan_id, step, column, method       (column encodings in long form)
contexts   plan_id, downstream_model, redundant_features array<string>,
           leakage_cols array<string>
semantics  plan_id, column, semantics
profile    plan_id, column, is_text, is_numeric, n_unique, is_target

Row rules are projections on the plan rows (no shuffle after the one join with
the contexts); a removed action only gets ``keep = false`` until the end.
Rules that look at a whole plan use one aggregate per plan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.plans.presets import LINEAR_WORDS, ORDERED_WORDS, TREE_WORDS

SAFE_IQR_K = 3.0
TREE_CARDINALITY = 10
LINEAR_CARDINALITY = 200
KNN_BUDGET = 50
LINEAR_BUDGET = 200
CHAINED = ["impute", "mice", "iterative", "mean"]
ENCODERS = ["encode_categorical", "encode_categorical_per_column"]
PLAN_COLUMNS = ["plan_id", "step", "action", "rationale", "target_columns", "params"]


def put(params: Column, key: str, value: Column) -> Column:
    """The map with one key set (a plain concat refuses repeated keys)."""
    rest = F.map_filter(params, lambda k, v: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def _any_word(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def family(contexts: DataFrame) -> DataFrame:
    """Model family flags from the downstream model's name."""
    name = F.lower(F.coalesce("downstream_model", F.lit("")))
    knn = name.contains("knn")
    empty = F.array().cast("array<string>")
    return contexts.withColumns(
        {
            "is_tree": _any_word(name, TREE_WORDS),
            "is_linear": _any_word(name, LINEAR_WORDS),
            "is_knn": knn,
            "is_knn_classifier": knn & ~name.contains("regress"),
            "redundant_features": F.coalesce("redundant_features", empty),
            "leakage_cols": F.coalesce("leakage_cols", empty),
        }
    )


def prepare(plans: DataFrame, contexts: DataFrame) -> DataFrame:
    """Plan rows with their context, ``keep`` and an empty change list."""
    empty_map = F.create_map().cast("map<string,string>")
    return plans.join(family(contexts), "plan_id").withColumns(
        {
            "params": F.coalesce("params", empty_map),
            "target_columns": F.coalesce("target_columns", F.array().cast("array<string>")),
            "keep": F.lit(True),
            "changes": F.array().cast("array<string>"),
        }
    )


@dataclass
class Change:
    """What a row rule does: where it fires, how it is logged, and its new values.

    Rules read the plan as it came in. Each acts on one kind of action, so they
    never compete for a row and all of them fit in one projection.
    """

    hit: Column
    note: Column | None = None
    noted: Column | None = None
    remove: Column | None = None
    params: Column | None = None
    target_columns: Column | None = None


def _params(key: str, default: str) -> Column:
    return F.coalesce(F.col("params")[key], F.lit(default))


def clip_rule() -> list[Change]:
    """No clipping for trees; elsewhere the IQR factor is at least 3."""
    is_clip = F.col("action") == "clip_outliers"
    gone = is_clip & F.col("is_tree")
    k = F.coalesce(F.col("params")["iqr_k"].try_cast("double"), F.lit(1.5))
    low = is_clip & ~F.col("is_tree") & (k < SAFE_IQR_K)
    raised = F.concat(F.lit("clip_k:"), k.cast("string"), F.lit(f"->{SAFE_IQR_K}"))
    return [
        Change(gone, F.lit("rm clip_outliers(tree)"), remove=gone),
        Change(low, raised, params=put(F.col("params"), "iqr_k", F.lit(str(SAFE_IQR_K)))),
    ]


def bin_rule() -> list[Change]:
    """Binning loses signal and is always taken out."""
    gone = F.col("action") == "bin_numeric"
    return [Change(gone, F.lit("rm bin_numeric"), remove=gone)]


def drop_rule() -> list[Change]:
    """Only redundant or leaking columns may be dropped."""
    safe = F.array_union("redundant_features", "leakage_cols")
    allowed = F.filter("target_columns", lambda c: F.array_contains(safe, c))
    blocked = F.filter("target_columns", lambda c: ~F.array_contains(safe, c))
    hit = (F.col("action") == "drop_column") & (F.size(blocked) > 0)
    return [
        Change(
            hit,
            F.concat(F.lit("block_drop:"), F.array_join(blocked, ",")),
            remove=hit & (F.size(allowed) == 0),
            target_columns=allowed,
        )
    ]


def impute_rule() -> list[Change]:
    """Trees and nearest-neighbour classifiers impute the median; linear models fill the mode."""
    is_fill = F.col("action") == "handle_missing"
    now = _params("strategy", "impute")
    soft = is_fill & now.isin(CHAINED)
    tree = soft & F.col("is_tree")
    knn = soft & ~F.col("is_tree") & F.col("is_knn_classifier")
    linear = (
        is_fill & ~tree & ~knn & F.col("is_linear") & ~F.col("is_knn")
        & F.col("params")["cat_missing_strategy"].isNull()
    )
    family_name = F.when(tree, "tree").otherwise("knn_clf")
    softened = F.concat(F.lit("impute:"), now, F.lit("->median("), family_name, F.lit(")"))
    return [
        Change(tree | knn, softened, params=put(F.col("params"), "strategy", F.lit("median"))),
        Change(
            linear,
            F.lit("cat_missing:fill_mode(linear)"),
            params=put(F.col("params"), "cat_missing_strategy", F.lit("fill_mode")),
        ),
    ]


def select_rule() -> list[Change]:
    """``select_features`` may drop redundant columns only; its automatic filters are off.

    ``drop_columns`` is a comma-separated parameter.
    """
    hit = F.col("action") == "select_features"
    asked = F.array_remove(F.split(_params("drop_columns", ""), ","), "")
    allowed = F.filter(asked, lambda c: F.array_contains("redundant_features", c))
    blocked = F.filter(asked, lambda c: ~F.array_contains("redundant_features", c))
    fixed = F.map_concat(
        F.map_filter(
            "params",
            lambda k, v: ~k.isin("drop_columns", "variance_threshold", "correlation_threshold"),
        ),
        F.create_map(
            F.lit("drop_columns"), F.array_join(allowed, ","),
            F.lit("variance_threshold"), F.lit("0.0"),
            F.lit("correlation_threshold"), F.lit("1.0"),
        ),
    )
    text = F.concat(F.lit("block_select:"), F.array_join(blocked, ","))
    return [Change(hit, text, noted=hit & (F.size(blocked) > 0), params=fixed)]


def _family_method() -> Column:
    return F.when(F.col("is_tree"), "ordinal").otherwise("one_hot")


def method_rule() -> list[Change]:
    """The method of a global encoding follows the model family."""
    now = _params("method", "unknown")
    hit = (F.col("action") == "encode_categorical") & (now != _family_method())
    text = F.concat(F.lit("encoding:"), now, F.lit("->"), _family_method())
    return [Change(hit, text, params=put(F.col("params"), "method", _family_method()))]


def method_rule_known_family() -> list[Change]:
    """The milder form for plans without column semantics: unknown families are left alone."""
    (change,) = method_rule()
    change.hit = change.hit & (F.col("is_tree") | F.col("is_linear"))
    return [change]


def default_method_rule() -> list[Change]:
    """Columns a per-column encoding does not list follow the family too."""
    hit = F.col("action") == "encode_categorical_per_column"
    return [Change(hit, params=put(F.col("params"), "default_method", _family_method()))]


ROW_RULES = (
    clip_rule,
    bin_rule,
    drop_rule,
    impute_rule,
    select_rule,
    method_rule,
    default_method_rule,
)


def apply_row_rules(p: DataFrame, rules=ROW_RULES) -> DataFrame:
    """All row rules in one projection."""
    changes = [c for rule in rules for c in rule()]
    keep, new = F.col("keep"), {}
    for c in changes:
        if c.remove is not None:
            keep = keep & ~c.remove
    for field in ("params", "target_columns"):
        value = None
        for c in changes:
            fresh = getattr(c, field)
            if fresh is not None:
                value = F.when(c.hit, fresh) if value is None else value.when(c.hit, fresh)
        if value is not None:
            new[field] = value.otherwise(F.col(field))
    notes = [F.when(c.hit if c.noted is None else c.noted, c.note) for c in changes if c.note is not None]
    new |= {"keep": keep, "changes": F.array_compact(F.array(*notes))}
    return p.withColumns(new)


# ---------------------------------------------------------------- whole-plan rules
def whole_plan_rules(p: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Complete a plan and scale it for linear models, in one pass over its rows.

    A plan without an encoding gets one, after imputation or at the end, if its
    table has text columns (asked only with a ``profile``); later steps move up by
    one. A linear model's plan gets one ``scale_features`` at the end. The new
    rows come out of the plan's last row, so the plans are read and shuffled once.
    """
    plan, kept = Window.partitionBy("plan_id"), F.col("keep")
    marked = p.withColumns(
        {
            "__last": F.max("step").over(plan),
            "__scales": F.max(kept & (F.col("action") == "scale_features")).over(plan),
            "__encodes": F.max(kept & F.col("action").isin(ENCODERS)).over(plan),
            "__fill": F.min(F.when(kept & (F.col("action") == "handle_missing"), F.col("step"))).over(plan),
            "__end": F.row_number().over(plan.orderBy(F.desc("step"), "action")) == 1,
        }
    )
    bare = F.lit(False)
    if profile is not None:
        texts = profile.where(F.col("is_text")).select("plan_id").distinct().withColumn("__text", F.lit(True))
        marked = marked.join(texts, "plan_id", "left")
        bare = F.coalesce(F.col("__text"), F.lit(False)) & ~F.col("__encodes")
    at = F.coalesce("__fill", "__last") + 1
    moved = F.when(bare & (F.col("step") >= at), F.col("step") + 1).otherwise(F.col("step"))
    scaled = F.col("is_linear") & ~F.col("is_knn") & ~F.col("__scales")

    def row(changed: dict[str, Column]) -> Column:
        return F.struct(
            *[
                changed.get(f.name, F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
                for f in p.schema
            ]
        )

    def injected(step: Column, action: str, why: str, params: Column) -> Column:
        return row(
            {
                "step": step,
                "action": F.lit(action),
                "rationale": F.lit(why),
                "target_columns": F.array(),
                "params": params,
                "keep": F.lit(True),
                "changes": F.array(F.lit(f"inject:{action}")),
            }
        )

    default = F.create_map(F.lit("default_method"), _family_method())
    rows = F.array(
        row({"step": moved}),
        F.when(
            F.col("__end") & bare,
            injected(at, "encode_categorical_per_column", "encoding was left out", default),
        ),
        F.when(
            F.col("__end") & scaled,
            injected(F.col("__last") + bare.cast("int") + 1, "scale_features", "scaling for a linear model", F.create_map()),
        ),
    )
    return marked.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


def scale_rule(p: DataFrame) -> DataFrame:
    """Linear models get one ``scale_features`` at the end of their plan."""
    return whole_plan_rules(p)


def completeness_rule(p: DataFrame, profile: DataFrame) -> DataFrame:
    """A plan without an encoding gets one (and nothing else)."""
    return whole_plan_rules(p.withColumn("is_linear", F.lit(False)), profile)


def known_targets(plans: DataFrame, profile: DataFrame) -> DataFrame:
    """Strike target columns the plan's table does not have; ``all`` means no restriction.

    The lists are exploded and met with the profile on (plan, column), so the
    columns of a table are never gathered into one value.
    """
    cells = plans.select(
        "plan_id", "step", F.posexplode("target_columns").alias("__pos", "column")
    )
    whole = F.exists("target_columns", lambda c: F.lower(c) == "all")
    real = cells.join(profile.select("plan_id", "column"), ["plan_id", "column"], "left_semi")
    kept = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "column"))), lambda x: x["column"])
    lists = real.groupBy("plan_id", "step").agg(kept.alias("__kept"))
    empty = F.array().cast("array<string>")
    found = F.when(whole, empty).otherwise(F.coalesce("__kept", empty))
    out = plans.join(lists, ["plan_id", "step"], "left")
    return out.withColumns(
        {
            "invented": F.when(~whole, F.array_except("target_columns", found)).otherwise(empty),
            "target_columns": found,
        }
    ).drop("__kept")


# ---------------------------------------------------------------- encodings
def _ordered(c: Column) -> Column:
    return _any_word(F.lower(c), ORDERED_WORDS)


def encoding_rule(
    encodings: DataFrame, contexts: DataFrame, semantics: DataFrame, profile: DataFrame, steps: DataFrame
) -> DataFrame:
    """Final method per (plan, step, column).

    Numeric columns are struck from the plan's own encodings. A text column with
    stated semantics is ordinal if they are ordered or its cardinality is over
    the family's threshold; else ordinal for trees and one-hot for the rest.
    ``steps`` lists the (plan_id, step) of the per-column encoding actions.
    """
    texts = profile.where(F.col("is_text")).select("plan_id", "column", "n_unique")
    own = encodings.join(texts.select("plan_id", "column"), ["plan_id", "column"], "left_semi")
    limit = F.when(F.col("is_tree"), TREE_CARDINALITY).otherwise(LINEAR_CARDINALITY)
    choice = (
        F.when(_ordered(F.col("semantics")) | (F.col("n_unique") > limit), "ordinal")
        .when(F.col("is_tree"), "ordinal")
        .otherwise("one_hot")
    )
    ruled = (
        steps.join(semantics, "plan_id")
        .join(texts, ["plan_id", "column"])
        .join(family(contexts).select("plan_id", "is_tree"), "plan_id")
        .select("plan_id", "step", "column", choice.alias("choice"))
    )
    return own.join(ruled, ["plan_id", "step", "column"], "full").select(
        "plan_id", "step", "column",
        F.coalesce("choice", "method").alias("method"),
        (F.col("choice").isNotNull() & ~F.col("choice").eqNullSafe(F.col("method"))).alias("changed"),
    )


def planned_encodings(
    contexts: DataFrame, semantics: DataFrame, profile: DataFrame
) -> DataFrame:
    """Method per (plan, column) before the budget: stated semantics, then every other text column."""
    fam = family(contexts).select("plan_id", "is_tree", "is_linear", "is_knn")
    limit = F.when(F.col("is_linear"), LINEAR_CARDINALITY).otherwise(TREE_CARDINALITY)
    texts = profile.where(F.col("is_text") & ~F.col("is_target")).select(
        "plan_id", "column", "n_unique"
    )
    high = F.lower(F.coalesce("semantics", F.lit(""))).contains("high cardinality") | (
        F.coalesce("n_unique", F.lit(0)) > limit
    )
    stated = F.col("semantics").isNotNull()
    method = (
        F.when(stated & (_ordered(F.col("semantics")) | high), "ordinal")
        .when(F.col("is_tree"), "ordinal")
        .otherwise("one_hot")
    )
    return (
        semantics.join(texts, ["plan_id", "column"], "full")
        .join(fam, "plan_id")
        .withColumn("method", method)
    )


def budget_rule(contexts: DataFrame, semantics: DataFrame, profile: DataFrame) -> DataFrame:
    """Keep the encoded width of linear and knn plans within their budget.

    One-hot columns are made ordinal, the largest first (ties by name), while
    the estimate is still over the budget.
    """
    planned = planned_encodings(contexts, semantics, profile)
    numbers = profile.groupBy("plan_id").agg(
        F.count_if(F.col("is_numeric") & ~F.col("is_target")).alias("n_numeric")
    )
    onehot = (F.col("method") == "one_hot") & F.col("n_unique").isNotNull()
    width = F.when(onehot, F.col("n_unique")).otherwise(F.lit(0))
    plan = Window.partitionBy("plan_id")
    # Columns of one plan: as many as its table has columns.
    earlier = plan.orderBy(F.desc("__size"), "column").rowsBetween(Window.unboundedPreceding, -1)
    est = F.sum(width).over(plan) + F.sum((F.col("method") == "ordinal").cast("bigint")).over(plan)
    saved = F.coalesce(F.sum(F.when(onehot, F.col("n_unique") - 1)).over(earlier), F.lit(0))
    limit = F.when(F.col("is_knn"), KNN_BUDGET).otherwise(LINEAR_BUDGET)
    demote = F.col("is_linear") & onehot & (F.col("__est") - F.col("__saved") > limit)
    return (
        planned.join(numbers, "plan_id", "left")
        .withColumn("__size", F.when(onehot, F.col("n_unique")).otherwise(F.lit(-1)))
        .withColumns({"__est": est + F.coalesce("n_numeric", F.lit(0)), "__saved": saved})
        .select(
            "plan_id", "column",
            F.when(demote, "ordinal").otherwise(F.col("method")).alias("method"),
            demote.alias("demoted"),
        )
    )


# ---------------------------------------------------------------- everything
def enforce(
    plans: DataFrame,
    contexts: DataFrame,
    profile: DataFrame | None = None,
    encodings: DataFrame | None = None,
    semantics: DataFrame | None = None,
) -> DataFrame:
    """All rules on the plan rows; the result keeps ``changes`` for the log.

    With a ``profile`` plans are completed. With ``semantics`` as well, the methods
    of per-column encodings are settled (``encodings`` are the plan's own), kept
    within the budget and written into the parameter ``column_encodings``.
    """
    p = whole_plan_rules(apply_row_rules(prepare(plans, contexts)), profile)
    if profile is None or semantics is None:
        return p
    return settle_encodings(p, contexts, profile, encodings, semantics)


def settle_encodings(
    p: DataFrame, contexts: DataFrame, profile: DataFrame, encodings: DataFrame | None, semantics: DataFrame
) -> DataFrame:
    """Write the final method of each column, and what was changed, into the encoding steps."""
    is_encoder = F.col("keep") & (F.col("action") == "encode_categorical_per_column")
    steps = p.where(is_encoder).select("plan_id", "step")
    if encodings is None:
        encodings = p.sparkSession.createDataFrame([], "plan_id string, step bigint, column string, method string")
        encodings = encodings.select(*[F.col(c).cast(p.schema[c].dataType) for c in ("plan_id", "step")], "column", "method")
    ruled = encoding_rule(encodings, contexts, semantics, profile, steps)
    budget = budget_rule(contexts, semantics, profile).where("demoted").select("plan_id", "column", "demoted")
    settled = ruled.join(budget, ["plan_id", "column"], "left").withColumn(
        "demoted", F.coalesce("demoted", F.lit(False)) & (F.col("method") == "one_hot")
    )
    note = F.when(F.col("demoted"), F.concat(F.lit("budget:"), "column", F.lit("->ordinal"))).when(
        F.col("changed"), F.concat(F.lit("encoding:"), "column", F.lit("->"), "method")
    )
    numbers = profile.where("is_numeric").select("plan_id", "column")
    struck = encodings.join(numbers, ["plan_id", "column"], "left_semi").select(
        "plan_id", "step", "column", F.lit(None).cast("string").alias("method"),
        F.concat(F.lit("encoding:strike "), "column").alias("note"),
    )
    final = F.when(F.col("demoted"), "ordinal").otherwise(F.col("method"))
    cells = settled.select("plan_id", "step", "column", final.alias("method"), note.alias("note")).unionByName(struck)
    # Columns of one plan's table: as many as a plan can name.
    listed = F.array_sort(F.collect_list(F.struct("column", "method", "note")))
    per = cells.groupBy("plan_id", "step").agg(listed.alias("__cells"))
    known = F.filter("__cells", lambda x: x["method"].isNotNull())
    methods = F.map_from_entries(F.transform(known, lambda x: F.struct(x["column"], x["method"])))
    notes = F.array_compact(F.transform("__cells", lambda x: x["note"]))
    out = p.join(per, ["plan_id", "step"], "left")
    hit = is_encoder & F.col("__cells").isNotNull()
    return out.withColumns(
        {
            "params": F.when(hit, put(F.col("params"), "column_encodings", F.to_json(methods))).otherwise(F.col("params")),
            "changes": F.when(hit, F.concat("changes", notes)).otherwise(F.col("changes")),
        }
    ).select(*p.columns)


# Parameters that hold lists; in a plan table they are comma-separated or JSON.
LIST_PARAMS = ["columns", "drop_columns", "exclude_columns", "ops"]


def typed_params(params: dict[str, str] | None) -> dict:
    """Text values of a plan table as the values actions take."""
    out = {}
    for k, v in (params or {}).items():
        if v is None:
            continue
        try:
            out[k] = json.loads(v)
        except ValueError:
            out[k] = v
        if k in LIST_PARAMS and not isinstance(out[k], list):
            out[k] = [c for c in str(v).split(",") if c]
    return out


def to_plans(p: DataFrame, plan_ids: list) -> dict:
    """Enforced plans by id, as ``PlanCleaner`` and ``run_plan`` take them."""
    rows = kept_actions(p).where(F.col("plan_id").isin(list(plan_ids))).collect()
    plans: dict = {i: {"actions": []} for i in plan_ids}
    for r in sorted(rows, key=lambda r: r["step"]):
        plans[r["plan_id"]]["actions"].append(
            {
                "action": r["action"],
                "rationale": r["rationale"],
                "target_columns": list(r["target_columns"] or []),
                "params": typed_params(r["params"]),
            }
        )
    return plans


def kept_actions(p: DataFrame) -> DataFrame:
    return p.where("keep").select(*PLAN_COLUMNS)


def change_log(p: DataFrame) -> DataFrame:
    """``plan_id, changes``: what the rules did, in step order."""
    rows = p.where(F.size("changes") > 0).select("plan_id", F.struct("step", "changes").alias("c"))
    ordered = F.array_sort(F.collect_list("c"))
    return rows.groupBy("plan_id").agg(
        F.flatten(F.transform(ordered, lambda x: x["changes"])).alias("changes")
    )


def useful_plans(plans: DataFrame) -> DataFrame:
    """Plans that do more than rename columns."""
    per = plans.groupBy("plan_id").agg(
        F.count("*").alias("n"), F.max("action").alias("last"), F.min("action").alias("first")
    )
    only_names = (F.col("n") == 1) & (F.col("first") == "fix_column_names")
    return per.where(~only_names).select("plan_id", F.col("n").alias("n_actions"))
