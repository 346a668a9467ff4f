"""Queries for plan policy, plan quality and plan documents.

Plans, contexts and column profiles are derived from the order tables: each
customer is a plan, each of their orders a step or a column, so the audit
grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.catalog.common import DIRTY_ORDERS_SQL, dirty_orders, query, table
from tidyloom.plans import PlanCleaner, policy
from tidyloom.plans.normalise import column_encodings, plan_actions, plan_notes
from tidyloom.plans.provenance import plan_quality
from tidyloom.plans.runner import CANONICAL_ORDER, order_actions
from tidyloom.sources.documents import parse_context, recover_json, tolerant_json

_NAMES = [
    "clip_outliers",
    "bin_numeric",
    "drop_column",
    "handle_missing",
    "select_features",
    "encode_categorical",
    "encode_categorical_per_column",
    "scale_features",
    "fix_column_names",
    "deduplicate",
]
_ACTION = (
    "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
)
_STRATEGY = (
    "CASE o_orderkey % 4 WHEN 0 THEN 'impute' WHEN 1 THEN 'mean' WHEN 2 THEN 'median' ELSE 'drop_rows' END"
)
_MODEL = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'RandomForest' WHEN 'BUILDING' THEN 'LogisticRegression' "
    "WHEN 'FURNITURE' THEN 'KNN' WHEN 'HOUSEHOLD' THEN 'Ridge' ELSE 'KNN_regression' END"
)
# The family of each derived model, spelled out for the SQL side.
_FAMILY = """
    SELECT c_custkey AS plan_id, c_mktsegment = 'AUTOMOBILE' AS is_tree, c_mktsegment <> 'AUTOMOBILE' AS is_linear,
           c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') AS is_knn,
           c_mktsegment = 'FURNITURE' AS is_knn_clf, c_custkey, c_nationkey FROM customer
"""
_STEPS = f"""
    SELECT o_custkey AS plan_id, o_orderkey AS step, {_ACTION} AS action, {_STRATEGY} AS strategy,
           CAST(o_orderkey % 5 AS VARCHAR(3)) AS k, 'col' || CAST(o_orderkey % 5 AS VARCHAR(3)) AS c1,
           'col' || CAST(o_orderkey % 7 + 3 AS VARCHAR(3)) AS c2,
           CASE o_orderkey % 3 WHEN 0 THEN 'one_hot' WHEN 1 THEN 'ordinal' END AS method,
           o_orderkey, o_custkey FROM orders
"""
_PLAN = f"SELECT s.*, f.* EXCLUDE (plan_id) FROM ({_STEPS}) s JOIN ({_FAMILY}) f USING (plan_id)"
_SAFE = "(c = 'col' || CAST(c_nationkey % 5 AS VARCHAR) OR c = 'col6')"


def _plans(spark, d):
    base = table(spark, d, "orders").selectExpr(
        "o_custkey AS plan_id",
        "o_orderkey AS step",
        f"{_ACTION} AS action",
        "'from orders' AS rationale",
        "array(concat('col', o_orderkey % 5), concat('col', o_orderkey % 7 + 3)) AS target_columns",
        f"{_STRATEGY} AS strategy",
        "CAST(o_orderkey % 5 AS STRING) AS k",
        "CASE o_orderkey % 3 WHEN 0 THEN 'one_hot' WHEN 1 THEN 'ordinal' END AS method",
    )
    drops = F.array_join("target_columns", ",")
    params = (
        F.when(F.col("action") == "clip_outliers", F.create_map(F.lit("iqr_k"), F.col("k")))
        .when(F.col("action") == "handle_missing", F.create_map(F.lit("strategy"), F.col("strategy")))
        .when(F.col("action") == "select_features", F.create_map(F.lit("drop_columns"), drops))
        .when(
            (F.col("action") == "encode_categorical") & F.col("method").isNotNull(),
            F.create_map(F.lit("method"), F.col("method")),
        )
    )
    return base.withColumn("params", params).select(*policy.PLAN_COLUMNS)


def _contexts(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey AS plan_id",
        f"{_MODEL} AS downstream_model",
        "array(concat('col', c_nationkey % 5)) AS redundant_features",
        "array('col6') AS leakage_cols",
    )


# Columns of a plan's table: one per order of the customer.
_PROFILE = """
    SELECT o_custkey AS plan_id, 'col' || CAST(o_orderkey AS VARCHAR(20)) AS "column", o_orderstatus <> 'P' AS is_text,
           o_orderstatus = 'P' AS is_numeric,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) % 60 + 2 END AS n_unique,
           FALSE AS is_target,
           CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Ordered scale' WHEN '2' THEN 'nominal, high cardinality'
                WHEN '3' THEN 'nominal' END AS semantics
    FROM {orders}
"""


def _profile(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("__plan_columns")
    return spark.sql(_PROFILE.format(orders="__plan_columns").replace('"column"', "`column`"))


def _prepared(spark, d):
    return policy.prepare(_plans(spark, d), _contexts(spark, d))


# ---------------------------------------------------------------- row rules
@query(
    "policy_family",
    f"SELECT plan_id, is_tree, is_linear, is_knn, is_knn_clf AS is_knn_classifier FROM ({_FAMILY})",
)
def policy_family(spark, d):
    return policy.family(_contexts(spark, d)).select(
        "plan_id", "is_tree", "is_linear", "is_knn", "is_knn_classifier"
    )


@query(
    "policy_clip",
    f"""
    SELECT plan_id, step, action,
           CASE WHEN action = 'clip_outliers' AND CAST(k AS DOUBLE) < 3 THEN '3.0'
                WHEN action = 'clip_outliers' THEN k END AS iqr_k
    FROM ({_PLAN}) WHERE NOT (action = 'clip_outliers' AND is_tree) AND action <> 'bin_numeric'
    """,
)
def policy_clip(spark, d):
    p = policy.apply_row_rules(_prepared(spark, d), [policy.clip_rule, policy.bin_rule])
    return policy.kept_actions(p).select("plan_id", "step", "action", F.col("params")["iqr_k"].alias("iqr_k"))


@query(
    "policy_drop",
    f"""
    WITH c AS (SELECT plan_id, step, c_nationkey, c1 AS c, 1 AS pos FROM ({_PLAN}) WHERE action = 'drop_column'
               UNION ALL SELECT plan_id, step, c_nationkey, c2, 2 FROM ({_PLAN}) WHERE action = 'drop_column')
    SELECT plan_id, step, string_agg(c, ',' ORDER BY pos) AS dropped FROM c WHERE {_SAFE} GROUP BY 1, 2
    """,
)
def policy_drop(spark, d):
    kept = policy.kept_actions(policy.apply_row_rules(_prepared(spark, d), [policy.drop_rule]))
    return kept.where(F.col("action") == "drop_column").select(
        "plan_id", "step", F.array_join("target_columns", ",").alias("dropped")
    )


@query(
    "policy_select",
    f"""
    SELECT plan_id, step,
           array_to_string(list_filter([c1, c2], lambda x: x = 'col' || CAST(c_nationkey % 5 AS VARCHAR)), ',') AS drops,
           '0.0' AS variance, '1.0' AS correlation
    FROM ({_PLAN}) WHERE action = 'select_features'
    """,
)
def policy_select(spark, d):
    kept = policy.kept_actions(policy.apply_row_rules(_prepared(spark, d), [policy.select_rule]))
    p = F.col("params")
    return kept.where(F.col("action") == "select_features").select(
        "plan_id",
        "step",
        p["drop_columns"].alias("drops"),
        p["variance_threshold"].alias("variance"),
        p["correlation_threshold"].alias("correlation"),
    )


@query(
    "policy_impute",
    f"""
    SELECT plan_id, step,
           CASE WHEN strategy IN ('impute', 'mean') AND (is_tree OR is_knn_clf) THEN 'median' ELSE strategy END AS strategy,
           CASE WHEN is_linear AND NOT is_knn THEN 'fill_mode' END AS categorical
    FROM ({_PLAN}) WHERE action = 'handle_missing'
    """,
)
def policy_impute(spark, d):
    kept = policy.kept_actions(policy.apply_row_rules(_prepared(spark, d), [policy.impute_rule]))
    p = F.col("params")
    return kept.where(F.col("action") == "handle_missing").select(
        "plan_id", "step", p["strategy"].alias("strategy"), p["cat_missing_strategy"].alias("categorical")
    )


@query(
    "policy_method",
    f"""
    SELECT plan_id, step, CASE WHEN is_tree THEN 'ordinal' ELSE 'one_hot' END AS method
    FROM ({_PLAN}) WHERE action = 'encode_categorical'
    """,
)
def policy_method(spark, d):
    kept = policy.kept_actions(policy.apply_row_rules(_prepared(spark, d), [policy.method_rule]))
    return kept.where(F.col("action") == "encode_categorical").select(
        "plan_id", "step", F.col("params")["method"].alias("method")
    )


@query(
    "policy_known_targets",
    f"""
    WITH x AS ({_PROFILE.format(orders='orders')}),
    t AS (SELECT o_custkey AS plan_id, o_orderkey AS step, 'col' || CAST(o_orderkey AS VARCHAR) AS good,
                 'col' || CAST(o_orderkey + 1 AS VARCHAR) AS odd, o_orderkey % 4 = 0 AS everything FROM orders)
    SELECT t.plan_id, step, CASE WHEN everything THEN '' ELSE good || CASE WHEN x."column" IS NULL THEN '' ELSE ',' || odd END END
               AS targets,
           CASE WHEN everything OR x."column" IS NOT NULL THEN '' ELSE odd END AS invented
    FROM t LEFT JOIN x ON x.plan_id = t.plan_id AND x."column" = t.odd
    """,
)
def policy_known_targets(spark, d):
    plans = table(spark, d, "orders").selectExpr(
        "o_custkey AS plan_id",
        "o_orderkey AS step",
        "CASE WHEN o_orderkey % 4 = 0 THEN array('All') "
        "ELSE array(concat('col', o_orderkey), concat('col', o_orderkey + 1)) END AS target_columns",
    )
    out = policy.known_targets(plans, _profile(spark, d))
    return out.select(
        "plan_id",
        "step",
        F.array_join("target_columns", ",").alias("targets"),
        F.array_join("invented", ",").alias("invented"),
    )


# ---------------------------------------------------------------- whole plans
_KEPT = f"""
    SELECT * FROM ({_PLAN}) WHERE NOT (action = 'clip_outliers' AND is_tree) AND action <> 'bin_numeric'
       AND NOT (action = 'drop_column' AND NOT (c1 = 'col' || CAST(c_nationkey % 5 AS VARCHAR)
                OR c1 = 'col6' OR c2 = 'col' || CAST(c_nationkey % 5 AS VARCHAR) OR c2 = 'col6'))
"""


@query(
    "policy_scale",
    f"""
    WITH k AS ({_KEPT}), a AS ({_PLAN})
    SELECT plan_id, step, action FROM k
    UNION ALL
    SELECT plan_id, max(step) + 1, 'scale_features' FROM a WHERE is_linear AND NOT is_knn
       AND plan_id NOT IN (SELECT plan_id FROM k WHERE action = 'scale_features') GROUP BY plan_id
    """,
)
def policy_scale(spark, d):
    p = policy.enforce(_plans(spark, d), _contexts(spark, d))
    return policy.kept_actions(p).select("plan_id", "step", "action")


@query(
    "policy_complete",
    f"""
    WITH k AS ({_KEPT}), a AS ({_PLAN}), x AS ({_PROFILE.format(orders='orders')}),
    t AS (SELECT plan_id, max(is_tree) AS is_tree,
                 coalesce((SELECT min(step) FROM k WHERE k.plan_id = a.plan_id AND action = 'handle_missing'), max(step)) + 1
                     AS spot
          FROM a WHERE plan_id NOT IN (SELECT plan_id FROM k WHERE action LIKE 'encode%')
            AND plan_id IN (SELECT plan_id FROM x WHERE is_text) GROUP BY plan_id)
    SELECT plan_id, CASE WHEN t.spot IS NOT NULL AND step >= t.spot THEN step + 1 ELSE step END AS step, action,
           CAST(NULL AS VARCHAR) AS default_method FROM k LEFT JOIN t USING (plan_id)
    UNION ALL SELECT plan_id, spot, 'encode_categorical_per_column', CASE WHEN is_tree THEN 'ordinal' ELSE 'one_hot' END FROM t
    """,
)
def policy_complete(spark, d):
    rules = (policy.clip_rule, policy.bin_rule, policy.drop_rule)
    p = policy.apply_row_rules(_prepared(spark, d), rules)
    done = policy.completeness_rule(p, _profile(spark, d))
    return policy.kept_actions(done).select(
        "plan_id", "step", "action", F.col("params")["default_method"].alias("default_method")
    )


@query(
    "policy_changes",
    f"""
    WITH a AS ({_PLAN}), k AS ({_KEPT}),
    b AS (SELECT plan_id, step, CASE
            WHEN action = 'clip_outliers' AND is_tree THEN 'rm clip_outliers(tree)'
            WHEN action = 'clip_outliers' AND CAST(k AS DOUBLE) < 3 THEN 'clip_k:' || k || '.0->3.0'
            WHEN action = 'bin_numeric' THEN 'rm bin_numeric'
            WHEN action = 'drop_column' AND len(bl) > 0 THEN 'block_drop:' || array_to_string(bl, ',')
            WHEN action = 'handle_missing' AND strategy IN ('impute', 'mean') AND is_tree
                 THEN 'impute:' || strategy || '->median(tree)'
            WHEN action = 'handle_missing' AND strategy IN ('impute', 'mean') AND is_knn_clf
                 THEN 'impute:' || strategy || '->median(knn_clf)'
            WHEN action = 'handle_missing' AND is_linear AND NOT is_knn THEN 'cat_missing:fill_mode(linear)'
            WHEN action = 'select_features' AND len(br) > 0 THEN 'block_select:' || array_to_string(br, ',')
            WHEN action = 'encode_categorical' AND method IS DISTINCT FROM CASE WHEN is_tree THEN 'ordinal' ELSE 'one_hot' END
                 THEN 'encoding:' || coalesce(method, 'unknown') || '->' || CASE WHEN is_tree THEN 'ordinal' ELSE 'one_hot' END
            END AS note
          FROM (SELECT *, list_filter([c1, c2], lambda x: x <> 'col' || CAST(c_nationkey % 5 AS VARCHAR) AND x <> 'col6') AS bl,
                       list_filter([c1, c2], lambda x: x <> 'col' || CAST(c_nationkey % 5 AS VARCHAR)) AS br FROM a)
          UNION ALL
          SELECT plan_id, max(step) + 1, 'inject:scale_features' FROM a WHERE is_linear AND NOT is_knn
             AND plan_id NOT IN (SELECT plan_id FROM k WHERE action = 'scale_features') GROUP BY plan_id)
    SELECT plan_id, string_agg(note, ';' ORDER BY step) AS changes FROM b WHERE note IS NOT NULL GROUP BY 1
    """,
)
def policy_changes(spark, d):
    log = policy.change_log(policy.enforce(_plans(spark, d), _contexts(spark, d)))
    return log.select("plan_id", F.array_join("changes", ";").alias("changes"))


@query(
    "policy_useful",
    f"""
    SELECT plan_id, count(*) AS n_actions FROM ({_STEPS}) GROUP BY 1
    HAVING NOT (count(*) = 1 AND min(action) = 'fix_column_names')
    """,
)
def policy_useful(spark, d):
    return policy.useful_plans(_plans(spark, d))


@query(
    "policy_order",
    f"""
    WITH r AS (SELECT plan_id, step, action, CASE action
               {' '.join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(CANONICAL_ORDER))} ELSE 9 END AS rank
               FROM ({_STEPS}))
    SELECT plan_id, string_agg(action, ' > ' ORDER BY rank, step) AS ordered FROM r GROUP BY 1
    """,
)
def policy_order(spark, d):
    ranked = order_actions(_plans(spark, d)).select("plan_id", F.struct("rank", "step", "action").alias("a"))
    listed = F.transform(F.array_sort(F.collect_list("a")), lambda x: x["action"])
    return ranked.groupBy("plan_id").agg(F.array_join(listed, " > ").alias("ordered"))


# ---------------------------------------------------------------- encodings
@query(
    "policy_encoding",
    f"""
    WITH x AS ({_PROFILE.format(orders='orders')}), f AS ({_FAMILY}),
    e AS (SELECT o_custkey AS plan_id, 'col' || CAST(o_orderkey AS VARCHAR) AS "column",
                 CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'ordinal' ELSE 'one_hot' END AS method
          FROM orders),
    own AS (SELECT e.* FROM e JOIN x USING (plan_id, "column") WHERE is_text),
    r AS (SELECT plan_id, "column", CASE WHEN contains(lower(semantics), 'ordered')
                 OR n_unique > CASE WHEN is_tree THEN 10 ELSE 200 END OR is_tree THEN 'ordinal' ELSE 'one_hot' END AS choice
          FROM x JOIN f USING (plan_id) WHERE is_text AND semantics IS NOT NULL)
    SELECT plan_id, CAST(1 AS BIGINT) AS step, "column", coalesce(choice, method) AS method,
           choice IS NOT NULL AND choice IS DISTINCT FROM method AS changed
    FROM own FULL JOIN r USING (plan_id, "column")
    """,
)
def policy_encoding(spark, d):
    profile = _profile(spark, d)
    encodings = table(spark, d, "orders").selectExpr(
        "o_custkey AS plan_id",
        "CAST(1 AS BIGINT) AS step",
        "concat('col', o_orderkey) AS column",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'ordinal' ELSE 'one_hot' END AS method",
    )
    semantics = profile.where("semantics IS NOT NULL").select("plan_id", "column", "semantics")
    contexts = _contexts(spark, d)
    steps = contexts.select("plan_id", F.lit(1).cast("bigint").alias("step"))
    return policy.encoding_rule(encodings, contexts, semantics, profile, steps)


@query(
    "policy_budget",
    f"""
    WITH x AS (SELECT * FROM ({_PROFILE.format(orders='orders')}) JOIN ({_FAMILY}) USING (plan_id)),
    m AS (SELECT *, CASE WHEN semantics IS NOT NULL AND (contains(lower(semantics), 'ordered')
                              OR contains(semantics, 'high cardinality')
                              OR coalesce(n_unique, 0) > CASE WHEN is_linear THEN 200 ELSE 10 END) THEN 'ordinal'
                         WHEN is_tree THEN 'ordinal' ELSE 'one_hot' END AS method
          FROM x WHERE is_text OR semantics IS NOT NULL),
    n AS (SELECT plan_id, count(*) FILTER (WHERE is_numeric) AS nn FROM x GROUP BY 1),
    e AS (SELECT m.*, method = 'one_hot' AND n_unique IS NOT NULL AS oh, nn FROM m JOIN n USING (plan_id)),
    w AS (SELECT *, nn + sum(CASE WHEN oh THEN n_unique ELSE 0 END) OVER p
                    + count(*) FILTER (WHERE method = 'ordinal') OVER p AS est,
                 coalesce(sum(CASE WHEN oh THEN n_unique - 1 END) OVER (PARTITION BY plan_id
                     ORDER BY CASE WHEN oh THEN n_unique ELSE -1 END DESC, "column"
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved
          FROM e WINDOW p AS (PARTITION BY plan_id)),
    z AS (SELECT *, is_linear AND oh AND est - saved > CASE WHEN is_knn THEN 50 ELSE 200 END AS demoted FROM w)
    SELECT plan_id, "column", CASE WHEN demoted THEN 'ordinal' ELSE method END AS method, demoted FROM z
    """,
)
def policy_budget(spark, d):
    profile = _profile(spark, d)
    semantics = profile.where("semantics IS NOT NULL").select("plan_id", "column", "semantics")
    return policy.budget_rule(_contexts(spark, d), semantics, profile.drop("semantics"))


# ---------------------------------------------------------------- from rules to rows
_FAMILIES = {"linear": "LogisticRegression", "tree": "RandomForest", "near": "KNN"}


def _family_sql(name: str) -> str:
    """One family's cleaning of the dirty orders, statistics from even keys, rows with odd keys."""
    center = "avg(o_totalprice)" if name == "linear" else "quantile_cont(o_totalprice, 0.5)"
    mode = "(SELECT {c} FROM t WHERE ev AND {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    gap = mode if name == "linear" else "'None'"
    clip = "tp" if name == "tree" else "least(greatest(tp, q1 - 3.0 * (q3 - q1)), q3 + 3.0 * (q3 - q1))"
    status = "coalesce(sc.code, -1)" if name == "tree" else "CAST(st = 'F' AS DOUBLE)"
    value = "({c} - (avg({c}) FILTER (WHERE ev) OVER ())) / (stddev_pop({c}) FILTER (WHERE ev) OVER ())"
    scaled = {c: value.format(c=c) if name == "linear" else c for c in ("tp", "pr", "st")}
    return f"""
    (WITH t AS (SELECT *, o_orderkey % 2 = 0 AS ev FROM ({DIRTY_ORDERS_SQL})),
    f AS (SELECT o_orderkey, ev, coalesce(o_totalprice, (SELECT {center} FROM t WHERE ev)) AS tp,
          coalesce(o_orderpriority, {gap.format(c="o_orderpriority")}) AS pr,
          coalesce(o_orderstatus, {gap.format(c="o_orderstatus")}) AS st FROM t),
    b AS (SELECT quantile_cont(tp, 0.25) AS q1, quantile_cont(tp, 0.75) AS q3 FROM f WHERE ev),
    pc AS (SELECT pr, row_number() OVER (ORDER BY pr) - 1 AS code FROM (SELECT DISTINCT pr FROM f WHERE ev)),
    sc AS (SELECT st, row_number() OVER (ORDER BY st) - 1 AS code FROM (SELECT DISTINCT st FROM f WHERE ev)),
    e AS (SELECT o_orderkey, ev, {clip} AS tp, CAST(coalesce(pc.code, -1) AS DOUBLE) AS pr, CAST({status} AS DOUBLE) AS st
          FROM f LEFT JOIN pc USING (pr) LEFT JOIN sc USING (st), b),
    z AS (SELECT o_orderkey, ev, {scaled["tp"]} AS tp, {scaled["pr"]} AS pr, {scaled["st"]} AS st FROM e)
    SELECT '{name}' AS family, o_orderkey, round(tp, 6) AS total, round(pr, 6) AS priority, round(st, 6) AS status
    FROM z WHERE NOT ev)"""


@query("enforced_clean", " UNION ALL ".join(_family_sql(n) for n in _FAMILIES))
def enforced_clean(spark, d):
    """One written plan for three model families: rules, fit on even keys, applied to odd ones."""
    steps = [
        (1, "handle_missing", {"strategy": "impute"}),
        (2, "clip_outliers", {"method": "iqr", "iqr_k": "1.5"}),
        (3, "bin_numeric", {"n_bins": "5"}),
        (4, "encode_categorical_per_column", {"default_method": "one_hot"}),
    ]
    plans = spark.createDataFrame(
        [(f, i, a, "as written", [], p) for f in _FAMILIES for i, a, p in steps],
        "plan_id string, step bigint, action string, rationale string, target_columns array<string>, params map<string,string>",
    )
    contexts = spark.createDataFrame(
        [(f, m, [], []) for f, m in _FAMILIES.items()],
        "plan_id string, downstream_model string, redundant_features array<string>, leakage_cols array<string>",
    )
    df = dirty_orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in ("o_orderstatus", "o_orderpriority")]).first()
    columns = [("o_totalprice", False, None, None), ("o_orderstatus", True, counts[0], "nominal"),
               ("o_orderpriority", True, counts[1], "Ordered scale")]
    profile = spark.createDataFrame(
        [(f, c, text, not text, n, False) for f in _FAMILIES for c, text, n, _ in columns],
        "plan_id string, column string, is_text boolean, is_numeric boolean, n_unique bigint, is_target boolean",
    )
    semantics = spark.createDataFrame(
        [(f, c, s) for f in _FAMILIES for c, _, _, s in columns if s], "plan_id string, column string, semantics string"
    )
    own = spark.createDataFrame(
        [(f, 4, c, "ordinal") for f in _FAMILIES for c in ("o_totalprice", "o_orderstatus")],
        "plan_id string, step bigint, column string, method string",
    )
    enforced = policy.enforce(plans, contexts, profile, own, semantics)
    parts = []
    for name, plan in policy.to_plans(enforced, list(_FAMILIES)).items():
        model = PlanCleaner(plan, carry=["o_orderkey"]).fit(df.where("o_orderkey % 2 = 0"))
        out = model.transform(df.where("o_orderkey % 2 = 1"))
        status = "o_orderstatus__ord" if name == "tree" else "o_orderstatus__F"
        parts.append(
            out.select(
                F.lit(name).alias("family"), "o_orderkey", F.round("o_totalprice", 6).alias("total"),
                F.round("o_orderpriority__ord", 6).alias("priority"), F.round(status, 6).alias("status"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- plan quality and documents
@query(
    "plan_quality",
    f"""
    WITH a AS ({_STEPS}),
    t AS (SELECT plan_id, action, count(*) AS n FROM a GROUP BY 1, 2),
    p AS (SELECT plan_id, CAST(sum(n) AS BIGINT) AS np, string_agg(action || ':' || n, ';' ORDER BY action || ':' || n) AS types
          FROM t GROUP BY 1),
    s AS (SELECT plan_id, count(*) FILTER (WHERE step % 3 = 0 AND action <> 'bin_numeric') AS ap,
                 count(*) FILTER (WHERE step % 3 = 1 AND action <> 'bin_numeric') AS sk,
                 count(*) FILTER (WHERE step % 3 = 2 AND action <> 'bin_numeric') AS fa FROM a GROUP BY 1)
    SELECT plan_id, np AS n_actions_proposed, coalesce(ap, 0) AS n_actions_applied, coalesce(sk, 0) AS n_actions_skipped,
           coalesce(fa, 0) AS n_actions_failed,
           round(coalesce(sk + fa, 0) / greatest(np, coalesce(ap + sk + fa, 0)), 4) AS rejection_rate,
           NOT (np = 1 AND types = 'fix_column_names:1') AS structurally_valid,
           np = 1 AND types = 'fix_column_names:1' AS fallback_triggered,
           types AS distinct_action_types, c_acctbal AS latency_seconds
    FROM p LEFT JOIN s USING (plan_id) LEFT JOIN customer ON c_custkey = plan_id
    """,
)
def quality_of_plans(spark, d):
    plans = _plans(spark, d).withColumn("rationale", F.lit("Fallback: names only."))
    status = F.element_at(
        F.array(F.lit("applied"), F.lit("skipped"), F.lit("failed")), (F.col("step") % 3 + 1).cast("int")
    )
    # Binning left no status behind.
    known = F.when(F.col("action") != "bin_numeric", status)
    steps = plans.select("plan_id", F.col("action").alias("action_name"), known.alias("status"))
    latency = table(spark, d, "customer").select(
        F.col("c_custkey").alias("plan_id"), F.col("c_acctbal").alias("latency_seconds")
    )
    return plan_quality(plans, steps, ["plan_id"], latency)


_DAMAGE = """
    CASE event_id % 8
         WHEN 0 THEN props
         WHEN 1 THEN 'Here is the plan:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done.'
         WHEN 2 THEN 'Sure! ' || props || ' - hope it helps'
         WHEN 3 THEN replace(props, '}', ', }')
         WHEN 4 THEN replace(props, '"', '''')
         WHEN 5 THEN replace(props, '}', ', "more": [1, 2, {"x": "cut')
         WHEN 6 THEN replace(props, '}', '} // trailing note')
         ELSE 'nothing to see' END
"""


@query(
    "recover_json",
    """
    SELECT event_id, CASE WHEN event_id % 8 < 7 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
           event_id % 8 < 7 AS recovered
    FROM events
    """,
)
def recover_json_events(spark, d):
    df = table(spark, d, "events").selectExpr("event_id", f"{_DAMAGE} AS answer".replace("''''", "\"'\""))
    return recover_json(df, "answer", "j").select(
        "event_id",
        F.get_json_object("j", "$.k").cast("bigint").alias("k"),
        F.col("j").isNotNull().alias("recovered"),
    )


_BODY = """
    '{"dataset_summary": "orders of ' || o_custkey || '", "diagnostics": ["first note", {"code": "c1", "observation": "seen"}],
      "actions": [ "skip me", {"action": "normalize_text", "target_columns": ["a", "b"], "params": {"ops": "lower"}},
      {"name": "handle_missing", "description": "' || o_orderpriority || '", "params": "none"},
      {"code": "encode_categorical_per_column", "target_columns": "x",
       "params": {"column_encodings": {"c' || o_orderstatus || '": "ordinal"}}}, {"rationale": "no name"} ]}'
"""


def _plan_bodies(spark, d):
    body = f"CASE o_orderkey % 3 WHEN 0 THEN {_BODY} WHEN 1 THEN {_BODY} || chr(0) || chr(0) ELSE {_BODY} || ' trailing' END"
    df = table(spark, d, "orders").selectExpr("o_orderkey AS plan_id", f"{body} AS stored")
    return tolerant_json(df, "stored", "plan_json").drop("stored")


@query(
    "load_plans",
    """
    SELECT o_orderkey AS plan_id, CAST(2 AS INTEGER) AS step, 'normalize_text' AS action, 'No rationale.' AS rationale,
           'a,b' AS target_columns, 'lower' AS ops FROM orders
    UNION ALL SELECT o_orderkey, 3, 'handle_missing', o_orderpriority, '', NULL FROM orders
    UNION ALL SELECT o_orderkey, 4, 'encode_categorical_per_column', 'No rationale.', '', NULL FROM orders
    """,
)
def load_plans(spark, d):
    return plan_actions(_plan_bodies(spark, d)).select(
        "plan_id",
        "step",
        "action",
        "rationale",
        F.array_join("target_columns", ",").alias("target_columns"),
        F.col("params")["ops"].alias("ops"),
    )


@query(
    "load_plan_encodings",
    """
    SELECT o_orderkey AS plan_id, CAST(4 AS INTEGER) AS step, 'c' || o_orderstatus AS "column", 'ordinal' AS method
    FROM orders
    """,
)
def load_plan_encodings(spark, d):
    return column_encodings(plan_actions(_plan_bodies(spark, d)))


@query(
    "load_plan_notes",
    """
    SELECT o_orderkey AS plan_id, CAST(0 AS INTEGER) AS position, 'note' AS code, 'info' AS severity, 'first note' AS message
    FROM orders UNION ALL SELECT o_orderkey, 1, 'c1', 'info', 'seen' FROM orders
    """,
)
def load_plan_notes(spark, d):
    return plan_notes(_plan_bodies(spark, d)).drop("evidence")


@query(
    "load_contexts",
    """
    SELECT c_custkey AS plan_id, c_mktsegment AS downstream_model, 'c' || c_nationkey AS redundant,
           'ordered' AS semantics FROM customer
    """,
)
def load_contexts(spark, d):
    inner = (
        """'{"downstream_model": "' || c_mktsegment || '", "redundant_features": ["c' || c_nationkey || '"],"""
        """ "column_semantics": {"size": "ordered"}}'"""
    )
    stored = f"""CASE WHEN c_custkey % 2 = 0 THEN {inner} ELSE '{{"user_context": ' || {inner} || '}}' END"""
    df = table(spark, d, "customer").selectExpr("c_custkey AS plan_id", f"{stored} AS body")
    c = parse_context(F.col("body"))
    return df.select("plan_id", c.alias("c")).select(
        "plan_id",
        "c.downstream_model",
        F.array_join("c.redundant_features", ",").alias("redundant"),
        F.col("c.column_semantics")["size"].alias("semantics"),
    )
