"""Queries for profiles, findings, comparisons and questionnaires."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyloom.catalog.common import DIRTY_ORDERS_SQL, dirty_orders, query, rounded, table
from tidyloom.operators import findings, profile, survey
from tidyloom.operators.texts import normalize_text
from tidyloom.plans import run_fixed


def _profile_sql(source: str, cols: list[tuple[str, bool, bool]]) -> str:
    """``cols``: (name, is_numeric, is_text); one UNION ALL branch per column."""
    parts = []
    for i, (c, num, text) in enumerate(cols):
        low = f"round(CAST(min({c}) AS DOUBLE), 6), round(CAST(max({c}) AS DOUBLE), 6), round(avg({c}), 6), round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6)"
        none = ", ".join(["CAST(NULL AS DOUBLE)"] * 4)
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS name, count(*) - count({c}) AS missing_count, "
            f"round((count(*) - count({c})) / count(*), 6) AS missing_ratio, "
            f"count(DISTINCT {c}) AS n_unique, {num} AS is_numeric, {text} AS is_text, "
            f"count(DISTINCT {c}) <= 1 AS is_constant, {low if num else none} FROM {source}"
        )
    names = "position, name, missing_count, missing_ratio, n_unique, is_numeric, is_text, is_constant, min, max, mean, median"
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS p({names})"


_CUSTOMER = [
    ("c_custkey", True, False),
    ("c_name", False, True),
    ("c_nationkey", True, False),
    ("c_acctbal", True, False),
    ("c_mktsegment", False, True),
]
_SHOWN = [
    "position", "name", "missing_count", "missing_ratio", "n_unique", "is_numeric", "is_text",
    "is_constant", "min", "max", "mean", "median",
]


def _shown(df):
    return rounded(df.select(*_SHOWN), min=6, max=6, mean=6, median=6)


@query("profile_customer", _profile_sql("customer", _CUSTOMER))
def profile_customer(spark, d):
    return _shown(profile.profile_columns(table(spark, d, "customer")))


_EVENTS = [
    ("event_id", True, False),
    ("ts", False, False),
    ("user_id", True, False),
    ("event_type", False, True),
    ("value", True, False),
    ("props", False, True),
]


@query("profile_events", _profile_sql("events", _EVENTS))
def profile_events(spark, d):
    return _shown(profile.profile_columns(table(spark, d, "events")))


_DIRTY = [
    ("o_orderkey", True, False),
    ("o_custkey", True, False),
    ("o_orderstatus", False, True),
    ("o_totalprice", True, False),
    ("o_orderdate", False, False),
    ("o_orderpriority", False, True),
]


@query("profile_dirty_orders", _profile_sql(f"({DIRTY_ORDERS_SQL})", _DIRTY))
def profile_dirty_orders(spark, d):
    return _shown(profile.profile_columns(dirty_orders(spark, d)))


@query(
    "profile_samples_part",
    """
    WITH v AS (SELECT 'p_brand' AS name, p_brand AS x FROM part UNION ALL
               SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part),
    s AS (SELECT DISTINCT name, x FROM v WHERE x IS NOT NULL),
    r AS (SELECT name, x FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY x) <= 5)
    SELECT name, string_agg(x, '|' ORDER BY x) AS samples FROM r GROUP BY name
    """,
)
def profile_samples_part(spark, d):
    out = profile.profile_columns(table(spark, d, "part").select("p_brand", "p_type", "p_name"))
    return out.select("name", F.array_join("sample_values", "|").alias("samples"))


@query(
    "target_profile_labels",
    """
    SELECT coalesce(CAST(q AS VARCHAR), 'nan') AS "class", count(*) AS n, q IS NULL AS is_missing
    FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN NULL ELSE quality END AS q FROM labels) GROUP BY q
    """,
)
def target_profile_labels(spark, d):
    df = table(spark, d, "labels").selectExpr(
        "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE quality END AS quality"
    )
    return profile.target_profile(df, "quality")


@query(
    "overview_orders",
    f"""
    WITH t AS (SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM ({DIRTY_ORDERS_SQL})),
    m AS (SELECT count(*) AS n, 4 * count(*) - count(o_custkey) - count(o_orderstatus)
                 - count(o_totalprice) - count(o_orderpriority) AS gaps FROM t),
    u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM t))
    SELECT n AS n_rows, CAST(4 AS INTEGER) AS n_columns, gaps AS missing_cells,
           round(100.0 * gaps / (4 * n), 8) AS missing_pct, n - k AS duplicate_rows,
           CAST(2 AS INTEGER) AS text_columns
    FROM m, u
    """,
)
def overview_orders(spark, d):
    df = dirty_orders(spark, d).select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(profile.overview(df), missing_pct=8)


def _describe_sql() -> str:
    parts = []
    for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount"]):
        q = ", ".join(f"round(quantile_cont({c}, {p}), 4)" for p in (0.25, 0.5, 0.75))
        parts.append(
            f"SELECT CAST({i} AS INTEGER), '{c}', count({c}), round(avg({c}), 6), round(stddev_samp({c}), 4), "
            f"min({c}), {q}, max({c}), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) "
            "FROM lineitem"
        )
    parts.append(
        "SELECT CAST(3 AS INTEGER), 'l_returnflag', (SELECT count(l_returnflag) FROM lineitem), "
        + ", ".join(["CAST(NULL AS DOUBLE)"] * 7)
        + ", (SELECT count(DISTINCT l_returnflag) FROM lineitem), v, n FROM "
        "(SELECT l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"
    )
    names = "position, name, count, mean, std, min, p25, p50, p75, max, \"unique\", top, freq"
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS t({names})"


@query("describe_lineitem", _describe_sql())
def describe_lineitem(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return rounded(profile.describe(df), mean=6, std=4, p25=4, p50=4, p75=4)


@query(
    "cardinality_part",
    """
    SELECT 'p_name' AS "column", count(DISTINCT p_name) AS n_unique FROM part
    UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
    UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
    """,
)
def cardinality_part(spark, d):
    return profile.cardinality(table(spark, d, "part"))


# ---------------------------------------------------------------- before / after
@query(
    "cell_diff",
    f"""
    WITH b AS ({DIRTY_ORDERS_SQL})
    SELECT 'o_custkey' AS "column", CAST(0 AS BIGINT) AS changed_cells
    UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE b.o_orderstatus IS DISTINCT FROM o.o_orderstatus)
              FROM b JOIN orders o USING (o_orderkey)
    UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE b.o_totalprice IS DISTINCT FROM o.o_totalprice)
              FROM b JOIN orders o USING (o_orderkey)
    UNION ALL SELECT 'o_orderpriority',
              count(*) FILTER (WHERE b.o_orderpriority IS DISTINCT FROM o.o_orderpriority)
              FROM b JOIN orders o USING (o_orderkey)
    """,
)
def cell_diff(spark, d):
    before = dirty_orders(spark, d).drop("o_orderdate")
    return profile.cell_diff(before, table(spark, d, "orders"), "o_orderkey")


@query(
    "quality_delta",
    f"""
    WITH b AS ({DIRTY_ORDERS_SQL}), s AS (SELECT o_orderstatus AS v FROM b WHERE o_orderstatus IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM b),
    a AS (SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, med) AS o_totalprice FROM b, m),
    qb AS (SELECT quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.75) q3 FROM b),
    qa AS (SELECT quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.75) q3 FROM a),
    x AS (SELECT
      (SELECT 4 * count(*) - count(o_orderkey) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice) FROM b) AS m0,
      (SELECT 4 * count(*) - count(o_orderkey) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice) FROM a) AS m1,
      (SELECT count(*) FROM b, qb WHERE o_totalprice < q1 - 3 * (q3 - q1) OR o_totalprice > q3 + 3 * (q3 - q1)) AS o0,
      (SELECT count(*) FROM a, qa WHERE o_totalprice < q1 - 3 * (q3 - q1) OR o_totalprice > q3 + 3 * (q3 - q1)) AS o1)
    SELECT 'orders' AS dataset, m0 AS missing_before, m1 AS missing_after, m0 - m1 AS missing_filled,
           round((m0 - m1) / greatest(m0, 1) * 100.0, 6) AS missing_fill_rate, o0 AS outliers_before,
           o1 AS outliers_after, o0 - o1 AS outlier_reduction, CAST(1 AS INTEGER) AS cols_added,
           CAST(0 AS INTEGER) AS cols_removed
    FROM x
    """,
)
def quality_delta(spark, d):
    from tidyloom.operators.missing import fill, fit_center

    before = dirty_orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    after = fill(before, fit_center(before, ["o_totalprice"], "median")).withColumn("extra", F.lit(1))
    return rounded(profile.quality_delta({"orders": (before, after)}, spark), missing_fill_rate=6)


@query(
    "before_after_summary",
    """
    SELECT count(*) AS rows_before,
           (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)) AS rows_after,
           'clerk' AS columns_added, 'o_orderdate,o_orderkey,o_orderstatus,o_totalprice' AS columns_removed
    FROM orders
    """,
)
def before_after_summary(spark, d):
    before = table(spark, d, "orders")
    after = before.select("o_custkey", "o_orderpriority").dropDuplicates().withColumn("clerk", F.lit("x"))
    diff = profile.schema_diff(before, after)
    row = (
        diff["rows_before"],
        diff["rows_after"],
        ",".join(sorted(diff["columns_added"])),
        ",".join(sorted(diff["columns_removed"])),
    )
    return spark.createDataFrame(
        [row], "rows_before bigint, rows_after bigint, columns_added string, columns_removed string"
    )


@query(
    "audit_steps",
    f"""
    WITH t AS ({DIRTY_ORDERS_SQL}),
    m AS (SELECT round(quantile_cont(o_totalprice, 0.5), 4) AS med FROM t),
    p AS (SELECT o_orderpriority AS v FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    n AS (SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS rows_after,
                 count(*) FILTER (WHERE trim(regexp_replace(o_orderpriority, '[ ]+', ' ', 'g')) <> o_orderpriority) AS changed
          FROM t),
    s AS (SELECT unnest([1, 2, 3, 4]) AS step_id)
    SELECT 'orders' AS dataset_id, step_id,
           ['fix_column_names', 'handle_missing', 'deduplicate', 'normalize_text'][step_id] AS action_name,
           'applied' AS status, step_id = 3 AND rows_before = rows_after OR step_id = 4 AS warned,
           CASE step_id WHEN 2 THEN med END AS filled_price, CASE step_id WHEN 2 THEN v END AS filled_priority,
           CASE step_id WHEN 3 THEN rows_before END AS rows_before, CASE step_id WHEN 3 THEN rows_after END AS rows_after,
           CASE step_id WHEN 4 THEN changed END AS priorities_changed
    FROM s, m, p, n
    """,
)
def audit_steps(spark, d):
    """Provenance of the fixed preset over the dirty orders; its counts read from the records."""
    log = run_fixed(dirty_orders(spark, d), "orders")[1].to_frame(spark)

    def told(path: str, kind: str):
        return F.get_json_object("diff_summary", f"$.{path}").cast(kind)

    return log.select(
        "dataset_id", F.col("step_id").cast("int").alias("step_id"), "action_name", "status",
        (F.size("warnings") > 0).alias("warned"),
        F.round(told("imputation_values.o_totalprice", "double"), 4).alias("filled_price"),
        told("imputation_values.o_orderpriority", "string").alias("filled_priority"),
        told("rows_before", "bigint").alias("rows_before"),
        told("rows_after", "bigint").alias("rows_after"),
        told("values_changed_count.o_orderpriority", "bigint").alias("priorities_changed"),
    )


@query(
    "audit_text_counts",
    f"""
    WITH t AS ({DIRTY_ORDERS_SQL})
    SELECT 'o_orderpriority' AS "column",
           count(*) FILTER (WHERE upper(trim(o_orderpriority)) <> o_orderpriority
                            OR lower(trim(o_orderpriority)) <> o_orderpriority) AS changed
    FROM t
    """,
)
def audit_text_counts(spark, d):
    params = {"columns": ["o_orderpriority"], "ops": ["strip", "lower"]}
    diff = normalize_text(dirty_orders(spark, d), params)[1]
    rows = list(diff["values_changed_count"].items())
    return spark.createDataFrame(rows, "column string, changed bigint")


# ---------------------------------------------------------------- findings
@query(
    "find_target_distribution",
    """
    WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
    s AS (SELECT max(n) / sum(n) AS share, count(*) AS k FROM c)
    SELECT CAST(0 AS INTEGER) AS position, 'check_target_distribution' AS code,
           CASE WHEN share >= 0.9 THEN 'critical' WHEN share >= 0.7 THEN 'warning' ELSE 'info' END AS severity,
           format('the target has {} classes, the largest with {:.0f} % of the rows', k, 100 * share) AS message,
           round(share, 8) AS max_share
    FROM s
    """,
)
def find_target_distribution(spark, d):
    found = findings.check_target_distribution(table(spark, d, "labels"), "quality")
    out = findings.findings_frame(spark, [found])
    share = F.round(F.col("evidence")["max_class_share"].cast("double"), 8)
    return out.select("position", "code", "severity", "message", share.alias("max_share"))


@query(
    "find_target_continuous",
    """
    SELECT 'info' AS severity, count(DISTINCT o_totalprice) AS nunique, count(o_totalprice) AS "count",
           round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std,
           min(o_totalprice) AS min, max(o_totalprice) AS max
    FROM orders
    """,
)
def find_target_continuous(spark, d):
    f = findings.check_target_distribution(table(spark, d, "orders"), "o_totalprice")
    s = f["evidence"]["stats"]
    row = (f["severity"], f["evidence"]["nunique"], s["count"], s["mean"], s["std"], s["min"], s["max"])
    out = spark.createDataFrame(
        [row], "severity string, nunique bigint, count bigint, mean double, std double, min double, max double"
    )
    return rounded(out, mean=4, std=4)


_CONSTANTS = [
    "l_returnflag",
    "l_linestatus",
    "1 AS one",
    "CAST(NULL AS VARCHAR(5)) AS void",
    "CASE WHEN l_orderkey = 0 THEN 'rare' ELSE 'usual' END AS nearly",
]


@query(
    "find_constant",
    f"""
    WITH t AS (SELECT {', '.join(_CONSTANTS)} FROM lineitem),
    u AS (SELECT 'l_linestatus' AS "column", l_linestatus AS v FROM t UNION ALL SELECT 'one', CAST(one AS VARCHAR) FROM t
          UNION ALL SELECT 'void', void FROM t UNION ALL SELECT 'nearly', nearly FROM t),
    c AS (SELECT "column", v, count(*) AS n FROM u GROUP BY 1, 2),
    p AS (SELECT "column", count(v) AS n_unique,
                 coalesce(max(n) FILTER (WHERE v IS NOT NULL) / sum(n) FILTER (WHERE v IS NOT NULL), 1.0) AS top_ratio
          FROM c GROUP BY 1)
    SELECT "column", n_unique, round(top_ratio, 8) AS top_ratio,
           CASE WHEN n_unique <= 1 THEN 'constant' WHEN top_ratio >= 0.99 THEN 'near_constant' END AS kind
    FROM p
    """,
)
def find_constant(spark, d):
    df = table(spark, d, "lineitem").selectExpr(*_CONSTANTS)
    return rounded(findings.constant_columns(df, "l_returnflag"), top_ratio=8)


_LEAKS = [
    "o_totalprice AS price",
    "o_totalprice AS copy_of_it",
    "o_totalprice * 1.1 + o_orderkey * 0.001 AS gross",
    "CAST(o_orderkey AS DOUBLE) AS other",
    "o_custkey % 10 AS unit_price_band",
]


@query(
    "find_leakage",
    f"""
    WITH t AS (SELECT {', '.join(_LEAKS)} FROM orders),
    r AS (SELECT 0 AS position, 'copy_of_it' AS c, bool_and(copy_of_it = price) AS same, corr(copy_of_it, price) AS r FROM t
          UNION ALL SELECT 1, 'gross', bool_and(gross = price), corr(gross, price) FROM t
          UNION ALL SELECT 2, 'other', bool_and(other = price), corr(other, price) FROM t
          UNION ALL SELECT 3, 'unit_price_band', FALSE, corr(unit_price_band, price) FROM t)
    SELECT CAST(position AS INTEGER) AS position, c AS "column", same AS "identical", round(r, 6) AS corr,
           abs(r) >= 0.98 AS high_corr, contains(c, 'price') AS name_suspect
    FROM r
    """,
)
def find_leakage(spark, d):
    df = table(spark, d, "orders").selectExpr(*_LEAKS)
    return rounded(findings.leakage_signals(df, "price"), corr=6)


@query(
    "findings_all",
    """
    WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1),
    s AS (SELECT max(n) / sum(n) AS share, sum(n) AS rows FROM c),
    g AS (SELECT CASE WHEN share >= 0.9 THEN 'critical' WHEN share >= 0.7 THEN 'warning' ELSE 'info' END AS grade FROM s),
    z AS (SELECT abs(corr(quality, toxic)) AS a, abs(corr(doc_id, toxic)) AS b FROM labels)
    SELECT CAST(0 AS INTEGER) AS position, 'check_target_distribution' AS code, grade AS severity FROM g
    UNION ALL SELECT 1, 'flag_leakage', CASE WHEN a >= 0.98 OR b >= 0.98 THEN 'critical' ELSE 'info' END FROM z
    UNION ALL SELECT 2, 'flag_redundant_or_constant_features', 'info'
    UNION ALL SELECT 3, 'recommend_feature_selection',
              CASE WHEN 2 / rows >= 1 THEN 'critical' WHEN 2 / rows >= 0.5 THEN 'warning' ELSE 'info' END FROM s
    UNION ALL SELECT 4, 'recommend_oversampling', grade FROM g
    """,
)
def findings_all(spark, d):
    found = findings.compute_findings(table(spark, d, "labels"), "toxic")
    return findings.findings_frame(spark, found).select("position", "code", "severity")


# ---------------------------------------------------------------- questionnaires
_ANSWERS = [
    "c_custkey",
    *[f"1 + (c_custkey * {i} + c_nationkey) % 5 AS sus_{i}" for i in range(1, 11)],
]
_WORDS = [
    "c_custkey",
    *[
        f"CASE (c_custkey + c_nationkey * {i}) % 4 WHEN 0 THEN 'Disagree' WHEN 1 THEN 'Agree' "
        f"WHEN 2 THEN 'Strongly agree' END AS q11_{i}"
        for i in range(1, 4)
    ],
]
_WORDS_SQL = (
    f"WITH t AS (SELECT {', '.join(_WORDS)} FROM customer), u AS ("
    + " UNION ALL ".join(f"SELECT 'q11_{i}' AS item, q11_{i} AS v FROM t" for i in range(1, 4))
    + ")"
)


@query(
    "likert_crosstab",
    f"""
    {_WORDS_SQL}
    SELECT item, count(*) FILTER (WHERE v = 'Disagree') AS "Disagree",
           count(*) FILTER (WHERE v = 'Agree') AS "Agree",
           count(*) FILTER (WHERE v = 'Strongly agree') AS "Strongly agree"
    FROM u GROUP BY item
    """,
)
def likert_crosstab(spark, d):
    df = table(spark, d, "customer").selectExpr(*_WORDS)
    return survey.likert_crosstab(df, ["q11_1", "q11_2", "q11_3"], ["Disagree", "Agree", "Strongly agree"])


@query(
    "survey_top_box",
    f"""
    {_WORDS_SQL}
    SELECT item, count(*) FILTER (WHERE v IN ('Agree', 'Strongly agree')) AS n_positive, count(v) AS n_answers,
           round(count(*) FILTER (WHERE v IN ('Agree', 'Strongly agree')) / count(v), 8) AS share
    FROM u GROUP BY item
    """,
)
def survey_top_box(spark, d):
    df = table(spark, d, "customer").selectExpr(*_WORDS)
    out = survey.top_box(df, ["q11_1", "q11_2", "q11_3"], ["Agree", "Strongly agree"])
    return rounded(out, share=8)


@query(
    "survey_frequencies",
    """
    SELECT c_mktsegment AS answer, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer WHERE c_nationkey <> 3), 8)
               AS share
    FROM customer WHERE c_nationkey <> 3 GROUP BY 1
    """,
)
def survey_frequencies(spark, d):
    df = table(spark, d, "customer").withColumn(
        "status", F.when(F.col("c_nationkey") != 3, "done").otherwise("open")
    )
    return rounded(survey.frequencies(survey.accepted(df, "status", "done"), "c_mktsegment"), share=8)


_ITEMS = [f"sus_{i}" for i in range(1, 11)]


@query(
    "survey_item_summary",
    f"""
    WITH t AS (SELECT {', '.join(_ANSWERS)} FROM customer)
    {' UNION ALL '.join(
        f"SELECT '{c}' AS item, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS sd, count({c}) AS n FROM t"
        for c in _ITEMS)}
    """,
)
def survey_item_summary(spark, d):
    df = table(spark, d, "customer").selectExpr(*_ANSWERS)
    return rounded(survey.item_summary(df, _ITEMS), mean=8, sd=8)


@query(
    "usability_score",
    f"""
    WITH t AS (SELECT {', '.join(_ANSWERS)} FROM customer)
    SELECT c_custkey, (sus_1 - 1 + 5 - sus_2 + sus_3 - 1 + 5 - sus_4 + sus_5 - 1 + 5 - sus_6 + sus_7 - 1
                       + 5 - sus_8 + sus_9 - 1 + 5 - sus_10) * CAST(2.5 AS DOUBLE) AS score
    FROM t
    """,
)
def usability_score(spark, d):
    df = table(spark, d, "customer").selectExpr(*_ANSWERS)
    out = survey.usability_score(df, _ITEMS)
    return out.select("c_custkey", F.col("score").cast("double").alias("score"))
