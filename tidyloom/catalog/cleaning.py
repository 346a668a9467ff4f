"""Queries for column, missing-value, text, duplicate, category and numeric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyloom.catalog.common import (
    DIRTY_LINES_SQL,
    DIRTY_ORDERS_SQL,
    dirty_lines,
    dirty_orders,
    query,
    rounded,
    table,
)
from tidyloom.functions.scalar import nan_to_null
from tidyloom.operators import chained, columns, dedup, encode, missing, numeric, texts
from tidyloom.operators.profile import profile_columns
from tidyloom.plans import PlanCleaner, run_fixed
from tidyloom.sources.tables import infer_types, nullify_tokens


# ---------------------------------------------------------------- columns
@query(
    "fix_names_orders",
    """
    SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderstatus AS order_status
    FROM orders
    """,
)
def fix_names_orders(spark, d):
    df = table(spark, d, "orders").selectExpr(
        "o_orderkey AS `Order Key`", "o_totalprice AS ` Total-Price `", "o_orderstatus AS `ORDER STATUS`"
    )
    return columns.fix_column_names(df)[0]


_CASTS = """
    SELECT event_id,
           CASE event_id % 10 WHEN 0 THEN 'n/a'
                WHEN 1 THEN CAST(event_id % 89 AS VARCHAR(20)) || '.0'
                WHEN 2 THEN CAST(event_id % 89 AS VARCHAR(20)) || '.5'
                ELSE CAST(event_id % 89 AS VARCHAR(20)) END AS k,
           CASE event_id % 7 WHEN 0 THEN 'oops' ELSE CAST(value AS VARCHAR(40)) END AS v,
           CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1'
                WHEN 3 THEN '0' ELSE 'maybe' END AS flag,
           CASE event_id % 6 WHEN 0 THEN 'soon'
                ELSE lpad(CAST(event_id % 28 + 1 AS VARCHAR(2)), 2, '0') || '/03/2024' END AS day
    FROM events
"""


@query(
    "cast_coerce_events",
    f"""
    WITH t AS ({_CASTS})
    SELECT event_id,
           CASE WHEN TRY_CAST(k AS DOUBLE) = floor(TRY_CAST(k AS DOUBLE))
                THEN CAST(TRY_CAST(k AS DOUBLE) AS BIGINT) END AS k,
           TRY_CAST(v AS DOUBLE) AS v,
           CASE WHEN lower(flag) IN ('true', '1', '1.0') THEN TRUE
                WHEN lower(flag) IN ('false', '0', '0.0') THEN FALSE END AS flag,
           try_strptime(day, '%d/%m/%Y') AS day
    FROM t
    """,
)
def cast_coerce_events(spark, d):
    table(spark, d, "events").createOrReplaceTempView("__cast_events")
    df = spark.sql(_CASTS.replace("FROM events", "FROM __cast_events"))
    for column, dtype in (("k", "int"), ("v", "float"), ("flag", "bool"), ("day", "datetime")):
        params = {"columns": [column], "dtype": dtype, "errors": "coerce", "datetime_format": "%d/%m/%Y"}
        df = columns.cast_type(df, params, audit=False)[0]
    return df


_TOKENS = [
    "c_custkey",
    "CASE c_custkey % 6 WHEN 0 THEN 'NA' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'null' "
    "WHEN 3 THEN '' ELSE c_mktsegment END AS segment",
    "CASE WHEN c_custkey % 4 = 0 THEN 'NULL' ELSE CAST(c_nationkey AS VARCHAR(10)) END AS nation",
]


@query(
    "nullify_tokens_customer",
    f"""
    WITH t AS (SELECT {', '.join(_TOKENS)} FROM customer)
    SELECT c_custkey,
           CASE WHEN trim(segment) IN ('NA', 'N/A', 'null', 'NULL', '') THEN NULL ELSE segment END AS segment,
           CAST(CASE WHEN trim(nation) IN ('NA', 'N/A', 'null', 'NULL', '') THEN NULL ELSE nation END AS BIGINT)
               AS nation
    FROM t
    """,
)
def nullify_tokens_customer(spark, d):
    return infer_types(nullify_tokens(table(spark, d, "customer").selectExpr(*_TOKENS)))


@query(
    "relabel_status",
    """
    SELECT o_orderkey,
           CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END
               AS o_orderstatus
    FROM orders
    """,
)
def relabel_status(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return columns.relabel_values(df, "o_orderstatus", {"F": "finished", "O": "open"})


@query(
    "drop_leakage_align",
    """
    SELECT l_quantity, CAST(0 AS INTEGER) AS l_weight, l_orderkey, l_returnflag FROM lineitem
    """,
)
def drop_leakage_align(spark, d):
    df = columns.drop_leakage(table(spark, d, "lineitem"), ["l_extendedprice", "not_there"])
    df = columns.drop_column(df, {"columns": ["l_tax", "nope"], "on_missing": "skip"})[0]
    return columns.align(df, ["l_quantity", "l_weight", "l_orderkey", "l_returnflag"])


@query(
    "nan_to_null",
    "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events",
)
def nan_as_null(spark, d):
    df = table(spark, d, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value"
    )
    return nan_to_null(df)


@query(
    "drop_missing_rows",
    f"""
    SELECT * FROM ({DIRTY_ORDERS_SQL}) WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL
    """,
)
def drop_missing_rows(spark, d):
    params = {"columns": ["o_totalprice", "o_orderpriority"], "strategy": "drop_rows"}
    return missing.handle_missing(dirty_orders(spark, d), params, audit=False)[0]


def _ratios_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, round((count(*) - count({c})) / count(*), 6) AS missing_ratio FROM {source}"
        for c in cols
    )


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "select_problem_columns",
    f"""
    WITH t AS ({DIRTY_ORDERS_SQL}), p AS ({_ratios_sql('t', _ORDER_COLS)})
    SELECT name, missing_ratio,
           (contains(lower(name), 'id') OR contains(lower(name), 'nbr')) AS is_id_candidate
    FROM p
    WHERE contains(lower(name), 'id') OR contains(lower(name), 'nbr') OR missing_ratio > 0
    """,
)
def select_problem_columns(spark, d):
    return columns.problem_columns(profile_columns(dirty_orders(spark, d)))


@query(
    "select_droppable_columns",
    """
    WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS value,
                      CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_nbr, event_type
               FROM events),
    p AS (SELECT 'event_id' AS name, (count(*) - count(event_id)) / count(*) AS r FROM t
          UNION ALL SELECT 'value', (count(*) - count(value)) / count(*) FROM t
          UNION ALL SELECT 'user_nbr', (count(*) - count(user_nbr)) / count(*) FROM t
          UNION ALL SELECT 'event_type', (count(*) - count(event_type)) / count(*) FROM t)
    SELECT name, round(r, 6) AS missing_ratio,
           CASE WHEN name LIKE '%id%' OR name LIKE '%nbr%' THEN 'id_like' ELSE 'high_missing' END AS reason
    FROM p WHERE name LIKE '%id%' OR name LIKE '%nbr%' OR r > 0.4
    """,
)
def select_droppable_columns(spark, d):
    df = table(spark, d, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS value",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_nbr",
        "event_type",
    )
    return columns.droppable_columns(profile_columns(df))


@query(
    "choose_columns",
    """
    SELECT 'normalize_text' AS action, c AS "column" FROM (VALUES ('o_orderstatus'), ('o_orderpriority')) v(c)
    UNION ALL SELECT 'handle_missing', c FROM (VALUES ('o_orderstatus'), ('o_totalprice'), ('o_orderpriority')) v(c)
    UNION ALL SELECT 'remove_outliers', c FROM (VALUES ('o_orderkey'), ('o_custkey')) v(c)
    UNION ALL SELECT 'encode_categorical', 'o_orderstatus' FROM orders GROUP BY 1
              HAVING count(DISTINCT o_orderstatus) <= 20
    UNION ALL SELECT 'encode_categorical', 'o_orderpriority' FROM orders GROUP BY 1
              HAVING count(DISTINCT o_orderpriority) * 2 <= 20
    """,
)
def choose_columns(spark, d):
    """Columns each action picks by itself when a plan names none."""
    df = dirty_orders(spark, d)
    names = ["normalize_text", "handle_missing", "remove_outliers", "encode_categorical"]
    rows = [(a, c) for a in names for c in columns.choose_columns(a, df, "o_totalprice")]
    return spark.createDataFrame(rows, "action string, column string")


# ---------------------------------------------------------------- missing values
@query(
    "impute_median",
    f"""
    WITH t AS ({DIRTY_LINES_SQL}),
    m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_extendedprice, 0.5) AS e,
                 quantile_cont(l_discount, 0.5) AS s FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_quantity, q) AS l_quantity,
           round(coalesce(l_extendedprice, e), 4) AS l_extendedprice, coalesce(l_discount, s) AS l_discount
    FROM t, m
    """,
)
def impute_median(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    df = dirty_lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *cols)
    return rounded(missing.fill(df, missing.fit_center(df, cols, "median")), l_extendedprice=4)


@query(
    "impute_mean",
    f"""
    WITH t AS ({DIRTY_LINES_SQL}), m AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice) AS e FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(l_quantity, q), 6) AS l_quantity,
           round(coalesce(l_extendedprice, e), 4) AS l_extendedprice
    FROM t, m
    """,
)
def impute_mean(spark, d):
    cols = ["l_quantity", "l_extendedprice"]
    df = dirty_lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *cols)
    filled = missing.fill(df, missing.fit_center(df, cols, "mean"))
    return rounded(filled, l_quantity=6, l_extendedprice=4)


@query(
    "impute_mode",
    f"""
    WITH t AS ({DIRTY_ORDERS_SQL}),
    s AS (SELECT o_orderstatus AS v FROM t WHERE o_orderstatus IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    p AS (SELECT o_orderpriority AS v FROM t WHERE o_orderpriority IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey, coalesce(o_orderstatus, s.v) AS o_orderstatus,
           coalesce(o_orderpriority, p.v) AS o_orderpriority
    FROM t, s, p
    """,
)
def impute_mode(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    params = {"columns": ["o_orderstatus", "o_orderpriority"], "strategy": "impute"}
    return missing.handle_missing(df, params, audit=False)[0]


@query(
    "impute_constant",
    f"""
    SELECT o_orderkey, coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority,
           CAST(0 AS DOUBLE) AS all_gone
    FROM ({DIRTY_ORDERS_SQL})
    """,
)
def impute_constant(spark, d):
    df = dirty_orders(spark, d).select(
        "o_orderkey", "o_orderpriority", F.lit(None).cast("double").alias("all_gone")
    )
    params = {
        "columns": ["o_orderpriority", "all_gone"],
        "impute": {"categorical": "constant", "constant_categorical": "UNKNOWN", "constant_value": 0},
    }
    return missing.handle_missing(df, params, audit=False)[0]


@query(
    "missing_indicators",
    f"""
    SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
           CAST(o_orderstatus IS NULL AS INTEGER) AS o_orderstatus_was_missing,
           CAST(o_totalprice IS NULL AS INTEGER) AS o_totalprice_was_missing,
           CAST(o_orderpriority IS NULL AS INTEGER) AS o_orderpriority_was_missing
    FROM ({DIRTY_ORDERS_SQL})
    """,
)
def missing_indicators(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return missing.apply_indicators(df, missing.fit_indicators(df))


@query(
    "semantic_fill",
    f"""
    SELECT o_orderkey, coalesce(o_orderstatus, 'None') AS o_orderstatus,
           coalesce(o_orderpriority, 'No priority') AS o_orderpriority
    FROM ({DIRTY_ORDERS_SQL})
    """,
)
def semantic_fill(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    fills = missing.fit_semantic_fill(
        df, "None", {"O-OrderPriority": "No priority", "o_orderpriority": "No priority"}, 0.05
    )
    return missing.fill(df, fills)


@query(
    "chained_impute_one_col",
    f"""
    WITH t AS ({DIRTY_ORDERS_SQL}), m AS (SELECT avg(o_totalprice) AS a FROM t)
    SELECT o_orderkey, round(coalesce(o_totalprice, a), 4) AS o_totalprice FROM t, m
    """,
)
def chained_impute_one_col(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_totalprice")
    params = {"columns": ["o_totalprice"], "strategy": "impute"}
    return rounded(missing.handle_missing(df, params, audit=False)[0], o_totalprice=4)


@query("chained_impute_multi")
def chained_impute_multi(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    df = dirty_lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *cols)
    return chained.apply_chained(df, chained.fit_chained(df, cols), closed_form=True)


@query(
    "safety_step",
    f"""
    WITH t AS ({DIRTY_ORDERS_SQL}),
    s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM
          (SELECT DISTINCT coalesce(o_orderstatus, '__missing__') AS v FROM t)),
    p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM
          (SELECT DISTINCT coalesce(o_orderpriority, '__missing__') AS v FROM t)),
    m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM t)
    SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(s.code AS DOUBLE) AS o_orderstatus,
           round(coalesce(o_totalprice, med), 4) AS o_totalprice, CAST(p.code AS DOUBLE) AS o_orderpriority
    FROM t CROSS JOIN m
    JOIN s ON s.v = coalesce(o_orderstatus, '__missing__')
    JOIN p ON p.v = coalesce(o_orderpriority, '__missing__')
    """,
)
def safety_step(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(missing.apply_safety(df, missing.fit_safety(df)), o_totalprice=4)


# ---------------------------------------------------------------- text
_SEGMENTS = [
    "c_custkey",
    "CASE c_custkey % 5 WHEN 0 THEN '  ' || c_mktsegment || '\t ' "
    "WHEN 1 THEN lower(c_mktsegment) || '  ' || lower(c_mktsegment) "
    "WHEN 2 THEN ' N/A ' ELSE c_mktsegment END AS segment",
]


@query(
    "normalize_text_segment",
    f"""
    WITH t AS (SELECT {', '.join(_SEGMENTS)} FROM customer),
    n AS (SELECT c_custkey,
                 replace(regexp_replace(trim(regexp_replace(lower(segment), '\\s+', ' ', 'g')),
                                        '(house)(hold)', '\\2-\\1', 'g'), 'furniture', 'home') AS s
          FROM t)
    SELECT c_custkey, CASE WHEN s IN ('n/a', 'unknown') THEN NULL ELSE s END AS segment FROM n
    """,
)
def normalize_text_segment(spark, d):
    df = table(spark, d, "customer").selectExpr(*_SEGMENTS)
    params = {
        "columns": ["segment"],
        "ops": ["strip", "lower", "collapse_whitespace"],
        "replace": [
            {"pattern": "(house)(hold)", "repl": r"\2-\1"},
            {"pattern": "furniture", "repl": "home"},
        ],
        "null_like_to_nan": ["N/A", "unknown"],
    }
    return texts.normalize_text(df, params, audit=False)[0]


_UNICODE_SPACE = (
    "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
)


@query(
    "normalize_text_docs",
    f"""
    SELECT doc_id, md5(trim(regexp_replace(lower(text), '{_UNICODE_SPACE}', ' ', 'g'))) AS digest,
           CAST(length(trim(regexp_replace(lower(text), '{_UNICODE_SPACE}', ' ', 'g'))) AS BIGINT) AS n_chars
    FROM documents
    """,
)
def normalize_text_docs(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text")
    out = texts.normalize_text(df, {"columns": ["text"]}, audit=False)[0]
    return out.select(
        "doc_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars")
    )


@query(
    "strip_accents_docs",
    "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents",
)
def strip_accents_docs(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text")
    out = texts.normalize_text(df, {"columns": ["text"], "ops": ["remove_accents"]}, audit=False)[0]
    return out.select("doc_id", F.md5("text").alias("digest"))


@query(
    "regex_replace_docs",
    """
    SELECT doc_id,
           md5(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '(e)e+', '\\1', 'g')) AS digest
    FROM documents
    """,
)
def regex_replace_docs(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text")
    rules = [{"pattern": "[0-9]+", "repl": "#"}, {"pattern": "(e)e+", "repl": r"\1"}]
    out = texts.normalize_text(df, {"columns": ["text"], "ops": [], "replace": rules}, audit=False)[0]
    return out.select("doc_id", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- duplicates
@query(
    "dedup_first",
    """
    SELECT doc_id, lang, source, n_chars FROM documents
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
    """,
)
def dedup_first(spark, d):
    df = table(spark, d, "documents")
    params = {"subset": ["text"], "keep": "first", "order_by": ["doc_id"]}
    return dedup.deduplicate(df, params, audit=False)[0].drop("text")


@query(
    "dedup_last",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    """,
)
def dedup_last(spark, d):
    df = table(spark, d, "orders")
    params = {
        "subset": ["o_custkey", "o_orderstatus"],
        "keep": "last",
        "order_by": ["o_orderdate", "o_orderkey"],
    }
    return dedup.deduplicate(df, params, audit=False)[0].select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )


@query(
    "dedup_none",
    """
    SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
    QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) = 1
    """,
)
def dedup_none(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    params = {"subset": ["o_custkey", "o_orderpriority"], "keep": "none"}
    return dedup.deduplicate(df, params, audit=False)[0]


_CASED = [
    "c_custkey",
    "c_nationkey",
    "CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment",
]


@query(
    "dedup_ci",
    f"""
    WITH t AS (SELECT {', '.join(_CASED)} FROM customer)
    SELECT * FROM t
    QUALIFY row_number() OVER (PARTITION BY c_nationkey, lower(segment) ORDER BY c_custkey) = 1
    """,
)
def dedup_ci(spark, d):
    df = table(spark, d, "customer").selectExpr(*_CASED)
    params = {"subset": ["c_nationkey", "segment"], "case_insensitive": True, "order_by": ["c_custkey"]}
    return dedup.deduplicate(df, params, audit=False)[0]


@query(
    "dedup_full_row",
    "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders",
)
def dedup_full_row(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return dedup.deduplicate(df, {}, audit=False)[0]


@query(
    "dup_keys",
    "SELECT md5(text) AS digest, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1",
)
def dup_keys(spark, d):
    out = dedup.duplicate_keys(table(spark, d, "documents"), ["text"])
    return out.select(F.md5("text").alias("digest"), "n_rows")


@query(
    "dup_row_count",
    """
    SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders))
           AS BIGINT) AS duplicate_rows FROM orders
    """,
)
def dup_row_count(spark, d):
    return dedup.duplicate_row_count(table(spark, d, "orders").select("o_custkey", "o_orderpriority"))


@query(
    "latest_wins",
    """
    SELECT conv_id, role, turn, md5(text) AS digest FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) = 1
    """,
)
def latest_wins(spark, d):
    out = dedup.latest_wins(table(spark, d, "conversations"), ["conv_id", "role"], "turn")
    return out.select("conv_id", "role", "turn", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- categories
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


@query(
    "one_hot_flag",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(l_returnflag = 'A' AS BIGINT) AS "l_returnflag__A",
           CAST(l_returnflag = 'N' AS BIGINT) AS "l_returnflag__N",
           CAST(l_returnflag = 'R' AS BIGINT) AS "l_returnflag__R",
           CAST(l_linestatus = 'F' AS BIGINT) AS "l_linestatus__F",
           CAST(l_linestatus = 'O' AS BIGINT) AS "l_linestatus__O"
    FROM ({DIRTY_LINES_SQL})
    """,
)
def one_hot_flag(spark, d):
    df = dirty_lines(spark, d).select(*_LINE_KEY, "l_returnflag", "l_linestatus")
    params = {"columns": ["l_returnflag", "l_linestatus"], "method": "one_hot"}
    return encode.encode_categorical(df, params)[0]


@query(
    "one_hot_topk_other",
    """
    WITH top AS (SELECT p_type AS v FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
    t AS (SELECT p_partkey, CASE WHEN p_type IN (SELECT v FROM top) THEN p_type ELSE 'OTHER' END AS v FROM part)
    SELECT p_partkey, v AS hot FROM t
    """,
)
def one_hot_topk_other(spark, d):
    """Long form of the top-k encoding: the single flag that is set on each row."""
    df = table(spark, d, "part").select("p_partkey", "p_type")
    out, diff, _ = encode.encode_categorical(
        df, {"columns": ["p_type"], "method": "one_hot", "max_categories": 3}
    )
    flags = [F.when(F.col(f"`{c}`") == 1, c.split("__", 1)[1]) for c in diff["created_columns"]]
    return out.select("p_partkey", F.coalesce(*flags).alias("hot"))


@query(
    "ordinal_alpha",
    """
    WITH v AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code
               FROM (SELECT DISTINCT p_name FROM part))
    SELECT p_partkey, code AS "p_name__ord" FROM part JOIN v USING (p_name)
    """,
)
def ordinal_alpha(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name")
    return encode.encode_categorical(df, {"columns": ["p_name"], "method": "ordinal"})[0]


@query(
    "ordinal_freq",
    """
    WITH v AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS code
               FROM part GROUP BY p_brand)
    SELECT p_partkey, code AS "p_brand__ord" FROM part JOIN v USING (p_brand)
    """,
)
def ordinal_freq(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand")
    params = {"columns": ["p_brand"], "method": "ordinal", "ordinal_order": "frequency"}
    return encode.encode_categorical(df, params)[0]


@query(
    "ordinal_large_vocabulary",
    """
    WITH v AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code
               FROM (SELECT DISTINCT c_name FROM customer))
    SELECT c_custkey, code AS "c_name__ord" FROM customer JOIN v USING (c_name)
    """,
)
def ordinal_large_vocabulary(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    return encode.encode_categorical(df, {"columns": ["c_name"], "method": "ordinal"})[0]


@query(
    "encode_per_column",
    f"""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_returnflag, 'None') AS r, l_linestatus,
                      l_suppkey % 4 AS grade FROM ({DIRTY_LINES_SQL})),
    v AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS code FROM (SELECT DISTINCT r FROM t))
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(code AS DOUBLE) AS "l_returnflag__ord",
           CAST(grade AS DOUBLE) AS "grade__ord",
           CAST(l_linestatus = 'F' AS DOUBLE) AS "l_linestatus__F",
           CAST(l_linestatus = 'O' AS DOUBLE) AS "l_linestatus__O"
    FROM t JOIN v USING (r)
    """,
)
def encode_per_column(spark, d):
    df = dirty_lines(spark, d).select(
        *_LINE_KEY, "l_returnflag", "l_linestatus", (F.col("l_suppkey") % 4).alias("grade")
    )
    encodings = {"L ReturnFlag": "ordinal", "l_returnflag": "ordinal", "Grade": "ordinal"}
    methods = encode.encoding_methods(df, encodings, "one_hot")
    return encode.apply_encoding(df, encode.fit_encoding(df, methods))


@query(
    "group_rare",
    """
    WITH n AS (SELECT greatest(5, round_even(0.02 * count(*), 0)) AS least FROM documents),
    k AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= (SELECT least FROM n))
    SELECT doc_id, CASE WHEN source IN (SELECT source FROM k) THEN source ELSE 'Other' END AS source
    FROM documents
    """,
)
def group_rare(spark, d):
    df = table(spark, d, "documents").select("doc_id", "source")
    return encode.apply_rare(df, encode.fit_rare(df, ["source"], min_pct=0.02))


@query(
    "group_rare_top_n",
    """
    WITH n AS (SELECT greatest(5, round_even(0.01 * count(*), 0)) AS least FROM part),
    k AS (SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= (SELECT least FROM n)
          ORDER BY count(*) DESC, p_name LIMIT 10)
    SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM k) THEN p_name ELSE 'rest' END AS p_name FROM part
    """,
)
def group_rare_top_n(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name")
    return encode.apply_rare(df, encode.fit_rare(df, ["p_name"], max_categories=10, label="rest"))


# ---------------------------------------------------------------- numbers
_IQR = "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3"


@query(
    "iqr_drop",
    f"""
    WITH b AS (SELECT {_IQR.format(c='value')} FROM events)
    SELECT event_id, value FROM events, b
    WHERE NOT (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
    """,
)
def iqr_drop(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return numeric.remove_outliers(df, {"columns": ["value"], "method": "iqr"}, audit=False)[0]


@query(
    "iqr_clip",
    f"""
    WITH b AS (SELECT {_IQR.format(c='value')} FROM events)
    SELECT event_id, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS value
    FROM events, b
    """,
)
def iqr_clip(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    params = {"columns": ["value"], "method": "iqr", "mode": "clip"}
    return rounded(numeric.remove_outliers(df, params, audit=False)[0], value=6)


@query(
    "zscore_drop",
    """
    WITH b AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
    SELECT event_id, value FROM events, b WHERE abs((value - m) / s) <= 2.5
    """,
)
def zscore_drop(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    params = {"columns": ["value"], "method": "zscore", "z_thresh": 2.5}
    return numeric.remove_outliers(df, params, audit=False)[0]


@query(
    "zscore_all",
    """
    WITH b AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
                      avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem, b
    WHERE NOT (abs((l_quantity - mq) / sq) > 1.2 AND abs((l_extendedprice - me) / se) > 1.2)
    """,
)
def zscore_all(spark, d):
    df = table(spark, d, "lineitem").select(*_LINE_KEY, "l_quantity", "l_extendedprice")
    params = {
        "columns": ["l_quantity", "l_extendedprice"],
        "method": "zscore",
        "z_thresh": 1.2,
        "combine": "all",
    }
    return numeric.remove_outliers(df, params, audit=False)[0]


@query(
    "log1p_skewed",
    """
    SELECT event_id, CAST(user_id AS BIGINT) AS user_id,
           round(CASE WHEN (SELECT skewness(value) FROM events) > 1 THEN ln(1 + value) ELSE value END, 8) AS value
    FROM events
    """,
)
def log1p_skewed(spark, d):
    df = table(spark, d, "events").select("event_id", "user_id", "value")
    state = numeric.fit_deskew(df, target="event_id")
    return rounded(numeric.apply_deskew(df, state), value=8)


@query("yeo_johnson_events")
def yeo_johnson_events(spark, d):
    df = table(spark, d, "events").selectExpr("event_id", "value - 5 AS value")
    state = numeric.fit_deskew(df, method="yeo-johnson", target="event_id")
    return numeric.apply_deskew(df, state)


@query(
    "bin_quantile",
    f"""
    WITH t AS ({DIRTY_LINES_SQL}), m AS (SELECT quantile_cont(l_extendedprice, 0.5) AS med FROM t),
    f AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_extendedprice, med) AS v FROM t, m),
    e AS (SELECT quantile_cont(v, 0.2) AS a, quantile_cont(v, 0.4) AS b, quantile_cont(v, 0.6) AS c,
                 quantile_cont(v, 0.8) AS d FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(CAST(v >= a AS INT) + CAST(v >= b AS INT) + CAST(v >= c AS INT) + CAST(v >= d AS INT) AS DOUBLE)
               AS "l_extendedprice__bin"
    FROM f, e
    """,
)
def bin_quantile(spark, d):
    df = dirty_lines(spark, d).select(*_LINE_KEY, "l_extendedprice")
    return numeric.apply_bins(df, numeric.fit_bins(df, ["l_extendedprice"]))


@query(
    "bin_uniform_onehot",
    """
    WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 4 AS w FROM events)
    SELECT event_id,
           CAST(value < lo + w AS DOUBLE) AS "value__bin_0",
           CAST(value >= lo + w AND value < lo + 2 * w AS DOUBLE) AS "value__bin_1",
           CAST(value >= lo + 2 * w AND value < lo + 3 * w AS DOUBLE) AS "value__bin_2",
           CAST(value >= lo + 3 * w AS DOUBLE) AS "value__bin_3"
    FROM events, b
    """,
)
def bin_uniform_onehot(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return numeric.apply_bins(df, numeric.fit_bins(df, ["value"], 4, "uniform", "onehot"))


@query("bin_kmeans")
def bin_kmeans(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return numeric.apply_bins(df, numeric.fit_bins(df, ["value"], 4, "kmeans"))


@query(
    "scale_standard",
    f"""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_quantity, 0) AS q,
                      coalesce(l_extendedprice, 0) AS e FROM ({DIRTY_LINES_SQL})),
    s AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(e) AS me, stddev_pop(e) AS se FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, round((q - mq) / sq, 6) AS l_quantity,
           round((e - me) / se, 6) AS l_extendedprice
    FROM t, s
    """,
)
def scale_standard(spark, d):
    df = dirty_lines(spark, d).select(*_LINE_KEY, "l_quantity", "l_extendedprice")
    state = numeric.fit_scale(df, ["l_quantity", "l_extendedprice"])
    return rounded(numeric.apply_scale(df, state), l_quantity=6, l_extendedprice=6)


@query(
    "scale_minmax",
    """
    WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT event_id, round((value - lo) / (hi - lo), 8) AS value FROM events, s
    """,
)
def scale_minmax(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(numeric.apply_scale(df, numeric.fit_scale(df, ["value"], kind="minmax")), value=8)


_FEATURES = [
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_quantity * 2 + l_tax AS quantity_twin",
    "l_extendedprice * (1 - l_discount) AS net",
    "l_tax",
    "1.5 AS fixed",
]


@query(
    "feature_select",
    f"""
    WITH t AS (SELECT {', '.join(_FEATURES)} FROM lineitem),
    v AS (SELECT 'l_extendedprice' AS c, var_samp(l_extendedprice) AS x FROM t
          UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM t
          UNION ALL SELECT 'quantity_twin', var_samp(quantity_twin) FROM t
          UNION ALL SELECT 'net', var_samp(net) FROM t
          UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM t
          UNION ALL SELECT 'fixed', var_samp(fixed) FROM t),
    r AS (SELECT 'quantity_twin' AS c, abs(corr(l_extendedprice, quantity_twin)) AS x FROM t
          UNION ALL SELECT 'net', abs(corr(l_extendedprice, net)) FROM t
          UNION ALL SELECT 'net', abs(corr(quantity_twin, net)) FROM t)
    SELECT 'l_quantity' AS "column", 'explicit' AS reason
    UNION ALL SELECT c, 'variance' FROM v WHERE x < 0.01
    UNION ALL SELECT DISTINCT c, 'correlation' FROM r WHERE x > 0.95
    """,
)
def feature_select(spark, d):
    df = table(spark, d, "lineitem").selectExpr(*_FEATURES)
    drops = numeric.select_features(df, ["l_quantity"])
    return spark.createDataFrame([(x["column"], x["reason"]) for x in drops], "column string, reason string")


@query(
    "corr_filter",
    f"""
    WITH t AS (SELECT {', '.join(_FEATURES)} FROM lineitem)
    SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM t
    UNION ALL SELECT 'l_quantity', 'quantity_twin', round(corr(l_quantity, quantity_twin), 6) FROM t
    UNION ALL SELECT 'l_extendedprice', 'quantity_twin', round(corr(l_extendedprice, quantity_twin), 6) FROM t
    """,
)
def corr_filter(spark, d):
    df = table(spark, d, "lineitem").selectExpr(*_FEATURES)
    pairs = numeric.correlation_pairs(df, ["l_quantity", "l_extendedprice", "quantity_twin"])
    rows = [(a, b, r) for (a, b), r in pairs.items()]
    return rounded(spark.createDataFrame(rows, "a string, b string, r double"), r=6)


# ---------------------------------------------------------------- whole plans
@query(
    "clean_fixed_preset",
    f"""
    WITH t AS ({DIRTY_ORDERS_SQL}),
    m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM t),
    s AS (SELECT o_orderstatus AS v FROM t WHERE o_orderstatus IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    p AS (SELECT o_orderpriority AS v FROM t WHERE o_orderpriority IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    c AS (SELECT DISTINCT o_custkey, coalesce(o_orderstatus, s.v) AS o_orderstatus,
                 coalesce(o_totalprice, med) AS o_totalprice, coalesce(o_orderpriority, p.v) AS o_orderpriority
          FROM t, m, s, p)
    SELECT o_custkey AS cust_key, trim(regexp_replace(o_orderstatus, '\\s+', ' ', 'g')) AS order_status,
           round(o_totalprice, 4) AS total_price,
           trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g')) AS order_priority
    FROM c
    """,
)
def clean_fixed_preset(spark, d):
    df = dirty_orders(spark, d).selectExpr(
        "o_custkey AS `Cust Key`",
        "o_orderstatus AS `Order Status`",
        "o_totalprice AS `Total-Price`",
        "o_orderpriority AS `Order-Priority`",
    )
    return rounded(run_fixed(df, "orders", audit=False)[0], total_price=4)


_HOLDOUT_PLAN = {
    "actions": [
        {"action": "handle_missing", "params": {"strategy": "median", "cat_missing_strategy": "fill_mode"}},
        {"action": "normalize_text", "params": {"ops": ["strip", "lower"]}},
        {"action": "clip_outliers", "target_columns": ["o_totalprice"], "params": {"iqr_k": 0.5}},
        {
            "action": "encode_categorical_per_column",
            "params": {"column_encodings": {"o_orderstatus": "ordinal"}, "default_method": "one_hot"},
        },
        {"action": "scale_features", "params": {"columns": ["o_totalprice"]}},
    ]
}


@query(
    "clean_holdout",
    f"""
    WITH t AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
                      o_orderdate < TIMESTAMP '1998-01-01' AS is_train FROM ({DIRTY_ORDERS_SQL})),
    s AS (SELECT o_orderstatus AS v FROM t WHERE is_train AND o_orderstatus IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    p AS (SELECT o_orderpriority AS v FROM t WHERE is_train AND o_orderpriority IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM t WHERE is_train),
    f AS (SELECT o_orderkey, is_train, lower(trim(coalesce(o_orderstatus, s.v))) AS st,
                 coalesce(o_totalprice, med) AS tp, lower(trim(coalesce(o_orderpriority, p.v))) AS pr FROM t, s, p, m),
    q AS (SELECT quantile_cont(tp, 0.25) AS q1, quantile_cont(tp, 0.75) AS q3 FROM f WHERE is_train),
    c AS (SELECT o_orderkey, is_train, st, pr,
                 least(greatest(tp, q1 - 0.5 * (q3 - q1)), q3 + 0.5 * (q3 - q1)) AS tp FROM f, q),
    z AS (SELECT avg(tp) AS a, stddev_pop(tp) AS b FROM c WHERE is_train),
    o AS (SELECT st, row_number() OVER (ORDER BY st) - 1 AS code FROM (SELECT DISTINCT st FROM c WHERE is_train))
    SELECT o_orderkey, round((tp - a) / b, 6) AS o_totalprice, CAST(coalesce(code, -1) AS DOUBLE) AS status_code,
           pr AS hot_priority
    FROM c CROSS JOIN z LEFT JOIN o USING (st) WHERE NOT is_train
    """,
)
def clean_holdout(spark, d):
    """Fitted on the earlier orders, applied to the later ones."""
    df = dirty_orders(spark, d).select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"
    )
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    train, test = df.where(old).drop("o_orderdate"), df.where(~old).drop("o_orderdate")
    model = PlanCleaner(_HOLDOUT_PLAN, carry=["o_orderkey"]).fit(train)
    out = model.transform(test)
    flags = [c for c in out.columns if c.startswith("o_orderpriority__")]
    hot = F.coalesce(*[F.when(F.col(f"`{c}`") == 1.0, c.split("__", 1)[1]) for c in flags])
    return out.select(
        "o_orderkey",
        F.round("o_totalprice", 6).alias("o_totalprice"),
        F.col("o_orderstatus__ord").alias("status_code"),
        hot.alias("hot_priority"),
    )
