"""Queries for sampling, metrics, scorecards and neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidyloom.catalog.common import query, rounded, table
from tidyloom.operators import metrics, neighbors, sampling, scorecard
from tidyloom.plans import PlanCleaner

_M = 2147483647


def _hash(key: str, seed: int = 369) -> str:
    return f"((({key} % {_M}) + {seed + 1}) * 48271 % {_M}) * 69621 % {_M}"


# ---------------------------------------------------------------- sampling
@query(
    "stratified_cap",
    f"""
    WITH n AS (SELECT count(*) AS n FROM orders),
    r AS (SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS k,
                 row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_hash('o_orderkey')}, o_orderkey) AS rn
          FROM orders)
    SELECT o_orderkey, o_orderpriority FROM r, n
    WHERE n <= 1000 OR rn <= greatest(1, round_even(k * 1000 / n, 0))
    """,
)
def stratified_cap(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_cap(df, "o_orderpriority", "o_orderkey", 1000)


@query(
    "plain_cap",
    f"""
    SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY {_hash('event_id')}, event_id) <= 500
    """,
)
def plain_cap(spark, d):
    return sampling.plain_cap(table(spark, d, "events").select("event_id"), "event_id", 500)


@query(
    "stratified_folds",
    f"""
    SELECT o_orderkey, o_orderstatus,
           CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_hash('o_orderkey')}, o_orderkey) - 1) % 5
                AS INTEGER) AS fold
    FROM orders
    """,
)
def stratified_folds(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.assign_folds(df, "o_orderkey", "o_orderstatus")


@query(
    "plain_folds",
    f"""
    SELECT event_id, CAST((row_number() OVER (ORDER BY {_hash('event_id')}, event_id) - 1) % 5 AS INTEGER) AS fold
    FROM events
    """,
)
def plain_folds(spark, d):
    return sampling.assign_folds(table(spark, d, "events").select("event_id"), "event_id")


_RATES = (0.05, 0.1, 0.2)


def _inject_sql() -> str:
    parts = []
    for c in ("o_custkey", "o_totalprice"):
        for rate in _RATES:
            parts.append(
                f"""SELECT '{c}' AS "column", CAST({rate} AS DOUBLE) AS missing_rate,
                    count(*) FILTER (WHERE hit) AS n_injected,
                    round(avg(abs({c} - m)) FILTER (WHERE hit), 4) AS mae_mean
                    FROM (SELECT {c}, hit, avg(CASE WHEN NOT hit THEN {c} END) OVER () AS m FROM
                          (SELECT {c}, row_number() OVER (ORDER BY {_hash('o_orderkey')}, o_orderkey)
                                  <= floor((SELECT count(*) FROM orders) * CAST({rate} AS DOUBLE)) AS hit FROM orders))"""
            )
    return " UNION ALL ".join(parts)


@query("imputation_mae", _inject_sql())
def imputation_mae(spark, d):
    """Mean imputation error over injected gaps, per column and rate."""
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cols = sampling.complete_numeric(df, ["o_custkey", "o_totalprice"])
    out = sampling.imputation_errors(df, cols, "o_orderkey", list(_RATES))
    return rounded(out.withColumnRenamed("mae", "mae_mean"), mae_mean=4)


@query("imputation_mae_chained")
def imputation_mae_chained(spark, d):
    """The same with chained imputation from the other numeric columns."""
    df = table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS k", "l_quantity", "l_extendedprice", "l_discount"
    )
    cols = sampling.complete_numeric(df, ["l_quantity", "l_extendedprice", "l_discount"])
    return sampling.imputation_errors(df, cols, "k", list(_RATES), "chained").drop("n_injected")


@query(
    "imputation_mae_plan",
    f"""
    WITH h AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY {_hash('o_orderkey')}, o_orderkey)
                      <= floor((SELECT count(*) FROM orders) * CAST(0.1 AS DOUBLE)) AS hit FROM orders),
    m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM h WHERE NOT hit)
    SELECT round(avg(abs(med - o_totalprice)), 4) AS mae, count(*) AS n_cells FROM h, m WHERE hit
    """,
)
def imputation_mae_plan(spark, d):
    """The error of a plan: gaps injected, the table cleaned by it, truth and result met by key."""
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    gaps = sampling.inject_missing(df, "o_totalprice", "o_orderkey", 0.1)
    holes = gaps.drop("__injected", "__truth")
    plan = {
        "actions": [
            {"action": "handle_missing", "params": {"strategy": "median"}},
            {"action": "encode_categorical_per_column", "params": {"default_method": "ordinal"}},
        ]
    }
    cleaned = PlanCleaner(plan, carry=["o_orderkey"]).fit(holes).transform(holes)
    error = sampling.imputation_error_by_key(df, cleaned, "o_orderkey", "o_totalprice", gaps.where("__injected"))
    return rounded(error, mae=4)


@query(
    "report_order",
    """
    WITH t AS (SELECT o_orderstatus AS dataset, o_orderpriority AS model,
               ['C1_manual', 'C0_raw', 'C4_expanded', 'C3_context'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS condition,
               count(*) AS n FROM orders GROUP BY 1, 2, 3)
    SELECT dataset, model, condition, n, row_number() OVER (ORDER BY dataset, model,
           CASE condition WHEN 'C0_raw' THEN 0 WHEN 'C1_manual' THEN 1 ELSE 9 END, condition) AS position FROM t
    """,
)
def report_order(spark, d):
    """Results in the order of a report; the position is read off the ordered rows."""
    names = F.array(*[F.lit(c) for c in ("C1_manual", "C0_raw", "C4_expanded", "C3_context")])
    runs = table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"),
        F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("condition"),
    ).agg(F.count("*").alias("n"))
    placed = scorecard.report_order(runs).withColumn("at", F.monotonically_increasing_id())
    position = F.row_number().over(Window.orderBy("at")).cast("bigint")
    return placed.withColumn("position", position).drop("at")


@query(
    "inject_missing",
    f"""
    SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {_hash('event_id')}, event_id)
                          <= floor((SELECT count(*) FROM events) * CAST(0.2 AS DOUBLE)) THEN NULL ELSE value END AS value
    FROM events
    """,
)
def inject_missing(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return sampling.inject_missing(df, "value", "event_id", 0.2).drop("__injected", "__truth")


# ---------------------------------------------------------------- metrics
_GUESS = (
    "CASE WHEN l_quantity > 30 THEN 'R' WHEN l_discount > 0.05 THEN 'A' "
    "WHEN l_tax > 0.03 THEN l_returnflag ELSE 'N' END"
)


@query(
    "clf_metrics",
    f"""
    WITH p AS (SELECT l_linenumber AS fold, l_returnflag AS y, {_GUESS} AS g FROM lineitem),
    k AS (SELECT fold, c,
                 count(*) FILTER (WHERE y = c AND g = c) AS tp, count(*) FILTER (WHERE y = c) AS sup,
                 count(*) FILTER (WHERE g = c) AS pred
          FROM p, (VALUES ('A'), ('N'), ('R')) v(c) GROUP BY 1, 2),
    f AS (SELECT *, 2.0 * tp / (sup + pred) AS f1 FROM k)
    SELECT fold, round(sum(tp) / sum(sup), 8) AS accuracy, round(sum(f1 * sup) / sum(sup), 8) AS f1_weighted,
           round(avg(f1), 8) AS f1_macro, CAST(sum(sup) AS BIGINT) AS n_rows
    FROM f GROUP BY fold
    """,
)
def clf_metrics(spark, d):
    df = table(spark, d, "lineitem").selectExpr(
        "l_linenumber AS fold", "l_returnflag AS label", f"{_GUESS} AS prediction"
    )
    out = metrics.classification_metrics(df, ["fold"])
    return rounded(out, accuracy=8, f1_weighted=8, f1_macro=8)


_SCORES = {
    "A": "l_discount * 8 + l_tax",
    "N": "l_quantity / 50",
    "R": "CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END + l_partkey % 97",
}


@query(
    "auc_ovr",
    "WITH s AS ("
    + " UNION ALL ".join(
        f"SELECT l_linenumber AS fold, '{c}' AS cls, CAST(l_returnflag = '{c}' AS INT) AS y, CAST({e} AS DOUBLE) AS score FROM lineitem"
        for c, e in _SCORES.items()
    )
    + """),
    r AS (SELECT fold, cls, y, rank() OVER w + (count(*) OVER (PARTITION BY fold, cls, score) - 1) / 2.0 AS rk
          FROM s WINDOW w AS (PARTITION BY fold, cls ORDER BY score)),
    a AS (SELECT fold, cls, sum(y) AS p, count(*) - sum(y) AS n, sum(rk) FILTER (WHERE y = 1) AS rs FROM r GROUP BY 1, 2)
    SELECT fold, round(sum(p * (rs - p * (p + 1) / 2.0) / (p * n)) / sum(p), 8) AS roc_auc FROM a GROUP BY fold
    """,
)
def auc_ovr(spark, d):
    df = table(spark, d, "lineitem")
    per = F.array(
        *[
            F.struct(
                F.lit(c).alias("cls"),
                (F.col("l_returnflag") == c).cast("int").alias("positive"),
                F.expr(e).cast("double").alias("score"),
            )
            for c, e in _SCORES.items()
        ]
    )
    long = df.select(F.col("l_linenumber").alias("fold"), F.explode(per).alias("s")).select("fold", "s.*")
    return rounded(metrics.one_vs_rest_auc(long, ["fold"]), roc_auc=8)


@query(
    "reg_metrics",
    """
    WITH p AS (SELECT event_type, value AS y, 10 + user_id % 7 AS g FROM events)
    SELECT event_type, round(avg(abs(y - g)), 8) AS mae, round(sqrt(avg((y - g) * (y - g))), 8) AS rmse,
           round(1 - avg((y - g) * (y - g)) / var_pop(y), 8) AS r2, count(*) AS n_rows
    FROM p GROUP BY 1
    """,
)
def reg_metrics(spark, d):
    df = table(spark, d, "events").selectExpr(
        "event_type", "value AS label", "CAST(10 + user_id % 7 AS DOUBLE) AS prediction"
    )
    return rounded(metrics.regression_metrics(df, ["event_type"]), mae=8, rmse=8, r2=8)


# ---------------------------------------------------------------- scorecards
_RUNS = """
    SELECT o_orderpriority AS dataset, l_returnflag AS model,
           CASE l_linenumber WHEN 1 THEN 'C0_raw' WHEN 2 THEN 'C1_manual' WHEN 3 THEN 'C2_x' WHEN 4 THEN 'C4_a'
                WHEN 5 THEN 'C4_b' ELSE 'C4_c' END AS condition,
           avg(l_discount) AS f1_macro, stddev_pop(l_discount) / 100 AS f1_macro_std
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3
"""
_DATASETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _runs(spark, d):
    joined = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    names = {1: "C0_raw", 2: "C1_manual", 3: "C2_x", 4: "C4_a", 5: "C4_b"}
    condition = F.lit("C4_c")
    for k, v in names.items():
        condition = F.when(F.col("l_linenumber") == k, v).otherwise(condition)
    return joined.groupBy(
        F.col("o_orderpriority").alias("dataset"),
        F.col("l_returnflag").alias("model"),
        condition.alias("condition"),
    ).agg(
        F.avg("l_discount").alias("f1_macro"),
        (F.stddev_pop("l_discount") / 100).alias("f1_macro_std"),
    )


_CARD = f"""
    WITH r AS ({_RUNS}),
    c AS (SELECT c.dataset, c.model, c.condition, b.f1_macro AS base, c.f1_macro AS value,
                 c.f1_macro - b.f1_macro AS delta, c.f1_macro_std + b.f1_macro_std AS s2, b.f1_macro_std AS s1
          FROM r c JOIN r b ON b.condition = 'C0_raw' AND b.dataset = c.dataset AND b.model = c.model
          WHERE c.condition LIKE 'C4%'),
    k AS (SELECT *, CASE WHEN delta > s2 THEN 'WIN' WHEN delta < -s2 THEN 'LOSS' ELSE 'TIE' END AS verdict FROM c)
"""
_SHOWN = "dataset, model, condition, round(base, 8) AS base, round(value, 8) AS value, round(delta, 8) AS delta"


def _card(spark, d, **options):
    cand = F.col("condition").startswith("C4")
    return scorecard.scorecard(_runs(spark, d), "f1_macro", "f1_macro_std", candidates=cand, **options)


def _neat(df):
    return rounded(df, base=8, value=8, delta=8, threshold=8)


@query("scorecard_sum_sd", f"{_CARD} SELECT {_SHOWN}, round(s2, 8) AS threshold, verdict FROM k")
def scorecard_sum_sd(spark, d):
    return _neat(_card(spark, d))


@query(
    "scorecard_base_sd",
    f"""{_CARD} SELECT dataset, model, condition, round(base, 8) AS base, round(value, 8) AS value,
        round(-delta, 8) AS delta, round(s1, 8) AS threshold,
        CASE WHEN -delta > s1 THEN 'WIN' WHEN -delta < -s1 THEN 'LOSS' ELSE 'TIE' END AS verdict FROM k""",
)
def scorecard_base_sd(spark, d):
    """Lower is better, and only the baseline's sd counts."""
    return _neat(_card(spark, d, direction=-1, threshold="baseline"))


@query(
    "scorecard_systems",
    f"""
    WITH r AS ({_RUNS}),
    s AS (SELECT 'other' AS system, o_orderpriority AS dataset, avg(l_tax) AS v, 0.001 AS sd
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2),
    p AS (SELECT dataset, avg(f1_macro) FILTER (WHERE condition = 'C0_raw') AS b,
                 avg(f1_macro_std) FILTER (WHERE condition = 'C0_raw') AS bs,
                 max(f1_macro) FILTER (WHERE condition LIKE 'C4%') AS x,
                 avg(f1_macro_std) FILTER (WHERE condition LIKE 'C4%') AS xs
          FROM r GROUP BY 1)
    SELECT system, dataset, round(v, 8) AS value, CAST(sd AS DOUBLE) AS sd, round(b, 8) AS base_val, round(x, 8) AS best_val,
           round(v - b, 8) AS delta_vs_base,
           CASE WHEN v - b > bs + sd THEN 'WIN' WHEN v - b < -(bs + sd) THEN 'LOSS' ELSE 'TIE' END AS verdict_vs_base,
           round(v - x, 8) AS delta_vs_best,
           CASE WHEN v - x > xs + sd THEN 'WIN' WHEN v - x < -(xs + sd) THEN 'LOSS' ELSE 'TIE' END AS verdict_vs_best
    FROM s LEFT JOIN p USING (dataset)
    """,
)
def scorecard_systems(spark, d):
    joined = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    systems = joined.groupBy(F.col("o_orderpriority").alias("dataset")).agg(
        F.lit("other").alias("system"),
        F.avg("l_tax").alias("f1_macro"),
        F.lit(0.001).cast("double").alias("f1_macro_std"),
    )
    out = scorecard.system_scorecard(systems, _runs(spark, d), "f1_macro", "f1_macro_std")
    return rounded(out, value=8, base_val=8, best_val=8, delta_vs_base=8, delta_vs_best=8)


@query(
    "scorecard_ablation",
    f"""
    WITH r AS ({_RUNS}),
    b AS (SELECT dataset, model, f1_macro AS base, f1_macro_std AS sd FROM r WHERE condition = 'C0_raw'),
    c AS (SELECT dataset, model, avg(f1_macro) AS cand FROM r WHERE condition LIKE 'C4%' GROUP BY 1, 2),
    g AS (SELECT dataset, model, f1_macro AS v FROM r WHERE condition = 'C2_x')
    SELECT dataset, model, round(base, 8) AS base, round(v, 8) AS value, round(cand, 8) AS candidate,
           CASE WHEN v - base > sd THEN 'WIN' WHEN v - base < -sd THEN 'LOSS' ELSE 'TIE' END AS vs_base,
           CASE WHEN v - cand > sd THEN 'ABOVE' WHEN v - cand < -sd THEN 'BELOW' ELSE 'EQUAL' END AS vs_candidate
    FROM g JOIN b USING (dataset, model) JOIN c USING (dataset, model)
    """,
)
def scorecard_ablation(spark, d):
    runs = _runs(spark, d).withColumnsRenamed({"f1_macro": "mean", "f1_macro_std": "std"})
    guarded = runs.where(F.col("condition") == "C2_x")
    out = scorecard.ablation_scorecard(guarded, runs, baseline="C0_raw")
    return rounded(out, base=8, value=8, candidate=8)


@query(
    "best_per_group",
    f"""
    WITH r AS ({_RUNS})
    SELECT dataset, round(f1_macro, 8) AS f1_macro, model, condition, round(f1_macro_std, 8) AS f1_macro_std FROM r
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY f1_macro DESC, model, condition) = 1
    """,
)
def best_per_group(spark, d):
    carry = ["model", "condition", "f1_macro_std"]
    out = scorecard.best_per_group(_runs(spark, d), ["dataset"], "f1_macro", carry)
    return rounded(out, f1_macro=8, f1_macro_std=8)


@query(
    "best_model_trio",
    f"""
    WITH r AS ({_RUNS}),
    w AS (SELECT dataset, model FROM r WHERE condition LIKE 'C4%'
          QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY f1_macro DESC, model) = 1)
    SELECT dataset, model, round(max(f1_macro) FILTER (WHERE condition = 'C0_raw'), 8) AS raw,
           round(max(f1_macro) FILTER (WHERE condition = 'C1_manual'), 8) AS fixed,
           round(max(f1_macro) FILTER (WHERE condition LIKE 'C4%'), 8) AS planned
    FROM r JOIN w USING (dataset, model) GROUP BY 1, 2
    """,
)
def best_model_trio(spark, d):
    conditions = {"raw": "C0_raw", "fixed": "C1_manual", "planned": "C4_"}
    out = scorecard.best_model_trio(_runs(spark, d), "f1_macro", conditions, "planned")
    return rounded(out, raw=8, fixed=8, planned=8)


@query(
    "condition_pivot",
    f"WITH r AS ({_RUNS}) SELECT condition, "
    + ", ".join(f"round(avg(f1_macro) FILTER (WHERE dataset = '{x}'), 8) AS \"{x}\"" for x in _DATASETS)
    + " FROM r GROUP BY condition",
)
def condition_pivot(spark, d):
    out = scorecard.condition_pivot(_runs(spark, d), "f1_macro", _DATASETS)
    return out.select("condition", *[F.round(F.col(f"`{x}`"), 8).alias(x) for x in _DATASETS])


@query(
    "condition_means",
    f"WITH r AS ({_RUNS}) SELECT condition, round(avg(f1_macro), 8) AS f1_macro FROM r GROUP BY 1",
)
def condition_means(spark, d):
    return rounded(scorecard.condition_means(_runs(spark, d), "f1_macro"), f1_macro=8)


@query(
    "delta_vs_base",
    f"""
    WITH r AS ({_RUNS}), m AS (SELECT condition, dataset, avg(f1_macro) AS v FROM r GROUP BY 1, 2)
    SELECT a.condition, round(avg(a.v - b.v), 8) AS avg_delta, count(*) AS n_datasets
    FROM m a JOIN m b ON b.condition = 'C1_manual' AND a.dataset = b.dataset
    WHERE a.condition LIKE 'C4%' GROUP BY 1
    """,
)
def delta_vs_base(spark, d):
    out = scorecard.delta_vs_baseline(_runs(spark, d), "f1_macro", "C1_manual", "C4_")
    return rounded(out, avg_delta=8)


@query(
    "delta_summary",
    f"""{_CARD} SELECT condition, round(avg(delta), 8) AS mean_delta, round(stddev_pop(delta), 8) AS std_delta,
        count(*) FILTER (WHERE delta > 0) AS n_wins, count(*) AS n_cells FROM k GROUP BY 1""",
)
def delta_summary(spark, d):
    return rounded(scorecard.delta_summary(_card(spark, d), "condition"), mean_delta=8, std_delta=8)


@query(
    "wtl_counts",
    f"""{_CARD} SELECT condition, count(*) FILTER (WHERE verdict = 'WIN') AS "WIN",
        count(*) FILTER (WHERE verdict = 'TIE') AS "TIE", count(*) FILTER (WHERE verdict = 'LOSS') AS "LOSS"
        FROM k GROUP BY 1""",
)
def wtl_counts(spark, d):
    return scorecard.verdict_counts(_card(spark, d), "condition")


_CELLS = ["1-URGENT/A", "5-LOW/R"]


@query(
    "delta_matrix",
    f"{_CARD} SELECT condition, "
    + ", ".join(
        f"round(max(delta * 100) FILTER (WHERE dataset || '/' || model = '{c}'), 8) AS \"{c}_delta_pp\", "
        f"CAST(max(CASE verdict WHEN 'WIN' THEN 1 WHEN 'LOSS' THEN -1 ELSE 0 END) "
        f"FILTER (WHERE dataset || '/' || model = '{c}') AS INTEGER) AS \"{c}_sign\", "
        f"round(max(delta / s2) FILTER (WHERE dataset || '/' || model = '{c}'), 6) AS \"{c}_in_sd\""
        for c in _CELLS
    )
    + " FROM k GROUP BY 1",
)
def delta_matrix(spark, d):
    out = scorecard.delta_matrix(_card(spark, d), "condition", _CELLS)
    cols = [F.col("condition")]
    for c in _CELLS:
        cols += [
            F.round(F.col(f"`{c}_delta_pp`"), 8).alias(f"{c}_delta_pp"),
            F.col(f"`{c}_sign`").alias(f"{c}_sign"),
            F.round(F.col(f"`{c}_in_sd`"), 6).alias(f"{c}_in_sd"),
        ]
    return out.select(*cols)


@query(
    "mean_error_by_tag",
    """
    SELECT event_type AS tag, round(avg(abs(value - 10)), 8) AS mean_error, max(length(event_type)) AS size
    FROM events WHERE event_type <> 'view' GROUP BY 1
    """,
)
def mean_error_by_tag(spark, d):
    df = table(spark, d, "events")
    errors = df.select(F.col("event_type").alias("tag"), F.abs(F.col("value") - 10).alias("error"))
    known = F.when(F.col("event_type") != "view", F.length("event_type").cast("bigint"))
    sizes = df.groupBy(F.col("event_type").alias("tag")).agg(F.max(known).alias("size"))
    return rounded(scorecard.mean_error_by_tag(errors, "tag", "error", sizes), mean_error=8)


_FILES = """
    SELECT o_orderpriority AS dataset,
           CASE o_orderkey % 5 WHEN 0 THEN 'C0_raw' WHEN 1 THEN 'C1_manual' WHEN 2 THEN 'C2_llm'
                WHEN 3 THEN 'C4_expanded' ELSE 'C3_context' END AS condition,
           CASE o_custkey % 3 WHEN 0 THEN 'rf' WHEN 1 THEN 'knn' ELSE 'logreg' END AS model,
           CASE o_orderkey % 5 WHEN 3 THEN 'c4_small_rf' || CASE WHEN o_orderkey % 2 = 0 THEN '_' || o_orderpriority ELSE '' END
                WHEN 4 THEN 'c3_big_knn' ELSE 'run' || CAST(o_orderkey % 4 AS VARCHAR(3)) END AS tag,
           o_orderkey AS seq, o_totalprice / 7 AS f1_macro
    FROM {orders}
"""


@query(
    "consolidate_runs",
    f"""
    WITH f AS ({_FILES.format(orders='orders')}),
    b AS (SELECT dataset, condition, model, seq, f1_macro FROM f WHERE condition IN ('C0_raw', 'C1_manual')
          QUALIFY row_number() OVER (PARTITION BY dataset, condition, model ORDER BY seq) = 1),
    t AS (SELECT *, CASE WHEN condition = 'C4_expanded' THEN
                         CASE WHEN ends_with(tag, '_' || dataset) THEN substr(tag, 4, length(tag) - 4 - length(dataset))
                              ELSE substr(tag, 4) END
                    WHEN condition = 'C3_context' THEN substr(tag, 4) ELSE tag END AS clean FROM f),
    r AS (SELECT dataset, CASE condition WHEN 'C2_llm' THEN 'C2_' || tag WHEN 'C4_expanded' THEN 'C4_' || clean
                               ELSE 'C3_' || clean END AS condition, model, seq, f1_macro
          FROM t WHERE condition = 'C2_llm' OR (condition = 'C4_expanded' AND model = 'rf')
                    OR (condition = 'C3_context' AND model = 'knn')),
    u AS (SELECT * FROM b UNION ALL SELECT * FROM r)
    SELECT dataset, condition, model, seq, round(f1_macro, 4) AS f1_macro FROM u
    QUALIFY row_number() OVER (PARTITION BY dataset, condition, model ORDER BY seq DESC) = 1
    """,
)
def consolidate_runs(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("__run_files")
    runs = spark.sql(_FILES.format(orders="__run_files"))
    return scorecard.consolidate(runs).select("dataset", "condition", "model", "seq", "f1_macro")


@query(
    "union_results",
    """
    SELECT 'events' AS dataset, avg_value, CAST(NULL AS DOUBLE) AS price FROM
           (SELECT event_type, round(avg(value), 8) AS avg_value FROM events GROUP BY 1)
    UNION ALL SELECT 'orders', NULL, price FROM
           (SELECT o_orderstatus, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1)
    """,
)
def union_results(spark, d):
    a = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 8).alias("avg_value"))
    b = table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.round(F.avg("o_totalprice"), 4).alias("price")
    )
    return scorecard.union_results(
        a.select(F.lit("events").alias("dataset"), "avg_value"),
        b.select(F.lit("orders").alias("dataset"), "price"),
    )


@query(
    "first_available",
    """
    WITH a AS (SELECT l_orderkey AS o_orderkey, max(CASE WHEN l_quantity > 40 THEN l_tax END) AS v FROM lineitem GROUP BY 1),
    b AS (SELECT c_custkey AS o_custkey, CASE WHEN c_nationkey < 12 THEN c_acctbal END AS v FROM customer)
    SELECT o.o_orderkey, coalesce(a.v, b.v, -1.0) AS latency
    FROM orders o LEFT JOIN a USING (o_orderkey) LEFT JOIN b USING (o_custkey)
    """,
)
def first_available(spark, d):
    runs = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    a = (
        table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max(F.when(F.col("l_quantity") > 40, F.col("l_tax"))).alias("latency"))
    )
    b = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.when(F.col("c_nationkey") < 12, F.col("c_acctbal")).alias("latency"),
    )
    general = spark.range(1).select(F.lit(-1.0).alias("latency"))
    sources = [(a, ["o_orderkey"]), (b, ["o_custkey"]), (general, [])]
    return scorecard.first_available(runs, sources, "latency").select("o_orderkey", "latency")


# ---------------------------------------------------------------- neighbours
@query(
    "knn_vote",
    """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    n AS (SELECT a.vec_id AS qid, b.label FROM v a JOIN v b ON a.vec_id <> b.vec_id
          QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) <= 5),
    c AS (SELECT qid, label, count(*) AS n FROM n GROUP BY 1, 2)
    SELECT qid, label AS prediction, n AS votes FROM c
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) = 1
    """,
)
def knn_vote(spark, d):
    """Leave-one-out vote of the five nearest other vectors."""
    df = table(spark, d, "embeddings")
    found = neighbors.knn_join(
        df, df, 5, "vec_id", "vec_id", "embedding", "embedding", "label", skip_self=True
    )
    return neighbors.knn_vote(found)


@query(
    "knn_impute_supplier",
    """
    WITH t AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation,
               CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier),
    n AS (SELECT q.s_suppkey, g.s_acctbal AS v FROM t q JOIN t g ON q.s_acctbal IS NULL AND g.s_acctbal IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY q.s_suppkey ORDER BY abs(q.nation - g.nation), g.s_suppkey) <= 5),
    m AS (SELECT s_suppkey, avg(v) AS v FROM n GROUP BY 1)
    SELECT s_suppkey, nation, round(coalesce(s_acctbal, v), 6) AS s_acctbal FROM t LEFT JOIN m USING (s_suppkey)
    """,
)
def knn_impute_supplier(spark, d):
    """Gaps of supplier balances filled from the nearest suppliers."""
    df = table(spark, d, "supplier").selectExpr(
        "s_suppkey",
        "CAST(s_nationkey AS DOUBLE) AS nation",
        "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal",
    )
    return rounded(neighbors.knn_impute(df, "s_suppkey", ["nation", "s_acctbal"]), s_acctbal=6)
