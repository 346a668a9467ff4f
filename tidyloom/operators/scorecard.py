"""Scorecards over result tables: ``dataset, condition, model`` with metrics and their sd.

Result tables join on ``(dataset[, model])`` without hints: they are small in
practice, and Spark broadcasts a side only where its size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.scalar import col
from tidyloom.operators.dedup import keep_one, latest_wins


def verdict(delta: Column, threshold: Column, names=("WIN", "TIE", "LOSS")) -> Column:
    return F.when(delta > threshold, names[0]).when(delta < -threshold, names[2]).otherwise(names[1])


def scorecard(
    results: DataFrame,
    metric: str,
    std: str,
    direction: int = 1,
    baseline: str = "C0_raw",
    candidates: Column | None = None,
    threshold: str = "sum",
) -> DataFrame:
    """Candidates against the baseline of the same dataset and model.

    ``direction`` is -1 where lower is better. The threshold is the sum of both
    sds, or the baseline's alone (``threshold="baseline"``). Rows without a
    baseline or without the metric are left out.
    """
    keys = ["dataset", "model"]
    base = results.where(F.col("condition") == baseline).select(
        *keys, col(metric).alias("base"), col(std).alias("base_sd")
    )
    rows = results.where(F.col("condition") != baseline if candidates is None else candidates)
    rows = rows.select(*keys, "condition", col(metric).alias("value"), col(std).alias("sd"))
    delta = (F.col("value") - F.col("base")) * direction
    own = F.coalesce("sd", F.lit(0.0)) if threshold == "sum" else F.lit(0.0)
    limit = own + F.coalesce("base_sd", F.lit(0.0))
    return (
        rows.join(base, keys)
        .where(F.col("value").isNotNull() & F.col("base").isNotNull())
        .withColumns({"delta": delta, "threshold": limit})
        .withColumn("verdict", verdict(F.col("delta"), F.col("threshold")))
        .select(*keys, "condition", "base", "value", "delta", "threshold", "verdict")
    )


def system_scorecard(
    systems: DataFrame,
    results: DataFrame,
    metric: str,
    std: str,
    baseline: str = "C0_raw",
    prefix: str = "C4_",
) -> DataFrame:
    """Outside systems against the dataset's mean baseline and its best candidate."""
    is_base = F.col("condition") == baseline
    is_cand = F.col("condition").startswith(prefix)
    per = results.groupBy("dataset").agg(
        F.avg(F.when(is_base, col(metric))).alias("base_val"),
        F.avg(F.when(is_base, col(std))).alias("base_sd"),
        F.max(F.when(is_cand, col(metric))).alias("best_val"),
        F.avg(F.when(is_cand, col(std))).alias("best_sd"),
    )
    joined = systems.where(col(metric).isNotNull()).join(per, "dataset", "left")
    own_sd = F.coalesce(col(std), F.lit(0.0))

    def against(side: str) -> tuple[Column, Column]:
        delta = col(metric) - F.col(f"{side}_val")
        limit = F.coalesce(f"{side}_sd", F.lit(0.0)) + own_sd
        return delta, F.when(delta.isNull(), "N/A").otherwise(verdict(delta, limit))

    d0, v0 = against("base")
    d1, v1 = against("best")
    return joined.select(
        "system", "dataset", col(metric).alias("value"), own_sd.alias("sd"),
        "base_val", "best_val",
        d0.alias("delta_vs_base"), v0.alias("verdict_vs_base"),
        d1.alias("delta_vs_best"), v1.alias("verdict_vs_best"),
    )


def ablation_scorecard(
    guarded: DataFrame, results: DataFrame, baseline: str = "C0", prefix: str = "C4"
) -> DataFrame:
    """Rules-only runs against the baseline (W/T/L) and the mean candidate (below/equal/above)."""
    keys = ["dataset", "model"]
    base = results.where(F.col("condition") == baseline).select(
        *keys, F.col("mean").alias("base"), F.col("std").alias("base_sd")
    )
    cand = (
        results.where(F.col("condition").startswith(prefix))
        .groupBy(*keys)
        .agg(F.avg("mean").alias("candidate"))
    )
    own = guarded.select(*keys, F.col("mean").alias("value"))
    joined = own.join(base, keys).join(cand, keys, "left")
    d0 = F.col("value") - F.col("base")
    d1 = F.col("value") - F.col("candidate")
    return joined.select(
        *keys, "base", "value", "candidate",
        verdict(d0, F.col("base_sd")).alias("vs_base"),
        F.when(d1.isNull(), F.lit(None))
        .otherwise(verdict(d1, F.col("base_sd"), ("ABOVE", "EQUAL", "BELOW")))
        .alias("vs_candidate"),
    )


def first_available(runs: DataFrame, sources: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """Look a value up in several tables, each with its own keys; the first hit wins."""
    out = runs
    names = []
    for i, (table, keys) in enumerate(sources):
        name = f"__v{i}"
        names.append(name)
        hit = table.select(*keys, col(value).alias(name))
        if keys:
            out = out.join(hit, keys, "left")
        else:
            # A source without keys is one general value.
            got = hit.first()
            out = out.withColumn(name, F.lit(got[0] if got else None))
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


# ---------------------------------------------------------------- aggregates for reports
def condition_means(results: DataFrame, metric: str) -> DataFrame:
    return results.groupBy("condition").agg(F.avg(metric).alias(metric))


def condition_pivot(results: DataFrame, metric: str, datasets: list[str]) -> DataFrame:
    """Condition by dataset, mean over models."""
    return results.groupBy("condition").pivot("dataset", datasets).agg(F.avg(metric))


def delta_vs_baseline(results: DataFrame, metric: str, baseline: str, prefix: str) -> DataFrame:
    """Mean over datasets of (condition mean - baseline mean)."""
    per = results.groupBy("condition", "dataset").agg(F.avg(metric).alias("m"))
    base = per.where(F.col("condition") == baseline).select("dataset", F.col("m").alias("b"))
    return (
        per.where(F.col("condition").startswith(prefix))
        .join(base, "dataset")
        .groupBy("condition")
        .agg(F.avg(F.col("m") - F.col("b")).alias("avg_delta"), F.count("*").alias("n_datasets"))
    )


def best_per_group(
    results: DataFrame, by: list[str], metric: str, carry: list[str], lowest: bool = False
) -> DataFrame:
    """The best row of each group; ties go to the smallest carried values."""
    score = col(metric) if lowest else -col(metric)
    picked = results.where(col(metric).isNotNull()).groupBy(*by).agg(
        F.min(F.struct(score.alias("__s"), *carry)).alias("b")
    )
    value = F.col("b.__s") if lowest else -F.col("b.__s")
    return picked.select(*by, value.alias(metric), *[F.col(f"b.{c}").alias(c) for c in carry])


def best_model_trio(
    results: DataFrame, metric: str, conditions: dict[str, str], chosen_by: str
) -> DataFrame:
    """Per dataset the model with the best candidate, and every condition's value for it.

    ``conditions`` maps an output name to a condition prefix; ``chosen_by`` names
    the one that picks the model.
    """
    cand = results.where(F.col("condition").startswith(conditions[chosen_by]))
    winner = best_per_group(cand, ["dataset"], metric, ["model"]).select("dataset", "model")
    reads = [
        F.max(F.when(F.col("condition").startswith(p), col(metric))).alias(n)
        for n, p in conditions.items()
    ]
    return results.join(winner, ["dataset", "model"]).groupBy("dataset", "model").agg(*reads)


def delta_summary(card: DataFrame, tag: str) -> DataFrame:
    """Mean and population sd of the deltas, and how many are positive, per tag."""
    return card.groupBy(tag).agg(
        F.avg("delta").alias("mean_delta"),
        F.stddev_pop("delta").alias("std_delta"),
        F.count_if(F.col("delta") > 0).alias("n_wins"),
        F.count("*").alias("n_cells"),
    )


def verdict_counts(card: DataFrame, tag: str) -> DataFrame:
    levels = ["WIN", "TIE", "LOSS"]
    return card.groupBy(tag).pivot("verdict", levels).count().na.fill(0, subset=levels)


def delta_matrix(card: DataFrame, tag: str, cells: list[str], base_sd: str = "threshold") -> DataFrame:
    """Tag by cell (``dataset/model``): delta in points with its sign and size in sds."""
    cell = F.concat_ws("/", "dataset", "model")
    sign = F.when(F.col("verdict") == "WIN", 1).when(F.col("verdict") == "LOSS", -1).otherwise(0)
    return (
        card.withColumns({"__cell": cell, "__sign": sign})
        .groupBy(tag)
        .pivot("__cell", cells)
        .agg(
            F.max(F.col("delta") * 100.0).alias("delta_pp"),
            F.max("__sign").alias("sign"),
            F.max(F.try_divide(F.col("delta"), F.col(base_sd))).alias("in_sd"),
        )
    )


def mean_error_by_tag(errors: DataFrame, tag: str, error: str, sizes: DataFrame) -> DataFrame:
    """Mean error per model with its size; models of unknown size are left out."""
    means = errors.groupBy(tag).agg(F.avg(error).alias("mean_error"))
    return means.join(sizes, tag).where(F.col("mean_error").isNotNull() & F.col("size").isNotNull())


# ---------------------------------------------------------------- consolidation
METRICS = ["accuracy", "f1_weighted", "f1_macro", "roc_auc", "mae", "rmse", "r2"]
BASELINES = {"C0_raw": 0, "C1_manual": 1}
# Plain condition -> prefix of its consolidated name.
CONTEXT_PREFIX = {"C3_context": "C3", "C4_expanded": "C4"}
MODEL_SUFFIX = "(logreg|rf|knn|gbm|ridge)"


def union_results(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def consolidate(runs: DataFrame, sequence: str = "seq", tag: str = "tag") -> DataFrame:
    """One master table from many result files.

    Baselines count once (the first file wins). The run tag becomes part of the
    condition; a context run keeps only the model its tag was made for. Then
    the latest row per (dataset, condition, model) wins and metrics are rounded.
    """
    keys = ["dataset", "condition", "model"]
    cond = F.col("condition")
    is_base = cond.isin(list(BASELINES))
    base = keep_one(runs.where(is_base), [col(k) for k in keys], [sequence])

    short = relabel_prefix(cond)
    lead = F.concat(F.lower(short), F.lit("_"))
    rest_of_tag = F.substring(F.col(tag), F.length(lead) + 1, F.length(F.col(tag)))
    name = F.when(F.col(tag).startswith(lead), rest_of_tag).otherwise(F.col(tag))
    suffix = F.concat(F.lit("_"), F.col("dataset"))
    stripped = F.when(
        name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    ).otherwise(name)
    meant_for = F.regexp_extract(F.col("__tag"), rf"^.+_{MODEL_SUFFIX}$", 1)
    rest = (
        runs.where(~is_base)
        .withColumn("__tag", stripped)
        .where(
            ~cond.isin(list(CONTEXT_PREFIX)) | (meant_for == "") | (meant_for == F.col("model"))
        )
        .withColumn(
            "condition",
            F.when(cond == "C2_llm", F.concat(F.lit("C2_"), F.col(tag)))
            .when(cond.isin(list(CONTEXT_PREFIX)), F.concat_ws("_", short, F.col("__tag")))
            .otherwise(cond),
        )
        .drop("__tag")
    )
    merged = latest_wins(base.unionByName(rest), keys, sequence)
    wanted = [c for m in METRICS for c in (m, f"{m}_std") if c in merged.columns]
    return merged.withColumns({c: F.round(col(c).try_cast("double"), 4) for c in wanted})


def relabel_prefix(cond: Column) -> Column:
    out = None
    for plain, short in CONTEXT_PREFIX.items():
        out = F.when(cond == plain, short) if out is None else out.when(cond == plain, short)
    return out


def report_order(master: DataFrame) -> DataFrame:
    """Dataset, model, baselines first, condition."""
    rank = F.lit(9)
    for name, r in BASELINES.items():
        rank = F.when(F.col("condition") == name, r).otherwise(rank)
    return master.orderBy("dataset", "model", rank, "condition")
