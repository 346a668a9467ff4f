"""Queries that write and read back: files, caches and streams.

Output goes to a fresh folder under the session's checkpoint directory.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.catalog.common import DIRTY_ORDERS_SQL, dirty_orders, query, rounded, table
from tidyloom.plans import PlanCleaner
from tidyloom.plans.model import PlanModel
from tidyloom.session import ensure_checkpoint_dir
from tidyloom.sources import cached_table, load_raw, preview, read_csv, scan_results, write_csv, write_json
from tidyloom.sources.tables import SEPARATORS
from tidyloom.streaming import clean_stream, dedup_stream, last_profile, profile_stream, write_stream


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_ORDER_COLUMNS = "o_orderkey, o_orderstatus, o_totalprice, o_orderpriority"


@query(
    "csv_round_trip",
    " UNION ALL ".join(
        f"SELECT '{name}' AS sep, {_ORDER_COLUMNS} FROM ({DIRTY_ORDERS_SQL})"
        for name in ("comma", "semicolon", "tab", "bar")
    ),
)
def csv_round_trip(spark, d):
    """Written with each delimiter, read back with the detected one and inferred types."""
    df = dirty_orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    parts = []
    for name, sep in zip(("comma", "semicolon", "tab", "bar"), SEPARATORS):
        path = _folder(spark, f"csv-{name}")
        write_csv(df, path, sep=sep)
        parts.append(read_csv(spark, path).select(F.lit(name).alias("sep"), *df.columns))
    return reduce(DataFrame.unionByName, parts)


_HARD_TEXTS = """
    SELECT doc_id, n_chars, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  a b '
        WHEN 3 THEN 'say "' || text || '"' WHEN 4 THEN chr(92) || text || chr(92) WHEN 5 THEN 'N/A' WHEN 6
        THEN ',;|' || chr(9) || text ELSE text END AS text FROM documents
"""


@query("csv_texts", _HARD_TEXTS)
def csv_texts(spark, d):
    """Texts with line breaks, quotes, outer blanks, delimiters; NULL and empty stay apart."""
    table(spark, d, "documents").createOrReplaceTempView("documents")
    path = _folder(spark, "csv-texts")
    write_csv(spark.sql(_HARD_TEXTS), path)
    kinds = T.StructType.fromDDL("doc_id bigint, n_chars bigint, text string")
    return read_csv(spark, path, ",", na_values=[], schema=kinds, multi_line=True)


@query(
    "json_sink",
    "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
)
def json_sink(spark, d):
    path = _folder(spark, "json")
    write_json(table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), path)
    return spark.read.schema("c_mktsegment string, n bigint").json(path)


@query(
    "baseline_cache",
    """
    SELECT o_orderpriority AS dataset, round(avg(o_totalprice), 4) AS f1_macro FROM orders GROUP BY 1
    """,
)
def baseline_cache(spark, d):
    """Computed once; the second call reads what the first one wrote."""
    path = _folder(spark, "cache")

    def compute():
        return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(
            F.round(F.avg("o_totalprice"), 4).alias("f1_macro")
        )

    source = table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    cached_table(spark, path, compute, source=source)
    return cached_table(spark, path, compute, source=source)


@query(
    "scan_result_files",
    """
    SELECT 'big_rf' AS tag, o_orderpriority AS dataset, round(avg(o_totalprice), 2) AS f1_macro FROM orders GROUP BY 2
    UNION ALL
    SELECT 'small_knn', o_orderpriority, round(avg(o_custkey), 2) FROM orders GROUP BY 2
    """,
)
def scan_result_files(spark, d):
    """Result files named after their run; the legacy file is skipped."""
    path = _folder(spark, "results")
    orders = table(spark, d, "orders")
    for tag, column in (("big_rf", "o_totalprice"), ("small_knn", "o_custkey"), ("cv5", "o_custkey")):
        per = orders.groupBy(F.col("o_orderpriority").alias("dataset")).agg(
            F.round(F.avg(column), 2).alias("f1_macro")
        )
        per.write.mode("overwrite").option("header", True).csv(f"{path}/results_{tag}.csv")
    # Spark names the part files itself, so the tag is read from their folder.
    found = scan_results(spark, f"{path}/*", name=F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return found.select("tag", "dataset", F.col("f1_macro").cast("double").alias("f1_macro"))


@query(
    "load_raw_orders",
    """
    SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE o_orderstatus END
               AS o_orderstatus FROM orders
    """,
)
def load_raw_orders(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    return load_raw(
        df, "o_orderstatus", "classification", "o_orderkey", ["o_custkey"], label_map={"F": "1", "O": "0"}
    )


@query("preview_documents", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 8")
def preview_documents(spark, d):
    return preview(table(spark, d, "documents"), 8, ["doc_id"]).select("doc_id", "lang", "n_chars")


_STREAM_PLAN = {
    "actions": [
        {"action": "handle_missing", "params": {"strategy": "median", "cat_missing_strategy": "fill_mode"}},
        {"action": "normalize_text", "params": {"ops": ["strip", "lower"]}},
        {"action": "scale_features", "params": {"columns": ["o_totalprice"]}},
    ]
}


@query(
    "stream_clean",
    f"""
    WITH t AS ({DIRTY_ORDERS_SQL}),
    m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM t),
    p AS (SELECT o_orderpriority AS v FROM t WHERE o_orderpriority IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT o_orderkey, coalesce(o_totalprice, med) AS tp, lower(trim(coalesce(o_orderpriority, v))) AS pr FROM t, m, p),
    z AS (SELECT avg(tp) AS a, stddev_pop(tp) AS b FROM f)
    SELECT o_orderkey, round((tp - a) / b, 6) AS o_totalprice, pr AS o_orderpriority FROM f, z
    """,
)
def stream_clean(spark, d):
    """A plan fitted on the table, saved, loaded and applied to a stream of it."""
    keep = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    batch = dirty_orders(spark, d).select(*keep)
    fitted = PlanCleaner(_STREAM_PLAN, carry=["o_orderkey"]).fit(batch)
    store = _folder(spark, "model")
    fitted.save(spark, store)
    model = PlanModel.load(spark, store)
    source = (
        spark.readStream.schema(table(spark, d, "orders").schema)
        .option("pathGlobFilter", "orders.parquet")
        .parquet(d)
    )
    from tidyloom.catalog.common import DIRTY_ORDERS

    stream = clean_stream(source.selectExpr(*DIRTY_ORDERS).select(*keep), model)
    out = _folder(spark, "stream")
    write_stream(stream, out, f"{out}-checkpoint").awaitTermination()
    return rounded(spark.read.parquet(out), o_totalprice=6)


_FIRST_SEEN = "user_id, event_type"


@query("stream_dedup", f"SELECT DISTINCT {_FIRST_SEEN} FROM events")
def stream_dedup(spark, d):
    """Kinds of events of each user as they come, once each within the watermark's hundred years."""
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    keys = _FIRST_SEEN.split(", ")
    out = _folder(spark, "first-seen")
    timed = source.withColumn("ts", F.col("ts").cast("timestamp"))
    seen = dedup_stream(timed, "ts", "36500 days", keys).select(*keys)
    write_stream(seen, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(seen.schema).parquet(out)


_STREAM_PROFILE = {"o_totalprice": "DOUBLE", "o_orderpriority": "VARCHAR", "o_orderstatus": "VARCHAR", "o_custkey": "BIGINT"}


def _profile_sql(c: str, kind: str) -> str:
    number = kind != "VARCHAR"
    stats = [f"{f}({c}::DOUBLE)" if number else "NULL::DOUBLE" for f in ("min", "max", "avg", "stddev_pop")]
    return (
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
        f"round((count(*) - count({c})) / count(*), 8) AS missing_share, "
        + ("NULL::VARCHAR AS min_value, NULL::VARCHAR AS max_value, " if number else f"min({c}) AS min_value, max({c}) AS max_value, ")
        + f"{stats[0]} AS min, {stats[1]} AS max, round({stats[2]}, 4) AS mean, round({stats[3]}, 4) AS sd FROM t"
    )


@query(
    "stream_profile",
    f"WITH t AS ({DIRTY_ORDERS_SQL}) " + " UNION ALL ".join(_profile_sql(*c) for c in _STREAM_PROFILE.items()),
)
def stream_profile(spark, d):
    """The last state of a profile kept up over a stream of the dirty orders."""
    from tidyloom.catalog.common import DIRTY_ORDERS

    source = spark.readStream.schema(table(spark, d, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    out = _folder(spark, "profile")
    profile_stream(source.selectExpr(*DIRTY_ORDERS).select(*_STREAM_PROFILE), out, f"{out}-checkpoint").awaitTermination()
    found = last_profile(spark, out).drop("distinct_estimate")
    number = F.col("min").isNotNull()
    texts = {c: F.when(~number, F.col(c)) for c in ("min_value", "max_value")}
    return rounded(found.withColumns(texts), missing_share=8, mean=4, sd=4)
