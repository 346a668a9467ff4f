"""Registry of named queries, their SQL counterparts, and derived inputs.

The shared tables hold no missing values, so several queries first blank or
blur some cells. That is written as SQL text both engines run, over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})


DIRTY_ORDERS = [
    "o_orderkey",
    "o_custkey",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "o_orderdate",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 "
    "THEN '  ' || lower(o_orderpriority) || '  ' ELSE o_orderpriority END AS o_orderpriority",
]
DIRTY_ORDERS_SQL = f"SELECT {', '.join(DIRTY_ORDERS)} FROM orders"

DIRTY_LINES = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "CASE WHEN (l_orderkey + l_partkey) % 8 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
    "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_discount END AS l_discount",
    "l_tax",
    "CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_linestatus",
]
DIRTY_LINES_SQL = f"SELECT {', '.join(DIRTY_LINES)} FROM lineitem"


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*DIRTY_ORDERS)


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*DIRTY_LINES)
