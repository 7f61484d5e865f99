"""The driver's tables seen as expense evidence.

``lineitem`` has no key, so a line is numbered inside its order by all of its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.session import table

LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)

MATERIAL_SQL = f"""
SELECT l_orderkey AS pool,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS rn,
       CASE WHEN l_linenumber % 2 = 1 THEN 'invoice' ELSE 'payment' END AS role,
       CAST(round(l_quantity * 100) AS BIGINT) AS cents,
       l_returnflag AS person, l_linestatus AS blocked, l_partkey AS number
FROM lineitem"""


def material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vouchers (odd lines) and payments (even lines) of one pool per order."""
    window = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pool"),
        F.row_number().over(window).alias("rn"),
        F.when(F.col("l_linenumber") % 2 == 1, "invoice").otherwise("payment").alias("role"),
        F.round(F.col("l_quantity") * 100).cast("bigint").alias("cents"),
        F.col("l_returnflag").alias("person"),
        F.col("l_linestatus").alias("blocked"),
        F.col("l_partkey").alias("number"),
    )


EXPENSE_SQL = """
SELECT o_orderkey AS id, c_nationkey AS project, c_mktsegment AS owner,
       CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
       CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'P' THEN 'ready' ELSE 'draft' END AS stage,
       o_orderpriority AS category, CAST(o_orderdate AS DATE) AS expense_date, o_custkey AS merchant
FROM orders JOIN customer ON o_custkey = c_custkey"""


def expense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as expenses of a project (nation) and an owner (market segment)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    stage = F.when(F.col("o_orderstatus") == "F", "submitted").when(F.col("o_orderstatus") == "P", "ready").otherwise("draft")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("owner"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), stage.alias("stage"),
        F.col("o_orderpriority").alias("category"), F.col("o_orderdate").cast("date").alias("expense_date"),
        F.col("o_custkey").alias("merchant"),
    )


MESSAGE_SQL = """
SELECT event_id AS id, user_id AS chat, ts, epoch_us(ts) // 1000000 AS second, event_type AS kind, value,
       CAST(props ->> '$.k' AS BIGINT) AS local_id
FROM events"""


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a chat (user); ``second`` counts from 1970."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("chat"), "ts",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), F.col("event_type").alias("kind"), "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("local_id"),
    )
