"""Input frames shared by several queries, each with the same definition in SQL.

The test tables have no nulls and no duplicate rows, so frames with gaps, copies or text derive
them from whole tables with expressions both engines read the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.base import table

# orders with gaps in a number and in a category
GAPS = [
    "o_orderkey",
    "o_custkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS BIGINT) END AS visits",
]
GAPS_SQL = f"(SELECT {', '.join(GAPS)} FROM orders)"

# orders with text dates and text money, some of it unreadable, and a constant and a sparse column
RAW = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS `Order Date`",
    "CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)) END AS `Total Price`",
    "o_orderstatus AS Status",
    "1 AS one",
    "CASE WHEN o_orderkey % 20 = 0 THEN o_orderstatus END AS sparse",
]
RAW_SQL = "(SELECT " + ", ".join(RAW).replace("`", '"').replace("AS STRING", "AS VARCHAR") + " FROM orders)"

# orders without their key: copies arise by themselves
COPIES = ["o_custkey % 50 AS cust", "o_orderstatus AS status", "o_orderpriority AS priority"]
COPIES_SQL = f"(SELECT {', '.join(COPIES)} FROM orders)"

# line-level sales under the column names the business rules use
SALES_SQL = """(SELECT o_custkey AS user_id, o_orderkey AS order_id, o_orderdate AS order_date, l_partkey AS product_id,
 p_name AS product_name, p_type AS category, l_extendedprice * (1 - l_discount) AS total_price
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

# order-level view of the same names
ORDERS_SQL = """(SELECT o_custkey AS user_id, o_orderkey AS order_id, o_orderdate AS order_date,
 o_totalprice AS total_price, o_orderpriority AS category FROM orders)"""

# events per type and hour
HOURLY_SQL = """(SELECT event_type AS k, date_trunc('hour', ts) AS t, sum(value) AS v FROM events GROUP BY 1, 2)"""
DAILY_SQL = """(SELECT event_type AS k, date_trunc('day', ts) AS t, sum(value) AS v FROM events GROUP BY 1, 2)"""


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*GAPS)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*RAW)


def copies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*COPIES)


def sales(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("l_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_price"),
        )
    )


def orders_view(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS user_id",
        "o_orderkey AS order_id",
        "o_orderdate AS order_date",
        "o_totalprice AS total_price",
        "o_orderpriority AS category",
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """One series per event type on an hourly grain, hours without events left out."""
    from brightlake.operators.series import prepare_series

    return prepare_series(table(spark, sf, "events"), ["event_type"], "ts", "value", grain="hour", agg="sum", fill=None).select(
        F.col("event_type").alias("k"), F.col("ts").alias("t"), F.col("value").alias("v")
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    from brightlake.operators.series import prepare_series

    return prepare_series(table(spark, sf, "events"), ["event_type"], "ts", "value", grain="day", agg="sum", fill=None).select(
        F.col("event_type").alias("k"), F.col("ts").alias("t"), F.col("value").alias("v")
    )
