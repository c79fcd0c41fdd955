"""Queries of section D: scaling, encoding, rebalancing."""

from pyspark.sql import functions as F

from brightlake.operators import encode as op
from catalog.base import register, table

LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def line(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE)


def scaled(a, b):
    x = ", ".join(f"({c} - {a.format(c=c)}) / ({b.format(c=c)}) AS {c}" for c in ("l_quantity", "l_extendedprice"))
    return f"SELECT l_orderkey, l_linenumber, {x} FROM lineitem"


@register("d1_scale_standard", scaled("(SELECT avg({c}) FROM lineitem)", "SELECT stddev_pop({c}) FROM lineitem"), dec="l_quantity l_extendedprice")
def _(spark, sf):
    return op.scale_standard(line(spark, sf), ["l_quantity", "l_extendedprice"])


@register("d2_scale_minmax", scaled("(SELECT min({c}) FROM lineitem)", "SELECT max({c}) - min({c}) FROM lineitem"), dec="l_quantity l_extendedprice")
def _(spark, sf):
    return op.scale_minmax(line(spark, sf), ["l_quantity", "l_extendedprice"])


@register(
    "d3_scale_robust",
    scaled("(SELECT median({c}) FROM lineitem)", "SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem"),
    dec="l_quantity l_extendedprice",
)
def _(spark, sf):
    return op.scale_robust(line(spark, sf), ["l_quantity", "l_extendedprice"])


@register(
    "d4_one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"CAST(o_orderstatus = '{v}' AS INT) AS \"o_orderstatus_{v}\"" for v in "FOP")
    + " FROM orders",
)
def _(spark, sf):
    return op.one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))


PRIORITY = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority"


@register(
    "d5_label_encode",
    f"""SELECT o_orderkey, CAST(CASE WHEN priority IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY priority NULLS LAST) - 1 END AS INT) AS priority
    FROM (SELECT o_orderkey, {PRIORITY} FROM orders)""",
)
def _(spark, sf):
    return op.label_encode(table(spark, sf, "orders").selectExpr("o_orderkey", PRIORITY))


@register(
    "d6_frequency_encode",
    f"""WITH o AS (SELECT o_orderkey, {PRIORITY} FROM orders)
    SELECT o_orderkey, f AS priority FROM o LEFT JOIN (SELECT priority, count(*) / (SELECT count(priority) FROM o) AS f FROM o
      WHERE priority IS NOT NULL GROUP BY 1) USING (priority)""",
    dec="priority",
)
def _(spark, sf):
    return op.frequency_encode(table(spark, sf, "orders").selectExpr("o_orderkey", PRIORITY))


@register(
    "d7_binary_encode",
    "WITH c AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS code FROM part) SELECT p_partkey, "
    + ", ".join(f"CAST((code >> {4 - i}) & 1 AS INT) AS p_brand_{i}" for i in range(5))
    + " FROM c",
)
def _(spark, sf):
    return op.binary_encode(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")


@register(
    "d8_undersample",
    """SELECT lang, (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) AS n FROM documents GROUP BY lang""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return op.undersample(docs, "lang", ["doc_id"]).groupBy("lang").agg(F.count_distinct("doc_id").alias("n"))


@register(
    "d9_oversample",
    """SELECT lang, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) AS n, count(*) AS distinct_docs
    FROM documents GROUP BY lang""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return op.oversample(docs, "lang", ["doc_id"]).groupBy("lang").agg(
        F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("distinct_docs")
    )
