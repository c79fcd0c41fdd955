"""Queries of sections A and H: reading, writing, naming, merging."""

from pyspark.sql import functions as F

from brightlake.operators import join as op
from brightlake.session import scratch_path
from brightlake.sources import demo, tables as src
from catalog.base import register, table

CUST = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUST_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@register("a1_read_csv", CUST, dec="c_acctbal:2")
def _(spark, sf):
    path = scratch_path(spark, "customer.csv")
    src.write_result(table(spark, sf, "customer").select(*[c.split()[0] for c in CUST_SCHEMA.split(", ")]), path, "csv")
    return src.read_csv(spark, path, CUST_SCHEMA)


@register("a2_read_json", CUST, dec="c_acctbal:2")
def _(spark, sf):
    path = scratch_path(spark, "customer.json")
    src.write_result(table(spark, sf, "customer").select(*[c.split()[0] for c in CUST_SCHEMA.split(", ")]), path, "json")
    return src.read_json(spark, path, CUST_SCHEMA, lines=True)


@register(
    "a3_register_tables",
    """SELECT 'orders' AS name, count(*) AS row_count FROM orders UNION ALL SELECT 'customer', count(*) FROM customer
    UNION ALL SELECT 'nation', count(*) FROM nation""",
)
def _(spark, sf):
    names = src.Tables(spark)
    got = names.load([f"{sf}/orders.parquet", f"{sf}/customer.parquet", f"{sf}/nation.parquet"], clean=False)
    parts = [names.get(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("row_count")) for n in got]
    return op.stack_tables(parts)


@register("a4_write_result", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2", dec="qty:2")
def _(spark, sf):
    path = scratch_path(spark, "lines.parquet")
    cols = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    src.write_result(cols, path, "parquet", ["l_returnflag", "l_linestatus"])
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")
    )


@register("a5_synthetic_orders", "SELECT count(*) AS orders, count(*) AS distinct_orders, TRUE AS prices_add_up, TRUE AS in_range FROM orders")
def _(spark, sf):
    made = demo.synthetic_orders(spark, ids=table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))
    exact = F.col("unit_price") * (1 - F.col("discount_rate")) * F.col("quantity") - F.col("coupon_amount")
    return made.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_distinct("order_id").alias("distinct_orders"),
        F.bool_and(F.abs(exact - F.col("total_price")) < 1e-6).alias("prices_add_up"),
        F.bool_and(F.col("quantity").between(1, 3) & F.col("user_id").between(1, 500)).alias("in_range"),
    )


@register(
    "a6_denormalize",
    """SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_nationkey, l_quantity FROM (SELECT l_orderkey, l_quantity FROM lineitem) JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey""",
    dec="o_totalprice:2 l_quantity:2",
)
def _(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return op.denormalize(
        line, [(orders, "o_orderkey", ["o_custkey", "o_totalprice"]), (customer, "o_custkey", ["c_mktsegment", "c_nationkey"])]
    )


@register(
    "a7_merge_history",
    """SELECT 'orders_customer' AS name, 'merge' AS kind, 'orders,customer' AS inputs, 'o_custkey=c_custkey' AS keys, 'left' AS how,
    (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey) AS row_count, CAST(11 AS INT) AS column_count
    UNION ALL SELECT 'by_segment', 'sql', '', '', '', (SELECT count(DISTINCT c_mktsegment) FROM customer), CAST(2 AS INT)""",
)
def _(spark, sf):
    names = src.Tables(spark)
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    names.record(
        "orders_customer", op.merge(orders, customer, [("o_custkey", "c_custkey")], "left"), scratch_path(spark, "merged"),
        "merge", ["orders", "customer"], "o_custkey=c_custkey", "left",
    )
    by = names.sql("SELECT c_mktsegment, sum(o_totalprice) AS total FROM orders_customer GROUP BY c_mktsegment")
    names.record("by_segment", by, scratch_path(spark, "by_segment"), "sql")
    return names.merge_history().drop("seconds")


# ---- merges ------------------------------------------------------------------------------------
# customers per nation key with null keys on either side: nulls match each other

LEFT = "SELECT c_custkey, CAST(nullif(c_nationkey, 3) AS INT) AS nk, c_acctbal FROM customer"
RIGHT = "SELECT s_suppkey, CAST(nullif(s_nationkey % 20, 3) AS INT) AS nk, s_acctbal FROM supplier"


def sides(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey", "CAST(nullif(c_nationkey, 3) AS INT) AS nk", "c_acctbal")
    b = table(spark, sf, "supplier").selectExpr("s_suppkey", "CAST(nullif(s_nationkey % 20, 3) AS INT) AS nk", "s_acctbal")
    return a, b


def merge_sql(kind, key):
    return f"""SELECT {key} AS nk, c_custkey, c_acctbal, s_suppkey, s_acctbal FROM ({LEFT}) l {kind} JOIN ({RIGHT}) r ON l.nk IS NOT DISTINCT FROM r.nk"""


MDEC = "c_acctbal:2 s_acctbal:2"


@register("h1_merge_inner", merge_sql("INNER", "l.nk"), dec=MDEC)
def _(spark, sf):
    return op.merge(*sides(spark, sf), "nk", "inner")


@register("h2_merge_left", merge_sql("LEFT", "l.nk"), dec=MDEC)
def _(spark, sf):
    return op.merge(*sides(spark, sf), "nk", "left")


@register("h3_merge_right", merge_sql("RIGHT", "r.nk"), dec=MDEC)
def _(spark, sf):
    return op.merge(*sides(spark, sf), "nk", "right")


@register("h4_merge_outer", merge_sql("FULL", "coalesce(l.nk, r.nk)"), dec=MDEC)
def _(spark, sf):
    return op.merge(*sides(spark, sf), "nk", "outer")


@register("h1_merge_inner_salted", merge_sql("INNER", "l.nk"), dec=MDEC)
def _(spark, sf):
    return op.merge(*sides(spark, sf), "nk", "inner", salt=8)


@register("h4_merge_outer_salted", merge_sql("FULL", "coalesce(l.nk, r.nk)"), dec=MDEC)
def _(spark, sf):
    return op.merge(*sides(spark, sf), "nk", "outer", salt=8)


@register(
    "h5_merge_multi_key",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, n FROM lineitem LEFT JOIN (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
    ON l_partkey IS NOT DISTINCT FROM p AND l_suppkey IS NOT DISTINCT FROM s""",
)
def _(spark, sf):
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    sizes = line.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return op.merge(line, sizes, ["l_partkey", "l_suppkey"], "left")


@register("h6_merge_different_keys", "SELECT s_suppkey, s_nationkey, n_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    return op.merge(
        table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"),
        table(spark, sf, "nation").select("n_nationkey", "n_name"),
        [("s_nationkey", "n_nationkey")],
    )


CLASH = """SELECT c_nationkey AS nk, {a} FROM (SELECT c_nationkey, min(c_name) AS n1, sum(c_acctbal) AS b1 FROM customer GROUP BY 1)
 JOIN (SELECT s_nationkey, min(s_name) AS n2, sum(s_acctbal) AS b2 FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey"""


def clash(spark, sf, how):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nk")).agg(F.min("c_name").alias("name"), F.sum("c_acctbal").alias("bal"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(F.min("s_name").alias("name"), F.sum("s_acctbal").alias("bal"))
    return op.merge(a, b, "nk", clash=how)


@register("h7_clash_suffix_both", CLASH.format(a="n1 AS name_left, b1 AS bal_left, n2 AS name_right, b2 AS bal_right"), dec="bal_left:2 bal_right:2")
def _(spark, sf):
    return clash(spark, sf, "both")


@register("h7_clash_left_wins", CLASH.format(a="n1 AS name, b1 AS bal, n2 AS name_right, b2 AS bal_right"), dec="bal:2 bal_right:2")
def _(spark, sf):
    return clash(spark, sf, "left")


@register("h7_clash_right_wins", CLASH.format(a="n1 AS name_left, b1 AS bal_left, n2 AS name, b2 AS bal"), dec="bal_left:2 bal:2")
def _(spark, sf):
    return clash(spark, sf, "right")


@register(
    "h8_merge_chain",
    """SELECT o_orderkey, o_custkey, c_custkey, c_nationkey, n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM (SELECT o_orderkey, o_custkey FROM orders)
    LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer) ON o_custkey = c_custkey LEFT JOIN (SELECT n_nationkey, n_name, n_regionkey FROM nation) ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT r_regionkey, r_name FROM region) ON n_regionkey = r_regionkey""",
)
def _(spark, sf):
    return op.merge_chain(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
        [
            (table(spark, sf, "customer").select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")]),
            (table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), [("c_nationkey", "n_nationkey")]),
            (table(spark, sf, "region").select("r_regionkey", "r_name"), [("n_regionkey", "r_regionkey")]),
        ],
    )


@register(
    "h9_common_keys",
    """SELECT 'documents' AS "left", 'labels' AS "right", 'doc_id' AS "column", (SELECT count(DISTINCT doc_id) / count(*) FROM documents) AS left_ratio,
    (SELECT count(DISTINCT doc_id) / count(*) FROM labels) AS right_ratio
    UNION ALL SELECT * FROM (SELECT 'documents', 'conversations', 'text', (SELECT count(DISTINCT text) / count(*) FROM documents) AS a,
    (SELECT count(DISTINCT text) / count(*) FROM conversations) AS b) WHERE a > 0.5 OR b > 0.5""",
    dec="left_ratio right_ratio",
)
def _(spark, sf):
    return op.common_keys({n: table(spark, sf, n) for n in ("documents", "labels", "conversations")})


@register(
    "h10_relationship_edges",
    """SELECT * FROM (VALUES ('documents', 'labels', 'doc_id', 'id'), ('documents', 'conversations', 'text', 'weak')) t("left", "right", "column", strength)""",
)
def _(spark, sf):
    return op.relationship_edges({n: table(spark, sf, n) for n in ("documents", "labels", "conversations", "orders")})


@register("h11_default_join_key", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def _(spark, sf):
    docs, labels = table(spark, sf, "documents").select("text", "doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality")
    return op.merge(docs, labels, op.default_join_key(docs, labels)).select("doc_id", "lang", "quality")


# ---- SQL over registered tables: one query per template ------------------------------------------

SQL = {
    "h12_sql_inner": "SELECT o_orderkey, o_totalprice, c_name FROM {o} JOIN {c} ON o_custkey = c_custkey",
    "h12_sql_left": "SELECT c_custkey, c_mktsegment, o_orderkey FROM {c} LEFT JOIN {o} ON c_custkey = o_custkey",
    "h12_sql_group_sum": "SELECT o_orderpriority, SUM(o_totalprice) AS total FROM {o} GROUP BY o_orderpriority",
    "h12_sql_three_tables": "SELECT o_orderkey, c_name, n_name FROM {o} JOIN {c} ON o_custkey = c_custkey JOIN {n} ON c_nationkey = n_nationkey",
}


def _sql(name, text, dec):
    @register(name, text.format(o="orders", c="customer", n="nation"), dec=dec)
    def _(spark, sf):
        names = src.Tables(spark)
        for t in ("orders", "customer", "nation"):
            names.add(f"shop_{t}", table(spark, sf, t))
        return names.sql(text.format(o="shop_orders", c="shop_customer", n="shop_nation"))


for _name, _dec in zip(SQL, ("o_totalprice:2", "", "total:2", "")):
    _sql(_name, SQL[_name], _dec)


# ---- summaries and sets ------------------------------------------------------------------------

@register(
    "h13_group_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS l_extendedprice_sum, avg(l_extendedprice) AS l_extendedprice_mean,
    count(l_extendedprice) AS l_extendedprice_count, sum(l_quantity) AS l_quantity_sum, avg(l_quantity) AS l_quantity_mean FROM lineitem GROUP BY 1, 2""",
    dec="l_extendedprice_sum:2 l_extendedprice_mean:4 l_quantity_sum:2 l_quantity_mean:5",
)
def _(spark, sf):
    return op.group_summary(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
        {"l_extendedprice": ["sum", "mean", "count"], "l_quantity": ["sum", "mean"]},
    )


@register(
    "h14_pivot_table",
    "SELECT o_orderpriority, "
    + ", ".join(f"coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 0) AS y{y}" for y in range(1995, 2002))
    + " FROM orders GROUP BY 1",
    dec=" ".join(f"y{y}:2" for y in range(1995, 2002)),
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", F.concat(F.lit("y"), F.year("o_orderdate")).alias("y"))
    return op.pivot_table(df, "o_orderpriority", "y", "o_totalprice")


@register("h15_only_in_first", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def _(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return op.only_in_first(table(spark, sf, "customer"), big, "c_custkey")


@register("h16_in_both", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return op.in_both(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_custkey")


@register(
    "h17_stack_tables",
    "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
    dec="balance:2",
)
def _(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment")
    return op.stack_tables([a, table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance")])
