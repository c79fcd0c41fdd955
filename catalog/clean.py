"""Queries of section B: cleaning, types, filters."""

from brightlake.operators import clean as op
from catalog.base import register, table
from catalog.frames import COPIES_SQL, GAPS_SQL, RAW_SQL, copies, gaps, raw


@register("b1_simple_names", f"""SELECT o_orderkey, "Order Date" AS order_date, "Total Price" AS total_price, Status AS status, one, sparse FROM {RAW_SQL}""")
def _(spark, sf):
    return op.simple_names(raw(spark, sf))


@register("b2_normalize_names", f"""SELECT o_orderkey, "Order Date" AS order_date_utc, "Total Price" AS total_price, Status AS status, one, sparse FROM {RAW_SQL}""")
def _(spark, sf):
    return op.normalize_names(raw(spark, sf).toDF("o_orderkey", " Order Date (UTC)", "Total--Price", "_Status_", "ONE", "sparse"))


@register(
    "b3_parse_date_columns",
    f"""SELECT o_orderkey, try_strptime("Order Date", '%Y-%m-%d') AS order_date, "Total Price" AS total_price FROM {RAW_SQL}""",
)
def _(spark, sf):
    df = op.simple_names(raw(spark, sf)).select("o_orderkey", "order_date", "total_price")
    return op.parse_date_columns(df)


@register(
    "b4_parse_money_columns",
    f"""SELECT o_orderkey, "Order Date" AS order_date,
    TRY_CAST(regexp_replace("Total Price", '[₩,$￦¥€£\\s]', '', 'g') AS DOUBLE) AS total_price FROM {RAW_SQL}""",
    dec="total_price:2",
)
def _(spark, sf):
    return op.parse_money_columns(op.simple_names(raw(spark, sf)).select("o_orderkey", "order_date", "total_price"))


@register(
    "b5_redundant_columns",
    f"""SELECT 'one' AS "column", 'all_same' AS reason, CAST(min(one) AS VARCHAR) AS value, CAST(NULL AS DOUBLE) AS percentage_na
    FROM {RAW_SQL} HAVING count(DISTINCT one) = 1
    UNION ALL SELECT 'sparse', 'mostly_na', NULL, 100.0 * (count(*) - count(sparse)) / count(*) FROM {RAW_SQL}
    HAVING (count(*) - count(sparse)) > 0.9 * count(*)""",
    dec="percentage_na",
)
def _(spark, sf):
    return op.redundant_columns(raw(spark, sf))


@register(
    "b6_logical_types",
    """SELECT u.c AS "column", CASE WHEN c = 'l_shipdate' THEN 'datetime' WHEN c IN ('l_returnflag', 'l_linestatus') THEN 'categorical'
      WHEN d <= 10 AND d < 0.05 * n THEN 'categorical' ELSE 'numeric' END AS logical_type FROM (
      SELECT unnest(['l_orderkey','l_partkey','l_suppkey','l_linenumber','l_quantity','l_extendedprice','l_discount','l_tax',
        'l_returnflag','l_linestatus','l_shipdate']) AS c,
      unnest([count(DISTINCT l_orderkey), count(DISTINCT l_partkey), count(DISTINCT l_suppkey), count(DISTINCT l_linenumber),
        count(DISTINCT l_quantity), count(DISTINCT l_extendedprice), count(DISTINCT l_discount), count(DISTINCT l_tax), 0, 0, 0]) AS d,
      count(*) AS n FROM lineitem) u""",
)
def _(spark, sf):
    return op.logical_types(table(spark, sf, "lineitem"))


DATE_HIT = r"""(regexp_matches({c}, '\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}') OR regexp_matches({c}, '\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}')
 OR regexp_matches({c}, '\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2}}') OR regexp_matches({c}, '\d{{4}}\d{{2}}\d{{2}}')
 OR regexp_matches({c}, '\d{{4}}년\s*\d{{1,2}}월\s*\d{{1,2}}일'))"""


@register(
    "b7_detect_date_columns",
    "SELECT c AS \"column\", s AS date_share, b AS name_suggests_date, (s > 0.5) OR b AS is_date FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS c, coalesce(avg(CAST({DATE_HIT.format(c=chr(34) + c + chr(34))} AS INT)), 0) AS s, {b} AS b FROM {RAW_SQL}"
        for c, b in (("Order Date", "TRUE"), ("Total Price", "FALSE"), ("Status", "FALSE"), ("sparse", "FALSE"))
    )
    + ")",
    dec="date_share",
)
def _(spark, sf):
    return op.detect_date_columns(raw(spark, sf))


@register("b8_drop_duplicate_rows", f"SELECT DISTINCT cust, status, priority FROM {COPIES_SQL}")
def _(spark, sf):
    return op.drop_duplicate_rows(copies(spark, sf))


@register(
    "b8_duplicate_count",
    f"""SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS n FROM {COPIES_SQL} GROUP BY cust, status, priority)""",
)
def _(spark, sf):
    return op.duplicate_count(copies(spark, sf))


@register("b9_drop_zero_variance", f"""SELECT o_orderkey, "Status" AS "Status" FROM {RAW_SQL}""")
def _(spark, sf):
    return op.drop_zero_variance(raw(spark, sf).select("o_orderkey", "Status", "one"))


@register(
    "b10_remove_outlier_rows",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value FROM events, q WHERE value BETWEEN a - 1.0 * (b - a) AND b + 1.0 * (b - a)""",
    dec="value:2",
)
def _(spark, sf):
    return op.remove_outlier_rows(table(spark, sf, "events").select("event_id", "value"), ["value"], threshold=1.0, min_percent=2.0)


@register(
    "b11_preprocess",
    f"""WITH d AS (SELECT DISTINCT o_custkey % 60 AS cust, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority_code,
      CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey % 9 END AS visits, substr(CAST(o_orderdate AS VARCHAR), 1, 7) || '-01' AS order_date FROM orders),
    s AS (SELECT mode(priority_code ORDER BY priority_code) AS m, avg(visits) AS av, median(visits) AS md, skewness(visits) AS sk FROM d)
    SELECT cust, coalesce(priority_code, (SELECT v FROM (SELECT priority_code AS v, count(*) AS n FROM d WHERE priority_code IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1))) AS priority_code,
    coalesce(CAST(visits AS DOUBLE), CASE WHEN abs(sk) > 1 THEN md ELSE av END) AS visits, CAST(order_date AS TIMESTAMP) AS order_date FROM d, s""",
    dec="visits",
)
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_custkey % 60 AS Cust",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS `Priority Code`",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey % 9 END AS Visits",
        "concat(substr(CAST(o_orderdate AS STRING), 1, 7), '-01') AS `Order Date`",
        "1 AS constant",
    )
    return op.preprocess(df)


@register("b12_period_filter_recent", """SELECT o_orderkey, o_orderdate FROM orders
    WHERE CAST(o_orderdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 90""")
def _(spark, sf):
    return op.period_filter(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "recent", days=90)


@register("b12_period_filter_range", """SELECT o_orderkey, o_orderdate FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'""")
def _(spark, sf):
    return op.period_filter(
        table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "range", "1996-03-01", "1997-02-28"
    )


@register("b12_period_filter_all", "SELECT o_orderkey, o_orderdate FROM orders")
def _(spark, sf):
    return op.period_filter(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@register(
    "b13_derive_columns",
    f"""SELECT o_orderkey AS order_id, price, priority, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month
    FROM (SELECT *, o_orderdate AS d FROM orders JOIN {GAPS_SQL} g USING (o_orderkey)) WHERE price > 0 AND priority IS NOT NULL""",
    dec="price:2",
)
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority",
        "o_orderdate AS d",
    )
    return op.derive_columns(df, "d", ["price"], ["priority"], ["d", "not_there"], {"o_orderkey": "order_id"})


@register("b14_drop_na_rows", f"SELECT * FROM {GAPS_SQL} WHERE price IS NOT NULL AND priority IS NOT NULL AND visits IS NOT NULL", dec="price:2")
def _(spark, sf):
    return op.drop_na_rows(gaps(spark, sf))


@register("b14_drop_na_subset", f"SELECT * FROM {GAPS_SQL} WHERE price IS NOT NULL", dec="price:2")
def _(spark, sf):
    return op.drop_na_rows(gaps(spark, sf), ["price"])


@register(
    "b15_is_in_top",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 50)""",
)
def _(spark, sf):
    return op.is_in_top(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", 50)
