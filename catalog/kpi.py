"""Queries of section N: indicators and insight rules."""

from pyspark.sql import functions as F

from brightlake.operators import insights as ins
from brightlake.operators import kpi as op
from catalog.base import ORACLES, register, table
from catalog.frames import ORDERS_SQL, SALES_SQL, orders_view, sales

O = f"WITH s AS {ORDERS_SQL}, m AS (SELECT max(order_date) AS now FROM s) "
S = f"WITH s AS {SALES_SQL}, m AS (SELECT max(order_date) AS now FROM s) "
NEW, OLD = "order_date >= now - INTERVAL {d} DAY", "order_date < now - INTERVAL {d} DAY AND order_date >= now - INTERVAL {e} DAY"
N30, O30 = NEW.format(d=30), OLD.format(d=30, e=60)
N90, O90 = NEW.format(d=90), OLD.format(d=90, e=180)
GROW = "CASE WHEN {p} > 0 THEN 100.0 * ({c} - {p}) / {p} END"

HALF = O + """, h AS (SELECT max(order_date) - (max(order_date) - min(order_date)) / 2 AS mid FROM s),
 a AS (SELECT coalesce(sum(total_price) FILTER (order_date >= mid), 0) AS current_revenue, coalesce(sum(total_price) FILTER (order_date < mid), 0) AS previous_revenue,
 count(DISTINCT order_id) FILTER (order_date >= mid) AS current_orders, count(DISTINCT order_id) FILTER (order_date < mid) AS previous_orders,
 count(DISTINCT user_id) FILTER (order_date >= mid) AS current_customers, count(DISTINCT user_id) FILTER (order_date < mid) AS previous_customers,
 count(DISTINCT category) AS k FROM s, h)
 SELECT * EXCLUDE (k), current_revenue / current_orders AS current_aov, previous_revenue / previous_orders AS previous_aov,
 100.0 * current_orders / (current_customers * k) AS current_conversion, 100.0 * previous_orders / (previous_customers * k) AS previous_conversion,
 previous_revenue * CAST(1.1 AS DOUBLE) AS target_revenue FROM a"""


@register(
    "n1_kpi_half_split", HALF,
    dec="current_revenue:2 previous_revenue:2 current_aov:5 previous_aov:5 current_conversion previous_conversion target_revenue:4",
)
def _(spark, sf):
    return op.kpi_half_split(orders_view(spark, sf))


@register(
    "n2_kpi_card",
    """SELECT p AS o_orderpriority, cur, prev, 160000.0 AS target, CASE WHEN prev <> 0 THEN 100.0 * (cur - prev) / prev END AS change_percentage, cur >= 160000 AS target_met FROM
    (SELECT o_orderpriority AS p, avg(o_totalprice) FILTER (year(o_orderdate) = 1998) AS cur, avg(o_totalprice) FILTER (year(o_orderdate) = 1997) AS prev FROM orders GROUP BY 1)""",
    dec="cur:5 prev:5 target change_percentage",
)
def _(spark, sf):
    y = F.year("o_orderdate")
    df = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.avg(F.when(y == 1998, F.col("o_totalprice"))).alias("cur"), F.avg(F.when(y == 1997, F.col("o_totalprice"))).alias("prev")
    )
    return op.kpi_card(df.withColumn("target", F.lit(160000.0)), "cur", "prev", "target")


@register(
    "n3_kpi_30d_revenue",
    S + f""", r AS (SELECT coalesce(sum(total_price) FILTER ({N30}), 0) AS current_revenue, coalesce(sum(total_price) FILTER ({O30}), 0) AS previous_revenue FROM s, m)
    SELECT *, {GROW.format(c='current_revenue', p='previous_revenue')} AS growth_percentage, CAST(10 AS DOUBLE) AS target_percentage,
    {GROW.format(c='current_revenue', p='previous_revenue')} >= 10 AS target_met FROM r""",
    dec="current_revenue:4 previous_revenue:4 growth_percentage target_percentage",
)
def _(spark, sf):
    return op.kpi_30d_revenue(sales(spark, sf))


@register(
    "n4_kpi_conversion",
    S + f""", r AS (SELECT count(DISTINCT order_id) AS orders, count(DISTINCT user_id) AS users FROM s, m WHERE {N30})
    SELECT *, 100.0 * orders / users AS conversion_rate, CAST(3 AS DOUBLE) AS target, 100.0 * orders / users >= 3 AS target_met, greatest(0, 3 - 100.0 * orders / users) AS gap FROM r""",
    dec="conversion_rate target gap",
)
def _(spark, sf):
    return op.kpi_conversion(sales(spark, sf))


@register(
    "n5_kpi_aov",
    S + f""", r AS (SELECT coalesce(sum(total_price), 0) AS revenue, count(DISTINCT order_id) AS orders FROM s, m WHERE {N30})
    SELECT *, revenue / orders AS aov, CAST(50000 AS DOUBLE) AS target, revenue / orders >= 50000 AS target_met, greatest(0, (50000 - revenue / orders) / 50000 * 100) AS gap_percentage FROM r""",
    dec="revenue:4 aov:5 target gap_percentage",
)
def _(spark, sf):
    return op.kpi_aov(sales(spark, sf))


@register(
    "n6_kpi_retention",
    S + f""", c AS (SELECT DISTINCT user_id FROM s, m WHERE {N30}), p AS (SELECT DISTINCT user_id FROM s, m WHERE {O30}),
    r AS (SELECT (SELECT count(*) FROM c) AS current_buyers, (SELECT count(*) FROM p) AS previous_buyers, (SELECT count(*) FROM c JOIN p USING (user_id)) AS returning_buyers)
    SELECT *, 100.0 * returning_buyers / current_buyers AS retention_rate, CAST(30 AS DOUBLE) AS target, 100.0 * returning_buyers / current_buyers >= 30 AS target_met FROM r""",
    dec="retention_rate target",
)
def _(spark, sf):
    return op.kpi_retention(sales(spark, sf))


@register(
    "n7_mau",
    O + """, t AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, count(DISTINCT user_id) AS active_users FROM s GROUP BY 1),
    g AS (SELECT *, 100.0 * (active_users - lag(active_users) OVER (ORDER BY month)) / lag(active_users) OVER (ORDER BY month) AS growth_percentage FROM t)
    SELECT *, growth_percentage >= 5 AS target_met FROM g""",
    dec="growth_percentage",
)
def _(spark, sf):
    return op.mau(orders_view(spark, sf))


STATS = """ st AS (SELECT user_id, count(*) AS order_count, sum(total_price) AS total_spent, avg(total_price) AS avg_order_value, min(order_date) AS first_order_date,
 max(order_date) AS last_order_date, string_agg(DISTINCT category, ', ' ORDER BY category) AS interest_categories,
 CAST(date_diff('day', max(order_date), any_value(now)) AS INT) AS days_since_last_order FROM s, m GROUP BY user_id)"""
SDEC = "total_spent:4 avg_order_value:1"


@register("n8_user_stats", S + "," + STATS + " SELECT * FROM st", dec=SDEC)
def _(spark, sf):
    return op.user_stats(sales(spark, sf))


REGION = """SELECT o_custkey AS user_id, o_orderdate AS order_date, o_totalprice AS total_price, o_orderpriority AS region, o_orderstatus = 'F' AS review_written FROM orders"""


@register(
    "n8_user_stats_region",
    f"""WITH s AS ({REGION}), m AS (SELECT max(order_date) AS now FROM s), st AS (SELECT user_id, count(*) AS order_count, sum(total_price) AS total_spent,
    avg(total_price) AS avg_order_value, min(order_date) AS first_order_date, max(order_date) AS last_order_date, count(*) FILTER (review_written) AS review_count,
    CAST(date_diff('day', max(order_date), any_value(now)) AS INT) AS days_since_last_order FROM s, m GROUP BY 1),
    r AS (SELECT user_id, region, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, region) AS k FROM s GROUP BY 1, 2)
    SELECT st.* EXCLUDE (avg_order_value), region FROM st JOIN r USING (user_id) WHERE k = 1""",
    dec="total_spent:2",
)
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_custkey AS user_id", "o_orderdate AS order_date", "o_totalprice AS total_price", "o_orderpriority AS region",
        "o_orderstatus = 'F' AS review_written",
    )
    return op.user_stats(df).drop("avg_order_value")  # checked in n8_user_stats


SEG = """CASE WHEN order_count >= 3 AND days_since_last_order <= 180 THEN 'loyal_customers' WHEN avg_order_value > 100000 THEN 'high_value_customers'
 WHEN date_diff('day', first_order_date, (SELECT now FROM m)) <= 30 THEN 'new_customers' WHEN days_since_last_order > 90 THEN 'at_risk_customers' ELSE 'browsers' END"""
ORDER_STATS = STATS.replace("string_agg(DISTINCT category, ', ' ORDER BY category) AS interest_categories,", "")


@register("n9_user_segment", O + "," + ORDER_STATS + f" SELECT user_id, order_count, {SEG} AS user_segment FROM st")
def _(spark, sf):
    df = orders_view(spark, sf)
    now = op.as_of_date(df)
    return op.user_segment(op.user_stats(df, now), now).select("user_id", "order_count", "user_segment")


@register(
    "n10_cluster_names",
    """WITH u AS (SELECT o_custkey AS user_id, sum(o_totalprice) AS total_spent, avg(o_totalprice) AS avg_order, count(*) AS purchase_count FROM orders GROUP BY 1),
    c AS (SELECT CAST(least(purchase_count // 6, 4) AS INT) AS cluster, * FROM u),
    p AS (SELECT cluster, count(*) AS size, avg(total_spent) AS t, avg(avg_order) AS a, avg(purchase_count) AS n FROM c GROUP BY 1),
    g AS (SELECT avg(total_spent) AS gt, avg(avg_order) AS ga, avg(purchase_count) AS gn FROM u)
    SELECT cluster, size, CASE WHEN t > 1.5 * gt AND n > 1.5 * gn THEN 'high_value_loyal' WHEN t > 1.5 * gt THEN 'big_spender' WHEN n > 1.5 * gn AND a < 0.8 * ga THEN 'small_frequent'
    WHEN n > 1.5 * gn THEN 'loyal' WHEN a < 0.6 * ga THEN 'price_sensitive' ELSE 'cluster_' || CAST(cluster + 1 AS VARCHAR) END AS segment_name FROM p, g""",
)
def _(spark, sf):
    users = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total_spent"), F.avg("o_totalprice").alias("avg_order"), F.count(F.lit(1)).alias("purchase_count")
    )
    labelled = users.withColumn("cluster", F.least(F.floor(F.col("purchase_count") / 6), F.lit(4)).cast("int"))
    from brightlake.operators.cluster import customer_profile

    return ins.cluster_names(customer_profile(labelled, "cluster")).select("cluster", "size", "segment_name")


DAYS = ", d AS (SELECT CAST(order_date AS DATE) AS day, sum(total_price) AS sales FROM s GROUP BY 1) "


@register(
    "n11_weekday_sales",
    S + """, w AS (SELECT dayname(order_date) AS n, isodow(order_date) AS i, sum(total_price) AS v FROM s GROUP BY 1, 2)
    SELECT arg_max(n, v) AS best_weekday, arg_min(n, v) AS worst_weekday, max(v) AS best_sales, min(v) AS worst_sales FROM w""",
    dec="best_sales:3 worst_sales:3",
)
def _(spark, sf):
    return ins.weekday_sales(sales(spark, sf))


@register(
    "n12_week_over_week",
    S + DAYS + """, r AS (SELECT sales, row_number() OVER (ORDER BY day DESC) AS r FROM d),
    q AS (SELECT sum(sales) FILTER (r <= 7) AS recent_sales, sum(sales) FILTER (r BETWEEN 8 AND 14) AS previous_sales FROM r),
    g AS (SELECT *, 100.0 * (recent_sales - previous_sales) / previous_sales AS change_percentage FROM q)
    SELECT *, CASE WHEN change_percentage > 10 THEN 'increase' WHEN change_percentage < -10 THEN 'decrease' END AS direction FROM g""",
    dec="recent_sales:4 previous_sales:4 change_percentage",
)
def _(spark, sf):
    return ins.week_over_week(sales(spark, sf))


def change_sql(new, old):
    return f""", c AS (SELECT category, sum(total_price) FILTER ({new}) AS a, sum(total_price) FILTER ({old}) AS b FROM s, m GROUP BY 1),
     g AS (SELECT category, 100.0 * (a - b) / b AS ch FROM c WHERE a IS NOT NULL AND b > 0)"""


PAST = S.replace("SELECT max(order_date) AS now FROM s", "SELECT TIMESTAMP '2001-03-06' AS now")
UPTO = "order_date <= now AND "


@register(
    "n13_declining_category",
    PAST + change_sql(UPTO + N30, O30) + f""", t AS (SELECT 100.0 * (sum(total_price) FILTER ({UPTO}{N30}) - sum(total_price) FILTER ({O30})) / sum(total_price) FILTER ({O30}) AS total_change FROM s, m)
    SELECT category, ch AS change_percentage, total_change FROM g, t WHERE total_change < -10 AND ch < -20 ORDER BY ch, category LIMIT 1""",
    dec="change_percentage total_change",
)
def _(spark, sf):
    return ins.declining_category(sales(spark, sf), "2001-03-06")


CHURN = f""", n AS (SELECT DISTINCT user_id FROM s, m WHERE {N90}), o AS (SELECT DISTINCT user_id FROM s, m WHERE {O90}),
 x AS (SELECT user_id FROM o EXCEPT SELECT user_id FROM n)"""


@register(
    "n14_churn_90d",
    S + CHURN + """, r AS (SELECT (SELECT count(*) FROM o) AS older_users, (SELECT count(*) FROM x) AS churned_users)
    SELECT *, 100.0 * churned_users / older_users AS churn_rate, 100.0 * churned_users / older_users > 70 AS alert FROM r""",
    dec="churn_rate",
)
def _(spark, sf):
    return ins.churn_90d(sales(spark, sf))


@register("n15_churned_top_category", S + CHURN + " SELECT category, sum(total_price) AS sales FROM s WHERE user_id IN (SELECT user_id FROM x) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", dec="sales:4")
def _(spark, sf):
    return ins.churned_top_category(sales(spark, sf))


@register(
    "n16_cross_sell_pairs",
    S + """, u AS (SELECT DISTINCT user_id, category FROM s) SELECT a.category AS category1, b.category AS category2, count(*) AS users FROM u a JOIN u b
    ON a.user_id = b.user_id AND a.category < b.category GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""",
)
def _(spark, sf):
    return ins.cross_sell_pairs(sales(spark, sf), 10)


@register(
    "n17_price_dispersion",
    """SELECT * FROM (SELECT p_type, avg(l_extendedprice) AS mean_price, stddev_samp(l_extendedprice) AS std_price, stddev_samp(l_extendedprice) / avg(l_extendedprice) AS dispersion
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE dispersion > 0.5""",
    dec="mean_price:4 std_price:4 dispersion",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice").join(
        table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    return ins.price_dispersion(df, "l_extendedprice", "p_type")


EV = """SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value, user_id % 30 AS u, event_type, CASE WHEN event_id % 50 = 0 THEN 'y' ELSE 'x' END AS flag FROM events"""


def ev(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value", "user_id % 30 AS u", "event_type",
        "CASE WHEN event_id % 50 = 0 THEN 'y' ELSE 'x' END AS flag",
    )


def rule(sel, r, subject, metric, threshold, severity):
    return f"SELECT '{r}' AS rule, {subject} AS subject, '{metric}' AS metric, v AS value, CAST({threshold} AS DOUBLE) AS threshold, {severity} AS severity FROM ({sel})"


MISS = "SELECT 100.0 * (count(*) - count(value)) / count(*) AS v FROM e"


@register(
    "n18_quality_insights",
    f"WITH e AS ({EV}), f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM e) "
    + " UNION ALL ".join(
        [
            rule(f"SELECT * FROM ({MISS}) WHERE v > 5", "high_missing", "'value'", "missing_percentage", 5, "'warning'"),
            rule("SELECT * FROM (SELECT 100.0 * sum(n - 1) / sum(n) AS v FROM (SELECT count(*) AS n FROM e GROUP BY value, u, event_type, flag)) WHERE v > 5", "duplicates", "'rows'", "duplicate_percentage", 5, "'warning'"),
            rule("SELECT * FROM (SELECT 100.0 * count(*) FILTER (flag = 'x') / count(*) AS v FROM e) WHERE v > 90", "dominant_category", "'flag=x'", "percentage", 90, "'warning'"),
            rule("SELECT * FROM (SELECT 100.0 * count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(value) AS v FROM e, f) WHERE v > 5", "high_outliers", "'value'", "outlier_percentage", 5, "'warning'"),
        ]
    ),
    dec="value threshold",
)
def _(spark, sf):
    return ins.quality_insights(ev(spark, sf))


LQ = """SELECT l_quantity AS q, l_extendedprice AS p, l_extendedprice * (1 - l_discount) AS net, l_tax * l_tax * l_tax * l_tax AS t4,
 CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE l_discount END AS d FROM lineitem"""


@register(
    "n19_basic_insights",
    f"WITH e AS ({LQ}), c AS (SELECT unnest(['q~p', 'q~net', 'p~net']) AS s, unnest([abs(corr(q, p)), abs(corr(q, net)), abs(corr(p, net))]) AS v FROM e), k AS (SELECT unnest(['q', 'p', 'net', 't4', 'd']) AS s, unnest([skewness(q), skewness(p), skewness(net), skewness(t4), skewness(d)]) AS v FROM e) "
    + " UNION ALL ".join(
        [
            rule("SELECT * FROM (SELECT 100.0 * (count(*) - count(d)) / count(*) AS v FROM e) WHERE v > 5", "high_missing", "'d'", "missing_percentage", 5, "'info'"),
            rule("SELECT * FROM c WHERE v > 0.7 AND v < 1", "high_correlation", "s", "abs_correlation", 0.7, "'info'"),
            rule("SELECT * FROM k WHERE abs(v) > 1", "skewed", "s", "skewness", 1, "CASE WHEN v > 0 THEN 'right' ELSE 'left' END"),
        ]
    ),
    dec="value:5 threshold",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_quantity AS q", "l_extendedprice AS p", "l_extendedprice * (1 - l_discount) AS net", "l_tax * l_tax * l_tax * l_tax AS t4",
        "CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE l_discount END AS d",
    )
    return ins.basic_insights(df)


MONTHS = ", mo AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, sum(total_price) AS sales, count(order_id) AS orders FROM s GROUP BY 1) "
LAST = ", l AS (SELECT month, {v} AS current, lag({v}) OVER (ORDER BY month) AS previous FROM mo ORDER BY month DESC LIMIT 1), g AS (SELECT *, 100.0 * (current - previous) / previous AS change_percentage FROM l) "


@register(
    "n20_monthly_sales_change",
    S + MONTHS + LAST.format(v="sales") + "SELECT *, CASE WHEN change_percentage > 10 THEN 'strong_growth' WHEN change_percentage > 5 THEN 'growth' WHEN change_percentage < -10 THEN 'strong_decline' WHEN change_percentage < -5 THEN 'decline' END AS band FROM g",
    dec="current:4 previous:4 change_percentage",
)
def _(spark, sf):
    return ins.monthly_sales_change(sales(spark, sf))


@register(
    "n21_top_category_shift",
    S + f""", c AS (SELECT category, sum(total_price) AS a, sum(total_price) FILTER ({N90}) AS r FROM s, m GROUP BY 1)
    SELECT arg_max(category, a) AS top_category, 100.0 * max(a) / sum(a) AS top_percentage, arg_max(category, r) AS recent_top_category, arg_max(category, a) <> arg_max(category, r) AS shifted FROM c""",
    dec="top_percentage",
)
def _(spark, sf):
    return ins.top_category_shift(sales(spark, sf))


@register(
    "n22_category_growth",
    S + change_sql(N90, O90) + """ SELECT 'fastest_growing' AS rule, category, ch AS change_percentage FROM (SELECT * FROM g ORDER BY ch DESC, category LIMIT 1) WHERE ch > 30
    UNION ALL SELECT 'steepest_decline', category, ch FROM (SELECT * FROM g ORDER BY ch, category LIMIT 1) WHERE ch < -20""",
    dec="change_percentage",
)
def _(spark, sf):
    return ins.category_growth(sales(spark, sf))


@register("n23_repeat_rate", O + ", u AS (SELECT count(*) AS n FROM s GROUP BY user_id) SELECT count(*) AS users, count(*) FILTER (n > 1) AS repeat_users, 100.0 * count(*) FILTER (n > 1) / count(*) AS repeat_rate FROM u", dec="repeat_rate")
def _(spark, sf):
    return ins.repeat_rate(orders_view(spark, sf))


@register(
    "n24_new_customer_share",
    O + f""", r AS (SELECT DISTINCT user_id FROM s, m WHERE {N30}), x AS (SELECT user_id FROM r EXCEPT SELECT user_id FROM s, m WHERE NOT ({N30})),
    q AS (SELECT (SELECT count(*) FROM r) AS recent_users, (SELECT count(*) FROM x) AS new_users)
    SELECT *, 100.0 * new_users / recent_users AS new_percentage, CASE WHEN 100.0 * new_users / recent_users > 30 THEN 'many_new' WHEN 100.0 * new_users / recent_users < 10 THEN 'few_new' END AS band FROM q""",
    dec="new_percentage",
)
def _(spark, sf):
    return ins.new_customer_share(orders_view(spark, sf))


BAND = "CASE WHEN {c} > 0 AND {c} <= 10000 THEN 'under_10k' WHEN {c} > 10000 AND {c} <= 30000 THEN '10k_30k' WHEN {c} > 30000 AND {c} <= 50000 THEN '30k_50k' WHEN {c} > 50000 AND {c} <= 100000 THEN '50k_100k' WHEN {c} > 100000 THEN 'over_100k' END"


@register(
    "n25_price_band_share",
    f"""WITH b AS (SELECT {BAND.format(c='o_totalprice')} AS band FROM orders), c AS (SELECT band, count(*) AS "count", 100.0 * count(*) / sum(count(*)) OVER () AS percentage FROM b WHERE band IS NOT NULL GROUP BY 1)
    SELECT *, CASE WHEN band = 'over_100k' AND percentage > 25 THEN 'many_expensive' WHEN band = 'under_10k' AND percentage > 40
    AND coalesce((SELECT percentage FROM c WHERE band = 'over_100k'), 0) <= 25 THEN 'many_cheap' END AS flag FROM c""",
    dec="percentage",
)
def _(spark, sf):
    return ins.price_band_share(orders_view(spark, sf))


@register(
    "n26_monthly_aov_change",
    S + MONTHS + LAST.format(v="sales / orders") .replace("lag(sales / orders)", "lag(sales / orders)") + "SELECT *, CASE WHEN change_percentage > 10 THEN 'rise' WHEN change_percentage < -10 THEN 'fall' END AS band FROM g",
    dec="current:5 previous:5 change_percentage",
)
def _(spark, sf):
    return ins.monthly_aov_change(sales(spark, sf))


PART = "CASE WHEN hour(ts) <= 5 THEN 'night' WHEN hour(ts) <= 10 THEN 'morning' WHEN hour(ts) <= 14 THEN 'lunch' WHEN hour(ts) <= 18 THEN 'afternoon' WHEN hour(ts) <= 22 THEN 'evening' ELSE 'night' END"


@register(
    "n27_peak_weekday_daypart",
    f"""WITH w AS (SELECT dayname(ts) AS d, isodow(ts) AS i, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT {PART} AS p, count(*) AS n FROM events GROUP BY 1)
    SELECT * FROM (SELECT d AS peak_weekday, n AS weekday_orders FROM w ORDER BY n DESC, i LIMIT 1), (SELECT p AS peak_daypart, n AS daypart_orders FROM p ORDER BY n DESC, p LIMIT 1)""",
)
def _(spark, sf):
    return ins.peak_weekday_daypart(table(spark, sf, "events"), "ts")


@register(
    "n28_season_ratio",
    """WITH s AS (SELECT CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' WHEN month(o_orderdate) IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS s,
    count(*) AS n FROM orders GROUP BY 1) SELECT arg_max(s, n) AS top_season, arg_min(s, n) AS bottom_season, max(n) AS top_orders, min(n) AS bottom_orders, max(n) / min(n) AS ratio, max(n) / min(n) > 1.5 AS is_seasonal FROM s""",
    dec="ratio",
)
def _(spark, sf):
    return ins.season_ratio(orders_view(spark, sf))


@register(
    "n29_segment_contribution",
    O + "," + ORDER_STATS + f""", u AS (SELECT user_id, {SEG} AS user_segment FROM st), j AS (SELECT user_segment, sum(total_price) AS sales, count(*) AS row_count FROM s JOIN u USING (user_id) GROUP BY 1)
    SELECT user_segment, sales, row_count, 100.0 * sales / sum(sales) OVER () AS sales_percentage, 100.0 * row_count / sum(row_count) OVER () AS row_percentage,
    user_segment = 'at_risk_customers' AND 100.0 * row_count / sum(row_count) OVER () > 30 AS alert FROM j""",
    dec="sales:2 sales_percentage row_percentage",
)
def _(spark, sf):
    df = orders_view(spark, sf)
    now = op.as_of_date(df)
    seg = op.user_segment(op.user_stats(df, now), now).select("user_id", "user_segment")
    return ins.segment_contribution(df.join(seg, "user_id"))


@register("n30_best_sellers", S + "SELECT product_id, sum(total_price) AS revenue, min(product_name) AS product_name FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", dec="revenue:4")
def _(spark, sf):
    return ins.best_sellers(sales(spark, sf))


@register(
    "n31_trend_strength",
    """WITH e AS (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS q, avg(l_orderkey) AS o FROM lineitem GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY d) AS i FROM e),
    r AS (SELECT 'l_quantity' AS "column", corr(i, q) AS correlation FROM i UNION ALL SELECT 'l_orderkey', corr(i, o) FROM i)
    SELECT *, CASE WHEN correlation > 0.7 THEN 'up' WHEN correlation < -0.7 THEN 'down' ELSE 'none' END AS direction FROM r""",
    dec="correlation",
)
def _(spark, sf):
    return ins.trend_strength(table(spark, sf, "lineitem"), "l_shipdate", ["l_quantity", "l_orderkey"])


def on_sales(name):
    return ORACLES[name].replace(ORDERS_SQL, SALES_SQL)


def topic(sql, rule, subject, metric, value, threshold, name, where="TRUE"):
    return f"""SELECT '{rule}' AS rule, CAST({subject} AS VARCHAR) AS subject, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value, CAST({threshold} AS DOUBLE) AS threshold,
     'info' AS severity, '{name}' AS topic FROM ({sql}) WHERE {where}"""


PEAK = S + """ SELECT (SELECT dayname(order_date) AS d FROM s GROUP BY dayname(order_date), isodow(order_date) ORDER BY count(*) DESC, isodow(order_date) LIMIT 1) || ' night' AS x,
 (SELECT count(*) AS n FROM s GROUP BY isodow(order_date) ORDER BY n DESC LIMIT 1) AS n"""
SEASON = ORACLES["n28_season_ratio"].replace("o_orderdate", "order_date").replace("FROM orders", f"FROM {SALES_SQL}").replace("l_orderkey = order_date", "l_orderkey = o_orderkey")


@register(
    "n32_business_insights_topics",
    " UNION ALL ".join(
        [
            topic(ORACLES["n20_monthly_sales_change"], "monthly_sales_change", "band", "change_percentage", "change_percentage", 5, "sales", "band IS NOT NULL"),
            topic(ORACLES["n26_monthly_aov_change"], "monthly_aov_change", "band", "change_percentage", "change_percentage", 10, "sales", "band IS NOT NULL"),
            topic(on_sales("n23_repeat_rate"), "repeat_rate", "'users'", "repeat_rate", "repeat_rate", "NULL", "customer"),
            topic(on_sales("n24_new_customer_share"), "new_customer_share", "band", "new_percentage", "new_percentage", 30, "customer", "band IS NOT NULL"),
            topic(ORACLES["n21_top_category_shift"], "top_category", "recent_top_category", "top_percentage", "top_percentage", "NULL", "product"),
            topic(ORACLES["n22_category_growth"], "category_growth", "category", "change_percentage", "change_percentage", 30, "product"),
            topic(ORACLES["n25_price_band_share"].replace("o_totalprice", "total_price").replace("FROM orders", f"FROM {SALES_SQL}"), "price_band", "band", "percentage", "percentage", 25, "product", "flag IS NOT NULL"),
            topic(PEAK, "peak_time", "x", "weekday_orders", "n", "NULL", "time"),
            topic(SEASON, "season_ratio", "top_season", "ratio", "ratio", 1.5, "time", "is_seasonal"),
            topic(ORACLES["n30_best_sellers"] + " ORDER BY revenue DESC LIMIT 1", "best_seller", "product_id", "revenue", "revenue", "NULL", "product"),
        ]
    ),
    dec="value:4 threshold",
)
def _(spark, sf):
    return ins.business_insights(sales(spark, sf))
