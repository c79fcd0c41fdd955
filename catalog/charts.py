"""Queries of section I: chart data."""

from pyspark.sql import functions as F

from brightlake.operators import chartdata as op
from catalog.base import register, table

@register(
    "i1_top_groups_other",
    """WITH t AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, CAST(l_suppkey AS VARCHAR) LIMIT 19)
    SELECT CASE WHEN l_suppkey IN (FROM t) THEN CAST(l_suppkey AS VARCHAR) ELSE 'other' END AS supp, count(*) AS n FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("supp"))
    return op.top_groups_other(df, "supp", 20).groupBy("supp").agg(F.count(F.lit(1)).alias("n"))


@register(
    "i2_bounded_sample",
    "SELECT least(2000, count(*)) AS n, least(2000, count(*)) AS distinct_rows FROM events",
)
def _(spark, sf):
    s = op.bounded_sample(table(spark, sf, "events").select("event_id", "value"), 2000, ["event_id"])
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("distinct_rows"))


def hist_sql(c, t, bins):
    return f"""WITH e AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}), b AS (SELECT CAST(least(floor(({c} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INT) AS bin, count(*) AS n FROM {t}, e GROUP BY 1)
     SELECT CAST(i AS INT) AS bin, lo + i * ((hi - lo) / {bins}) AS bin_start, lo + (i + 1) * ((hi - lo) / {bins}) AS bin_end, coalesce(n, 0) AS "count"
     FROM (SELECT unnest(range({bins})) AS i) LEFT JOIN b ON bin = i, e"""


@register("i3_histogram", hist_sql("l_extendedprice", "lineitem", 30), dec="bin_start bin_end")
def _(spark, sf):
    return op.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30)


@register("i3_histogram_few_values", hist_sql("l_linenumber", "lineitem", 10), dec="bin_start bin_end")
def _(spark, sf):
    return op.histogram(table(spark, sf, "lineitem"), "l_linenumber", 30)


@register(
    "i4_kde_curve",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events),
    b AS (SELECT least(floor((value - lo) / ((hi - lo) / 512)), 511) AS bin, count(*) AS c FROM events, e GROUP BY 1),
    k AS (SELECT lo + (bin + 0.5) * ((hi - lo) / 512) AS m, c FROM b, e),
    g AS (SELECT lo + i * ((hi - lo) / 199) AS x FROM e, (SELECT unnest(range(200)) AS i)),
    d AS (SELECT x, sum(c * exp(-0.5 * pow((x - m) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM g, k, e GROUP BY x)
    SELECT x, density, density * n * (hi - lo) / 30 AS scaled FROM d, e""",
    dec="x density:9 scaled:5",
)
def _(spark, sf):
    return op.kde_curve(table(spark, sf, "events"), "value", 30, 200)


BOX = """WITH q AS (SELECT {g} AS g, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {t} GROUP BY 1),
 r AS (SELECT {g} AS g, {c} AS v FROM {t})
 SELECT r.g AS {n}, count(*) AS "count", any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3, min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
 max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high, min(v) AS min, max(v) AS max,
 count(*) FILTER (v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM r JOIN q ON r.g = q.g GROUP BY 1"""
BDEC = "q1:4 median:4 q3:4 whisker_low:2 whisker_high:2 min:2 max:2"


@register("i5_box_summary", BOX.format(g="event_type", c="value", t="events", n="event_type"), dec=BDEC)
def _(spark, sf):
    return op.box_summary(table(spark, sf, "events"), "value", "event_type", max_groups=8)


@register("i5_box_summary_all", BOX.format(g="'all'", c="l_extendedprice", t="lineitem", n='"group"'), dec=BDEC)
def _(spark, sf):
    return op.box_summary(table(spark, sf, "lineitem"), "l_extendedprice")


@register("i6_bar_counts", 'SELECT p_brand, count(*) AS "count" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
def _(spark, sf):
    return op.bar_counts(table(spark, sf, "part"), "p_brand", top_n=10)


@register("i6_bar_counts_by_name", 'SELECT p_brand, count(*) AS "count" FROM part GROUP BY 1 ORDER BY 1 LIMIT 10')
def _(spark, sf):
    return op.bar_counts(table(spark, sf, "part"), "p_brand", "name", True, 10)


PIE = """WITH t AS (SELECT {g} AS c, CAST({a} AS DOUBLE) AS a FROM {t} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY a DESC, c) AS r FROM t),
 x AS (SELECT CASE WHEN r <= {k} THEN c ELSE 'other' END AS category, sum(a) AS amount FROM r GROUP BY 1) SELECT *, 100.0 * amount / sum(amount) OVER () AS percentage FROM x"""


@register("i7_pie_shares", PIE.format(g="p_brand", a="count(*)", t="part", k=7), dec="amount percentage")
def _(spark, sf):
    return op.pie_shares(table(spark, sf, "part"), "p_brand")


@register("i7_pie_shares_values", PIE.format(g="p_brand", a="sum(p_retailprice)", t="part", k=8), dec="amount:2 percentage")
def _(spark, sf):
    return op.pie_shares(table(spark, sf, "part"), "p_brand", "p_retailprice", top_n=8, keep=8)


@register(
    "i8_linear_trend",
    """SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
    min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem""",
    dec="slope:5 intercept:4 x_min x_max",
)
def _(spark, sf):
    return op.linear_trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@register(
    "i9_quadratic_trend",
    """WITH st AS (SELECT l_returnflag AS g, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, count(*) AS n, min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem GROUP BY 1),
    z AS (SELECT g, (l_quantity - m) / s AS z, l_extendedprice AS y FROM lineitem JOIN st ON g = l_returnflag),
    o AS (SELECT g, z, y, z * z - 1 - regr_slope(z * z, z) OVER (PARTITION BY g) * z AS u FROM z),
    f AS (SELECT g, sum(u * y) / sum(u * u) AS k2, regr_slope(z * z, z) AS sl, regr_slope(y, z) AS s1, avg(y) AS ym FROM o GROUP BY g)
    SELECT l.g AS l_returnflag, n, k2 / (s * s) AS a, (s1 - k2 * sl) / s - 2 * k2 * m / (s * s) AS b, (ym - k2) - (s1 - k2 * sl) * m / s + k2 * m * m / (s * s) AS c, x_min, x_max
    FROM f l JOIN st ON st.g = l.g""",
    dec="a:5 b:4 c:3 x_min x_max",
)
def _(spark, sf):
    return op.quadratic_trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@register("i10_scatter_points", "SELECT least(5000, count(*)) AS n, count(DISTINCT event_type) AS colors FROM events")
def _(spark, sf):
    p = op.scatter_points(table(spark, sf, "events"), "user_id", "value", ["event_id"], 5000, "event_type")
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("colors"))


@register("i10_scatter_matrix", "SELECT least(5000, count(*)) AS n, least(5000, count(*)) AS complete FROM lineitem")
def _(spark, sf):
    m = op.scatter_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"], 5000)
    return m.agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("complete"))


DUAL = ["o_orderdate", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS cust"]


@register("i11_dual_axis", f"SELECT * FROM (SELECT {', '.join(DUAL)} FROM orders) WHERE price IS NOT NULL AND cust IS NOT NULL", dec="price:2")
def _(spark, sf):
    return op.dual_axis(table(spark, sf, "orders").selectExpr(*DUAL), "o_orderdate", "price", "cust")


@register("i12_line_series", "SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS x, o_totalprice AS y, o_orderstatus FROM orders", dec="y:2")
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr("substr(CAST(o_orderdate AS STRING), 1, 10) AS d", "o_totalprice", "o_orderstatus")
    return op.line_series(df, "d", "o_totalprice", "o_orderstatus")


@register(
    "i13_calendar_daily",
    """SELECT CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day,
    CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, sum(o_totalprice) AS amount FROM orders GROUP BY ALL""",
    dec="amount:2",
)
def _(spark, sf):
    return op.calendar_daily(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@register(
    "i14_calendar_weekly",
    "WITH w AS (SELECT date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS s, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(year(s) AS INT) AS year, "
    + ", ".join(f"CAST(sum(n) FILTER (weekofyear(s) = {i}) AS DOUBLE) AS w{i:02d}" for i in range(1, 54))
    + " FROM w GROUP BY 1",
)
def _(spark, sf):
    return op.calendar_weekly(table(spark, sf, "orders"), "o_orderdate")


@register(
    "i15_calendar_monthly",
    "SELECT CAST(year(o_orderdate) AS INT) AS year, " + ", ".join(f"sum(o_totalprice) FILTER (month(o_orderdate) = {i}) AS m{i:02d}" for i in range(1, 13)) + " FROM orders GROUP BY 1",
    dec=" ".join(f"m{i:02d}:2" for i in range(1, 13)),
)
def _(spark, sf):
    return op.calendar_monthly(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@register("i16_radar_means", "SELECT l_shipdate IS NULL AS x, l_returnflag, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY ALL", dec="l_quantity l_discount l_tax")
def _(spark, sf):
    return op.radar_means(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"]).withColumn("x", F.lit(False))


@register(
    "i17_geo_points",
    "SELECT CAST(s_suppkey % 180 - 90 AS DOUBLE) AS lat, s_acctbal AS lon, s_name FROM supplier WHERE s_suppkey % 9 <> 0",
    dec="lat lon:2",
)
def _(spark, sf):
    df = table(spark, sf, "supplier").selectExpr(
        "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 180 - 90 AS DOUBLE) END AS lat", "s_acctbal AS lon", "s_name"
    )
    return op.geo_points(df, "lat", "lon", ["s_name"])


@register("i18_frequency_of_frequency", "SELECT n AS orders, count(*) AS users FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1")
def _(spark, sf):
    return op.frequency_of_frequency(table(spark, sf, "orders"), "o_custkey")


for _unit, _name in (("D", "day"), ("W", "week"), ("M", "month")):

    def _make(unit=_unit, name=_name):
        @register(
            f"i19_period_sales_{name}",
            f"SELECT CAST(date_trunc('{name}', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS amount FROM orders GROUP BY 1",
            dec="amount:2",
        )
        def _(spark, sf):
            return op.period_sales(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", unit)

    _make()
