"""Queries of sections F and G: relationships and tests."""

from itertools import combinations

from brightlake.operators import inference as inf
from brightlake.operators import relate as op
from catalog.base import register, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line(spark, sf, extra=()):
    return table(spark, sf, "lineitem").select(*NUM, *extra)


def matrix(pair, names, diag="1.0"):
    parts = [f"SELECT '{c}' AS var1, '{c}' AS var2, CAST({diag} AS DOUBLE) AS correlation" for c in names]
    for a, b in combinations(names, 2):
        parts += [f"SELECT '{x}', '{y}', ({pair.format(a=a, b=b)})" for x, y in ((a, b), (b, a))]
    return " UNION ALL ".join(parts)


@register("f1_correlation_pearson", matrix("SELECT corr({a}, {b}) FROM lineitem", NUM), dec="correlation")
def _(spark, sf):
    return op.correlation(line(spark, sf))


def rank(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@register("f2_correlation_spearman", matrix("SELECT corr(x, y) FROM (SELECT " + rank("{a}") + " AS x, " + rank("{b}") + " AS y FROM lineitem)", NUM), dec="correlation")
def _(spark, sf):
    return op.correlation(line(spark, sf), "spearman")


TAU = """SELECT s / sqrt((n0 - tx) * (n0 - ty)) FROM (SELECT sum(CAST(p.n AS DOUBLE) * q.n * sign(p.x - q.x) * sign(p.y - q.y)) / 2 AS s FROM c_{a}_{b} p, c_{a}_{b} q),
 (SELECT sum(n) * (sum(n) - 1) / 2.0 AS n0 FROM c_{a}_{b}), (SELECT sum(m * (m - 1) / 2.0) AS tx FROM (SELECT sum(n) AS m FROM c_{a}_{b} GROUP BY x)),
 (SELECT sum(m * (m - 1) / 2.0) AS ty FROM (SELECT sum(n) AS m FROM c_{a}_{b} GROUP BY y))"""
KEN = ["l_quantity", "l_discount", "l_tax"]


@register(
    "f3_correlation_kendall",
    "WITH " + ", ".join(f"c_{a}_{b} AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM lineitem GROUP BY 1, 2)" for a, b in combinations(KEN, 2)) + " " + matrix(TAU, KEN),
    dec="correlation",
)
def _(spark, sf):
    return op.correlation(line(spark, sf), "kendall", KEN)


@register(
    "f4_high_corr_pairs",
    "WITH w AS (SELECT *, l_extendedprice * (1 - l_discount) AS net, -l_quantity * l_quantity AS q2 FROM lineitem) SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS correlation FROM w" for a, b in combinations(["l_quantity", "l_extendedprice", "net", "q2"], 2)
    )
    + ") WHERE abs(correlation) >= 0.7",
    dec="correlation",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net", "-l_quantity * l_quantity AS q2"
    )
    return op.high_corr_pairs(df, 0.7)


@register(
    "f5_target_correlation",
    " UNION ALL ".join(f"SELECT '{c}' AS variable, corr({c}, l_extendedprice) AS correlation, abs(corr({c}, l_extendedprice)) AS importance FROM lineitem" for c in NUM if c != "l_extendedprice"),
    dec="correlation importance",
)
def _(spark, sf):
    return op.target_correlation(line(spark, sf), "l_extendedprice")


@register("f6_heatmap_correlation", matrix("SELECT corr({a}, {b}) FROM lineitem", ["l_quantity", "l_discount"]), dec="correlation")
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_quantity", "l_discount", "CASE WHEN l_orderkey % 3 = 0 THEN l_tax END AS sparse")
    return op.heatmap_correlation(df)


@register(
    "f7_interaction_numeric",
    """SELECT 'l_quantity' AS feature1, 'l_discount' AS feature2, corr(l_quantity, l_discount) AS correlation,
    corr(l_quantity * l_discount, l_extendedprice) AS interaction_corr_with_target FROM lineitem""",
    dec="correlation interaction_corr_with_target",
)
def _(spark, sf):
    return op.interaction_numeric(line(spark, sf), "l_quantity", "l_discount", "l_extendedprice")


@register(
    "f8_interaction_mixed",
    "SELECT 'l_extendedprice' AS feature1, 'l_returnflag' AS feature2, var_samp(m) AS group_means_variance FROM (SELECT avg(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag)",
    dec="group_means_variance:4",
)
def _(spark, sf):
    return op.interaction_mixed(line(spark, sf, ["l_returnflag"]), "l_extendedprice", "l_returnflag")


# tail probabilities by Simpson's rule over the density, an independent check of the tail functions
STEPS = 20000
SIMPSON = "(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def integral(density, lo, hi):
    x = f"({lo} + ({hi} - {lo}) * i / {STEPS}.0)"
    return f"(SELECT ({hi} - {lo}) / {STEPS} / 3 * sum({SIMPSON.format(n=STEPS)} * {density.format(x=x)}) FROM (SELECT unnest(range({STEPS + 1})) AS i))"


def t_two_sided(t, v):
    d = f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - 0.5 * ln({v} * pi()) - ({v} + 1) / 2 * ln(1 + {{x}} * {{x}} / {v}))"
    return f"1 - 2 * {integral(d, '0.0', f'abs({t})')}"


def chi2_tail(c, v):
    # substituting x = u^2 keeps the density smooth at zero
    u = "greatest({x}, 1e-12)"
    d = f"2 * exp(({v} - 1) * ln({u}) - {{x}} * {{x}} / 2 - {v} / 2 * ln(2) - lgamma({v} / 2))"
    return f"1 - {integral(d, '0.0', f'sqrt({c})')}"


def f_tail(f, a, b):
    d = f"2 * {{x}} * (CASE WHEN {{x}} = 0 THEN 0 ELSE exp(lgamma(({a} + {b}) / 2) - lgamma({a} / 2) - lgamma({b} / 2) + {a} / 2 * ln({a} / {b}) + ({a} / 2 - 1) * 2 * ln({{x}}) - ({a} + {b}) / 2 * ln(1 + {a} * {{x}} * {{x}} / {b})) END)"
    return f"1 - {integral(d, '0.0', f'sqrt({f})')}"


def chi2_sql(a, b, src):
    return f"""c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS r FROM c GROUP BY 1), cb AS (SELECT b, sum(n) AS q FROM c GROUP BY 1),
     g AS (SELECT coalesce(n, 0) AS o, CAST(r AS DOUBLE) * q / (SELECT sum(n) FROM c) AS e, ((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1) AS dof FROM ra CROSS JOIN cb LEFT JOIN c ON c.a = ra.a AND c.b = cb.b),
     x AS (SELECT sum(CASE WHEN dof = 1 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) ELSE pow(o - e, 2) END / e) AS chi2, any_value(dof) AS dof FROM g)"""


@register(
    "f9_interaction_categorical",
    f"WITH {chi2_sql('o_orderstatus', 'o_orderpriority', 'orders')} SELECT 'o_orderstatus' AS feature1, 'o_orderpriority' AS feature2, chi2, dof, {chi2_tail('chi2', 'dof')} AS p_value FROM x",
    dec="chi2:5 p_value",
)
def _(spark, sf):
    return op.interaction_categorical(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


MI = """SELECT variable, greatest(0, sum(n / t * ln(n * t / (a * b)))) AS importance FROM (SELECT variable, n, sum(n) OVER (PARTITION BY variable) AS t,
 sum(n) OVER (PARTITION BY variable, v) AS a, sum(n) OVER (PARTITION BY variable, y) AS b FROM (SELECT variable, v, y, CAST(count(*) AS DOUBLE) AS n FROM u GROUP BY ALL)) GROUP BY 1"""


@register(
    "f10_mutual_information",
    "WITH q AS (SELECT " + ", ".join(f"list_distinct(quantile_cont({c}, [0.2, 0.4, 0.6, 0.8])) AS e_{c}" for c in NUM[:3]) + " FROM lineitem), u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST(len(list_filter(e_{c}, lambda e: {c} > e)) AS VARCHAR) AS v, l_returnflag AS y FROM lineitem, q" for c in NUM[:3])
    + " UNION ALL SELECT 'l_linestatus', l_linestatus, l_returnflag FROM lineitem) " + MI,
    dec="importance:8",
)
def _(spark, sf):
    df = line(spark, sf, ["l_linestatus", "l_returnflag"]).drop("l_tax")
    return op.mutual_information(df, "l_returnflag", bins=5)


@register("f11_forest_importance")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_type", "p_brand", "p_size", "p_retailprice")
    return op.forest_importance(df, "p_retailprice")


# ---- tests -------------------------------------------------------------------------------------

WELCH = f"""WITH g AS (SELECT {{g}} AS g, count({{v}}) AS n, avg({{v}}) AS m, var_samp({{v}}) AS s FROM {{t}} GROUP BY 1),
 w AS (SELECT a.g AS group1, b.g AS group2, a.m AS mean1, b.m AS mean2, a.m - b.m AS mean_difference, (a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) AS t_statistic,
  pow(a.s / a.n + b.s / b.n, 2) / (pow(a.s / a.n, 2) / (a.n - 1) + pow(b.s / b.n, 2) / (b.n - 1)) AS dof FROM g a JOIN g b ON a.g < b.g),
 p AS (SELECT *, {t_two_sided('t_statistic', 'dof')} AS p_value FROM w) """


@register(
    "g1_welch_ttest",
    WELCH.format(g="l_linestatus", v="l_extendedprice", t="lineitem") + "SELECT *, CASE WHEN p_value < 0.05 THEN 'significant' ELSE 'not_significant' END AS conclusion FROM p",
    dec="mean1:4 mean2:4 mean_difference:4 t_statistic dof:3 p_value",
)
def _(spark, sf):
    return inf.welch_ttest(table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice")


ANOVA = f"""WITH g AS (SELECT {{g}} AS "group", count({{v}}) AS n, avg({{v}}) AS group_mean, var_samp({{v}}) AS s FROM {{t}} GROUP BY 1),
 a AS (SELECT count(*) AS n_groups, CAST(count(*) - 1 AS DOUBLE) AS dof_between, CAST(sum(n) - count(*) AS DOUBLE) AS dof_within,
  (sum(n * pow(group_mean - (SELECT sum(n * group_mean) / sum(n) FROM g), 2)) / (count(*) - 1)) / (sum((n - 1) * s) / (sum(n) - count(*))) AS f_statistic FROM g),
 p AS (SELECT *, {f_tail('f_statistic', 'dof_between', 'dof_within')} AS p_value FROM a) """


@register(
    "g2_anova",
    ANOVA.format(g="o_orderpriority", v="o_totalprice", t="orders")
    + """SELECT "group", n, group_mean, n_groups, f_statistic, dof_between, dof_within, p_value, CASE WHEN p_value < 0.05 THEN 'significant' ELSE 'not_significant' END AS conclusion FROM g, p""",
    dec="group_mean:4 f_statistic dof_between dof_within p_value",
)
def _(spark, sf):
    return inf.anova(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


def chi2_full(a, b, src):
    return f"""WITH {chi2_sql(a, b, src)}, p AS (SELECT *, {chi2_tail('chi2', 'dof')} AS p_value FROM x)
    SELECT '{a}' AS var1, '{b}' AS var2, chi2, dof, p_value, CASE WHEN p_value < 0.05 THEN 'significant' ELSE 'not_significant' END AS conclusion FROM p"""


@register("g3_chi2_independence", chi2_full("l_returnflag", "l_linestatus", "lineitem"), dec="chi2:5 p_value")
def _(spark, sf):
    return inf.chi2_independence(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


TWO = "(SELECT CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'N' END AS s, CASE WHEN o_orderpriority < '3' THEN 'hi' ELSE 'lo' END AS p FROM orders)"


@register("g3_chi2_yates", chi2_full("s", "p", TWO), dec="chi2:6 p_value")
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'N' END AS s", "CASE WHEN o_orderpriority < '3' THEN 'hi' ELSE 'lo' END AS p"
    )
    return inf.chi2_independence(df, "s", "p")


K2 = """SELECT '{c}' AS "column", n AS sample_size, skewness, kurtosis, mean, std, median, pow(zs, 2) + pow(zk, 2) AS statistic, exp(-(pow(zs, 2) + pow(zk, 2)) / 2) AS p_value, exp(-(pow(zs, 2) + pow(zk, 2)) / 2) > 0.05 AS is_normal FROM (
 SELECT *, asinh(y * sqrt((w2 - 1) / 2)) / sqrt(ln(w2) / 2) AS zs, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk FROM (
 SELECT *, sqrt(2 * (be - 1)) - 1 AS w2, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) AS a FROM (
 SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS be,
  (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rt FROM (
 SELECT count({c})::DOUBLE AS n, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, avg({c}) AS mean, stddev_samp({c}) AS std, median({c}) AS median,
  skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)) AS g1, kurtosis_pop({c}) AS g2 FROM {t}))))"""


@register(
    "g4_normality_k2",
    "SELECT * REPLACE (CAST(sample_size AS BIGINT) AS sample_size) FROM (" + " UNION ALL ".join(K2.format(c=c, t="customer") for c in ["c_acctbal"]) + ")",
    dec="skewness kurtosis mean:4 std:4 median:3 statistic:4 p_value",
)
def _(spark, sf):
    return inf.normality_k2(table(spark, sf, "customer"), ["c_acctbal"])


@register(
    "g5_uniformity_ks",
    """WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, CAST(count(*) AS DOUBLE) AS n FROM customer), s AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) AS i FROM customer),
    c AS (SELECT v, max(i) AS i, min(i) - 1 AS j FROM s GROUP BY v), d AS (SELECT greatest(abs(i / n - (floor((v - lo) / (hi - lo) * (n - 1)) + 1) / n), abs(j / n - ceil((v - lo) / (hi - lo) * (n - 1)) / n)) AS d, n FROM c, e),
    k AS (SELECT CAST(any_value(n) AS BIGINT) AS sample_size, max(d) AS statistic FROM d),
    p AS (SELECT *, (SELECT 2 * sum(pow(-1, j - 1) * exp(-2 * j * j * statistic * statistic * sample_size / 2)) FROM (SELECT unnest(range(1, 101)) AS j)) AS p0 FROM k)
    SELECT 'c_acctbal' AS "column", sample_size, statistic, least(1, greatest(0, p0)) AS p_value, least(1, greatest(0, p0)) > 0.05 AS is_uniform FROM p""",
    dec="statistic p_value",
)
def _(spark, sf):
    return inf.uniformity_ks(table(spark, sf, "customer"), "c_acctbal")


@register(
    "g6_qq_points",
    "SELECT unnest(range(1, 100)) / 100.0 AS prob, unnest(quantile_cont(l_extendedprice, [" + ", ".join(f"{i / 100}" for i in range(1, 100)) + "])) AS sample FROM lineitem",
    dec="prob sample:4",
)
def _(spark, sf):
    return inf.qq_points(table(spark, sf, "lineitem"), "l_extendedprice").select("prob", "sample")


@register("g6_qq_line")
def _(spark, sf):
    return inf.qq_points(table(spark, sf, "lineitem"), "l_extendedprice")


@register("g7_normality_flags", "SELECT * FROM (VALUES ('l_quantity', FALSE), ('l_extendedprice', FALSE), ('l_discount', FALSE), ('l_tax', FALSE)) t(\"column\", is_normal)")
def _(spark, sf):
    from brightlake.operators.profile import basic_stats

    return basic_stats(table(spark, sf, "lineitem"), NUM).select("column", "is_normal")


@register(
    "g8_significance_two_groups",
    WELCH.format(g="l_linestatus", v="l_quantity", t="lineitem") + "SELECT 'welch_t' AS test, CAST(2 AS BIGINT) AS n_groups, t_statistic AS statistic, p_value, CASE WHEN p_value < 0.05 THEN 'significant' ELSE 'not_significant' END AS conclusion FROM p",
    dec="statistic p_value",
)
def _(spark, sf):
    return inf.significance(table(spark, sf, "lineitem"), "l_linestatus", "l_quantity")


@register(
    "g8_significance_many_groups",
    ANOVA.format(g="c_mktsegment", v="c_acctbal", t="customer") + "SELECT 'anova' AS test, n_groups, f_statistic AS statistic, p_value, CASE WHEN p_value < 0.05 THEN 'significant' ELSE 'not_significant' END AS conclusion FROM p",
    dec="statistic p_value",
)
def _(spark, sf):
    return inf.significance(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
