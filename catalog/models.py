"""Queries of sections L and M: features, components, clusters, models."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from brightlake.operators import cluster as cl
from brightlake.operators import model as ml
from brightlake.operators import reduce as red
from catalog.base import register, table

PART = ["p_size", "p_retailprice"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def std(c, t, n=None):
    return f"({c} - (SELECT avg({c}) FROM {t})) / (SELECT stddev_pop({c}) FROM {t})"


@register(
    "l1_feature_matrix",
    f"""WITH g AS (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END, (SELECT median(CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END) FROM part)) AS s, p_retailprice FROM part)
    SELECT p_partkey, {std('s', 'g')} AS f1, {std('p_retailprice', 'g')} AS f2 FROM g""",
    dec="f1 f2",
)
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS p_size", "p_retailprice")
    x = vector_to_array("features")
    return red.feature_matrix(df, PART).select("p_partkey", x[0].alias("f1"), x[1].alias("f2"))


@register(
    "l2_pca_two_columns",
    f"""WITH r AS (SELECT sign(corr(p_size, p_retailprice)) AS s FROM part), z AS (SELECT p_name, p_brand, p_type, {std('p_size', 'part')} AS a, {std('p_retailprice', 'part')} AS b FROM part)
    SELECT p_name, p_brand, p_type, abs((a + s * b) / sqrt(2)) AS pc1_abs, abs((a - s * b) / sqrt(2)) AS pc2_abs FROM z, r""",
    dec="pc1_abs pc2_abs",
)
def _(spark, sf):
    df = table(spark, sf, "part").select("p_name", "p_brand", "p_type", *PART)
    return red.pca(df, 2, PART).select("p_name", "p_brand", "p_type", F.abs("PC1").alias("pc1_abs"), F.abs("PC2").alias("pc2_abs"))


@register("l2_pca_scores")
def _(spark, sf):
    return red.pca(table(spark, sf, "lineitem").select("l_returnflag", *LINE), 2, LINE)


@register("l3_biplot_loadings")
def _(spark, sf):
    return red.biplot_loadings(table(spark, sf, "lineitem"), 0.7, LINE)


@register("l4_pca_importance")
def _(spark, sf):
    return red.pca_importance(table(spark, sf, "lineitem"), 2, LINE)


@register(
    "l5_optimal_components_two_columns",
    """WITH r AS (SELECT abs(corr(p_size, p_retailprice)) AS r FROM part) SELECT CAST(1 AS INT) AS n_components, (1 + r) / 2 AS explained_variance_ratio, (1 + r) / 2 AS cumulative_variance_ratio,
    (1 + r) / 2 >= 0.95 AS is_optimal FROM r UNION ALL SELECT 2, (1 - r) / 2, 1.0, (1 + r) / 2 < 0.95 FROM r""",
    dec="explained_variance_ratio cumulative_variance_ratio",
)
def _(spark, sf):
    return red.optimal_components(table(spark, sf, "part"), 0.95, columns=PART)


@register("l5_optimal_components")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select(*[F.element_at("embedding", i + 1).alias(f"e{i}") for i in range(64)])
    return red.optimal_components(df, 0.95)


@register("l6_component_interpretation")
def _(spark, sf):
    return red.component_interpretation(table(spark, sf, "lineitem"), 2, 3, LINE)


@register("l7_kmeans")
def _(spark, sf):
    return cl.kmeans(table(spark, sf, "part").select("p_partkey", *PART), 3, PART)


@register("l7_kmeans_centres")
def _(spark, sf):
    return cl.kmeans_centres(table(spark, sf, "lineitem"), 3, LINE[:2])


@register("l8_optimal_k")
def _(spark, sf):
    return cl.optimal_k(table(spark, sf, "lineitem"), method="elbow", columns=LINE[:2])


METRICS = """WITH l AS (SELECT CAST(floor(p_size / 13) AS INT) - 1 AS g, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y FROM part),
 c AS (SELECT g, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM l GROUP BY g),
 d AS (SELECT l.g, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM l JOIN c ON l.g = c.g), s AS (SELECT g, avg(d) AS s, sum(d * d) AS w FROM d GROUP BY g),
 o AS (SELECT avg(x) AS ox, avg(y) AS oy, count(*) AS t FROM l), k AS (SELECT count(*) AS k FROM c),
 b AS (SELECT sum(n * (pow(cx - ox, 2) + pow(cy - oy, 2))) AS b FROM c, o),
 db AS (SELECT avg(m) AS db FROM (SELECT a.g, max((sa.s + sb.s) / sqrt(pow(a.cx - z.cx, 2) + pow(a.cy - z.cy, 2))) AS m FROM c a JOIN c z ON a.g <> z.g JOIN s sa ON sa.g = a.g JOIN s sb ON sb.g = z.g GROUP BY a.g))
 SELECT (b / (k - 1)) / ((SELECT sum(w) FROM s) / (t - k)) AS calinski_harabasz, db AS davies_bouldin, CAST(k AS INT) AS n_clusters, (SELECT n FROM c WHERE g = -1) AS n_noise,
 100.0 * (SELECT n FROM c WHERE g = -1) / t AS noise_percentage FROM b, k, o, db"""


def labelled(spark, sf):
    return table(spark, sf, "part").selectExpr("CAST(floor(p_size / 13) AS INT) - 1 AS g", "CAST(p_size AS DOUBLE) AS x", "p_retailprice / 100 AS y", "p_type", "p_brand")


@register("l9_cluster_metrics", METRICS, dec="calinski_harabasz:5 davies_bouldin noise_percentage")
def _(spark, sf):
    return cl.cluster_metrics(labelled(spark, sf), "g", ["x", "y"]).drop("silhouette_squared")


@register("l9_cluster_sizes", "SELECT CAST(floor(p_size / 13) AS INT) - 1 AS g, count(*) AS size FROM part GROUP BY 1")
def _(spark, sf):
    return cl.cluster_sizes(labelled(spark, sf), "g")


@register(
    "l9_silhouette_squared",
    """WITH l AS (SELECT p_partkey AS r, CAST(floor(p_size / 13) AS INT) AS g, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y FROM part),
    c AS (SELECT g AS o, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(x * x + y * y) AS q FROM l GROUP BY g),
    m AS (SELECT r, g, o, n, x * x + y * y - 2 * (x * cx + y * cy) + q AS d FROM l, c),
    s AS (SELECT r, max(CASE WHEN g = o THEN d * n / (n - 1) END) AS a, min(CASE WHEN g <> o THEN d END) AS b FROM m GROUP BY r)
    SELECT avg((b - a) / greatest(a, b)) AS silhouette_squared FROM s""",
    dec="silhouette_squared",
)
def _(spark, sf):
    return cl.cluster_metrics(labelled(spark, sf), "g", ["x", "y"]).select("silhouette_squared")


@register("l12_hierarchical")
def _(spark, sf):
    return cl.hierarchical(table(spark, sf, "part").select("p_partkey", *PART), 3, PART)


# In one column the tree joins neighbouring values, and clusters end at the widest gaps.
GAPS = """v AS (SELECT DISTINCT o_totalprice AS x FROM orders),
    g AS (SELECT x, x - lag(x) OVER (ORDER BY x) AS gap FROM v),
    r AS (SELECT x, gap, row_number() OVER (ORDER BY gap DESC NULLS LAST, x DESC) AS k FROM g)"""


@register(
    "l12_single_linkage",
    f"""WITH {GAPS}, e AS (SELECT x FROM r WHERE k <= 4 AND gap IS NOT NULL)
    SELECT o_orderkey, (SELECT count(*) FROM e WHERE e.x <= o_totalprice) AS cluster FROM orders""",
)
def _(spark, sf):
    out = cl.single_linkage(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 5, ["o_totalprice"], scaler=None)
    return out.select("o_orderkey", F.col("cluster").cast("long").alias("cluster"))


@register(
    "l12_linkage_heights",
    f"WITH {GAPS} SELECT CAST(k AS INT) AS clusters, gap AS distance FROM r WHERE k <= 30 AND gap IS NOT NULL",
    dec="distance:4",
)
def _(spark, sf):
    return cl.linkage_heights(table(spark, sf, "orders"), ["o_totalprice"], scaler=None)


@register(
    "l12_linkage_two_columns",
    f"""WITH RECURSIVE p AS (SELECT s_suppkey AS id, {std('s_acctbal', 'supplier')} AS x, {std('s_nationkey', 'supplier')} AS y FROM supplier),
    d AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS far FROM p a JOIN p b ON a.id <> b.id),
    t AS (SELECT [min(id)] AS done, CAST(NULL AS DOUBLE) AS far FROM p
        UNION ALL
        SELECT list_append(n.done, n.b), n.far FROM (
            SELECT t.done, d.b, d.far, row_number() OVER (ORDER BY d.far, d.b) AS k FROM t, d
            WHERE list_contains(t.done, d.a) AND NOT list_contains(t.done, d.b)) n WHERE k = 1)
    SELECT CAST(row_number() OVER (ORDER BY far DESC) AS INT) AS clusters, far AS distance FROM t WHERE far > 0
    QUALIFY clusters <= 30""",
    dec="distance",
)
def _(spark, sf):
    return cl.linkage_heights(table(spark, sf, "supplier"), ["s_acctbal", "s_nationkey"])


@register("l13_gmm")
def _(spark, sf):
    return cl.gmm(table(spark, sf, "part").select("p_partkey", *PART), 2, PART)


@register("l14_optimal_gmm")
def _(spark, sf):
    return cl.optimal_gmm(table(spark, sf, "customer"), columns=["c_acctbal", "c_nationkey"])


@register("l15_compare_clusterers")
def _(spark, sf):
    return cl.compare_clusterers(table(spark, sf, "part"), 3, PART)


@register("l15_compare_with_dbscan")
def _(spark, sf):
    return cl.compare_clusterers(table(spark, sf, "part"), 3, PART, algorithms=("kmeans", "hierarchical", "gmm", "dbscan"), eps=0.3)


PROF = """SELECT g AS cluster, '{c}' AS "column", count(*) AS size, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
 (avg({c}) - (SELECT avg({c}) FROM l)) / (SELECT stddev_samp({c}) FROM l) AS z_score, median({c}) AS median FROM l GROUP BY g"""


@register(
    "l16_cluster_profile",
    "WITH l AS (SELECT CAST(floor(p_size / 13) AS INT) - 1 AS g, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y FROM part) " + PROF.format(c="x") + " UNION ALL " + PROF.format(c="y"),
    dec="mean std min max z_score median",
)
def _(spark, sf):
    return cl.cluster_profile(labelled(spark, sf), "g", ["x", "y"])


@register(
    "l16_cluster_categories",
    """WITH l AS (SELECT CAST(floor(p_size / 13) AS INT) - 1 AS g, p_type, p_brand FROM part), u AS (SELECT g, 'p_type' AS c, p_type AS v FROM l UNION ALL SELECT g, 'p_brand', p_brand FROM l)
    SELECT g AS cluster, c AS "column", v AS value, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY g, c) AS percentage FROM u GROUP BY 1, 2, 3""",
    dec="percentage",
)
def _(spark, sf):
    return cl.cluster_categories(labelled(spark, sf), "g")


@register("n10_customer_clusters")
def _(spark, sf):
    return cl.customer_clusters(table(spark, sf, "orders"), "o_custkey", "o_totalprice")


# ---- models ------------------------------------------------------------------------------------

@register(
    "m1_prepare_ml",
    """WITH g AS (SELECT *, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS s FROM part)
    SELECT p_partkey, CAST(coalesce(s, (SELECT median(s) FROM g)) AS DOUBLE) AS s, p_retailprice AS label, 'regression' AS problem FROM g""",
    dec="s label:2",
)
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS s", "p_retailprice", "p_type")
    return ml.prepare_ml(df, "p_retailprice", ["p_partkey"]).drop("is_test")


KEY = ["l_orderkey", "l_linenumber"]


def reg(spark, sf):
    return ml.prepare_ml(table(spark, sf, "lineitem").select(*KEY, *LINE), "l_extendedprice", KEY)


@register(
    "m2_linear_regression_one_feature",
    """SELECT 'l_quantity' AS feature, regr_slope(l_extendedprice, l_quantity) AS coefficient FROM lineitem UNION ALL
    SELECT 'intercept', regr_intercept(l_extendedprice, l_quantity) FROM lineitem""",
    dec="coefficient:3",
)
def _(spark, sf):
    data = ml.prepare_ml(table(spark, sf, "lineitem").select(*KEY, "l_quantity", "l_extendedprice"), "l_extendedprice", KEY, test_size=0.0)
    return ml.linear_coefficients(data, KEY)


@register("m2_linear_regression")
def _(spark, sf):
    return ml.regression_report(ml.linear_regression(reg(spark, sf), KEY))


@register("m3_random_forest_regression")
def _(spark, sf):
    data = ml.prepare_ml(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", ["p_partkey"])
    return ml.regression_report(ml.random_forest_regression(data, ["p_partkey"]))


def cls(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"))
    labels = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("quality"))
    return ml.prepare_ml(docs.join(labels, "doc_id"), "quality", ["doc_id"])


@register("m4_logistic_regression")
def _(spark, sf):
    return ml.classification_report(ml.logistic_regression(cls(spark, sf), ["doc_id"]))


@register("m5_random_forest_classification")
def _(spark, sf):
    return ml.classification_report(ml.random_forest_classification(cls(spark, sf), ["doc_id"]))


@register("m5_forest_feature_importance")
def _(spark, sf):
    return ml.forest_feature_importance(cls(spark, sf), ["doc_id"])


PRED = "CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_orderkey % 3 = 0 THEN 'P' ELSE 'O' END"


@register(
    "m6_classification_report",
    f"""WITH s AS (SELECT o_orderstatus AS a, {PRED} AS p FROM orders), k AS (SELECT DISTINCT a AS c FROM s UNION SELECT DISTINCT p FROM s),
    r AS (SELECT c, (SELECT count(*) FROM s WHERE a = c AND p = c) AS hit, (SELECT count(*) FROM s WHERE p = c) AS f, (SELECT count(*) FROM s WHERE a = c) AS support FROM k),
    q AS (SELECT c AS class, CASE WHEN f > 0 THEN hit / f ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, support, hit FROM r),
    x AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM q)
    SELECT class, precision, recall, f1, support FROM x UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM x
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM x
    UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), CAST(sum(support) AS BIGINT) FROM x""",
    dec="precision recall f1",
)
def _(spark, sf):
    return ml.classification_report(table(spark, sf, "orders").selectExpr("o_orderstatus AS actual", f"{PRED} AS prediction"))


@register(
    "m7_regression_report",
    """WITH s AS (SELECT l_extendedprice AS a, l_quantity * 1500 AS p FROM lineitem) SELECT count(*) AS n, sqrt(avg(pow(a - p, 2))) AS rmse, 1 - avg(pow(a - p, 2)) / var_pop(a) AS r2 FROM s""",
    dec="rmse:4 r2",
)
def _(spark, sf):
    return ml.regression_report(table(spark, sf, "lineitem").selectExpr("l_extendedprice AS actual", "l_quantity * 1500 AS prediction"))
