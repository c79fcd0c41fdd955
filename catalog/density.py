"""Queries on nearest neighbours and density: C10, D10, L10, L11."""

from pyspark.sql import functions as F

from brightlake.operators import density as de
from brightlake.operators import neighbors as nb
from catalog.base import register, table

EV = ["event_id", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value", "CAST(user_id AS DOUBLE) AS user", "{day} AS day"]


def ev_columns(day):
    return ", ".join(EV).format(day=day)


KNN_SQL = f"""WITH e AS (SELECT {ev_columns("(epoch(ts) - 1704067200) / 86400.0")} FROM events),
 d AS (SELECT a.event_id, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY (pow(a."user" - b."user", 2) + pow(a.day - b.day, 2)), b.value) AS r
  FROM e a, e b WHERE a.value IS NULL AND b.value IS NOT NULL)
 SELECT e.event_id, coalesce(e.value, f.v) AS value FROM e LEFT JOIN (SELECT event_id, avg(value) AS v FROM d WHERE r <= 5 GROUP BY 1) f USING (event_id)"""


@register("c10_impute_knn", KNN_SQL, dec="value:4")
def _(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value",
        "CAST(user_id AS DOUBLE) AS user",
        "(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 86400000000D AS day",
    )
    return nb.impute_knn(df, ["value"], ["value", "user", "day"]).select("event_id", "value")


@register(
    "d10_smote",
    """SELECT lang, (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) AS n,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) - count(*) AS synthetic, TRUE AS in_range FROM documents GROUP BY lang""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.size(F.split("text", " ")).alias("n_words"))
    made = nb.smote(docs, "lang", ["doc_id"], ["n_chars", "n_words"])
    ends = docs.groupBy("lang").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    return made.join(ends, "lang").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("synthetic").alias("synthetic"),
        F.bool_and(F.col("n_chars").between(F.col("lo"), F.col("hi"))).alias("in_range"),
    )


Z = """z AS (SELECT c_custkey, (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) AS x,
 (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer) AS y FROM customer)"""

EPS, MIN = 0.12, 9


@register(
    "l10_dbscan",
    f"""WITH RECURSIVE {Z}, p AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM z a, z b WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {EPS * EPS}),
    core AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= {MIN}), e AS (SELECT a, b FROM p WHERE a IN (FROM core) AND b IN (FROM core)),
    r(id, seen) AS (SELECT id, id FROM core UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
    comp AS (SELECT id, min(struct_pack(x := z.x, y := z.y)) AS root FROM r JOIN z ON z.c_custkey = r.seen GROUP BY id),
    num AS (SELECT root, CAST(row_number() OVER (ORDER BY root) - 1 AS INT) AS cluster FROM (SELECT DISTINCT root FROM comp)),
    lab AS (SELECT id, cluster FROM comp JOIN num USING (root)),
    bord AS (SELECT p.a AS id, min(cluster) AS cluster FROM p JOIN lab ON lab.id = p.b WHERE p.a NOT IN (FROM core) GROUP BY 1)
    SELECT c_custkey, coalesce(lab.cluster, bord.cluster, -1) AS cluster FROM z LEFT JOIN lab ON lab.id = c_custkey LEFT JOIN bord ON bord.id = c_custkey""",
)
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return de.dbscan(df, EPS, MIN, ["c_acctbal", "c_nationkey"]).select("c_custkey", "cluster")


def dbscan_sql(source, key, columns, eps, least):
    """Brute force over all pairs of the scaled columns."""
    scaled = ", ".join(f"({e} - avg({e}) OVER ()) / stddev_pop({e}) OVER () AS x{i}" for i, e in enumerate(columns))
    square = " + ".join(f"pow(a.x{i} - b.x{i}, 2)" for i in range(len(columns)))
    point = ", ".join(f"x{i} := z.x{i}" for i in range(len(columns)))
    return f"""WITH RECURSIVE z AS (SELECT {key} AS id, {scaled} FROM {source}), p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM z a, z b WHERE {square} <= {eps * eps}),
    core AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= {least}), e AS MATERIALIZED (SELECT a, b FROM p WHERE a IN (FROM core) AND b IN (FROM core)),
    r(id, seen) AS (SELECT id, id FROM core UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
    comp AS (SELECT r.id, min(struct_pack({point})) AS root FROM r JOIN z ON z.id = r.seen GROUP BY 1),
    num AS (SELECT root, CAST(row_number() OVER (ORDER BY root) - 1 AS INT) AS cluster FROM (SELECT DISTINCT root FROM comp)),
    lab AS (SELECT id, cluster FROM comp JOIN num USING (root)),
    bord AS (SELECT p.a AS id, min(cluster) AS cluster FROM p JOIN lab ON lab.id = p.b WHERE p.a NOT IN (FROM core) GROUP BY 1)
    SELECT z.id AS {key}, coalesce(lab.cluster, bord.cluster, -1) AS cluster FROM z LEFT JOIN lab ON lab.id = z.id LEFT JOIN bord ON bord.id = z.id"""


FIVE = ["p_size", "p_retailprice", "p_partkey", "length(p_name)", "length(p_type)"]


@register("l10_dbscan_five_columns", dbscan_sql("part", "p_partkey", FIVE, 0.6, 6))
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey", *[f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(FIVE)])
    return de.dbscan(df, 0.6, 6, [f"x{i}" for i in range(5)]).select("p_partkey", "cluster")


CROWDED = ["CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 1e6 ELSE c_acctbal END", "CASE WHEN c_custkey % 2 = 0 THEN c_nationkey / 1e3 ELSE c_nationkey END"]


@register("l10_dbscan_crowded_cell", dbscan_sql("customer", "c_custkey", CROWDED, EPS, MIN))
def _(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", *[f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(CROWDED)])
    return de.dbscan(df, EPS, MIN, ["x0", "x1"]).select("c_custkey", "cluster")


@register(
    "l10_dbscan_five_columns_sizes",
    f"SELECT cluster, count(*) AS size FROM ({dbscan_sql('part', 'p_partkey', FIVE, 0.6, 6)}) WHERE cluster >= 0 GROUP BY 1",
)
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr(*[f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(FIVE)])
    return de.dbscan_centres(de.dbscan(df, 0.6, 6, [f"x{i}" for i in range(5)]), ["x0"]).select("cluster", "size")


@register("l10_dbscan_centres")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return de.dbscan_centres(de.dbscan(df, EPS, MIN, ["c_acctbal", "c_nationkey"]), ["c_acctbal", "c_nationkey"])


@register(
    "l11_k_distance_eps",
    f"""WITH {Z}, d AS (SELECT a.c_custkey AS id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM z a, z b),
    k AS (SELECT id, max(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM d) WHERE r <= 5 GROUP BY id),
    o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM k), e AS (SELECT min(d) AS lo, max(d) AS hi, count(*) AS n, median(d) AS med FROM k),
    c AS (SELECT d, i / (n - 1) - (d - lo) / (hi - lo) AS b FROM o, e)
    SELECT (SELECT d FROM c ORDER BY b DESC, d LIMIT 1) AS eps, med AS median_distance, n AS rows FROM e""",
    dec="eps median_distance",
)
def _(spark, sf):
    return nb.k_distance_eps(table(spark, sf, "customer"), 5, ["c_acctbal", "c_nationkey"])
