"""Queries of section C: missing values."""

from brightlake.operators import impute as op
from catalog.base import register, table
from catalog.frames import GAPS_SQL, gaps, hourly

SPARSE = "CASE WHEN hour(t) % 4 = 0 THEN NULL ELSE v END"
SPARSE_SQL = f"(SELECT k, t, {SPARSE} AS v FROM (SELECT event_type AS k, date_trunc('hour', ts) AS t, sum(value) AS v FROM events GROUP BY 1, 2))"
KEYS = "o_orderkey, o_custkey"


def sparse_series(spark, sf):
    return hourly(spark, sf).selectExpr("k", "t", f"{SPARSE} AS v")


@register("c1_impute_median", f"""SELECT {KEYS}, coalesce(price, (SELECT median(price) FROM {GAPS_SQL})) AS price, priority,
    coalesce(visits, (SELECT CAST(median(visits) AS BIGINT) FROM {GAPS_SQL})) AS visits FROM {GAPS_SQL}""", dec="price:3 visits:3")
def _(spark, sf):
    return op.impute_median(gaps(spark, sf))


@register("c2_impute_mean", f"""SELECT {KEYS}, coalesce(price, (SELECT avg(price) FROM {GAPS_SQL})) AS price, priority,
    coalesce(CAST(visits AS DOUBLE), (SELECT avg(visits) FROM {GAPS_SQL})) AS visits FROM {GAPS_SQL}""", dec="price:3 visits:4")
def _(spark, sf):
    return op.impute_mean(gaps(spark, sf))


@register("c3_impute_zero", f"SELECT {KEYS}, coalesce(price, 0) AS price, priority, coalesce(visits, 0) AS visits FROM {GAPS_SQL}", dec="price:2")
def _(spark, sf):
    return op.impute_zero(gaps(spark, sf))


def mode_sql(c, src=GAPS_SQL):
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register("c4_impute_mode", f"""SELECT {KEYS}, price, coalesce(priority, {mode_sql('priority')}) AS priority,
    coalesce(visits, {mode_sql('visits')}) AS visits FROM {GAPS_SQL}""", dec="price:2")
def _(spark, sf):
    return op.impute_mode(gaps(spark, sf), ["priority", "visits"])


AUTO_SQL = f"""WITH s AS (SELECT avg(price) AS pa, median(price) AS pm, skewness(price) AS ps, avg(visits) AS va, median(visits) AS vm,
    skewness(visits) AS vs FROM {GAPS_SQL})
    SELECT {KEYS}, coalesce(price, CASE WHEN abs(ps) > 1 THEN pm ELSE pa END) AS price, coalesce(priority, {mode_sql('priority')}) AS priority,
    coalesce(CAST(visits AS DOUBLE), CASE WHEN abs(vs) > 1 THEN vm ELSE va END) AS visits FROM {GAPS_SQL}, s"""


@register("c5_impute_auto", AUTO_SQL, dec="price:3 visits:4")
def _(spark, sf):
    return op.impute_auto(gaps(spark, sf), ["price", "priority", "visits"])


@register(
    "c5_impute_auto_skewed",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value FROM events)
    SELECT event_id, coalesce(value, (SELECT CASE WHEN abs(skewness(value)) > 1 THEN median(value) ELSE avg(value) END FROM e)) AS value FROM e""",
    dec="value:4",
)
def _(spark, sf):
    return op.impute_auto(
        table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS value")
    )


@register("c6_impute_smart", f"""SELECT a.*, CASE WHEN a.o_orderkey % 10 = 0 THEN a.o_custkey END AS rare
    FROM ({AUTO_SQL}) a""", dec="price:3 visits:4")
def _(spark, sf):
    df = gaps(spark, sf).selectExpr("*", "CASE WHEN o_orderkey % 10 = 0 THEN o_custkey END AS rare")
    return op.impute_smart(df)


@register("c7_impute_by_column", f"""SELECT {KEYS}, coalesce(price, (SELECT median(price) FROM {GAPS_SQL})) AS price,
    coalesce(priority, {mode_sql('priority')}) AS priority, coalesce(visits, 0) AS visits FROM {GAPS_SQL}""", dec="price:3")
def _(spark, sf):
    return op.impute_by_column(gaps(spark, sf), {"price": "median", "priority": "mode", "visits": "zero", "nope": "mean"})


@register(
    "c8_interpolate_time",
    f"""SELECT k, t, coalesce(v, CASE WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (epoch(t) - epoch(t0)) / (epoch(t1) - epoch(t0)) END) AS v
    FROM (SELECT k, t, v,
      last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
      first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1
      FROM {SPARSE_SQL} WINDOW b AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    dec="v:5",
)
def _(spark, sf):
    return op.interpolate_time(sparse_series(spark, sf), ["k"], "t", ["v"])


@register("c9_ffill", f"""SELECT k, t, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
    FROM {SPARSE_SQL}""", dec="v:5")
def _(spark, sf):
    return op.ffill(sparse_series(spark, sf), ["k"], "t", ["v"])


@register("c9_bfill", f"""SELECT k, t, first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v
    FROM {SPARSE_SQL}""", dec="v:5")
def _(spark, sf):
    return op.bfill(sparse_series(spark, sf), ["k"], "t", ["v"])
