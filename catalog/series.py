"""Queries of sections J and K: time series, forecasts, anomalies."""

from pyspark.sql import functions as F

from brightlake.operators import anomaly as an
from brightlake.operators import forecast as fc
from brightlake.operators import series as op
from catalog.base import ORACLES, register, table
from catalog.frames import DAILY_SQL, HOURLY_SQL, daily, hourly

K = ["k"]
T, V = "t", "v"
HOURLY, DAILY = f"WITH s AS {HOURLY_SQL} ", f"WITH s AS {DAILY_SQL} "
W = "(PARTITION BY k ORDER BY t)"


@register(
    "j1_pick_date_column",
    """SELECT c.name AS date_column, count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts FROM events,
    (SELECT 'ts' AS name) c GROUP BY 1""",
)
def _(spark, sf):
    df = table(spark, sf, "events")
    name = op.pick_date_column(df)
    return df.agg(
        F.lit(name).alias("date_column"), F.count(F.lit(1)).alias("row_count"), F.min(name).alias("first_ts"), F.max(name).alias("last_ts")
    )


@register("j2_prepare_series", "SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2", dec="value")
def _(spark, sf):
    return op.prepare_series(table(spark, sf, "events"), ["event_type"], "ts", "value", grain="hour")


@register("j2_prepare_series_max", "SELECT o_custkey, o_orderdate AS ts, max(o_totalprice) AS value FROM orders GROUP BY 1, 2", dec="value:2")
def _(spark, sf):
    return op.prepare_series(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice", agg="max", fill="interpolate")


def resample_sql(unit, step, label, agg, empty):
    return f"""WITH b AS (SELECT o_orderpriority AS k, date_trunc('{unit}', o_orderdate) AS b, {agg}(o_totalprice) AS v FROM orders GROUP BY 1, 2),
    c AS (SELECT k, unnest(generate_series(min(b), max(b), INTERVAL {step})) AS b FROM b GROUP BY k)
    SELECT k, CAST({label} AS TIMESTAMP) AS ts, {empty} AS value FROM c LEFT JOIN b USING (k, b)"""


def priorities(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderpriority AS k", "o_orderdate AS t", "o_totalprice AS v")


@register("j3_resample_day", resample_sql("day", "1 DAY", "b", "sum", "coalesce(v, 0)"), dec="value:2")
def _(spark, sf):
    return op.resample(priorities(spark, sf), K, "D", "sum", T, V)


@register("j3_resample_week", resample_sql("week", "7 DAY", "b + INTERVAL 6 DAY", "avg", "v"), dec="value:6")
def _(spark, sf):
    return op.resample(priorities(spark, sf), K, "W", "mean", T, V)


@register("j3_resample_month", resample_sql("month", "1 MONTH", "b + INTERVAL 1 MONTH - INTERVAL 1 DAY", "max", "v"), dec="value:2")
def _(spark, sf):
    return op.resample(priorities(spark, sf), K, "M", "max", T, V)


@register("j3_resample_quarter", resample_sql("quarter", "3 MONTH", "b + INTERVAL 3 MONTH - INTERVAL 1 DAY", "sum", "coalesce(v, 0)"), dec="value:2")
def _(spark, sf):
    return op.resample(priorities(spark, sf), K, "Q", "sum", T, V)


@register("j3_resample_year", resample_sql("year", "1 YEAR", "b + INTERVAL 1 YEAR - INTERVAL 1 DAY", "min", "v"), dec="value:2")
def _(spark, sf):
    return op.resample(priorities(spark, sf), K, "Y", "min", T, V)


LADDER = """CASE WHEN g < 60 THEN 'S' WHEN g < 3600 THEN 'T' WHEN g < 86400 THEN 'H' WHEN g // 86400 = 1 THEN 'D' WHEN g // 86400 BETWEEN 6 AND 8 THEN 'W'
 WHEN g // 86400 BETWEEN 28 AND 31 THEN 'M' WHEN g // 86400 BETWEEN 89 AND 93 THEN 'Q' WHEN g // 86400 BETWEEN 364 AND 366 THEN 'Y' ELSE 'D' END"""
FREQ = f"""f AS (SELECT k, g AS gap_seconds, {LADDER} AS frequency FROM (SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, g) AS r
  FROM (SELECT k, CAST(epoch(t) - epoch(lag(t) OVER {W}) AS BIGINT) AS g FROM s) WHERE g IS NOT NULL GROUP BY k, g) WHERE r = 1)"""


@register("j4_detect_frequency", HOURLY + f", {FREQ} SELECT * FROM f")
def _(spark, sf):
    return op.detect_frequency(hourly(spark, sf), K, T)


@register(
    "j5_default_period",
    DAILY + f""", {FREQ} SELECT k, frequency, count(*) AS length, CAST(CASE frequency WHEN 'S' THEN 60 WHEN 'T' THEN 60 WHEN 'H' THEN 24 WHEN 'D' THEN 7 WHEN 'W' THEN 52
    WHEN 'M' THEN 12 WHEN 'Q' THEN 4 ELSE 4 END AS INT) AS period FROM s JOIN f USING (k) GROUP BY 1, 2""",
)
def _(spark, sf):
    return op.series_periods(daily(spark, sf), K, T)


def decompose_sql(m, mul):
    h = m // 2
    frame = f"(PARTITION BY k ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    if m % 2:
        trend = f"CASE WHEN count(v) OVER {frame} = {m} THEN avg(v) OVER {frame} END"
    else:
        trend = f"CASE WHEN count(v) OVER {frame} = {m + 1} THEN (sum(v) OVER {frame} - (lag(v, {h}) OVER {W} + lead(v, {h}) OVER {W}) / 2) / {m} END"
    off, centre, rest = ("v / tr", "m / avg(m) OVER (PARTITION BY k)", "v / (tr * seasonal)") if mul else ("v - tr", "m - avg(m) OVER (PARTITION BY k)", "v - tr - seasonal")
    return f""", b AS (SELECT k, t, v, {trend} AS tr, (row_number() OVER {W} - 1) % {m} AS p FROM s),
      ph AS (SELECT k, p, {centre} AS seasonal FROM (SELECT k, p, avg({off}) AS m FROM b GROUP BY 1, 2))
      SELECT k, t AS ts, v AS observed, tr AS trend, seasonal, {rest} AS residual FROM b JOIN ph USING (k, p)"""


@register("j6_decompose_additive", HOURLY + decompose_sql(24, False), dec="observed:7 trend:7 seasonal:7 residual:7")
def _(spark, sf):
    return op.decompose(hourly(spark, sf), K, 24, "additive", T, V)


@register("j7_decompose_multiplicative", DAILY + decompose_sql(7, True), dec="observed:5 trend:5 seasonal:6 residual:6")
def _(spark, sf):
    return op.decompose(daily(spark, sf), K, 7, "multiplicative", T, V)


def rolled(fn, frame, w):
    return f"CASE WHEN count(v) OVER {frame} = {w} THEN {fn}(v) OVER {frame} END"


FR24 = "(PARTITION BY k ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
FR7C = "(PARTITION BY k ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
EWM = """(SELECT k, t, (SELECT sum(b.v * pow(1 - 2.0 / ({w} + 1), a.i - b.i)) / sum(pow(1 - 2.0 / ({w} + 1), a.i - b.i)) FROM n b
  WHERE b.k = a.k AND b.i <= a.i AND b.i >= a.i - 700) AS e FROM n a)"""


def rolling_sql(frame, w):
    return f""", n AS (SELECT k, t, v, row_number() OVER {W} AS i FROM s), e AS {EWM.format(w=w)},
     r AS (SELECT k, t, v AS original, {rolled('avg', frame, w)} AS rolling_mean, {rolled('stddev_samp', frame, w)} AS rolling_std,
     {rolled('min', frame, w)} AS rolling_min, {rolled('max', frame, w)} AS rolling_max FROM s)
     SELECT r.k, r.t AS ts, original, rolling_mean, rolling_std, rolling_min, rolling_max, e.e AS exp_mean FROM r JOIN e ON r.k = e.k AND r.t = e.t"""


ROLL_DEC = "original:7 rolling_mean:7 rolling_std:7 rolling_min:7 rolling_max:7 exp_mean:7"


@register("j8_rolling_stats", HOURLY + rolling_sql(FR24, 24), dec=ROLL_DEC)
def _(spark, sf):
    return op.rolling_stats(hourly(spark, sf), K, 24, False, T, V)


@register("j8_rolling_stats_centered", DAILY + rolling_sql(FR7C, 7), dec=ROLL_DEC)
def _(spark, sf):
    return op.rolling_stats(daily(spark, sf), K, 7, True, T, V)


@register("j9_ewm_mean", HOURLY + f", n AS (SELECT k, t, v, row_number() OVER {W} AS i FROM s) SELECT k, t, e AS exp_mean FROM {EWM.format(w=12)}", dec="exp_mean:7")
def _(spark, sf):
    return op.ewm_mean(hourly(spark, sf), K, 12, T, V).drop("v")


@register(
    "j10_adf_statistic",
    HOURLY + f""", d AS (SELECT k, v - lag(v) OVER {W} AS dv, lag(v) OVER {W} AS y FROM s),
    r AS (SELECT k, count(dv) AS n, regr_slope(dv, y) AS b, regr_sxx(dv, y) AS sxx, regr_syy(dv, y) AS syy FROM d WHERE y IS NOT NULL GROUP BY k),
    z AS (SELECT k, n, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS adf_statistic, -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n) AS critical_value FROM r)
    SELECT *, adf_statistic < critical_value AS adf_stationary FROM z""",
    dec="adf_statistic:5 critical_value",
)
def _(spark, sf):
    return op.adf_statistic(hourly(spark, sf), K, 0, T, V)


def adf_fit_sql(fit, rows, lags):
    """Unit-root regression on ``rows`` (k, c1, d, y, l1, l2): its columns are made orthogonal one after the other, the level last."""
    ctes, names = [f"{fit}0 AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM {rows})"], ["c1", *[f"l{i}" for i in range(1, lags + 1)], "y"]
    for at, name in enumerate(names):
        rest = [*names[at + 1 :], "d"]
        same = [c for c in ("k", "n", *names[: at + 1])]
        less = [f"{c} - {name} * sum({c} * {name}) OVER (PARTITION BY k) / sum({name} * {name}) OVER (PARTITION BY k) AS {c}" for c in rest]
        keep = ", d AS d0" if name == "y" else ""
        ctes.append(f"{fit}{at + 1} AS (SELECT {', '.join(same)}, {', '.join(less)}{keep} FROM {fit}{at})")
    out = f"SELECT k, any_value(n) AS n, {lags} AS lags, sum(d * d) AS sse, sum(d0 * y) / sum(y * y) / sqrt(sum(d * d) / (any_value(n) - {lags + 2}) / sum(y * y)) AS t FROM {fit}{len(names)} GROUP BY k"
    return ", ".join(ctes), out


def adf_auto_sql(most):
    steps = f"""x AS (SELECT k, t, v - lag(v) OVER {W} AS d, lag(v) OVER {W} AS y FROM s), f AS (SELECT k, 1.0 AS c1, d, y, lag(d, 1) OVER {W} AS l1, lag(d, 2) OVER {W} AS l2 FROM x),
      w AS (SELECT * FROM f WHERE l{most} IS NOT NULL)"""
    parts, fits, finals = [steps], [], []
    for lags in range(most + 1):
        for name, rows, out in (("a", "w", fits), ("b", f"g{lags}", finals)):
            if name == "b":
                parts.append(f"g{lags} AS (SELECT * FROM f WHERE {f'l{lags}' if lags else 'd'} IS NOT NULL)")
            ctes, select = adf_fit_sql(f"{name}{lags}_", rows, lags)
            parts.append(ctes)
            out.append(select)
    best = f"best AS (SELECT k, arg_min(lags, n * ln(sse / n) + 2 * (lags + 2)) AS lags FROM ({' UNION ALL '.join(fits)}) GROUP BY k)"
    return f""", {', '.join(parts)}, {best}, z AS (SELECT k, n, CAST(lags AS BIGINT) AS lags, t AS adf_statistic, -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n) AS critical_value
      FROM ({' UNION ALL '.join(finals)}) JOIN best USING (k, lags)) SELECT *, adf_statistic < critical_value AS adf_stationary FROM z"""


@register("j10_adf_lag_by_aic", HOURLY + adf_auto_sql(2), dec="adf_statistic:5 critical_value")
def _(spark, sf):
    return op.adf_statistic(hourly(spark, sf), K, None, T, V, most_lags=2)


def acov_sql(lags):
    return f"""n AS (SELECT k, v - avg(v) OVER (PARTITION BY k) AS e, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY k) AS n FROM s),
     c AS (SELECT a.k, any_value(a.n) AS n, l.lag, sum(a.e * b.e) AS c FROM n a, (SELECT unnest(range({lags + 1})) AS lag) l, n b
       WHERE a.k = b.k AND b.i = a.i - l.lag GROUP BY a.k, l.lag)"""


@register(
    "j11_kpss_statistic",
    DAILY + f""", {acov_sql(5)}, e AS (SELECT k, sum(p * p) AS eta FROM (SELECT k, sum(e) OVER (PARTITION BY k ORDER BY i) AS p FROM n) GROUP BY k),
    v AS (SELECT k, n, sum(CASE WHEN lag = 0 THEN c ELSE 2 * (1 - lag / 6.0) * c END) AS lr FROM c GROUP BY 1, 2)
    SELECT k, CAST(5 AS BIGINT) AS lags, eta / n / lr AS kpss_statistic, eta / n / lr < 0.463 AS kpss_stationary FROM v JOIN e USING (k)""",
    dec="kpss_statistic",
)
def _(spark, sf):
    return op.kpss_statistic(daily(spark, sf), K, 5, T, V)


@register(
    "j11_kpss_auto_bandwidth",
    HOURLY + f""", {acov_sql(60)}, e AS (SELECT k, sum(p * p) AS eta FROM (SELECT k, sum(e) OVER (PARTITION BY k ORDER BY i) AS p FROM n) GROUP BY k),
    b AS (SELECT k, n, CAST(floor(1.1447 * pow(pow(s1 / s0, 2), 1 / 3.0) * pow(n, 1 / 3.0)) AS BIGINT) AS lags FROM (
      SELECT k, n, sum(CASE WHEN lag = 0 THEN c / n ELSE c / (n / 2) END) AS s0, sum(CASE WHEN lag > 0 THEN lag * c / (n / 2) ELSE 0 END) AS s1
      FROM c WHERE lag <= floor(pow(n, 2 / 9.0)) GROUP BY 1, 2)),
    v AS (SELECT k, n, b.lags, sum(CASE WHEN lag = 0 THEN c WHEN lag <= b.lags THEN 2 * (1 - lag / (b.lags + 1.0)) * c ELSE 0 END) AS lr FROM c JOIN b USING (k, n) GROUP BY 1, 2, 3)
    SELECT k, lags, eta / n / lr AS kpss_statistic, eta / n / lr < 0.463 AS kpss_stationary FROM v JOIN e USING (k)""",
    dec="kpss_statistic",
)
def _(spark, sf):
    return op.kpss_statistic(hourly(spark, sf), K, None, T, V)


@register(
    "j12_stationarity_verdict",
    f"""SELECT a.k, adf_statistic, adf_stationary, kpss_statistic, kpss_stationary, CASE WHEN adf_stationary AND kpss_stationary THEN 'stationary'
    WHEN adf_stationary THEN 'trend_stationary' WHEN kpss_stationary THEN 'difference_may_be_needed' ELSE 'non_stationary' END AS verdict
    FROM ({ORACLES['j10_adf_statistic']}) a JOIN ({ORACLES['j11_kpss_auto_bandwidth']}) b ON a.k = b.k""",
    dec="adf_statistic:5 kpss_statistic",
)
def _(spark, sf):
    return op.stationarity_verdict(hourly(spark, sf), K, 0, T, V)


@register("j13_difference", HOURLY + f"SELECT * FROM (SELECT k, t, v - lag(v, 24) OVER {W} AS v FROM s) WHERE v IS NOT NULL", dec="v:5")
def _(spark, sf):
    return op.difference(hourly(spark, sf), K, 24, T, V)


SHIFT = ", z AS (SELECT k, t, CASE WHEN k < 'm' THEN v - 400 ELSE v END AS v FROM s), lg AS (SELECT k, t, ln(CASE WHEN min(v) OVER (PARTITION BY k) <= 0 THEN v - min(v) OVER (PARTITION BY k) + 1 ELSE v END) AS v FROM z) "


def shifted(spark, sf):
    return hourly(spark, sf).selectExpr("k", "t", "CASE WHEN k < 'm' THEN v - 400 ELSE v END AS v")


@register("j14_log_transform", HOURLY + SHIFT + "SELECT * FROM lg", dec="v")
def _(spark, sf):
    return op.log_transform(shifted(spark, sf), K, V)


@register("j15_log_difference", HOURLY + SHIFT + f"SELECT * FROM (SELECT k, t, v - lag(v) OVER {W} AS v FROM lg) WHERE v IS NOT NULL", dec="v")
def _(spark, sf):
    return op.log_difference(shifted(spark, sf), K, 1, T, V)


@register("j16_pct_change", DAILY + f"SELECT * FROM (SELECT k, t, v / lag(v, 7) OVER {W} - 1 AS v FROM s) WHERE v IS NOT NULL", dec="v")
def _(spark, sf):
    return op.pct_change(daily(spark, sf), K, 7, T, V)


@register(
    "j17_acf",
    HOURLY + f""", {acov_sql(40)}, a AS (SELECT k, n, lag, c / first_value(c) OVER (PARTITION BY k ORDER BY lag) AS acf FROM c)
    SELECT k, CAST(lag AS INT) AS lag, acf, CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END)
      OVER (PARTITION BY k ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS bound FROM a WHERE lag <= n // 2""",
    dec="acf bound",
)
def _(spark, sf):
    return op.acf(hourly(spark, sf), K, 40, T, V)


@register(
    "j18_pacf",
    DAILY + f""", {acov_sql(2)}, a AS (SELECT k, max(CASE WHEN lag = 1 THEN c END) / max(CASE WHEN lag = 0 THEN c END) AS r1,
      max(CASE WHEN lag = 2 THEN c END) / max(CASE WHEN lag = 0 THEN c END) AS r2 FROM c GROUP BY k)
    SELECT k, CAST(0 AS INT) AS lag, CAST(1 AS DOUBLE) AS pacf FROM a UNION ALL SELECT k, 1, r1 FROM a UNION ALL SELECT k, 2, (r2 - r1 * r1) / (1 - r1 * r1) FROM a""",
    dec="pacf",
)
def _(spark, sf):
    return op.pacf(daily(spark, sf), K, 2, T, V)


@register("j19_acf_peaks")
def _(spark, sf):
    return op.acf_peaks(hourly(spark, sf), K, 100, 3, T, V)


@register(
    "j20_weekday_month_seasonality",
    """WITH s AS (SELECT o_orderpriority AS k, o_orderdate AS t, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
    m AS (SELECT k, 'day_of_week' AS part, isodow(t) AS slot, avg(v) AS m FROM s GROUP BY ALL UNION ALL SELECT k, 'month', month(t), avg(v) FROM s GROUP BY ALL)
    SELECT k, part, count(*) AS groups, stddev_samp(m) / avg(m) AS strength, stddev_samp(m) / avg(m) > 0.1 AS significant FROM m GROUP BY 1, 2""",
    dec="strength",
)
def _(spark, sf):
    s = op.prepare_series(priorities(spark, sf), K, T, V, agg="sum", fill=None)
    return op.weekday_month_seasonality(s, K)


SPLIT = f""", n AS (SELECT k, t, v, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM s),
 sp AS (SELECT *, greatest(1, least(CAST(floor(n * 0.8) AS BIGINT), n - 1)) AS cut FROM n)"""


@register("j21_split_series", DAILY + SPLIT + "SELECT k, t AS ts, v AS value, i >= cut AS is_test FROM sp", dec="value:4")
def _(spark, sf):
    return fc.split_series(daily(spark, sf), K, 0.2, None, T, V).select("k", "ts", "value", "is_test")


def naive_sql(state, forecast, model):
    return SPLIT + f""", st AS (SELECT k, arg_max(v, i) AS l, arg_min(v, i) AS f, avg(v) AS m, count(*) AS c FROM sp WHERE i < cut GROUP BY k)
    SELECT sp.k, t AS ts, i - cut + 1 AS h, v AS actual, {forecast} AS forecast, '{model}' AS model FROM sp JOIN st USING (k) {state} WHERE i >= cut"""


NAIVE = {
    "last": naive_sql("", "l", "last"),
    "mean": naive_sql("", "m", "mean"),
    "drift": naive_sql("", "l + (l - f) / (c - 1) * (i - cut + 1)", "drift"),
    "seasonal": naive_sql("JOIN (SELECT k, i AS j, v AS sv FROM n) x ON x.k = sp.k AND x.j = sp.cut - 7 + (sp.i - sp.cut) % 7", "sv", "seasonal_7"),
}
FDEC = "actual:4 forecast:4"


@register("j22_naive_last", DAILY + NAIVE["last"], dec=FDEC)
def _(spark, sf):
    return fc.naive_forecast(daily(spark, sf), K, "last", ts=T, value=V)


@register("j23_naive_mean", DAILY + NAIVE["mean"], dec=FDEC)
def _(spark, sf):
    return fc.naive_forecast(daily(spark, sf), K, "mean", ts=T, value=V)


@register("j24_naive_drift", DAILY + NAIVE["drift"], dec=FDEC)
def _(spark, sf):
    return fc.naive_forecast(daily(spark, sf), K, "drift", ts=T, value=V)


@register("j25_naive_seasonal", DAILY + NAIVE["seasonal"], dec=FDEC)
def _(spark, sf):
    return fc.naive_forecast(daily(spark, sf), K, "seasonal", 7, ts=T, value=V)


@register("j25_naive_seasonal_default", DAILY + NAIVE["seasonal"], dec=FDEC)
def _(spark, sf):
    return fc.naive_forecast(daily(spark, sf), K, "seasonal", ts=T, value=V)


METRICS = """avg((actual - forecast) * (actual - forecast)) AS mse, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse, avg(abs(actual - forecast)) AS mae,
 CASE WHEN count(*) FILTER (actual = 0) = 0 THEN 100 * avg(abs((actual - forecast) / actual)) END AS mape"""
MDEC = "mse:3 rmse:5 mae:5 mape:5"


@register("j26_forecast_metrics", f"SELECT k, {METRICS} FROM ({DAILY + NAIVE['drift']}) GROUP BY k", dec=MDEC)
def _(spark, sf):
    return fc.forecast_metrics(fc.naive_forecast(daily(spark, sf), K, "drift", ts=T, value=V), K)


@register(
    "j27_exponential_smoothing_fixed",
    DAILY + SPLIT + """, st AS (SELECT k, sum(CASE WHEN i = 0 THEN pow(0.7, cut) * v + 0.3 * pow(0.7, cut - 1) * v ELSE 0.3 * pow(0.7, cut - 1 - i) * v END) AS l FROM sp WHERE i < cut GROUP BY k)
    SELECT sp.k, t AS ts, i - cut + 1 AS h, v AS actual, l AS forecast, 'ets' AS model FROM sp JOIN st USING (k) WHERE i >= cut""",
    dec=FDEC,
)
def _(spark, sf):
    return fc.exponential_smoothing(daily(spark, sf), K, alpha=0.3, ts=T, value=V)


@register("j27_holt_winters")
def _(spark, sf):
    return fc.exponential_smoothing(daily(spark, sf), K, "add", "add", 7, True, ts=T, value=V)


@register(
    "j28_ar_forecast",
    DAILY + SPLIT + f""", d AS (SELECT k, i, cut, v, v - lag(v) OVER (PARTITION BY k ORDER BY i) AS dv FROM sp WHERE i < cut),
     r AS (SELECT k, regr_slope(dv, x) AS b, regr_intercept(dv, x) AS a FROM (SELECT *, lag(dv) OVER (PARTITION BY k ORDER BY i) AS x FROM d) GROUP BY k),
     e AS (SELECT k, v AS lv, dv AS ld FROM d WHERE i = cut - 1)
     SELECT sp.k, t AS ts, i - cut + 1 AS h, v AS actual, lv + list_sum(list_transform(range(1, i - cut + 2), lambda j: pow(b, j) * ld + a * (1 - pow(b, j)) / (1 - b))) AS forecast,
     'ar_1_1' AS model FROM sp JOIN r USING (k) JOIN e USING (k) WHERE i >= cut""",
    dec=FDEC,
)
def _(spark, sf):
    return fc.ar_forecast(daily(spark, sf), K, 1, 1, ts=T, value=V)


SES_FIT = """, f AS (SELECT a.k, a.i, any_value(a.v) - sum(CASE WHEN b.i = 0 THEN pow(0.7, a.i - 1) ELSE 0.3 * pow(0.7, a.i - 1 - b.i) END * b.v) AS e
     FROM sp a JOIN sp b ON a.k = b.k AND b.i < a.i WHERE a.i < a.cut GROUP BY a.k, a.i),
    g AS (SELECT k, count(*) + 1 AS n, sum(e * e) AS sse FROM f GROUP BY k)"""


@register(
    "j27_smoothing_fit",
    DAILY + SPLIT + SES_FIT + """ SELECT k, 'ets' AS model, n, CAST(0.3 AS DOUBLE) AS alpha, CAST(NULL AS DOUBLE) AS beta, CAST(NULL AS DOUBLE) AS gamma,
    CAST(NULL AS DOUBLE) AS phi, n * ln(sse / n) + 4 AS aic, n * ln(sse / n) + 2 * ln(n) AS bic FROM g""",
    dec="aic:4 bic:4",
)
def _(spark, sf):
    fit = fc.smoothing_fit(daily(spark, sf), K, alpha=0.3, ts=T, value=V)
    return fit.select(*K, "model", "n", "alpha", "beta", "gamma", "phi", "aic", "bic")


AR_FIT = """, d AS (SELECT k, i, v - lag(v) OVER (PARTITION BY k ORDER BY i) AS dv FROM sp WHERE i < cut),
    x AS (SELECT *, lag(dv) OVER (PARTITION BY k ORDER BY i) AS x FROM d),
    h AS (SELECT k, regr_count(dv, x) AS n, regr_intercept(dv, x) AS a, regr_slope(dv, x) AS b, regr_syy(dv, x) - regr_sxy(dv, x) * regr_sxy(dv, x) / regr_sxx(dv, x) AS sse FROM x GROUP BY k)"""


@register(
    "j28_ar_fit",
    DAILY + SPLIT + AR_FIT + " SELECT k, 'ar_1_1' AS model, CAST(n AS BIGINT) AS n, a AS intercept, b AS ar1, n * ln(sse / n) + 4 AS aic, n * ln(sse / n) + 2 * ln(n) AS bic FROM h",
    dec="intercept:4 ar1 aic:4 bic:4",
)
def _(spark, sf):
    fit = fc.ar_fit(daily(spark, sf), K, ts=T, value=V)
    return fit.select(*K, "model", "n", "intercept", F.col("ar")[0].alias("ar1"), "aic", "bic")


@register("j28_arma_forecast")
def _(spark, sf):
    return fc.ar_forecast(daily(spark, sf), K, 2, 1, q=1, ts=T, value=V)


@register(
    "j29_compare_models_criteria",
    DAILY + SPLIT + SES_FIT + AR_FIT + """ SELECT k, 'ets' AS model, n * ln(sse / n) + 4 AS aic, n * ln(sse / n) + 2 * ln(n) AS bic FROM g
    UNION ALL SELECT k, 'ar_1_1', n * ln(sse / n) + 4, n * ln(sse / n) + 2 * ln(n) FROM h UNION ALL SELECT DISTINCT k, 'last', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM sp""",
    dec="aic:4 bic:4",
)
def _(spark, sf):
    s, at = daily(spark, sf), {"ts": T, "value": V}
    runs = [fc.naive_forecast(s, K, "last", **at), fc.exponential_smoothing(s, K, alpha=0.3, **at), fc.ar_forecast(s, K, **at)]
    return fc.compare_models(runs, K, [fc.smoothing_fit(s, K, alpha=0.3, **at), fc.ar_fit(s, K, **at)]).select(*K, "model", "aic", "bic")


@register(
    "j29_compare_models",
    " UNION ALL ".join(f"SELECT k, model, {METRICS} FROM ({DAILY + q}) GROUP BY k, model" for q in NAIVE.values()),
    dec=MDEC,
)
def _(spark, sf):
    s = daily(spark, sf)
    return fc.compare_models(
        [fc.naive_forecast(s, K, m, 7 if m == "seasonal" else None, ts=T, value=V) for m in NAIVE], K
    )


@register(
    "j30_forecast_future",
    DAILY + f""", st AS (SELECT k, arg_max(v, t) AS l, arg_min(v, t) AS f, count(*) AS c, max(t) AS last FROM s GROUP BY k)
    SELECT k, CAST(last + h * INTERVAL 1 DAY AS DATE) AS date, h, l + (l - f) / (c - 1) * h AS forecast, 'drift' AS model FROM st, (SELECT unnest(range(1, 15)) AS h)""",
    dec="forecast:4",
)
def _(spark, sf):
    return fc.forecast_future(daily(spark, sf), K, 14, "drift", "D", ts=T, value=V)


@register("j30_forecast_future_best")
def _(spark, sf):
    return fc.forecast_future(daily(spark, sf), K, 10, "best", "D", 7, ts=T, value=V)


# ---- anomalies ---------------------------------------------------------------------------------

BOUNDS = "lower_bound:7 upper_bound:7 value:7"


@register(
    "k1_anomaly_iqr",
    HOURLY + """, q AS (SELECT k, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM s GROUP BY k)
    SELECT k, t AS ts, v AS value, a - 1.5 * (b - a) AS lower_bound, b + 1.5 * (b - a) AS upper_bound, v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) AS is_anomaly FROM s JOIN q USING (k)""",
    dec=BOUNDS,
)
def _(spark, sf):
    return an.anomaly_iqr(hourly(spark, sf), K, 1.5, T, V)


FRC = "(PARTITION BY k ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
GLOBAL = ", b AS (SELECT k, t, v, avg(v) OVER (PARTITION BY k) AS m, stddev_samp(v) OVER (PARTITION BY k) AS sd FROM s) "
ROLLED = f""", b AS (SELECT k, t, v, coalesce({rolled('avg', FRC, 7)}, avg(v) OVER (PARTITION BY k)) AS m,
  coalesce({rolled('stddev_samp', FRC, 7)}, stddev_samp(v) OVER (PARTITION BY k)) AS sd FROM s) """
ZSEL = "SELECT k, t AS ts, v AS value, (v - m) / sd AS z_score, m AS mean, sd AS std, m - 2.0 * sd AS lower_bound, m + 2.0 * sd AS upper_bound, abs((v - m) / sd) > 2 AS is_anomaly FROM b"
SSEL = "SELECT k, t AS ts, v AS value, m AS mean, sd AS std, m - 2.0 * sd AS lower_bound, m + 2.0 * sd AS upper_bound, v < m - 2.0 * sd OR v > m + 2.0 * sd AS is_anomaly FROM b"


@register("k2_anomaly_zscore", HOURLY + GLOBAL + ZSEL, dec=BOUNDS + " z_score:5 mean:7 std:7")
def _(spark, sf):
    return an.anomaly_zscore(hourly(spark, sf), K, 2.0, None, T, V)


@register("k3_anomaly_zscore_rolling", HOURLY + ROLLED + ZSEL, dec=BOUNDS + " z_score:5 mean:7 std:7")
def _(spark, sf):
    return an.anomaly_zscore(hourly(spark, sf), K, 2.0, 7, T, V)


@register("k4_anomaly_std", HOURLY + GLOBAL + SSEL, dec=BOUNDS + " mean:7 std:7")
def _(spark, sf):
    return an.anomaly_std(hourly(spark, sf), K, 2.0, None, T, V)


@register("k4_anomaly_std_rolling", HOURLY + ROLLED + SSEL, dec=BOUNDS + " mean:7 std:7")
def _(spark, sf):
    return an.anomaly_std(hourly(spark, sf), K, 2.0, 7, T, V)


MAD = """, g AS (SELECT k, median(v) AS md FROM s GROUP BY k), gm AS (SELECT k, any_value(md) AS md, median(abs(v - md)) AS mad FROM s JOIN g USING (k) GROUP BY k) """
MSEL = "SELECT k, t AS ts, v AS value, m AS median, d AS mad, m - 3 * 1.4826 * d AS lower_bound, m + 3 * 1.4826 * d AS upper_bound, v < m - 3 * 1.4826 * d OR v > m + 3 * 1.4826 * d AS is_anomaly FROM b"


@register("k5_anomaly_mad", HOURLY + MAD + ", b AS (SELECT k, t, v, md AS m, mad AS d FROM s JOIN gm USING (k)) " + MSEL, dec=BOUNDS + " median:7 mad:7")
def _(spark, sf):
    return an.anomaly_mad(hourly(spark, sf), K, 3.0, None, T, V)


@register(
    "k6_anomaly_mad_rolling",
    HOURLY + MAD + f""", r AS (SELECT k, t, v, coalesce({rolled('median', FRC, 7)}, md) AS m, mad FROM s JOIN gm USING (k)),
     r2 AS (SELECT *, abs(v - m) AS nv FROM r),
     b AS (SELECT k, t, v, m, coalesce(CASE WHEN count(nv) OVER {FRC} = 7 THEN median(nv) OVER {FRC} END, mad) AS d FROM r2) """ + MSEL,
    dec=BOUNDS + " median:7 mad:7",
)
def _(spark, sf):
    return an.anomaly_mad(hourly(spark, sf), K, 3.0, 7, T, V)


def count_sql(src, method, window):
    return f"""SELECT k, '{method}' AS method, CAST({window} AS INT) AS "window", count(*) FILTER (is_anomaly) AS anomaly_count,
     100.0 * count(*) FILTER (is_anomaly) / count(*) AS anomaly_percentage FROM ({src}) GROUP BY k"""


IQR3 = HOURLY + """, q AS (SELECT k, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM s GROUP BY k)
    SELECT k, v < a - 2.0 * (b - a) OR v > b + 2.0 * (b - a) AS is_anomaly FROM s JOIN q USING (k)"""


@register(
    "k7_compare_anomaly_methods",
    " UNION ALL ".join(
        [
            count_sql(IQR3, "iqr", "NULL"),
            count_sql(HOURLY + GLOBAL + ZSEL, "zscore", "NULL"),
            count_sql(HOURLY + ROLLED + ZSEL, "zscore", "7"),
            count_sql(HOURLY + GLOBAL + SSEL, "std", "NULL"),
            count_sql(HOURLY + ROLLED + SSEL, "std", "7"),
        ]
    ),
    dec="anomaly_percentage",
)
def _(spark, sf):
    return an.compare_anomaly_methods(hourly(spark, sf), K, ("iqr", "zscore", "std"), [None, 7], 2.0, T, V)


@register("k7_compare_anomaly_methods_all")
def _(spark, sf):
    """All four methods with the windows of each series; the query above is bound to its SQL."""
    return an.compare_anomaly_methods(hourly(spark, sf), K, ts=T, value=V)


@register(
    "k8_anomaly_summary",
    f"""SELECT k, count(*) AS total_points, count(*) FILTER (is_anomaly) AS anomaly_count, 100.0 * count(*) FILTER (is_anomaly) / count(*) AS anomaly_percentage,
    min(value) FILTER (is_anomaly) AS min_value, max(value) FILTER (is_anomaly) AS max_value, avg(value) FILTER (is_anomaly) AS mean_value,
    min(ts) FILTER (is_anomaly) AS first_anomaly, max(ts) FILTER (is_anomaly) AS last_anomaly, median(value) FILTER (is_anomaly) AS median_value
    FROM ({HOURLY + GLOBAL + ZSEL}) GROUP BY k""",
    dec="anomaly_percentage min_value:5 max_value:5 mean_value:5 median_value:5",
)
def _(spark, sf):
    return an.anomaly_summary(an.anomaly_zscore(hourly(spark, sf), K, 2.0, None, T, V), K)


@register(
    "k8_anomaly_calendar",
    f"""SELECT k, part, CAST(slot AS INT) AS slot, count(*) FILTER (is_anomaly) AS anomaly_count, 100.0 * count(*) FILTER (is_anomaly) / count(*) AS anomaly_percentage
    FROM (SELECT k, is_anomaly, 'day_of_week' AS part, isodow(ts) - 1 AS slot FROM ({HOURLY + GLOBAL + ZSEL})
     UNION ALL SELECT k, is_anomaly, 'month', month(ts) FROM ({HOURLY + GLOBAL + ZSEL})) GROUP BY 1, 2, 3""",
    dec="anomaly_percentage",
)
def _(spark, sf):
    return an.anomaly_calendar(an.anomaly_zscore(hourly(spark, sf), K, 2.0, None, T, V), K)
