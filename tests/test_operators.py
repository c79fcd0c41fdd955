"""Edge cases on tiny frames: nulls, ties, constants, empty groups, published table values."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightlake.functions import tails
from brightlake.operators import (
    anomaly, chartdata, clean, cluster, encode, forecast, impute, inference, insights, join, kpi, model, profile, reduce, relate, series,
)
from brightlake.session import scratch_path
from brightlake.sources import demo, tables


def one(df):
    return df.first().asDict()


# ---- tails against published tables ------------------------------------------------------------

@pytest.mark.parametrize("x,dof,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.30704, 10, 0.05), (124.3421, 100, 0.05), (6.634897, 1, 0.01)])
def test_chi_square_table(x, dof, p):
    assert tails.chi2_tail(x, dof) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("t,dof,p", [(12.7062, 1, 0.05), (2.228139, 10, 0.05), (1.983972, 100, 0.05), (3.169273, 10, 0.01), (1.959966, 1e6, 0.05)])
def test_t_table(t, dof, p):
    assert tails.t_two_sided(t, dof) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("f,a,b,p", [(4.964603, 1, 10, 0.05), (3.325835, 5, 10, 0.05), (2.866081, 4, 20, 0.05), (10.0, 2, 2, 1 / 11)])
def test_f_table(f, a, b, p):
    assert tails.f_tail(f, a, b) == pytest.approx(p, abs=1e-6)


def test_kolmogorov_table():
    assert tails.kolmogorov_tail(1.3581) == pytest.approx(0.05, abs=1e-4)


# ---- cleaning ----------------------------------------------------------------------------------

def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` Total Price ` int, `A--b__C` int, `상품 명(1)` int")
    assert clean.simple_names(df).columns == ["total_price", "a--b__c", "상품_명(1)"]
    assert clean.normalize_names(df).columns == ["total_price", "a_b_c", "상품_명_1"]


def test_dates_and_money(spark):
    df = spark.createDataFrame(
        [("2024-01-31", "₩1,200"), ("2024/02/01", "$ 3.5"), ("20240203", "n/a"), ("2024년 2월 4일", None), ("soon", "€7")],
        "when_date string, price string",
    )
    out = clean.load_cleanup(df).collect()
    assert [r["when_date"] and r["when_date"].date().isoformat() for r in out] == ["2024-01-31", "2024-02-01", "2024-02-03", "2024-02-04", None]
    assert [r["price"] for r in out] == [1200.0, 3.5, None, None, 7.0]


def test_logical_types_and_redundant(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 3).alias("code"), F.lit("x").alias("same"), F.when(F.col("id") < 10, 1.0).alias("rare"),
        F.date_format(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")), "yyyy-MM-dd").alias("order_day"),
    )
    kinds = {r["column"]: r["logical_type"] for r in clean.logical_types(df).collect()}
    assert kinds == {"id": "numeric", "code": "categorical", "same": "categorical", "rare": "categorical", "order_day": "datetime"}
    reasons = {r["column"]: r["reason"] for r in clean.redundant_columns(df).collect()}
    assert reasons == {"same": "all_same", "rare": "all_same"}


def test_duplicates_see_nulls_and_long_text(spark):
    long = "a" * 500
    df = spark.createDataFrame([(None, "a", long), ("a", None, long), ("a", None, long), (None, "a", long + "b")], "x string, y string, z string")
    assert one(clean.duplicate_count(df)) == {"row_count": 4, "duplicate_rows": 1}


def test_preprocess_order(spark):
    df = spark.createDataFrame(
        [(1, "a", None, 5), (1, "a", None, 5), (2, "b", 4.0, 5), (3, None, 8.0, 5)], "`Key Id` int, Kind string, Amount double, Fixed int"
    )
    out = clean.preprocess(df, encode_categorical=True).orderBy("key_id")
    assert out.columns == ["key_id", "amount", "kind_a", "kind_b"]
    assert [tuple(r) for r in out.collect()] == [(1, 6.0, 1, 0), (2, 4.0, 0, 1), (3, 8.0, 0, 0)]


# ---- imputation and encoding -------------------------------------------------------------------

def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0), (3, 4.0)], "id int, x double")
    assert [r["x"] for r in impute.impute_mean(df).orderBy("id").collect()] == [3.0, 2.0, 4.0]


def test_mode_ties_and_unknown(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "x string, y string")
    assert {(r["x"], r["y"]) for r in impute.impute_mode(df).collect()} == {("b", "Unknown"), ("a", "Unknown")}


def test_smart_leaves_sparse_columns(spark):
    df = spark.range(10).select("id", F.when(F.col("id") == 0, 1.0).alias("rare"), F.when(F.col("id") > 1, 2.0).alias("some"))
    out = impute.impute_smart(df)
    assert out.where("rare IS NULL").count() == 9 and out.where("some IS NULL").count() == 0


def test_interpolation_edges(spark):
    df = spark.createDataFrame(
        [("k", dt.datetime(2024, 1, d), v) for d, v in ((1, None), (2, 10.0), (3, None), (6, 50.0), (7, None))], "k string, ts timestamp_ntz, v double"
    )
    got = [r["v"] for r in impute.interpolate_time(df, ["k"], "ts", ["v"]).orderBy("ts").collect()]
    assert got == [None, 10.0, 20.0, 50.0, 50.0]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    for method in ("standard", "minmax", "robust"):
        assert [r["x"] for r in encode.scale(df, method).collect()] == [0.0, 0.0, None]


def test_balance_is_a_no_op_below_the_ratio(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("y"))
    assert encode.undersample(df, "y", ["id"]).count() == 10


def test_oversample_copies_evenly(spark):
    df = spark.range(107).select("id", (F.col("id") < 7).alias("y"))
    counts = encode.oversample(df, "y", ["id"]).where("y").groupBy("id").count().collect()
    assert sum(r["count"] for r in counts) == 100 and {r["count"] for r in counts} == {14, 15}


# ---- profiles ----------------------------------------------------------------------------------

def test_profile_of_degenerate_columns(spark):
    df = spark.createDataFrame([(1.0, None, 0), (1.0, None, 1), (1.0, None, 1)], "a double, b double, c int")
    rows = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert rows["a"]["skewness"] == 0.0 and rows["a"]["std"] == 0.0
    assert rows["b"]["mean"] is None and rows["b"]["unique_count"] == 0 and rows["b"]["missing_count"] == 3
    assert rows["c"]["is_binary"] and rows["c"]["outliers_count"] is None


def test_scores_of_clean_data(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("name"))
    assert one(profile.quality_score(df))["grade"] == "A+"
    assert one(profile.home_quality_score(df.withColumnRenamed("name", "unit_price")))["score"] == 95.0


def test_words_keep_letters_only(spark):
    df = spark.createDataFrame([("The cat, the CAT 조명 조명 x1 café",), ("cat",)], "t string")
    got = {r["word"]: r["frequency"] for r in profile.word_frequencies(df, "t", min_freq=1).collect()}
    assert got == {"cat": 3, "조명": 2}


# ---- relations and tests -----------------------------------------------------------------------

def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    got = {(r["var1"], r["var2"]): r["correlation"] for r in relate.correlation(df).collect()}
    assert got[("a", "b")] is None and got[("a", "a")] is None and got[("b", "b")] == 1.0


def test_spearman_with_gaps_is_pairwise(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, None, 2.0), (3.0, 9.0, 1.0), (4.0, 4.0, None)], "a double, b double, c double")
    got = {(r["var1"], r["var2"]): r["correlation"] for r in relate.correlation(df, "spearman").collect()}
    assert got[("a", "c")] == pytest.approx(-1.0) and got[("a", "b")] == pytest.approx(0.5)


def test_tests_need_enough_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), (None, 9.0)], "g string, v double")
    assert inference.welch_ttest(df, "g", "v").count() == 0
    assert inference.anova(df.where("g <> 'c'"), "g", "v").count() == 0


def test_interactions_dispatch_on_types(spark):
    df = spark.createDataFrame([(i, i * i, "ab"[i % 2], "xyz"[i % 3]) for i in range(30)], "n int, m int, c string, d string")
    kinds = {(r["feature1"], r["feature2"]): r["kind"] for r in relate.feature_interactions(df, ["n", "m", "c", "d"], "m").collect()}
    assert kinds[("n", "m")] == "numeric-numeric" and kinds[("c", "d")] == "categorical-categorical"


# ---- joins and sources -------------------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_salted_merge_equals_plain(spark, how):
    a = spark.createDataFrame([(1, "p"), (1, "q"), (None, "r"), (3, "s")], "k int, a string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z"), (4, "z")], "k int, b string")
    key = lambda r: tuple(str(v) for v in r)
    plain = sorted((tuple(r[c] for c in ("k", "a", "b")) for r in join.merge(a, b, "k", how).collect()), key=key)
    salted = sorted((tuple(r[c] for c in ("k", "a", "b")) for r in join.merge(a, b, "k", how, salt=4).collect()), key=key)
    assert plain == salted
    assert (None, "r", "y") in plain


def test_csv_falls_back_to_the_korean_charset(spark, tmp_path):
    path = tmp_path / "shop.csv"
    path.write_bytes("상품,가격\n조명,\"₩\"\n의자,3000\n".replace("₩", "1,000").encode("cp949"))
    out = tables.read_table(spark, str(path)).collect()
    assert [(r["상품"], r["가격"]) for r in out] == [("조명", 1000.0), ("의자", 3000.0)]


def test_unknown_file_types_are_refused(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "/x/y.xlsx")


def test_table_names_get_a_number(spark):
    names = tables.Tables(spark)
    assert [names.add("t_orders", spark.range(1)), names.add("t_orders", spark.range(2))] == ["t_orders", "t_orders_1"]


@pytest.mark.parametrize("fmt,reader", [("csv", tables.read_csv), ("json", tables.read_json)])
def test_round_trip(spark, fmt, reader):
    df = spark.createDataFrame([(1, "a,b"), (2, "c\"d")], "id int, t string")
    path = scratch_path(spark, "trip")
    tables.write_result(df, path, fmt)
    back = reader(spark, path, "id int, t string") if fmt == "csv" else reader(spark, path, "id int, t string", lines=True)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a,b"), (2, "c\"d")]


def test_demo_shop_is_repeatable_and_consistent(spark):
    orders = demo.synthetic_orders(spark, 500)
    assert orders.exceptAll(demo.synthetic_orders(spark, 500)).count() == 0
    assert orders.count() == 500 and orders.join(demo.products(spark), "product_id", "left_anti").count() == 0
    users = demo.synthetic_users(orders)
    assert users.count() == orders.select("user_id").distinct().count()
    assert users.where("join_date >= first_order_date").count() == 0


# ---- series ------------------------------------------------------------------------------------

def ramp(spark, n=40, key="k"):
    rows = [(key, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 100.0 + 3 * i + 10 * (i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")


@pytest.mark.parametrize("form", ["additive", "multiplicative"])
def test_components_give_the_series_back(spark, form):
    out = series.decompose(ramp(spark), ["k"], 7, form).where("trend IS NOT NULL")
    back = F.col("trend") + F.col("seasonal") + F.col("residual") if form == "additive" else F.col("trend") * F.col("seasonal") * F.col("residual")
    assert out.where(F.abs(back - F.col("observed")) > 1e-9).count() == 0


def test_window_shrinks_for_short_series(spark):
    out = series.rolling_stats(ramp(spark, 20), ["k"], 15).where("rolling_mean IS NOT NULL")
    assert out.count() == 19  # 20 // 10 = 2 rows a window


def test_holt_follows_a_line(spark):
    line = spark.createDataFrame([("k", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 5.0 + 2 * i) for i in range(30)], "k string, ts timestamp_ntz, value double")
    assert forecast.exponential_smoothing(line, ["k"], trend="add").where(F.abs(F.col("forecast") - F.col("actual")) > 1e-6).count() == 0


@pytest.mark.parametrize("trend,seasonal,damped", [("add", "add", False), ("add", "mul", True), ("mul", "mul", False), (None, "add", False)])
def test_holt_winters_beats_the_mean(spark, trend, seasonal, damped):
    s = ramp(spark, 70)
    fit = forecast.forecast_metrics(forecast.exponential_smoothing(s, ["k"], trend, seasonal, 7, damped), ["k"]).first()["rmse"]
    flat = forecast.forecast_metrics(forecast.naive_forecast(s, ["k"], "mean"), ["k"]).first()["rmse"]
    assert fit < flat


def test_ar_recovers_its_coefficients(spark):
    x = [1.0, 2.0]
    for _ in range(60):
        x.append(0.6 * x[-1] - 0.3 * x[-2] + 1)
    s = spark.createDataFrame([("k", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(x)], "k string, ts timestamp_ntz, value double")
    out = forecast.ar_forecast(s, ["k"], p=2, d=0)
    assert out.where(F.abs(F.col("forecast") - F.col("actual")) > 1e-6).count() == 0


def test_future_dates(spark):
    s = ramp(spark, 40)  # the last day is Friday, 2024-02-09
    for freq, first in (("D", "2024-02-10"), ("W", "2024-02-18"), ("M", "2024-04-01"), ("Q", "2024-07-01")):
        got = forecast.forecast_future(s, ["k"], 3, "last", freq).orderBy("h").first()
        assert (got["h"], got["date"].isoformat()) == (1, first)
    assert forecast.forecast_future(s, ["k"], 5, "ets", "D", 7, "add", "add").count() == 5


def test_pacf_of_an_autoregression(spark):
    rng = np.random.default_rng(1)
    x = [0.0]
    for e in rng.normal(size=3000):
        x.append(0.7 * x[-1] + e)
    s = spark.createDataFrame([("k", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(x)], "k string, ts timestamp_ntz, value double")
    got = {r["lag"]: r["pacf"] for r in series.pacf(s, ["k"], 5).collect()}
    assert got[1] == pytest.approx(0.7, abs=0.05) and abs(got[2]) < 0.06
    assert series.stationarity_verdict(s, ["k"]).first()["adf_stationary"]


def test_acf_peaks_find_the_period(spark):
    assert series.acf_peaks(ramp(spark, 140).withColumn("value", F.sin(F.unix_date(F.to_date("ts")) * 2 * math.pi / 7)), ["k"]).agg(F.min("lag")).first()[0] == 7


def test_constant_series_has_no_anomalies(spark):
    flat = ramp(spark).withColumn("value", F.lit(3.0))
    for method in anomaly.METHODS:
        assert anomaly.detect_anomalies(flat, ["k"], method).where("is_anomaly").count() == 0


# ---- charts, components, clusters, models ------------------------------------------------------

def test_histogram_keeps_every_row(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    got = chartdata.histogram(df, "x", 30)
    assert got.agg(F.sum("count")).first()[0] == 1000 and got.count() == 30


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "x double, c string, t timestamp_ntz")
    assert chartdata.histogram(df, "x").count() == 0
    assert chartdata.kde_curve(df, "x").count() == 0
    assert chartdata.pie_shares(df, "c").count() == 0
    assert one(clean.duplicate_count(df)) == {"row_count": 0, "duplicate_rows": 0}


def test_pca_keeps_the_variance(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=500)
    df = spark.createDataFrame([(float(x), float(2 * x + n), float(m)) for x, n, m in zip(a, rng.normal(0, 0.1, 500), rng.normal(size=500))], "a double, b double, c double")
    fit = reduce.fit_pca(df, 3)
    assert sum(fit.ratios) == pytest.approx(1.0)
    scores = reduce.pca(df, fit=fit).agg(*[F.var_pop(f"PC{i}") for i in (1, 2, 3)]).first()
    assert [v / 3 for v in scores] == pytest.approx(fit.ratios, abs=1e-6)
    assert reduce.pca_importance(df, 2).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def blobs(spark):
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(c, 0.2, size=(60, 2)) for c in (0, 5, 10)])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, x double, y double")


def test_clusterers_find_the_blobs(spark):
    df = blobs(spark)
    for fit in (cluster.kmeans, cluster.hierarchical, cluster.gmm):
        out = fit(df, 3, ["x", "y"])
        sizes = out.groupBy("cluster", (F.col("id") / 60).cast("int")).count().collect()
        assert len(sizes) == 3, fit.__name__
    best = cluster.optimal_k(df, 5, "silhouette", ["x", "y"]).where("is_optimal").first()["n_clusters"]
    assert best == 3
    table = cluster.compare_clusterers(df, 3, ["x", "y"], algorithms=("kmeans", "dbscan"), eps=0.3)
    assert {r["algorithm"]: r["n_clusters"] for r in table.collect()} == {"kmeans": 3, "dbscan": 3}


def test_single_gaussian_matches_the_mixture_formula(spark):
    table = cluster.optimal_gmm(blobs(spark), 3, ["x", "y"])
    bic = {r["n_components"]: r["bic"] for r in table.collect()}
    assert bic[3] < bic[1]


def test_models_learn(spark):
    df = spark.range(600).select("id", (F.col("id") % 17).alias("a"), (F.col("id") % 5).alias("b")).withColumn("y", F.col("a") * 3.0 - F.col("b"))
    data = model.prepare_ml(df, "y", ["id"])
    assert one(model.regression_report(model.linear_regression(data, ["id"])))["r2"] > 0.999
    classes = model.prepare_ml(df.withColumn("c", F.when(F.col("a") > 8, "hi").otherwise("lo")).drop("y"), "c", ["id"])
    report = {r["class"]: r for r in model.classification_report(model.random_forest_classification(classes, ["id"], 10)).collect()}
    assert report["accuracy"]["f1"] > 0.95


# ---- business rules ----------------------------------------------------------------------------

def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 5, 1), 10.0, 1)], "user_id int, order_date timestamp_ntz, total_price double, order_id int")
    row = one(kpi.kpi_30d_revenue(df))
    assert row["previous_revenue"] == 0.0 and row["growth_percentage"] is None


def test_price_bands_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (10000.0,), (10000.5,), (200000.0,)], "total_price double")
    assert {r["band"]: r["count"] for r in insights.price_band_share(df).collect()} == {"under_10k": 1, "10k_30k": 1, "over_100k": 1}


def test_null_users_are_no_group(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "user_id int")
    assert one(insights.repeat_rate(df)) == {"users": 1, "repeat_users": 1, "repeat_rate": 100.0}


def test_declining_category_fires(spark):
    now = dt.datetime(2024, 6, 30)
    rows = [("a", now - dt.timedelta(days=40), 100.0), ("b", now - dt.timedelta(days=40), 100.0), ("a", now, 90.0), ("b", now, 20.0)]
    df = spark.createDataFrame(rows, "category string, order_date timestamp_ntz, total_price double")
    row = one(insights.declining_category(df))
    assert row["category"] == "b" and row["change_percentage"] == pytest.approx(-80.0)


def test_single_row_class_is_raised(spark):
    from brightlake.operators import neighbors

    rows = spark.createDataFrame([(i, float(i), "a") for i in range(8)] + [(9, 5.0, "b")], "id long, x double, t string")
    got = neighbors.smote(rows, "t", ["id"], ["x"])
    assert {r["t"]: r["count"] for r in got.groupBy("t").count().collect()} == {"a": 8, "b": 8}


def test_text_named_like_a_date_stays(spark):
    from brightlake.operators import clean

    rows = spark.createDataFrame([(i, "Monday" if i % 2 else "Friday", float(i)) for i in range(10)], "id long, weekday string, v double")
    assert clean.preprocess(rows).where("weekday IN ('Monday', 'Friday')").count() == 10


def test_short_series_keep_their_horizon(spark):
    from brightlake.operators import forecast

    rows = [("long", i, float(i)) for i in range(40)] + [("short", i, float(i)) for i in range(5)]
    frame = spark.createDataFrame(rows, "k string, d int, value double").selectExpr("k", "date_add(DATE'2024-01-01', d) AS ts", "value")
    got = forecast.naive_forecast(frame, ["k"], "seasonal", period=7, n_test=2).where("k = 'short'").orderBy("h").collect()
    assert [r["forecast"] for r in got] == [0.0, 1.0]


# ---- windows and periods of each series' own ---------------------------------------------------

def mixed(spark):
    """Daily series of 60, 25, 12 and 5 steps and a monthly one."""
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 100.0 + 3 * i + 10 * (i % 7) + (i * 37 % 11)) for k, n in (("a", 60), ("b", 25), ("c", 12), ("d", 5)) for i in range(n)]
    rows += [("m", dt.datetime(2020 + i // 12, i % 12 + 1, 1), 50.0 + i % 12 + i * 7 % 5) for i in range(40)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")


ALONE = {
    "rolling": lambda s: series.rolling_stats(s, ["k"], 7),
    "rolling_centred": lambda s: series.rolling_stats(s, ["k"], 8, center=True),
    "seasonal": lambda s: forecast.naive_forecast(s, ["k"], "seasonal"),
    "ets": lambda s: forecast.exponential_smoothing(s, ["k"], seasonal="add", alpha=0.3),
    "ar": lambda s: forecast.ar_forecast(s, ["k"], n_test=3),
    "future": lambda s: forecast.forecast_future(s, ["k"], 4, "seasonal"),
    "future_ar": lambda s: forecast.forecast_future(s, ["k"], 4, "ar"),
    "anomalies": lambda s: anomaly.compare_anomaly_methods(s, ["k"], threshold=1.5),
}


@pytest.mark.parametrize("form", ALONE)
def test_a_series_does_not_depend_on_the_others(spark, form):
    def plain(df):
        return sorted([tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)

    s = mixed(spark)
    apart = [r for k in "abcdm" for r in plain(ALONE[form](s.where(F.col("k") == k)))]
    assert plain(ALONE[form](s)) == sorted(apart, key=str)


@pytest.mark.parametrize("center", [False, True])
@pytest.mark.parametrize("window", [2, 3, 7, 10])
def test_own_frames_are_row_frames(spark, window, center):
    x = np.array([r["value"] for r in mixed(spark).where("k = 'a'").orderBy("ts").collect()])
    got = [r["rolling_mean"] for r in series.rolling_stats(mixed(spark), ["k"], window, center).where("k = 'a'").orderBy("ts").collect()]
    back, on = (window // 2, (window - 1) // 2) if center else (window - 1, 0)
    for i, g in enumerate(got):
        full = i >= back and i + on < len(x)
        assert (g is None) == (not full) and (not full or abs(g - x[i - back : i + on + 1].mean()) < 1e-9)


def test_default_periods_and_windows(spark):
    models = {r["k"]: r["model"] for r in forecast.naive_forecast(mixed(spark), ["k"], "seasonal").select("k", "model").distinct().collect()}
    assert models == {"a": "seasonal_7", "b": "seasonal_7", "c": "seasonal_7", "d": "seasonal_7", "m": "seasonal_12"}
    found = anomaly.compare_anomaly_methods(mixed(spark), ["k"], ("std",)).groupBy("k").agg(F.sort_array(F.collect_set("window")).alias("w")).collect()
    assert {r["k"]: r["w"] for r in found} == {"a": [7, 30], "b": [8], "c": [4], "d": [], "m": [7, 30]}


def test_short_series_keep_their_rows(spark):
    out = forecast.ar_forecast(mixed(spark).where("k in ('a', 'd')"), ["k"], n_test=3).where("k = 'd'")
    assert out.count() == 3 and out.where("forecast IS NOT NULL").count() in (0, 3)
    assert forecast.forecast_future(mixed(spark), ["k"], 4, "best").groupBy("k").count().where("count = 4").count() == 5
