"""Fits of smoothing and autoregression with shocks, against plain recursions and regressions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightlake.operators import forecast


def series(spark, values, key="k"):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(key, day + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "k string, ts timestamp_ntz, value double")


def holt_winters(x, w, m, steps):
    """Damped additive trend and additive season, one weight set, one step at a time."""
    alpha, beta, gamma, phi = w
    level, slope = x[:m].mean(), (x[m : 2 * m].mean() - x[:m].mean()) / m
    season, error = list(x[:m] - level), 0.0
    for t, v in enumerate(x):
        base, s = level + phi * slope, season[t % m]
        error += (v - base - s) ** 2
        new = alpha * (v - s) + (1 - alpha) * base
        slope = beta * (new - level) + (1 - beta) * phi * slope
        season[t % m] = gamma * (v - base) + (1 - gamma) * s
        level = new
    reach = np.cumsum([phi**h if phi < 1 else 1.0 for h in range(1, steps + 1)])
    return error, [level + slope * r + season[(len(x) + h) % m] for h, r in enumerate(reach)]


def multiplied(x, w, m, steps):
    """Multiplied trend and season."""
    alpha, beta, gamma, _ = w
    level = x[:m].mean()
    slope, season, error = (x[m : 2 * m].mean() / level) ** (1 / m), list(x[:m] / level), 0.0
    for t, v in enumerate(x):
        base, s = level * slope, season[t % m]
        error += (v - base * s) ** 2
        new = alpha * v / s + (1 - alpha) * base
        slope = beta * new / level + (1 - beta) * slope
        season[t % m] = gamma * v / base + (1 - gamma) * s
        level = new
    return error, [level * slope**h * season[(len(x) + h - 1) % m] for h in range(1, steps + 1)]


@pytest.mark.parametrize("kind,plain", [("add", holt_winters), ("mul", multiplied)])
def test_all_weights_in_one_pass(kind, plain):
    rnd = np.random.default_rng(1)
    x = 20 + 0.3 * np.arange(60) + 4 * np.sin(np.arange(60) * 2 * np.pi / 7) + rnd.normal(size=60)
    weights = np.column_stack([rnd.uniform(0.05, 0.9, size=(20, 3)), rnd.choice([0.8, 1.0], 20) if kind == "add" else np.ones(20)])
    error, guess = forecast.smooth(x, 9, weights, kind, kind, 7)
    for w, e, g in zip(weights, error, guess):
        want_e, want_g = plain(x, w, 7, 9)
        assert e == pytest.approx(want_e) and list(g) == pytest.approx(want_g)


def test_smoothing_fit_names_weights_and_criteria(spark):
    rnd = np.random.default_rng(2)
    x = 50 + np.arange(80) + 5 * np.sin(np.arange(80) * 2 * np.pi / 7) + rnd.normal(size=80)
    s = series(spark, x).unionByName(series(spark, [1.0, 2.0, 3.0], "short"))
    got = {r["k"]: r for r in forecast.smoothing_fit(s, ["k"], "add", "add", 7, True).collect()}
    r = got["k"]
    train = x[:64]
    error, _ = holt_winters(train, (r["alpha"], r["beta"], r["gamma"], r["phi"]), 7, 1)
    assert r["sse"] == pytest.approx(error) and r["n"] == 64
    assert r["aic"] == pytest.approx(64 * math.log(error / 64) + 2 * 12)
    assert r["bic"] == pytest.approx(64 * math.log(error / 64) + math.log(64) * 12)
    assert got["short"]["sse"] is None and got["short"]["aic"] is None and got["short"]["n"] == 2
    assert forecast.smoothing_fit(s.limit(0), ["k"]).count() == 0


def brute_arma(x, p, q):
    """The two regressions on one array; coefficients, squared error, rows and shocks."""
    long = p + q + 5
    lagged = lambda v, n: np.column_stack([v[n - j : len(v) - j] for j in range(1, n + 1)])
    a = np.column_stack([np.ones(len(x) - long), lagged(x, long)])
    e = np.full(len(x), np.nan)
    e[long:] = x[long:] - a @ np.linalg.lstsq(a, x[long:], rcond=None)[0]
    start = long + q
    rows = np.column_stack([np.ones(len(x) - start), *[x[start - j : len(x) - j] for j in range(1, p + 1)], *[e[start - j : len(x) - j] for j in range(1, q + 1)]])
    beta, *_ = np.linalg.lstsq(rows, x[start:], rcond=None)
    return beta, float(((x[start:] - rows @ beta) ** 2).sum()), len(rows), e


def test_shocks_equal_two_regressions(spark):
    rnd = np.random.default_rng(4)
    e = rnd.normal(size=1500)
    x = np.zeros(1500)
    for t in range(1, 1500):
        x[t] = 1.0 + 0.6 * x[t - 1] + e[t] + 0.5 * e[t - 1]
    s = series(spark, x)
    r = forecast.ar_fit(s, ["k"], 1, 0, 1).first()
    beta, sse, n, shocks = brute_arma(x[:1200], 1, 1)
    assert [r["intercept"], *r["ar"], *r["ma"]] == pytest.approx(list(beta)) and r["n"] == n
    assert r["sse"] == pytest.approx(sse) and r["aic"] == pytest.approx(n * math.log(sse / n) + 6)
    assert r["ar"][0] == pytest.approx(0.6, abs=0.08) and r["ma"][0] == pytest.approx(0.5, abs=0.08)
    guess = [row["forecast"] for row in forecast.ar_forecast(s, ["k"], 1, 0, q=1).orderBy("h").collect()]
    want, last, shock = [], x[1199], shocks[1199]
    for _ in range(len(guess)):
        last, shock = beta[0] + beta[1] * last + beta[2] * shock, 0.0
        want.append(last)
    assert guess == pytest.approx(want)


def test_short_series_have_no_fit(spark):
    s = series(spark, range(5)).unionByName(series(spark, np.random.default_rng(0).normal(size=60), "long"))
    got = {r["k"]: r for r in forecast.ar_fit(s, ["k"], 2, 1, 2).collect()}
    assert got["k"]["sse"] is None and got["k"]["aic"] is None and got["long"]["aic"] is not None
    out = forecast.ar_forecast(s, ["k"], 2, 1, q=2)
    assert out.where("k = 'k'").count() == 1 and out.where("k = 'k' AND forecast IS NOT NULL").count() == 0
    assert out.where("k = 'long' AND forecast IS NULL").count() == 0
    assert forecast.ar_fit(s.limit(0), ["k"], 1, 1, 1).count() == 0


def test_models_are_compared_with_criteria(spark):
    s = series(spark, np.random.default_rng(5).normal(size=60))
    table = forecast.compare_models(
        [forecast.naive_forecast(s, ["k"]), forecast.ar_forecast(s, ["k"])], ["k"], [forecast.ar_fit(s, ["k"])]
    )
    assert {(r["model"], r["aic"] is None) for r in table.collect()} == {("last", True), ("ar_1_1", False)}
    assert table.where(F.col("rmse").isNull()).count() == 0


def test_forests_train_on_even_shares(spark, monkeypatch):
    # all rows come in one partition: no task may hold the draws of all trees for all of them
    from pyspark.ml.regression import RandomForestRegressor

    from brightlake import session
    from brightlake.operators import model, relate

    seen, fit = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, data: seen.append((data.rdd.getNumPartitions(), data.count())) or fit(self, data))
    monkeypatch.setattr(session, "SHARE_ROWS", 100)
    df = spark.range(1000).coalesce(1).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 7 * 2.0).alias("y"))
    assert model.random_forest_regression(model.prepare_ml(df, "y", ["id"]), ["id"], trees=3).count() > 100
    assert relate.forest_importance(df, "y", ["x"], trees=3).first()["importance"] == pytest.approx(1)
    assert len(seen) == 2 and all(parts >= rows / 100 for parts, rows in seen)
