"""Splits, forecasts and their errors for many series at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from brightlake.functions.columns import col, count_if, num
from brightlake.operators.series import TS, VALUE, by_time, cols, detect_frequency, normal_sums, whole


def split_series(
    series: DataFrame, key: Sequence[str], test_size: float = 0.2, n_test: int | None = None, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """(key..., ts, value, i, n, cut, is_test) in time order; each side keeps a row at least."""
    known = series.where(num(value).isNotNull()).select(*cols(key), col(ts).alias(TS), num(value).alias(VALUE))
    n = F.count(F.lit(1)).over(whole(key))
    numbered = known.withColumns({"i": F.row_number().over(by_time(key)) - 1, "n": n})
    raw = F.col("n") - n_test if n_test else F.floor(F.col("n") * F.lit(1.0 - test_size))
    cut = F.greatest(F.lit(1).cast("long"), F.least(raw.cast("long"), F.col("n") - 1))
    return numbered.withColumn("cut", cut).withColumn("is_test", F.col("i") >= F.col("cut"))


def seasons(train: DataFrame, key: Sequence[str], period: int | None) -> DataFrame:
    """(key..., _p): the given seasonal period, else each series' own: 7 daily, 12 monthly, 4 quarterly,
    half the length up to 12 for other frequencies and single rows."""
    sizes = train.groupBy(*cols(key)).agg(F.count(F.lit(1)).alias("_n"))
    if period:
        return sizes.select(*cols(key), F.lit(period).cast("long").alias("_p"))
    letter, half = F.col("frequency"), F.floor(F.col("_n") / 2)
    own = F.when(letter == "D", 7).when(letter == "M", 12).when(letter == "Q", 4).otherwise(F.greatest(F.lit(1), F.least(half, F.lit(12))))
    known = sizes.join(detect_frequency(train, key).drop("gap_seconds"), list(key), "left")
    return known.select(*cols(key), own.cast("long").alias("_p"))


def _naive_state(train: DataFrame, key: Sequence[str]) -> DataFrame:
    """What the simple forecasts need of a training part, one row per key."""
    return train.groupBy(*cols(key)).agg(
        F.max_by(VALUE, "i").alias("_last"),
        F.min_by(VALUE, "i").alias("_first"),
        F.avg(VALUE).alias("_mean"),
        F.count(F.lit(1)).alias("_n"),
    )


def _naive_value(method: str) -> Column:
    """Forecast ``h`` steps ahead (from 1)."""
    if method == "last":
        return F.col("_last")
    if method == "mean":
        return F.col("_mean")
    slope = F.coalesce(F.try_divide(F.col("_last") - F.col("_first"), F.col("_n") - 1), F.lit(0.0))
    return F.col("_last") + slope * F.col("h")


def _naive(train: DataFrame, horizon: DataFrame, key: Sequence[str], method: str, period: int | None) -> DataFrame:
    """Add ``forecast`` and ``model`` to ``horizon`` rows (key..., h, ...)."""
    if method in ("last", "mean", "drift"):
        out = horizon.join(_naive_state(train, key), list(key)).withColumns({"forecast": _naive_value(method), "model": F.lit(method)})
        return out.drop("_last", "_first", "_mean", "_n")
    if method != "seasonal":
        raise ValueError(f"unknown forecast method: {method}")
    # a series shorter than the period repeats what it has; without training rows the forecast is null
    own = seasons(train, key, period)
    sized = train.withColumn("_n", F.count(F.lit(1)).over(whole(key))).join(own, list(key)).withColumn("_m", F.least("_n", "_p"))
    tail = sized.where(F.col("i") >= F.col("_n") - F.col("_m")).select(
        *cols(key), (F.col("i") - (F.col("_n") - F.col("_m"))).cast("long").alias("_s"), F.col(VALUE).alias("forecast")
    )
    sizes = sized.groupBy(*cols(key)).agg(F.max("_m").alias("_m"), F.concat(F.lit("seasonal_"), F.max("_p")).alias("model"))
    at = horizon.join(sizes, list(key), "left").withColumn("_s", ((F.col("h") - 1) % F.col("_m")).cast("long")).drop("_m")
    return at.join(tail, [*key, "_s"], "left").drop("_s")


def naive_forecast(
    series: DataFrame, key: Sequence[str], method: str = "last", period: int | None = None,
    test_size: float = 0.2, n_test: int | None = None, ts: str = TS, value: str = VALUE,
) -> DataFrame:
    """(key..., ts, h, actual, forecast, model) over the test part of every series."""
    parts = split_series(series, key, test_size, n_test, ts, value)
    out = _naive(parts.where(~F.col("is_test")), _test_rows(parts, key), key, method, period)
    return out.select(*cols(key), TS, "h", "actual", "forecast", "model")


def _test_rows(parts: DataFrame, key: Sequence[str]) -> DataFrame:
    return parts.where("is_test").select(
        *cols(key), TS, (F.col("i") - F.col("cut") + 1).alias("h"), F.col(VALUE).alias("actual")
    )


def forecast_metrics(forecast: DataFrame, by: Sequence[str]) -> DataFrame:
    """MSE, RMSE, MAE and MAPE (null if an actual value is zero) per ``by`` group."""
    off = F.col("actual") - F.col("forecast")
    return forecast.groupBy(*cols(by)).agg(
        F.avg(off * off).alias("mse"),
        F.sqrt(F.avg(off * off)).alias("rmse"),
        F.avg(F.abs(off)).alias("mae"),
        F.when(
            count_if(F.col("actual") == 0) == 0, F.avg(F.abs(F.try_divide(off, F.col("actual")))) * 100
        ).alias("mape"),
    )


# ---- exponential smoothing ---------------------------------------------------------------------

def smooth(
    x: np.ndarray, horizon: int, weights: np.ndarray, trend: str | None, seasonal: str | None, m: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squared one-step errors and forecasts of one series, for every row of weights
    (alpha, beta, gamma, phi) in one pass over its steps."""
    alpha, beta, gamma, phi = np.asarray(weights, dtype=float).T
    level = float(x[:m].mean()) if seasonal else float(x[0])
    slope = 0.0
    if trend == "add":
        slope = float((x[m : 2 * m].mean() - x[:m].mean()) / m) if seasonal else float(x[1] - x[0])
    elif trend == "mul":
        top, base = (x[m : 2 * m].mean(), x[:m].mean()) if seasonal else (x[1], x[0])
        slope = float((top / base) ** (1.0 / (m if seasonal else 1))) if base else 1.0
    season = np.zeros((m, len(alpha)))
    if seasonal:
        season += (x[:m] - level if seasonal == "add" else x[:m] / level)[:, None]
    level, slope = np.full(len(alpha), level), np.full(len(alpha), slope)
    if trend and not seasonal:  # one step before the first value
        level = level - phi * slope if trend == "add" else np.divide(level, slope**phi, out=level.copy(), where=slope != 0)
    error = np.zeros(len(alpha))

    def ahead(lv: np.ndarray, sl: np.ndarray, steps) -> np.ndarray:
        if trend == "add":
            return lv + sl * steps
        return lv * sl**steps if trend == "mul" else lv

    def share(value, base: np.ndarray, otherwise) -> np.ndarray:
        return np.where(base != 0, value / np.where(base != 0, base, 1.0), otherwise)

    for t, value in enumerate(x):
        base = ahead(level, slope, phi)
        s = season[t % m] if seasonal else 0.0
        guess = base * s if seasonal == "mul" else base + s
        error += (value - guess) ** 2
        clean = share(value, s, value) if seasonal == "mul" else value - s
        new = alpha * clean + (1 - alpha) * base
        if trend == "add":
            slope = beta * (new - level) + (1 - beta) * phi * slope
        elif trend == "mul":
            slope = beta * share(new, level, 1.0) + (1 - beta) * slope**phi
        if seasonal == "add":
            season[t % m] = gamma * (value - base) + (1 - gamma) * s
        elif seasonal == "mul":
            season[t % m] = gamma * share(value, base, 1.0) + (1 - gamma) * s
        level = new
    out, reach = [], np.zeros(len(alpha))
    for h in range(1, horizon + 1):
        reach = reach + np.where(phi < 1, phi**h, 1.0)
        base = ahead(level, slope, reach)
        s = season[(len(x) + h - 1) % m] if seasonal else 0.0
        out.append(base * s if seasonal == "mul" else base + s)
    return error, np.array(out).reshape(horizon, len(alpha)).T


GRID = (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
COARSE = (0.05, 0.2, 0.5)


def _best_smooth(x, horizon, trend, seasonal, m, damped, alpha):
    """Weights, error and forecasts: smallest one-step error on a grid, then on a finer one around it."""
    alphas = GRID if alpha is None else (alpha,)
    betas = COARSE if trend else (0.0,)
    gammas = COARSE if seasonal else (0.0,)
    phis = (0.8, 0.9, 0.98) if damped and trend else (1.0,)

    def run(grid):
        grid = np.array(list(grid))
        with np.errstate(all="ignore"):
            error, guess = smooth(x, horizon, grid, trend, seasonal, m)
        at = int(np.argmin(np.where(np.isnan(error), np.inf, error)))
        return grid[at], float(error[at]), guess[at]

    best = run(product(alphas, betas, gammas, phis))
    if alpha is None:
        w = best[0]
        near = lambda v, on: sorted({min(0.99, max(0.01, v * f)) for f in (0.7, 0.85, 1.0, 1.15, 1.3)}) if on else (v,)
        best = run(product(near(w[0], True), near(w[1], bool(trend)), near(w[2], bool(seasonal)), (w[3],)))
    return best


def ets_label(trend: str | None, seasonal: str | None, period: int, damped: bool) -> str:
    parts = [f"trend_{trend}" + ("_damped" if damped else "")] if trend else []
    parts += [f"seasonal_{seasonal}_{period}"] if seasonal else []
    return "_".join(["ets", *parts])


def exponential_smoothing(
    series: DataFrame, key: Sequence[str], trend: str | None = None, seasonal: str | None = None,
    period: int | None = None, damped: bool = False, alpha: float | None = None,
    test_size: float = 0.2, n_test: int | None = None, ts: str = TS, value: str = VALUE,
) -> DataFrame:
    """Simple, Holt or Holt-Winters smoothing fitted per series: (key..., ts, h, actual, forecast,
    model). The recursion is per key; keys run in parallel and each holds time steps only."""
    parts = split_series(series, key, test_size, n_test, ts, value)
    sized = _with_season(parts, parts.where(~F.col("is_test")), key, seasonal, period)
    fields = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in key)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        train, test = pdf[~pdf["is_test"]], pdf[pdf["is_test"]]
        guess, label = _smoothed(train[VALUE].to_numpy(dtype=float), len(test), trend, seasonal, int(pdf["_p"].iloc[0]), damped, alpha)
        return test[[*key, TS]].assign(
            h=np.arange(1, len(test) + 1), actual=test[VALUE].to_numpy(), forecast=guess, model=label
        )

    return (
        sized.select(*cols(key), TS, VALUE, "i", "is_test", "_p")
        .groupBy(*cols(key))
        .applyInPandas(one, f"{fields}, ts timestamp_ntz, h long, actual double, forecast double, model string")
    )


def _with_season(rows: DataFrame, train: DataFrame, key: Sequence[str], seasonal: str | None, period: int | None) -> DataFrame:
    """Add each series' period ``_p`` (1 without a season)."""
    if not seasonal:
        return rows.withColumn("_p", F.lit(1).cast("long"))
    return rows.join(seasons(train, key, period), list(key))


def _can_smooth(x: np.ndarray, seasonal: str | None, m: int) -> bool:
    return len(x) >= max(2, 2 * m if seasonal else 2)


def _smoothed(x: np.ndarray, steps: int, trend, seasonal, m: int, damped: bool, alpha) -> tuple[np.ndarray, str]:
    """Forecasts and label; a series shorter than two seasons takes its mean."""
    fits = _can_smooth(x, seasonal, m)
    guess = _best_smooth(x, steps, trend, seasonal, m, damped, alpha)[2] if fits else np.full(steps, x.mean())
    return guess, ets_label(trend, seasonal, m, damped)


def criteria(n: Column, sse: Column, k: Column) -> dict[str, Column]:
    """Akaike's and Schwarz's criterion of a fit with ``k`` parameters, constants left out; null for an exact fit."""
    fit = F.when((n > 0) & (sse > 0), n * F.log(sse / n))
    return {"aic": fit + 2 * k, "bic": fit + k * F.log(n)}


def smoothing_fit(
    series: DataFrame, key: Sequence[str], trend: str | None = None, seasonal: str | None = None,
    period: int | None = None, damped: bool = False, alpha: float | None = None,
    test_size: float = 0.2, n_test: int | None = None, ts: str = TS, value: str = VALUE,
) -> DataFrame:
    """(key..., model, n, alpha, beta, gamma, phi, sse, parameters, aic, bic) of the fit on each training part.

    ``parameters`` counts level and trend with a weight and a start each, one start per season, and the damping.
    A series shorter than two seasons has no weights and no error.
    """
    parts = split_series(series, key, test_size, n_test, ts, value)
    train = parts.where(~F.col("is_test"))
    sized = _with_season(train, train, key, seasonal, period)
    fields = ", ".join(f"`{c}` {series.schema[c].dataType.simpleString()}" for c in key)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, m = pdf.sort_values("i")[VALUE].to_numpy(dtype=float), int(pdf["_p"].iloc[0])
        w, sse = [None] * 4, None
        if _can_smooth(x, seasonal, m):
            w, sse, _ = _best_smooth(x, 0, trend, seasonal, m, damped, alpha)
        used = [True, bool(trend), bool(seasonal), bool(damped and trend)]
        row = {c: pdf[c].iloc[0] for c in key} | {"model": ets_label(trend, seasonal, m, damped), "n": len(x)}
        row |= {c: v if on else None for c, v, on in zip(("alpha", "beta", "gamma", "phi"), w, used)}
        return pd.DataFrame([row | {"sse": sse, "parameters": 2 + 2 * bool(trend) + (m if seasonal else 0) + used[3]}])

    out = sized.select(*cols(key), VALUE, "i", "_p").groupBy(*cols(key)).applyInPandas(
        one, f"{fields}, model string, n long, alpha double, beta double, gamma double, phi double, sse double, parameters long"
    )
    return out.withColumns(criteria(F.col("n"), F.col("sse"), F.col("parameters")))


# ---- autoregression ----------------------------------------------------------------------------

def _difference_once(df: DataFrame, key: Sequence[str], column: str) -> Column:
    return col(column) - F.lag(col(column)).over(by_time(key))


def ar_forecast(
    series: DataFrame, key: Sequence[str], p: int = 1, d: int = 1,
    test_size: float = 0.2, n_test: int | None = None, ts: str = TS, value: str = VALUE, q: int = 0,
) -> DataFrame:
    """Autoregression of order p on the d-times differenced series by least squares, with ``q``
    moving-average terms if asked for (Hannan and Rissanen's regressions).

    The sums of every key's normal equations are one Spark aggregate; what reaches Python is one
    row per key: these sums, the last p differences and the last values to integrate from.
    """
    parts = split_series(series, key, test_size, n_test, ts, value)
    out = _autoregressed(parts.where(~F.col("is_test")), _test_rows(parts, key), key, p, d, q)
    return out.select(*cols(key), TS, "h", "actual", "forecast", "model")


def ar_fit(
    series: DataFrame, key: Sequence[str], p: int = 1, d: int = 1, q: int = 0,
    test_size: float = 0.2, n_test: int | None = None, ts: str = TS, value: str = VALUE,
) -> DataFrame:
    """(key..., model, n, intercept, ar, ma, sse, parameters, aic, bic) of the fit on each training part.

    ``parameters`` counts the coefficients. A series too short for a fit has no coefficients and no error.
    """
    train = split_series(series, key, test_size, n_test, ts, value).where(~F.col("is_test"))
    sums, _ = _arma_sums(train, key, p, d, q)
    beta = F.col("_beta")
    out = _solved(sums, key, 1 + p + q).select(
        *cols(key), F.lit(ar_label(p, d, q)).alias("model"), F.col("n"),
        F.element_at(beta, 1).alias("intercept"), F.slice(beta, 2, p).alias("ar"), F.slice(beta, 2 + p, q).alias("ma"),
        "sse", F.when(beta.isNotNull(), F.lit(1 + p + q).cast("long")).alias("parameters"),
    )
    keys = train.select(*cols(key)).distinct()
    return keys.join(out, list(key), "left").withColumns({"model": F.lit(ar_label(p, d, q)), "n": F.coalesce("n", F.lit(0).cast("long"))}).withColumns(
        criteria(F.col("n"), F.col("sse"), F.col("parameters"))
    )


def ar_label(p: int, d: int, q: int) -> str:
    return f"arma_{p}_{d}_{q}" if q else f"ar_{p}_{d}"


def _solve(xx, xy) -> np.ndarray:
    b = np.asarray(xy, dtype=float)
    return np.linalg.lstsq(np.asarray(xx, dtype=float).reshape(len(b), len(b)), b, rcond=None)[0]


def _solved(sums: DataFrame, key: Sequence[str], terms: int) -> DataFrame:
    """Add the coefficients ``_beta`` and the sum of squared errors to normal sums; null with fewer rows than terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            betas, errors = [], []
            for n, xx, xy, yy in zip(pdf["n"], pdf["xx"], pdf["xy"], pdf["yy"]):
                beta = _solve(xx, xy) if n >= terms else None
                betas.append(beta)
                errors.append(None if beta is None else max(0.0, float(yy - beta @ np.asarray(xy, dtype=float))))
            yield pdf[[*key, "n"]].assign(_beta=betas, sse=errors)

    fields = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in key)
    return sums.select(*cols(key), "n", "xx", "xy", "yy").mapInPandas(run, f"{fields}, n long, _beta array<double>, sse double")


def _arma_sums(train: DataFrame, key: Sequence[str], p: int, d: int, q: int) -> tuple[DataFrame, DataFrame]:
    """Normal sums of the step on its last p steps and last q shocks, and the rows with ``_d0`` to ``_d<d>``
    and the shock ``_e``.

    Shocks are the residuals of a longer autoregression of p + q + 5 steps, null before it can be applied.
    """
    rows = train.withColumns({"_d0": F.col(VALUE), "_n": F.count(F.lit(1)).over(whole(key))})
    for k in range(1, d + 1):
        rows = rows.withColumn(f"_d{k}", _difference_once(rows, key, f"_d{k - 1}"))
    top = f"_d{d}"
    longest = p + q + 5 if q else p
    lags = [f"_x{j}" for j in range(1, longest + 1)]
    rows = rows.withColumns({f"_x{j}": F.lag(col(top), j).over(by_time(key)) for j in range(1, longest + 1)})
    if not q:
        return normal_sums(rows, key, top, lags), rows.withColumn("_e", F.lit(None).cast("double"))
    first = _solved(normal_sums(rows, key, top, lags), key, longest + 1).select(*cols(key), "_beta")
    guess = F.element_at("_beta", 1)
    for j, lag in enumerate(lags):
        guess = guess + F.element_at("_beta", j + 2) * F.col(lag)
    rows = rows.join(first, list(key)).withColumn("_e", F.col(top) - guess).drop("_beta")
    rows = rows.withColumns({f"_s{j}": F.lag("_e", j).over(by_time(key)) for j in range(1, q + 1)})
    return normal_sums(rows, key, top, [*lags[:p], *[f"_s{j}" for j in range(1, q + 1)]]), rows


def _autoregressed(train: DataFrame, horizon: DataFrame, key: Sequence[str], p: int, d: int, q: int = 0) -> DataFrame:
    """Add ``forecast`` and ``model`` to ``horizon`` rows; the forecast is null where a series is too short for a fit."""
    sums, rows = _arma_sums(train, key, p, d, q)
    if q:
        sums = sums.where(F.col("n") >= 1 + p + q)
    top = f"_d{d}"
    ends = rows.withColumn("_back", F.col("_n") - F.col("i")).where(F.col("_back") <= max(p, q, 1))
    tail = ends.groupBy(*cols(key)).agg(
        F.sort_array(F.collect_list(F.struct("_back", F.col(top).alias("v"), F.col("_e").alias("e")))).alias("_tail"),
        *[F.max(F.when(F.col("_back") == 1, col(f"_d{k}"))).alias(f"_end{k}") for k in range(d)],
    )
    steps = horizon.groupBy(*cols(key)).agg(F.count(F.lit(1)).alias("_steps"))
    state = sums.join(tail, list(key)).join(steps, list(key))
    fields = ", ".join(f"`{k}` {train.schema[k].dataType.simpleString()}" for k in key)

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            frames = []
            for row in pdf.to_dict("records"):
                beta = _solve(row["xx"], row["xy"])
                recent = [t["v"] for t in row["_tail"]][:p]
                shocks = [t["e"] for t in row["_tail"]][:q]
                ends = [row[f"_end{k}"] for k in range(d)]
                guess = []
                for _ in range(int(row["_steps"])):
                    step = float(beta[0] + sum(c * v for c, v in zip(beta[1:], [*recent, *shocks])))
                    recent, shocks = [step, *recent][:p], [0.0, *shocks][:q]  # no shock is expected ahead
                    for k in reversed(range(d)):
                        ends[k] = step = ends[k] + step
                    guess.append(step)
                frames.append(pd.DataFrame({k: row[k] for k in key} | {"h": np.arange(1, len(guess) + 1), "forecast": guess}))
            if frames:
                yield pd.concat(frames)

    guesses = state.mapInPandas(roll, f"{fields}, h long, forecast double")
    return horizon.join(guesses, [*key, "h"], "left").withColumn("model", F.lit(ar_label(p, d, q)))


# ---- comparison and the future -----------------------------------------------------------------

def compare_models(forecasts: Sequence[DataFrame], key: Sequence[str], fits: Sequence[DataFrame] = ()) -> DataFrame:
    """Errors of every model, best RMSE first within a key. With ``fits`` (``smoothing_fit``, ``ar_fit``) also
    ``aic`` and ``bic``, null for models without a fit."""
    table = forecasts[0]
    for f in forecasts[1:]:
        table = table.unionByName(f)
    errors = forecast_metrics(table, [*key, "model"])
    if fits:
        known = [f.select(*cols(key), "model", "aic", "bic") for f in fits]
        errors = errors.join(reduce(DataFrame.unionByName, known), [*key, "model"], "left")
    return errors.orderBy(*cols(key), "rmse", "model")


def future_dates(last: Column, steps: int, freq: str) -> Column:
    """Array of the next ``steps`` dates: days, Sundays, or first days of months or quarters."""
    day = F.date_trunc("day", last).cast("timestamp_ntz")
    if freq == "W":
        first = F.date_add(F.to_date(day), 7)
        first = F.date_add(first, F.pmod(F.lit(6) - F.weekday(first), F.lit(7)))
        return F.sequence(first, F.date_add(first, 7 * (steps - 1)), F.expr("INTERVAL 7 days"))
    if freq in ("M", "Q"):
        unit, months, gap = ("month", 1, 31) if freq == "M" else ("quarter", 3, 92)
        at = F.date_add(F.to_date(day), gap)
        start = F.to_date(F.date_trunc(unit, at))
        first = F.when(start == at, at).otherwise(F.add_months(start, months))
        return F.sequence(first, F.add_months(first, months * (steps - 1)), F.expr(f"INTERVAL {months} months"))
    first = F.date_add(F.to_date(day), 1)
    return F.sequence(first, F.date_add(first, steps - 1), F.expr("INTERVAL 1 day"))


def forecast_future(
    series: DataFrame, key: Sequence[str], steps: int = 10, method: str = "last", freq: str = "D",
    period: int | None = None, trend: str | None = None, seasonal: str | None = None, damped: bool = False,
    ts: str = TS, value: str = VALUE,
) -> DataFrame:
    """(key..., date, h, forecast, model) from a refit on all data: a simple model, ``ets`` (with the given
    trend, season and damping) or ``ar`` (orders 1, 1). ``best`` picks, per key, the model of all these with
    the smallest RMSE on the test split."""
    known = series.where(num(value).isNotNull()).select(*cols(key), col(ts).alias(TS), num(value).alias(VALUE))
    numbered = known.withColumn("i", F.row_number().over(by_time(key)) - 1)
    dates = known.groupBy(*cols(key)).agg(F.max(TS).alias("_last_ts")).select(
        *cols(key), F.posexplode(future_dates(F.col("_last_ts"), steps, freq)).alias("_p", "date")
    )
    horizon = dates.select(*cols(key), "date", (F.col("_p") + 1).cast("long").alias("h"))
    fields = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in key)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")[VALUE].to_numpy(dtype=float)
        guess, label = _smoothed(x, steps, trend, seasonal, int(pdf["_p"].iloc[0]), damped, None)
        return pd.DataFrame({k: pdf[k].iloc[0] for k in key} | {"h": np.arange(1, steps + 1), "forecast": guess, "model": label})

    def ahead(name: str) -> DataFrame:
        if name == "ar":
            return _autoregressed(numbered, horizon, key, 1, 1)
        if name != "ets":
            return _naive(numbered, horizon, key, name, period)
        sized = _with_season(numbered, numbered, key, seasonal, period)
        return horizon.join(sized.groupBy(*cols(key)).applyInPandas(one, f"{fields}, h long, forecast double, model string"), [*key, "h"])

    simple = ["last", "mean", "drift", "seasonal"]
    out = None
    for name in [*simple, "ets", "ar"] if method == "best" else [method]:
        part = ahead(name).select(*cols(key), "date", "h", "forecast", "model")
        out = part if out is None else out.unionByName(part)
    if method == "best":
        tried = [naive_forecast(series, key, n, period, ts=ts, value=value) for n in simple]
        tried.append(exponential_smoothing(series, key, trend, seasonal, period, damped, ts=ts, value=value))
        tried.append(ar_forecast(series, key, ts=ts, value=value))
        table = compare_models(tried, key).where("rmse IS NOT NULL")
        best = table.groupBy(*cols(key)).agg(F.min_by("model", F.struct("rmse", "model")).alias("model"))
        out = out.join(best, [*key, "model"]).select(*cols(key), "date", "h", "forecast", "model")
    return out
