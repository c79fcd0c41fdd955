"""Time series, many at once: long frames (key..., ts, value) with one row per key and time step.

``prepare_series`` collapses raw rows to a time grain with a partial aggregate, so one hot series is
cut down before any window: every window below spans the time steps of one key, never raw rows, and a
long series is cut into ranges that are lent their border rows (``plans/halo.py``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from brightlake.functions import fixed
from brightlake.functions.columns import col, datetime_columns, num, ratio
from brightlake.operators import impute
from brightlake.operators.clean import date_of_text, detect_date_columns
from brightlake.plans import halo
from brightlake.session import materialize, small_side

TS, VALUE = "ts", "value"


def by_time(key: Sequence[str], ts: str = TS) -> WindowSpec:
    return Window.partitionBy(*[col(k) for k in key]).orderBy(col(ts))


def whole(key: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*[col(k) for k in key])


def cols(names: Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


# ---- building ----------------------------------------------------------------------------------

def pick_date_column(df: DataFrame) -> str | None:
    """First date column, else the first text column that holds dates."""
    dates = datetime_columns(df)
    if dates:
        return dates[0]
    texts = {r["column"] for r in detect_date_columns(df).where("is_date AND date_share > 0.5").collect()}
    return next((c for c in df.columns if c in texts), None)


AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def prepare_series(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    value: str,
    grain: str | None = None,
    agg: str = "mean",
    fill: str | None = "ffill",
) -> DataFrame:
    """(key..., ts, value): one row per time step, duplicates aggregated, gaps filled in time order."""
    kind = df.schema[ts].dataType.typeName()
    stamp = date_of_text(col(ts)) if kind == "string" else col(ts).cast("timestamp_ntz")
    step = F.date_trunc(grain, stamp).cast("timestamp_ntz") if grain else stamp
    out = (
        df.select(*cols(key), step.alias(TS), num(value).alias(VALUE))
        .where(F.col(TS).isNotNull())
        .groupBy(*cols(key), TS)
        .agg(AGGREGATES[agg](VALUE).alias(VALUE))
    )
    if fill is None:
        return out
    filler = {"ffill": impute.ffill, "bfill": impute.bfill, "interpolate": impute.interpolate_time}[fill]
    return filler(out, key, TS, [VALUE])


UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def _step(freq: str) -> str:
    return {"D": "1 day", "W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year"}[freq]


def resample(series: DataFrame, key: Sequence[str], freq: str, agg: str = "mean", ts: str = TS, value: str = VALUE) -> DataFrame:
    """Day, week, month, quarter or year buckets, empty ones included; all but days are labelled by
    their last day. An empty bucket sums to 0 and is null otherwise."""
    start = F.date_trunc(UNITS[freq], col(ts)).cast("timestamp_ntz")
    got = series.groupBy(*cols(key), start.alias("_b")).agg(AGGREGATES[agg](num(value)).alias(VALUE))
    span = got.groupBy(*cols(key)).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    calendar = span.select(
        *cols(key), F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {_step(freq)}"))).alias("_b")
    )
    full = calendar.join(got, [*key, "_b"], "left")
    label = F.col("_b") if freq == "D" else F.col("_b") + F.expr(f"INTERVAL {_step(freq)}") - F.expr("INTERVAL 1 day")
    filled = F.coalesce(F.col(VALUE), F.lit(0.0)) if agg == "sum" else F.col(VALUE)
    return full.select(*cols(key), label.alias(TS), filled.alias(VALUE))


def detect_frequency(series: DataFrame, key: Sequence[str], ts: str = TS) -> DataFrame:
    """(key..., gap_seconds, frequency): letter of the most common gap, smallest gap on ties."""
    seconds = F.unix_seconds(col(ts).cast("timestamp"))
    gap = lambda rows, k: rows.withColumn("_g", seconds - F.lag(seconds).over(by_time(k, ts)))
    gaps = halo.windowed(series.select(*cols(key), col(ts)), key, ts, 1, 0, gap, halo.is_long(series, key)).where("_g IS NOT NULL")
    counts = gaps.groupBy(*cols(key), "_g").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*cols(key)).agg(F.min_by("_g", F.struct(-F.col("_n"), F.col("_g"))).alias("gap_seconds"))
    days = F.floor(F.col("gap_seconds") / F.lit(86400))
    rest = F.col("gap_seconds")
    letter = (
        F.when(rest < 60, "S")
        .when(rest < 3600, "T")
        .when(days == 0, "H")
        .when(days == 1, "D")
        .when(days.between(6, 8), "W")
        .when(days.between(28, 31), "M")
        .when(days.between(89, 93), "Q")
        .when(days.between(364, 366), "Y")
        .otherwise("D")
    )
    return best.withColumn("frequency", letter)


def default_period(frequency: Column, length: Column) -> Column:
    """Seasonal period of a frequency letter, by length where the letter has none."""
    ladder = F
    for letter, period in fixed.DEFAULT_PERIODS.items():
        ladder = ladder.when(frequency == letter, period)
    by_length = (
        F.when(length >= 365, 365)
        .when(length >= 52, 52)
        .when(length >= 12, 12)
        .otherwise(F.least(F.floor(length / F.lit(2)).cast("int"), F.lit(4)))
    )
    return ladder.otherwise(by_length)


def series_periods(series: DataFrame, key: Sequence[str], ts: str = TS) -> DataFrame:
    """(key..., frequency, length, period)."""
    sizes = series.groupBy(*cols(key)).agg(F.count(F.lit(1)).alias("length"))
    return (
        detect_frequency(series, key, ts)
        .join(sizes, list(key))
        .select(*cols(key), "frequency", "length", default_period(F.col("frequency"), F.col("length")).alias("period"))
    )


# ---- decomposition and rolling statistics -------------------------------------------------------

def decompose(
    series: DataFrame, key: Sequence[str], period: int, model: str = "additive", ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Observed, trend (centred moving average), seasonal (mean by phase) and residual."""
    half = period // 2
    x = num(value)
    long = halo.is_long(series, key)
    rows = halo.numbered(series.select(*cols(key), col(ts).alias(TS), x.alias("observed")), key, TS, long)

    def smooth(rows: DataFrame, k: list[str]) -> DataFrame:
        x, w = F.col("observed"), by_time(k)
        frame = w.rowsBetween(-half, half)
        if period % 2:
            return rows.withColumn("trend", F.when(F.count(x).over(frame) == period, F.avg(x).over(frame)))
        ends = (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2
        return rows.withColumn("trend", F.when(F.count(x).over(frame) == period + 1, (F.sum(x).over(frame) - ends) / period))

    base = halo.windowed(rows, key, TS, half, half, smooth, long)
    base = base.select(*cols(key), TS, "observed", "trend", (F.col(halo.NUMBER) % period).alias("_phase"))
    additive = model != "multiplicative"
    off = F.col("observed") - F.col("trend") if additive else F.try_divide(F.col("observed"), F.col("trend"))
    phases = base.groupBy(*cols(key), "_phase").agg(F.avg(off).alias("_m"))
    mean = F.avg("_m").over(whole(key))
    seasonal = phases.select(
        *cols(key), "_phase", (F.col("_m") - mean if additive else F.try_divide(F.col("_m"), mean)).alias("seasonal")
    )
    rest = (
        F.col("observed") - F.col("trend") - F.col("seasonal")
        if additive
        else F.try_divide(F.col("observed"), F.col("trend") * F.col("seasonal"))
    )
    return base.join(seasonal, [*key, "_phase"]).select(
        *cols(key), TS, "observed", "trend", "seasonal", rest.alias("residual")
    )


def frame_of(w: WindowSpec, window: int, center: bool) -> WindowSpec:
    return w.rowsBetween(-(window // 2), (window - 1) // 2) if center else w.rowsBetween(-(window - 1), 0)


def rolling(x: Column, fn, frame: WindowSpec, window: int | Column) -> Column:
    """``fn`` over full windows without gaps, else null."""
    return F.when(F.count(x).over(frame) == window, fn(x).over(frame))


_SCALE = 1_000_000_000  # places of a full window on the time axis of ``own_frame``


def own_frame(key: Sequence[str], center: bool) -> tuple[Column, WindowSpec]:
    """Time axis and frame for a window of ``_w`` rows that differs by key.

    The axis numbers the rows (``_i``) in units of a key's own window, so one range frame holds exactly
    ``_w`` rows of every key: whole windows apart are whole units apart, and rounding moves a row by
    less than one of the billion places.
    """
    axis = F.expr(f"_i * {_SCALE}L div _w")
    low, high = (-(_SCALE // 2 + 1), _SCALE // 2 - 2) if center else (-(_SCALE - 1), 0)
    return axis, Window.partitionBy(*cols(key)).orderBy("_x").rangeBetween(low, high)


def own_length(window: int) -> Column:
    """A window over half of a series shrinks to a tenth of it, two at least."""
    n = F.col(halo.LENGTH)
    own = F.when(F.lit(window) > F.floor(n / 2), F.greatest(F.floor(n / 10), F.lit(2))).otherwise(F.lit(window))
    return own.cast("long")


def rolling_stats(
    series: DataFrame, key: Sequence[str], window: int = 7, center: bool = False, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Rolling mean, std, min and max over full windows, and the exponential mean of that span.

    Each key's window depends on its own length only.
    """
    long = halo.is_long(series, key)
    known = series.select(*cols(key), col(ts).alias(TS), num(value).alias("original"))
    rows = halo.numbered(known, key, TS, long).withColumn("_w", own_length(window)).withColumn("_i", F.col(halo.NUMBER) + 1)
    span = max(window, 2)
    reach = (window // 2 + 1, window // 2) if center else (window, 0)

    def stats(rows: DataFrame, k: list[str]) -> DataFrame:
        axis, frame = own_frame(k, center)
        x = F.col("original")
        sized = _ewm(rows.withColumn("_x", axis), k, span, TS, "original", "_w")
        found = {f"rolling_{n}": rolling(x, fn, frame, F.col("_w")) for n, fn in (("mean", F.avg), ("std", F.stddev), ("min", F.min), ("max", F.max))}
        return sized.withColumns(found)

    out = halo.windowed(rows, key, TS, max(reach[0], ewm_depth(span)), reach[1], stats, long)
    return out.select(*cols(key), TS, "original", *[f"rolling_{n}" for n in ("mean", "std", "min", "max")], "exp_mean")


def ewm_depth(span: int) -> int:
    """Rows after which the weights of an exponential mean fall below double precision."""
    rest = 1.0 - 2.0 / (span + 1.0)
    return 1 if rest <= 0 else int(math.ceil(-40.0 / math.log(rest)))


def ewm_mean(series: DataFrame, key: Sequence[str], span: int, ts: str = TS, value: str = VALUE) -> DataFrame:
    """Adjusted exponential mean: weights (1 - 2/(span+1))^age, normalised.

    Weights below double precision are cut, so the frame has a fixed number of rows.
    """
    return halo.windowed(series, key, ts, ewm_depth(span), 0, lambda rows, k: _ewm(rows, k, span, ts, value), halo.is_long(series, key))


def _ewm(series: DataFrame, key: Sequence[str], span: int, ts: str, value: str, own: str | None = None) -> DataFrame:
    """``own`` names a column with the span of each key; ``span`` is then the largest of them."""
    r = 1.0 - 2.0 / (F.col(own) + 1.0) if own else F.lit(1.0 - 2.0 / (span + 1.0))
    frame = by_time(key, ts).rowsBetween(-ewm_depth(span), 0)
    # the newest value is last in the list; a running fold decays everything before it
    cell = F.collect_list(F.struct(num(value).alias("v"))).over(frame)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    fold = F.aggregate(
        cell,
        start,
        lambda a, e: F.struct(
            (a["s"] * r + F.coalesce(e["v"], F.lit(0.0))).alias("s"),
            (a["w"] * r + F.when(e["v"].isNull(), 0.0).otherwise(1.0)).alias("w"),
        ),
        lambda a: F.try_divide(a["s"], a["w"]),
    )
    return series.withColumn("exp_mean", fold)


# ---- transforms --------------------------------------------------------------------------------

def _lagged(series: DataFrame, key: Sequence[str], by: int, ts: str, value: str) -> DataFrame:
    """Add ``_before``, the value ``by`` rows earlier."""
    add = lambda rows, k: rows.withColumn("_before", F.lag(num(value), by).over(by_time(k, ts)))
    return halo.windowed(series, key, ts, by, 0, add, halo.is_long(series, key))


def difference(series: DataFrame, key: Sequence[str], order: int = 1, ts: str = TS, value: str = VALUE) -> DataFrame:
    """x_t - x_{t-order}; the first rows fall away."""
    out = _lagged(series, key, order, ts, value).withColumn(value, num(value) - F.col("_before")).drop("_before")
    return out.where(col(value).isNotNull())


def log_transform(series: DataFrame, key: Sequence[str], value: str = VALUE) -> DataFrame:
    """log x, shifted by 1 - min where a series reaches zero or below."""
    low = F.col("_low")
    out = halo.with_whole(series, key, {"_low": F.min(num(value))}, halo.is_long(series, key))
    return out.withColumn(value, F.log(F.when(low <= 0, num(value) - low + 1).otherwise(num(value)))).drop("_low")


def log_difference(series: DataFrame, key: Sequence[str], order: int = 1, ts: str = TS, value: str = VALUE) -> DataFrame:
    return difference(log_transform(series, key, value), key, order, ts, value)


def pct_change(series: DataFrame, key: Sequence[str], periods: int = 1, ts: str = TS, value: str = VALUE) -> DataFrame:
    """x_t / x_{t-periods} - 1; the first rows fall away."""
    out = _lagged(series, key, periods, ts, value).withColumn(value, F.try_divide(num(value), F.col("_before")) - 1).drop("_before")
    return out.where(col(value).isNotNull())


# ---- autocorrelation ---------------------------------------------------------------------------

def autocovariance(series: DataFrame, key: Sequence[str], nlags: int, ts: str = TS, value: str = VALUE) -> DataFrame:
    """(key..., n, lag, c): sum of e_t e_{t-lag} over centred values; one sort, one aggregate."""
    e, long = centred(series, key, ts, value)

    # the last nlags + 1 values, newest first, against the newest one
    def recent(rows: DataFrame, k: list[str]) -> DataFrame:
        return rows.withColumn("_r", F.collect_list("_e").over(by_time(k).rowsBetween(-nlags, 0)))

    products = F.transform(F.reverse("_r"), lambda x: x * F.col("_e"))
    tall = halo.windowed(e, key, TS, nlags, 0, recent, long).select(*cols(key), "n", F.posexplode(products).alias("lag", "_c"))
    return tall.groupBy(*cols(key), "n", "lag").agg(F.sum("_c").alias("c"))


def centred(series: DataFrame, key: Sequence[str], ts: str = TS, value: str = VALUE) -> tuple[DataFrame, bool]:
    """(key..., ts, n, _e): known values less the mean of their series; whether a series is long."""
    known = series.where(num(value).isNotNull()).select(*cols(key), col(ts).alias(TS), num(value).alias("_x"))
    long = halo.is_long(known, key)
    found = halo.with_whole(known, key, {"n": F.count(F.lit(1)), "_mean": F.avg("_x")}, long)
    return found.select(*cols(key), TS, "n", (F.col("_x") - F.col("_mean")).alias("_e")), long


def acf(series: DataFrame, key: Sequence[str], nlags: int = 40, ts: str = TS, value: str = VALUE) -> DataFrame:
    """(key..., lag, acf, bound) up to half the length; the bound is Bartlett's 95 % one."""
    cov = autocovariance(series, key, nlags, ts, value).where(F.col("lag") <= F.floor(F.col("n") / F.lit(2)))
    by_lag = Window.partitionBy(*cols(key)).orderBy("lag")
    c0 = F.first("c").over(by_lag.rowsBetween(Window.unboundedPreceding, 0))
    scored = cov.withColumn("acf", F.try_divide(F.col("c"), c0))
    before = by_lag.rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(before), F.lit(0.0))
    bound = F.when(F.col("lag") > 0, F.lit(1.959963984540054) * F.sqrt((1 + 2 * squares) / F.col("n")))
    return scored.select(*cols(key), "lag", "acf", F.coalesce(bound, F.lit(0.0)).alias("bound"))


def levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of autocorrelations r (r[0] = 1) by the Durbin-Levinson recursion."""
    out, phi, err = [1.0], np.zeros(0), 1.0
    for k in range(1, len(r)):
        a = (r[k] - phi @ r[k - 1 : 0 : -1]) / err if err else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        err *= 1 - a * a
        out.append(a)
    return np.array(out)


def pacf(series: DataFrame, key: Sequence[str], nlags: int = 40, ts: str = TS, value: str = VALUE) -> DataFrame:
    """(key..., lag, pacf): recursion over the at most nlags + 1 autocorrelations of each key."""
    table = acf(series, key, nlags, ts, value).select(*cols(key), "lag", "acf")
    fields = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in key)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pdf[[*key, "lag"]].assign(pacf=levinson(pdf["acf"].to_numpy()))

    return table.groupBy(*cols(key)).applyInPandas(one, f"{fields}, lag int, pacf double")


def acf_peaks(series: DataFrame, key: Sequence[str], nlags: int = 100, distance: int = 3, ts: str = TS, value: str = VALUE) -> DataFrame:
    """(key..., lag, acf, suggested_period): local maxima at least ``distance`` apart, higher first."""
    table = acf(series, key, nlags, ts, value).select(*cols(key), "lag", "acf")
    w = Window.partitionBy(*cols(key)).orderBy("lag")
    tops = table.withColumns({"_p": F.lag("acf").over(w), "_n": F.lead("acf").over(w)}).where(
        "acf > _p AND acf > _n"
    ).drop("_p", "_n")
    fields = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in key)

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for lag in pdf.sort_values(["acf", "lag"], ascending=[False, False])["lag"]:
            if all(abs(lag - other) >= distance for other in kept):
                kept.append(lag)
        return pdf[pdf["lag"].isin(kept)]

    kept = tops.groupBy(*cols(key)).applyInPandas(thin, f"{fields}, lag int, acf double")
    first = F.min("lag").over(Window.partitionBy(*cols(key)))
    return kept.withColumn("suggested_period", F.when(first > 1, first))


# ---- stationarity ------------------------------------------------------------------------------

def normal_sums(df: DataFrame, key: Sequence[str], target: str, features: Sequence[str]) -> DataFrame:
    """(key..., n, xx, xy, yy): sums of a least-squares problem with intercept, per key."""
    terms = [F.lit(1.0), *cols(features)]
    complete = df.dropna(subset=[target, *features])
    return complete.groupBy(*cols(key)).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(a * b) for a in terms for b in terms]).alias("xx"),
        F.array(*[F.sum(a * col(target)) for a in terms]).alias("xy"),
        F.sum(col(target) * col(target)).alias("yy"),
    )


# Critical value surface at 5 % for a regression with constant (MacKinnon 2010).
ADF_5_PERCENT = (-2.86154, -2.8903, -4.234, -40.04)
# Critical value at 5 % around a constant level (Kwiatkowski et al. 1992).
KPSS_5_PERCENT = 0.463


def lag_products(series: DataFrame, key: Sequence[str], most: int, own: bool, ts: str = TS, value: str = VALUE) -> DataFrame:
    """(key..., n, products): cross products of the unit-root regression, one row per key.

    Columns of the regression: constant, level before the step, the ``most`` steps before it, and the step itself.
    With ``own`` the frame has a column ``_lags`` with the lags of each series; steps further back count as 0.
    Every (key, range) makes one matrix product of its rows; the products of the ranges are summed.
    """
    known = series.where(num(value).isNotNull())
    extra = ["_lags"] if own else []
    rows = halo.numbered(known.select(*cols(key), col(ts).alias(TS), num(value).alias("_x"), *extra), key, TS, halo.is_long(known, key))
    ranged = halo.in_ranges(rows, key, TS, most + 1, 0)
    fields = ", ".join([f"`{k}` {ranged.schema[k].dataType.simpleString()}" for k in key] + ["n long, products array<double>"])

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(halo.NUMBER)
        x, number = pdf["_x"].to_numpy(float), pdf[halo.NUMBER].to_numpy()
        lags = int(pdf["_lags"].iloc[0]) if own else most
        d = np.diff(x, prepend=np.nan)
        at = np.flatnonzero(pdf[halo.OWN].to_numpy() & (number > lags))
        terms = np.zeros((len(at), most + 3))
        terms[:, 0], terms[:, -1] = 1, d[at]
        terms[:, 1] = x[at - 1]
        for i in range(1, lags + 1):
            terms[:, 1 + i] = d[at - i]
        out = pdf[list(key)].head(1).copy()
        out["n"] = len(at)
        out["products"] = [(terms.T @ terms).ravel()]
        return out

    found = ranged.groupBy(*cols([*key, halo.RANGE])).applyInPandas(product, fields)
    cells = found.select(*cols(key), "n", F.posexplode("products").alias("_at", "_v"))
    sums = cells.groupBy(*cols(key), "_at").agg(F.sum("n").alias("n"), F.sum("_v").alias("_v"))
    return sums.groupBy(*cols(key)).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("_at", "_v")))["_v"].alias("products"))


def nested_errors(products: np.ndarray) -> np.ndarray:
    """Residual sums of squares with 0, 1, 2, ... lags: one factorisation, whose leading blocks are those of the smaller fits."""
    scale = np.sqrt(np.maximum(np.diag(products), 1e-300))
    lower = np.linalg.cholesky(products[:-1, :-1] / np.outer(scale[:-1], scale[:-1]))
    z = np.linalg.solve(lower, products[:-1, -1] / scale[:-1])
    return products[-1, -1] - np.cumsum(z * z)[1:]


@F.pandas_udf(T.LongType())
def _best_lag(products: pd.Series, n: pd.Series, most: pd.Series) -> pd.Series:
    """Number of lags with the least Akaike criterion, the smaller one on ties; 0 without a fit."""
    out = []
    for p, m, top in zip(products, n, most):
        size = math.isqrt(len(p))
        p = np.asarray(p, float).reshape(size, size)
        keep = [*range(min(int(top), size - 3) + 2), size - 1]
        try:
            errors = nested_errors(p[np.ix_(keep, keep)])
            with np.errstate(divide="ignore", invalid="ignore"):
                aic = m * np.log(errors / m) + 2 * (np.arange(len(errors)) + 2)
            out.append(int(np.nanargmin(aic)))
        except (np.linalg.LinAlgError, ValueError):
            out.append(0)
    return pd.Series(out, dtype="int64")


@F.pandas_udf(T.DoubleType())
def _level_t(products: pd.Series, n: pd.Series, lags: pd.Series) -> pd.Series:
    """t value of the level in the regression with that many lags; null without a fit."""
    out = []
    for p, m, k in zip(products, n, lags):
        size = math.isqrt(len(p))
        p, k = np.asarray(p, float).reshape(size, size), int(k) + 2
        try:
            inverse = np.linalg.inv(p[:k, :k])
            beta = inverse @ p[:k, -1]
            error = p[-1, -1] - beta @ p[:k, -1]
            out.append(beta[1] / math.sqrt(error / (m - k) * inverse[1, 1]))
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            out.append(None)
    return pd.Series(out, dtype="float64")


def adf_statistic(
    series: DataFrame, key: Sequence[str], lags: int | None = 1, ts: str = TS, value: str = VALUE, most_lags: int | None = None
) -> DataFrame:
    """(key..., n, adf_statistic, critical_value, adf_stationary): unit-root regression with a constant and lagged differences.

    Without ``lags`` every series takes the number with the least Akaike criterion, of fits on the same rows, up to
    ``most_lags`` or 12 (length / 100)^(1/4) rounded up, and less than half its length; the statistic is then that of all its rows, and ``lags`` is a column.
    """
    if lags is None:
        known = series.where(num(value).isNotNull())
        n = F.col("_n").cast("double")
        top = F.lit(most_lags) if most_lags is not None else F.ceil(12 * F.pow(n / 100, F.lit(0.25)))
        # a short series has no fit of so many lags on enough rows
        sizes = known.groupBy(*cols(key)).agg(F.count(F.lit(1)).alias("_n"))
        sizes = small_side(sizes.select(*cols(key), F.greatest(F.least(top, F.floor(n / 2) - 2), F.lit(0)).cast("long").alias("_lags")))
        widest = sizes.agg(F.max("_lags")).first()[0] or 0
        first = lag_products(halo.by_key(known, sizes, key), key, widest, True, ts, value)
        chosen = halo.by_key(first, sizes, key).select(*cols(key), _best_lag("products", "n", "_lags").alias("_lags"))
        chosen = small_side(chosen)
        widest = chosen.agg(F.max("_lags")).first()[0] or 0
        sums = halo.by_key(lag_products(halo.by_key(known, chosen, key), key, widest, True, ts, value), chosen, key).withColumnRenamed("_lags", "lags")
    else:
        sums = lag_products(series, key, lags, False, ts, value).withColumn("lags", F.lit(lags).cast("long"))
    n = F.col("n").cast("double")
    c0, c1, c2, c3 = ADF_5_PERCENT
    shown = ["lags"] if lags is None else []
    return (
        sums.where("n > 0").withColumn("adf_statistic", _level_t("products", "n", "lags"))
        .withColumn("critical_value", c0 + c1 / n + c2 / (n * n) + c3 / (n * n * n))
        .select(
            *cols(key), "n", *shown, "adf_statistic", "critical_value",
            (F.col("adf_statistic") < F.col("critical_value")).alias("adf_stationary"),
        )
    )


def kpss_statistic(
    series: DataFrame, key: Sequence[str], lags: int | None = None, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """(key..., lags, kpss_statistic, kpss_stationary): squared partial sums over the long-run
    variance with Bartlett weights; without ``lags`` the bandwidth is chosen from the data."""
    known = series.where(num(value).isNotNull())
    e, long = centred(series, key, ts, value)
    if long:
        partial = halo.carried(e, key, TS, {"_s": (F.col("_e"), "sum")})
    else:
        partial = e.withColumn("_s", F.sum("_e").over(by_time(key).rowsBetween(Window.unboundedPreceding, 0)))
    eta = partial.groupBy(*cols(key)).agg(F.sum(F.col("_s") * F.col("_s")).alias("_eta"))
    n = F.col("n").cast("double")
    if lags is None:
        # data-dependent bandwidth (Hobijn, Franses and Ooms 1998), from the first n^(2/9) lags
        longest = known.groupBy(*cols(key)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
        cov = autocovariance(series, key, int(longest ** (2.0 / 9.0)) + 1, ts, value)
        reach = F.floor(F.pow(n, F.lit(2.0 / 9.0)))
        near = (F.col("lag") >= 1) & (F.col("lag") <= reach)
        prod = F.col("c") / (n / 2)
        band = cov.groupBy(*cols(key), "n").agg(
            F.sum(F.when(F.col("lag") == 0, F.col("c") / n).when(near, prod).otherwise(0.0)).alias("_s0"),
            F.sum(F.when(near, F.col("lag") * prod).otherwise(0.0)).alias("_s1"),
        )
        s = F.try_divide(F.col("_s1"), F.col("_s0"))
        third = F.lit(1.0 / 3.0)
        width = F.floor(F.lit(1.1447) * F.pow(s * s, third) * F.pow(n, third))
        band = materialize(band.select(*cols(key), F.least(width, F.col("n") - 1).cast("long").alias("lags")))
        widest = band.agg(F.max("lags").alias("m")).first()["m"] or 0
        cov = autocovariance(series, key, widest, ts, value).join(band, list(key))
    else:
        cov = autocovariance(series, key, lags, ts, value).withColumn("lags", F.lit(lags).cast("long"))
    weight = F.when(F.col("lag") == 0, 1.0).when(
        F.col("lag") <= F.col("lags"), 2 * (1 - F.col("lag") / (F.col("lags") + 1))
    ).otherwise(0.0)
    longrun = cov.groupBy(*cols(key), "n", "lags").agg((F.sum(weight * F.col("c"))).alias("_v"))
    return (
        longrun.join(eta, list(key))
        .withColumn("kpss_statistic", F.try_divide(F.col("_eta") / n, F.col("_v")))
        .select(*cols(key), "lags", "kpss_statistic", (F.col("kpss_statistic") < KPSS_5_PERCENT).alias("kpss_stationary"))
    )


def stationarity_verdict(series: DataFrame, key: Sequence[str], adf_lags: int | None = 1, ts: str = TS, value: str = VALUE) -> DataFrame:
    """Both tests side by side and what they say together."""
    a, k = F.col("adf_stationary"), F.col("kpss_stationary")
    verdict = (
        F.when(a & k, "stationary")
        .when(a & ~k, "trend_stationary")
        .when(~a & k, "difference_may_be_needed")
        .when(~a & ~k, "non_stationary")
    )
    both = adf_statistic(series, key, adf_lags, ts, value).join(kpss_statistic(series, key, None, ts, value), list(key))
    return both.select(
        *cols(key), "adf_statistic", "adf_stationary", "kpss_statistic", "kpss_stationary", verdict.alias("verdict")
    )


def seasonal_means(series: DataFrame, key: Sequence[str], ts: str = TS, value: str = VALUE) -> DataFrame:
    """(key..., part, slot, mean) by day of week (Monday = 0) and by month."""
    parts = series.where(num(value).isNotNull()).select(
        *cols(key),
        num(value).alias("_v"),
        F.explode(
            F.array(
                F.struct(F.lit("day_of_week").alias("part"), F.weekday(col(ts)).alias("slot")),
                F.struct(F.lit("month").alias("part"), F.month(col(ts)).alias("slot")),
            )
        ).alias("_p"),
    )
    return parts.groupBy(*cols(key), "_p.part", "_p.slot").agg(F.avg("_v").alias("mean"))


def weekday_month_seasonality(series: DataFrame, key: Sequence[str], ts: str = TS, value: str = VALUE) -> DataFrame:
    """(key..., part, groups, strength, significant): spread of the group means over their mean."""
    cv = seasonal_means(series, key, ts, value).groupBy(*cols(key), "part").agg(
        F.count(F.lit(1)).alias("groups"), ratio(F.stddev("mean"), F.avg("mean")).alias("strength")
    )
    return cv.withColumn("significant", F.coalesce(F.col("strength") > 0.1, F.lit(False)))
