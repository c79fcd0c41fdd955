"""Anomaly flags on prepared series (key..., ts, value), per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from brightlake.functions.columns import col, count_if, num, percent
from brightlake.functions.fixed import MAD_SCALE
from brightlake.operators.series import TS, VALUE, by_time, cols, frame_of, own_frame, rolling
from brightlake.plans import halo
from brightlake.plans.running import quantiles


def _known(series: DataFrame, key: Sequence[str], ts: str, value: str) -> DataFrame:
    return series.where(num(value).isNotNull()).select(*cols(key), col(ts).alias(TS), num(value).alias(VALUE))


def _flag(df: DataFrame, keep: Sequence[str | Column]) -> DataFrame:
    x = F.col(VALUE)
    return df.withColumn("is_anomaly", (x < F.col("lower_bound")) | (x > F.col("upper_bound"))).select(
        *keep, "lower_bound", "upper_bound", "is_anomaly"
    )


def anomaly_iqr(series: DataFrame, key: Sequence[str], threshold: float = 1.5, ts: str = TS, value: str = VALUE) -> DataFrame:
    """Outside the quartiles by ``threshold`` interquartile ranges."""
    known = _known(series, key, ts, value)
    marks = quantiles(known, [VALUE], [0.25, 0.75], by=key).drop("column")
    width = F.col("q1") - F.col("q0")
    bounded = known.join(marks, list(key)).withColumns(
        {"lower_bound": F.col("q0") - threshold * width, "upper_bound": F.col("q1") + threshold * width}
    )
    return _flag(bounded, [*cols(key), TS, VALUE])


#: Window name: every series takes the one that ``own_window`` gives for its length.
OWN = "own"


def own_window(n: Column) -> Column:
    """Window of a series of ``n`` values; null for a short one, which has none."""
    third = F.greatest(F.lit(3), F.floor(n / F.lit(3)))
    return F.when(n >= 30, 7).when(n >= 10, third).cast("int")


def _frame(key: Sequence[str], window: int | str) -> tuple[Column | None, WindowSpec, Column]:
    """Axis column if the window is each series' own, centred frame and rows of a full frame."""
    if window != OWN:
        return None, frame_of(by_time(key), window, center=True), F.lit(window)
    axis, frame = own_frame(key, center=True)
    return axis, frame, F.col("_w")


def _rolled(rows: DataFrame, key: Sequence[str], window: int | str, steps: Sequence[Callable], long: bool) -> DataFrame:
    """Add columns by centred windows; a step sees those of the steps before it in its own window."""
    if window == OWN:
        rows = halo.numbered(rows, key, TS, long).withColumn("_w", own_window(F.col(halo.LENGTH))).withColumn("_i", F.col(halo.NUMBER) + 1)
    half = ((9 if window == OWN else window) // 2 + 1) * len(steps)

    def add(rows: DataFrame, k: list[str]) -> DataFrame:
        axis, frame, size = _frame(k, window)
        rows = rows if axis is None else rows.withColumn("_x", axis)
        for step in steps:
            rows = rows.withColumns(step(frame, size))
        return rows

    return halo.windowed(rows, key, TS, half, half, add, long)


def _centred(known: DataFrame, key: Sequence[str], window: int | str | None) -> DataFrame:
    """Add ``mean`` and ``std`` of the series or of the window around each row."""
    x, long = F.col(VALUE), halo.is_long(known, key)
    whole = halo.with_whole(known, key, {"mean": F.avg(x), "std": F.stddev(x)}, long)
    if window is None:
        return whole
    fns = {"mean": F.avg, "std": F.stddev}
    return _rolled(whole, key, window, [lambda frame, size: {n: F.coalesce(rolling(x, fn, frame, size), F.col(n)) for n, fn in fns.items()}], long)


def anomaly_zscore(
    series: DataFrame, key: Sequence[str], threshold: float = 3.0, window: int | str | None = None, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Score against the mean and deviation of the series, or of a centred window whose incomplete
    edges take those of the series."""
    scored = _centred(_known(series, key, ts, value), key, window)
    scored = scored.withColumns(
        {
            "z_score": F.try_divide(F.col(VALUE) - F.col("mean"), F.col("std")),
            "lower_bound": F.col("mean") - threshold * F.col("std"),
            "upper_bound": F.col("mean") + threshold * F.col("std"),
        }
    )
    return scored.select(
        *cols(key), TS, VALUE, "z_score", "mean", "std", "lower_bound", "upper_bound",
        F.coalesce(F.abs("z_score") > threshold, F.lit(False)).alias("is_anomaly"),
    )


def anomaly_std(
    series: DataFrame, key: Sequence[str], threshold: float = 3.0, window: int | str | None = None, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Outside mean plus or minus ``threshold`` deviations."""
    bounded = _centred(_known(series, key, ts, value), key, window)
    bounded = bounded.withColumns(
        {
            "lower_bound": F.col("mean") - threshold * F.col("std"),
            "upper_bound": F.col("mean") + threshold * F.col("std"),
        }
    )
    return _flag(bounded, [*cols(key), TS, VALUE, "mean", "std"])


def anomaly_mad(
    series: DataFrame, key: Sequence[str], threshold: float = 3.0, window: int | str | None = None, ts: str = TS, value: str = VALUE
) -> DataFrame:
    """Outside median plus or minus ``threshold`` scaled median absolute deviations."""
    known = _known(series, key, ts, value)
    centre = quantiles(known, [VALUE], [0.5], by=key).select(*cols(key), F.col("q0").alias("_med"))
    off = known.join(centre, list(key)).withColumn("_dev", F.abs(F.col(VALUE) - F.col("_med")))
    spread = quantiles(off, ["_dev"], [0.5], by=key).select(*cols(key), F.col("q0").alias("_mad"))
    full = off.join(spread, list(key))
    if window is None:
        scored = full.withColumns({"median": F.col("_med"), "mad": F.col("_mad")})
    else:
        median_of = lambda c: F.percentile(c, 0.5)
        steps = [
            lambda frame, size: {"median": F.coalesce(rolling(F.col(VALUE), median_of, frame, size), F.col("_med"))},
            lambda frame, size: {"_near": F.abs(F.col(VALUE) - F.col("median"))},
            lambda frame, size: {"mad": F.coalesce(rolling(F.col("_near"), median_of, frame, size), F.col("_mad"))},
        ]
        scored = _rolled(full, key, window, steps, halo.is_long(known, key))
    reach = threshold * MAD_SCALE * F.col("mad")
    bounded = scored.withColumns({"lower_bound": F.col("median") - reach, "upper_bound": F.col("median") + reach})
    return _flag(bounded, [*cols(key), TS, VALUE, "median", "mad"])


METHODS = {"iqr": anomaly_iqr, "zscore": anomaly_zscore, "std": anomaly_std, "mad": anomaly_mad}


def detect_anomalies(
    series: DataFrame, key: Sequence[str], method: str = "iqr", window: int | str | None = None, threshold: float = 3.0,
    ts: str = TS, value: str = VALUE,
) -> DataFrame:
    """One entry point for all methods; ``iqr`` has no window form."""
    if method not in METHODS:
        raise ValueError(f"unknown anomaly method: {method}")
    if method == "iqr":
        return anomaly_iqr(series, key, threshold, ts, value)
    return METHODS[method](series, key, threshold, window, ts, value)


def compare_anomaly_methods(
    series: DataFrame, key: Sequence[str], methods: Sequence[str] = ("iqr", "zscore", "std", "mad"),
    windows: Sequence[int | None] | None = None, threshold: float = 3.0, ts: str = TS, value: str = VALUE,
) -> DataFrame:
    """(key..., method, window, anomaly_count, anomaly_percentage) for every method and window.

    By default every series has its own windows: none below 10 values, a third of them below 30, else
    7 and 30.
    """
    n = F.count(F.lit(1))
    out = None
    for method in methods:
        for window in (None, OWN, 30) if windows is None else windows:
            if method == "iqr" and window is not None:
                continue
            flags = detect_anomalies(series, key, method, window, threshold, ts, value)
            part = flags.groupBy(*cols(key)).agg(
                F.lit(method).alias("method"),
                own_window(n).alias("window") if window == OWN else F.lit(window).cast("int").alias("window"),
                count_if(F.col("is_anomaly")).alias("anomaly_count"),
                percent(count_if(F.col("is_anomaly")), n).alias("anomaly_percentage"),
                n.alias("_n"),
            )
            if windows is None and window is not None:
                part = part.where("_n >= 30" if window == 30 else "_n >= 10")
            part = part.drop("_n")
            out = part if out is None else out.unionByName(part)
    return out


def anomaly_summary(flags: DataFrame, key: Sequence[str], ts: str = TS, value: str = VALUE) -> DataFrame:
    """Counts, value range, mean and median of the flagged points and their first and last time."""
    hit = F.col("is_anomaly")
    x = F.when(hit, num(value))
    middle = quantiles(flags.where(hit), [value], [0.5], by=key).select(*cols(key), F.col("q0").alias("median_value"))
    base = flags.groupBy(*cols(key)).agg(
        F.count(F.lit(1)).alias("total_points"),
        count_if(hit).alias("anomaly_count"),
        percent(count_if(hit), F.count(F.lit(1))).alias("anomaly_percentage"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
        F.avg(x).alias("mean_value"),
        F.min(F.when(hit, col(ts))).alias("first_anomaly"),
        F.max(F.when(hit, col(ts))).alias("last_anomaly"),
    )
    return base.join(middle, list(key), "left")


def anomaly_calendar(flags: DataFrame, key: Sequence[str], ts: str = TS) -> DataFrame:
    """(key..., part, slot, anomaly_count, anomaly_percentage) by day of week and by month."""
    parts = flags.select(
        *cols(key),
        "is_anomaly",
        F.explode(
            F.array(
                F.struct(F.lit("day_of_week").alias("part"), F.weekday(col(ts)).alias("slot")),
                F.struct(F.lit("month").alias("part"), F.month(col(ts)).alias("slot")),
            )
        ).alias("_p"),
    )
    return parts.groupBy(*cols(key), "_p.part", "_p.slot").agg(
        count_if(F.col("is_anomaly")).alias("anomaly_count"),
        percent(count_if(F.col("is_anomaly")), F.count(F.lit(1))).alias("anomaly_percentage"),
    )
