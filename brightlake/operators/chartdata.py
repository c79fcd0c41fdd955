"""The aggregates behind charts: small tables, whatever the size of the input."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brightlake.functions.columns import col, count_if, num, percent
from brightlake.operators.clean import date_of_text, top_values
from brightlake.plans.running import quantiles
from brightlake.plans.sampling import lowest_by_hash
from brightlake.session import materialize, small_side

OTHER = "other"


def top_groups_other(df: DataFrame, column: str, max_groups: int = 30) -> DataFrame:
    """With more than ``max_groups`` values, all but the most frequent ``max_groups - 1`` become
    'other'. The kept values are a short literal list, so the rows are not shuffled."""
    kept = [r[column] for r in top_values(df, column, max_groups + 1).collect()]
    if len(kept) <= max_groups:
        return df
    return df.withColumn(
        column, F.when(col(column).isNull() | col(column).isin(kept[: max_groups - 1]), col(column)).otherwise(OTHER)
    )


def bounded_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``n`` rows, exactly that many if there are more, the same ones on every run."""
    one = df.withColumn("_all", F.lit(1))
    quota = df.sparkSession.createDataFrame([(1, n)], "_all int, take long")
    return lowest_by_hash(one, quota, ["_all"], key, seed).drop("_all")


def _range_of(df: DataFrame, column: str) -> tuple[float, float, int] | None:
    row = df.agg(F.min(num(column)).alias("lo"), F.max(num(column)).alias("hi"), F.count(num(column)).alias("n")).first()
    return None if not row["n"] else (row["lo"], row["hi"], row["n"])


def fitting_bins(df: DataFrame, column: str, bins: int) -> int:
    """Fewer distinct values than bins lower the number of bins to that, ten at least."""
    distinct = df.select(num(column).alias("v")).where("v IS NOT NULL").distinct().limit(bins).count()
    return max(10, distinct) if distinct < bins else bins


def _bin_counts(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((num(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(num(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, bin_start, bin_end, count) of equal widths from minimum to maximum, empty bins included."""
    ends = _range_of(df, column)
    if ends is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    lo, hi, _ = ends
    bins = fitting_bins(df, column, bins)
    width = (hi - lo) / bins
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(_bin_counts(df, column, lo, hi, bins), "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def kde_curve(df: DataFrame, column: str, bins: int = 30, points: int = 1000, cells: int = 512) -> DataFrame:
    """(x, density, scaled): Gaussian density with Scott's bandwidth on an even grid.

    The kernel sum runs over at most ``cells`` bin centres, so its cost does not depend on the rows.
    """
    ends = _range_of(df, column)
    if ends is None or ends[2] < 2 or ends[0] == ends[1]:
        return df.sparkSession.createDataFrame([], "x double, density double, scaled double")
    lo, hi, n = ends
    spread = df.agg(F.stddev(num(column)).alias("s")).first()["s"]
    h = spread * n ** (-0.2)
    width = (hi - lo) / cells
    centres = _bin_counts(df, column, lo, hi, cells).agg(
        F.collect_list(
            F.struct((F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)).alias("c"), F.col("count").cast("double").alias("n"))
        ).alias("_c")
    )
    step = (hi - lo) / (points - 1)
    grid = centres.select("_c", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn(
        "x", F.lit(lo) + F.col("i") * F.lit(step)
    )
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    kernel = F.aggregate(
        "_c", F.lit(0.0), lambda a, e: a + e["n"] * F.exp(-0.5 * F.pow((F.col("x") - e["c"]) / F.lit(h), F.lit(2.0)))
    )
    bins = fitting_bins(df, column, bins)
    return grid.select("x", (F.lit(norm) * kernel).alias("density")).withColumn(
        "scaled", F.col("density") * F.lit(n * (hi - lo) / bins)
    )


def box_summary(df: DataFrame, column: str, group: str | None = None, max_groups: int | None = None) -> DataFrame:
    """Quartiles, whisker ends (last values inside 1.5 IQR) and outliers, per group if given."""
    if group is None:
        df, group, name = df.withColumn("_g", F.lit("all")), "_g", "group"
    else:
        name = group
        if max_groups is not None:
            kept = [r[group] for r in top_values(df, group, max_groups).collect()]
            df = df.where(col(group).isin(kept))
    marks = small_side(quantiles(df, [column], [0.25, 0.5, 0.75], by=[group]).drop("column"))
    fence = 1.5 * (F.col("q2") - F.col("q0"))
    rows = df.select(col(group), num(column).alias("_v")).where("_v IS NOT NULL").join(marks, group)
    inside = (F.col("_v") >= F.col("q0") - fence) & (F.col("_v") <= F.col("q2") + fence)
    # the quartiles are the same on every row of a group, so any of them will do
    return rows.groupBy(col(group).alias(name)).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("q0").alias("q1"),
        F.min("q1").alias("median"),
        F.min("q2").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        count_if(~inside).alias("outliers"),
    )


def bar_counts(
    df: DataFrame, column: str, sort_by: str = "value", ascending: bool = False, top_n: int | None = None
) -> DataFrame:
    """Value counts ordered by count or by name, the first ``top_n`` of them."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))
    main = F.col("count") if sort_by == "value" else col(column)
    ordered = counts.orderBy(main.asc() if ascending else main.desc(), col(column).asc())
    return ordered.limit(top_n) if top_n is not None else ordered


def pie_shares(
    df: DataFrame, column: str, values: str | None = None, top_n: int | None = 8, keep: int | None = None
) -> DataFrame:
    """(category, amount, percentage): counts or sums of the largest categories and 'other'.

    More than ``top_n`` categories leave ``keep`` (by default top_n - 1) of them.
    """
    amount = F.coalesce(F.sum(num(values)), F.lit(0.0)) if values else F.count(F.lit(1)).cast("double")
    totals = df.where(col(column).isNotNull()).groupBy(col(column).alias("category")).agg(amount.alias("amount"))
    totals = materialize(totals)
    whole = totals.agg(F.sum("amount").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, n = whole["t"] or 0.0, whole["n"]
    if top_n and n > top_n:
        first = totals.orderBy(F.desc("amount"), "category").limit(keep or top_n - 1)
        rest = first.agg((F.lit(total) - F.sum("amount")).alias("amount")).select(F.lit(OTHER).alias("category"), "amount")
        totals = first.unionByName(rest)
    return totals.withColumn("percentage", percent(F.col("amount"), F.lit(total)))


# ---- trends ------------------------------------------------------------------------------------

def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line with the x range it is drawn over."""
    pair = num(x).isNotNull() & num(y).isNotNull()
    cx, cy = F.when(pair, num(x)), F.when(pair, num(y))
    return df.agg(
        F.count(cx).alias("n"),
        F.regr_slope(cy, cx).alias("slope"),
        F.regr_intercept(cy, cx).alias("intercept"),
        F.min(cx).alias("x_min"),
        F.max(cx).alias("x_max"),
    )


def quadratic_trend(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Second-degree fit per group: y = a x^2 + b x + c.

    Power sums are taken of the standardised x, so they neither overflow nor cancel; the 3 x 3 system
    is solved by Cramer's rule and rewritten for the raw x. Groups of one row are left out.
    """
    rows = df.select(col(group).alias(group), num(x).alias("_x"), num(y).alias("_y")).dropna()
    stats = rows.groupBy(col(group)).agg(
        F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"), F.count(F.lit(1)).alias("n"), F.min("_x").alias("x_min"),
        F.max("_x").alias("x_max"),
    ).where("n > 1 AND _s > 0")
    z = (F.col("_x") - F.col("_m")) / F.col("_s")
    sums = (
        rows.join(small_side(stats), group)
        .withColumn("_z", z)
        .groupBy(col(group), "n", "_m", "_s", "x_min", "x_max")
        .agg(
            *[F.sum(F.pow("_z", F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)],
            *[F.sum(F.pow("_z", F.lit(float(k))) * F.col("_y")).alias(f"t{k}") for k in range(3)],
        )
    )
    c = F.col
    n, s1, s2, s3, s4, t0, t1, t2 = (c(k).cast("double") for k in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))

    def det(m: Sequence[Sequence[Column]]) -> Column:
        (a, b, d), (e, f, g), (h, i, j) = m
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    base = det([[n, s1, s2], [s1, s2, s3], [s2, s3, s4]])
    k0 = F.try_divide(det([[t0, s1, s2], [t1, s2, s3], [t2, s3, s4]]), base)
    k1 = F.try_divide(det([[n, t0, s2], [s1, t1, s3], [s2, t2, s4]]), base)
    k2 = F.try_divide(det([[n, s1, t0], [s1, s2, t1], [s2, s3, t2]]), base)
    fit = sums.select(col(group), c("n"), "x_min", "x_max", c("_m"), c("_s"), k0.alias("_k0"), k1.alias("_k1"), k2.alias("_k2"))
    m, s = c("_m"), c("_s")
    return fit.select(
        col(group),
        "n",
        (c("_k2") / (s * s)).alias("a"),
        (c("_k1") / s - 2 * c("_k2") * m / (s * s)).alias("b"),
        (c("_k0") - c("_k1") * m / s + c("_k2") * m * m / (s * s)).alias("c"),
        "x_min",
        "x_max",
    )


# ---- points ------------------------------------------------------------------------------------

def scatter_points(
    df: DataFrame, x: str, y: str, key: Sequence[str], n: int, color: str | None = None, size: str | None = None, seed: int = 42
) -> DataFrame:
    """At most ``n`` complete points; a text colour keeps its largest groups."""
    rows = df.dropna(subset=[x, y])
    if color is not None and dict(df.dtypes)[color] == "string":
        rows = top_groups_other(rows, color)
    extra = [c for c in (color, size) if c is not None]
    return bounded_sample(rows, n, key, seed).select(*[col(c) for c in dict.fromkeys([*key, x, y, *extra])])


def scatter_matrix(df: DataFrame, columns: Sequence[str], key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` sampled rows behind a matrix of scatter plots of all the named columns."""
    return bounded_sample(df.select(*[col(c) for c in dict.fromkeys([*key, *columns])]), n, key, seed)


def dual_axis(df: DataFrame, x: str, y1: str, y2: str) -> DataFrame:
    return df.select(col(x), col(y1), col(y2)).dropna()


def line_series(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """(x, y, group) in order of x, date text parsed."""
    stamp = date_of_text(col(x)) if dict(df.dtypes)[x] == "string" else col(x)
    names = [col(group)] if group else []
    return df.select(stamp.alias("x"), num(y).alias("y"), *names).orderBy("x", *names)


def geo_points(df: DataFrame, lat: str, lon: str, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*[col(c) for c in [lat, lon, *extra]]).dropna(subset=[lat, lon])


def radar_means(df: DataFrame, category: str, values: Sequence[str]) -> DataFrame:
    return df.where(col(category).isNotNull()).groupBy(col(category)).agg(*[F.avg(num(v)).alias(v) for v in values])


# ---- calendars ---------------------------------------------------------------------------------

def _measure(value: str | None) -> Column:
    return F.coalesce(F.sum(num(value)), F.lit(0.0)) if value else F.count(F.lit(1)).cast("double")


def calendar_daily(df: DataFrame, date: str, value: str | None = None) -> DataFrame:
    """(date, year, month, day, weekday, amount), Monday = 0."""
    days = df.where(col(date).isNotNull()).groupBy(F.to_date(col(date)).alias("date")).agg(_measure(value).alias("amount"))
    return days.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"), F.day("date").alias("day"),
        F.weekday("date").alias("weekday"), "amount",
    )


def _calendar_pivot(cells: DataFrame, slots: Sequence[int], prefix: str) -> DataFrame:
    named = cells.withColumn("_slot", F.concat(F.lit(prefix), F.lpad(F.col("slot").cast("string"), 2, "0")))
    return named.groupBy("year").pivot("_slot", [f"{prefix}{i:02d}" for i in slots]).agg(F.sum("amount"))


def calendar_weekly(df: DataFrame, date: str, value: str | None = None) -> DataFrame:
    """Year by ISO week; a week belongs to the year of its Sunday. Null where nothing happened."""
    sunday = F.date_add(F.to_date(F.date_trunc("week", col(date))), 6)
    weeks = df.where(col(date).isNotNull()).groupBy(sunday.alias("_w")).agg(_measure(value).alias("amount"))
    cells = weeks.select(F.year("_w").alias("year"), F.weekofyear("_w").alias("slot"), "amount")
    return _calendar_pivot(cells, range(1, 54), "w")


def calendar_monthly(df: DataFrame, date: str, value: str | None = None) -> DataFrame:
    """Year by month. Null where nothing happened."""
    cells = df.where(col(date).isNotNull()).groupBy(F.year(col(date)).alias("year"), F.month(col(date)).alias("slot")).agg(
        _measure(value).alias("amount")
    )
    return _calendar_pivot(cells, range(1, 13), "m")


def frequency_of_frequency(df: DataFrame, user: str) -> DataFrame:
    """(orders, users): how many users have how many rows."""
    per_user = df.where(col(user).isNotNull()).groupBy(col(user)).agg(F.count(F.lit(1)).alias("orders"))
    return per_user.groupBy("orders").agg(F.count(F.lit(1)).alias("users"))


def period_sales(df: DataFrame, date: str, value: str, unit: str = "M") -> DataFrame:
    """(period, amount) by day, by week from Monday, or by month."""
    start = F.to_date(F.date_trunc({"D": "day", "W": "week", "M": "month"}[unit], col(date)))
    return df.where(col(date).isNotNull()).groupBy(start.alias("period")).agg(
        F.coalesce(F.sum(num(value)), F.lit(0.0)).alias("amount")
    )
