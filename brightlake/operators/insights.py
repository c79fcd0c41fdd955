"""Rule-based insights. Single rules return their figures; the collected ones return tall rows
(rule, subject, metric, value, threshold, severity)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightlake.functions import fixed
from brightlake.functions.columns import (
    beside,
    categorical_columns,
    col,
    count_if,
    growth,
    num,
    numeric_columns,
    percent,
    ratio,
    safe_corr,
    sample_skew,
    stack_rows,
    sum_if,
)
from brightlake.operators import profile as prof
from brightlake.operators.clean import duplicate_count
from brightlake.operators.kpi import (
    CATEGORY,
    DATE,
    ORDER,
    PRICE,
    USER,
    as_of_date,
    at,
    change_band,
    month_of,
    recent_periods,
    user_periods,
)
from brightlake.operators.relate import pearson_pairs
from brightlake.session import stored


def _periods(order: str):
    """Window over one row per period: a few thousand at most."""
    return Window.partitionBy(F.lit(1)).orderBy(order)


# ---- time --------------------------------------------------------------------------------------

def daily_sales(df: DataFrame) -> DataFrame:
    return df.where(col(DATE).isNotNull()).groupBy(F.to_date(col(DATE)).alias("day")).agg(
        F.coalesce(F.sum(num(PRICE)), F.lit(0.0)).alias("sales")
    )


def weekday_sales(df: DataFrame, min_days: int = 7) -> DataFrame:
    """Best and worst weekday by sales; no row below ``min_days`` days of data."""
    days = daily_sales(df)
    week = days.groupBy(F.weekday("day").alias("_w")).agg(F.sum("sales").alias("_s"), F.count(F.lit(1)).alias("_d"))
    names = F.array(*[F.lit(n) for n in fixed.WEEKDAYS])
    name = lambda c: F.element_at(names, c + 1)
    ends = week.agg(
        F.sum("_d").alias("days"),
        F.min_by("_w", F.struct(-F.col("_s"), F.col("_w"))).alias("_b"),
        F.min_by("_w", F.struct(F.col("_s"), F.col("_w"))).alias("_l"),
        F.max("_s").alias("best_sales"),
        F.min("_s").alias("worst_sales"),
    )
    return ends.where(F.col("days") >= min_days).select(
        name(F.col("_b")).alias("best_weekday"), name(F.col("_l")).alias("worst_weekday"), "best_sales", "worst_sales"
    )


def week_over_week(df: DataFrame) -> DataFrame:
    """Sales of the last seven days with sales against the seven before; needs fourteen such days."""
    last = daily_sales(df).orderBy(F.desc("day")).limit(14)
    ranked = last.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("day"))))
    sums = ranked.agg(
        F.count(F.lit(1)).alias("_n"),
        sum_if(F.col("_r") <= 7, F.col("sales")).alias("recent_sales"),
        sum_if(F.col("_r") > 7, F.col("sales")).alias("previous_sales"),
    ).where("_n = 14").drop("_n")
    out = sums.withColumn("change_percentage", growth(F.col("recent_sales"), F.col("previous_sales")))
    return out.withColumn("direction", change_band(F.col("change_percentage"), (10, "increase"), (-10, "decrease")))


def monthly_sales(df: DataFrame) -> DataFrame:
    return df.where(col(DATE).isNotNull()).groupBy(month_of().alias("month")).agg(
        F.coalesce(F.sum(num(PRICE)), F.lit(0.0)).alias("sales"), F.count(col(ORDER)).alias("orders")
    )


def _last_month(table: DataFrame, value: str) -> DataFrame:
    """Last month with its value and the one before."""
    w = _periods("month")
    both = table.withColumns({"_prev": F.lag(value).over(w), "_next": F.lead("month").over(w)})
    return both.where("_next IS NULL AND _prev IS NOT NULL").select(
        "month", col(value).alias("current"), F.col("_prev").alias("previous")
    )


def monthly_sales_change(df: DataFrame) -> DataFrame:
    """Last month's sales over the month before, in bands of 10 and 5 percent."""
    out = _last_month(monthly_sales(df), "sales").withColumn(
        "change_percentage", percent(F.col("current") - F.col("previous"), F.col("previous"))
    )
    bands = ((10, "strong_growth"), (5, "growth"), (-10, "strong_decline"), (-5, "decline"))
    return out.withColumn("band", change_band(F.col("change_percentage"), *bands))


def monthly_aov_change(df: DataFrame) -> DataFrame:
    """Order value of the last month over the month before, bands of 10 percent."""
    table = monthly_sales(df).withColumn("aov", ratio(F.col("sales"), F.col("orders")))
    out = _last_month(table, "aov").withColumn(
        "change_percentage", percent(F.col("current") - F.col("previous"), F.col("previous"))
    )
    return out.withColumn("band", change_band(F.col("change_percentage"), (10, "rise"), (-10, "fall")))


def _band_of(value: Column, bands: Sequence[tuple]) -> Column:
    """Label of the right-closed band a value falls in, else null."""
    ladder = F
    for low, high, label in bands:
        inside = value > low
        ladder = ladder.when(inside if high == float("inf") else inside & (value <= high), label)
    return ladder.otherwise(F.lit(None).cast("string"))


def peak_weekday_daypart(df: DataFrame, date: str = DATE) -> DataFrame:
    """Weekday and part of the day with the most rows."""
    hours = df.where(col(date).isNotNull()).groupBy(
        F.weekday(col(date)).alias("_w"), _band_of(F.hour(col(date)), fixed.DAYPARTS).alias("_p")
    ).agg(F.count(F.lit(1)).alias("_n"))
    best = lambda c: F.min_by(c, F.struct(-F.col("m"), F.col(c)))
    day = hours.groupBy("_w").agg(F.sum("_n").alias("m")).agg(best("_w").alias("_w"), F.max("m").alias("weekday_orders"))
    part = hours.groupBy("_p").agg(F.sum("_n").alias("m")).agg(best("_p").alias("peak_daypart"), F.max("m").alias("daypart_orders"))
    names = F.array(*[F.lit(n) for n in fixed.WEEKDAYS])
    return beside(day, part).select(
        F.element_at(names, F.col("_w") + 1).alias("peak_weekday"), "weekday_orders", "peak_daypart", "daypart_orders"
    )


def season_ratio(df: DataFrame, date: str = DATE) -> DataFrame:
    """Season with most and fewest orders and their ratio; seasonal above 1.5."""
    months = df.where(col(date).isNotNull()).groupBy(F.month(col(date)).alias("_m")).agg(F.count(col(ORDER)).alias("_n"))
    counts = months.agg(*[sum_if(F.col("_m").isin(m), F.col("_n").cast("double")).alias(s) for s, m in fixed.SEASONS.items()])
    listed = F.array(*[F.struct(F.col(s).alias("n"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(fixed.SEASONS)])
    lowest = F.array_min(listed)
    highest = F.array_min(F.transform(listed, lambda x: F.struct((-x["n"]).alias("n"), x["i"].alias("i"), x["s"].alias("s"))))
    out = counts.select(
        highest["s"].alias("top_season"),
        lowest["s"].alias("bottom_season"),
        (-highest["n"]).cast("long").alias("top_orders"),
        lowest["n"].cast("long").alias("bottom_orders"),
    ).withColumn("ratio", ratio(F.col("top_orders"), F.col("bottom_orders")))
    return out.withColumn("is_seasonal", F.coalesce(F.col("ratio") > 1.5, F.lit(False)))


def trend_strength(df: DataFrame, date: str, columns: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """(column, correlation, direction): correlation of the daily mean with the order of its day."""
    names = [c for c in (columns or numeric_columns(df))]
    days = df.where(col(date).isNotNull()).groupBy(F.to_date(col(date)).alias("_d")).agg(
        *[F.avg(num(c)).alias(f"_c{i}") for i, c in enumerate(names)]
    )
    ordered = days.withColumn("_i", F.row_number().over(_periods("_d")).cast("double"))
    row = ordered.agg(F.count(F.lit(1)).alias("_n"), *[safe_corr(F.col("_i"), F.col(f"_c{i}")).alias(f"_r{i}") for i in range(len(names))])
    tall = stack_rows(row.where("_n > 5"), [{"column": F.lit(c), "correlation": F.col(f"_r{i}")} for i, c in enumerate(names)])
    r = F.col("correlation")
    return tall.withColumn("direction", F.when(r > threshold, "up").when(r < -threshold, "down").otherwise("none"))


# ---- categories and products -------------------------------------------------------------------

def _category_change(df: DataFrame, days: int, as_of) -> DataFrame:
    """(category, current, previous, change) for categories with sales in both periods."""
    rows, new, old = recent_periods(df, days, as_of)
    table = rows.where(col(CATEGORY).isNotNull()).groupBy(col(CATEGORY)).agg(
        sum_if(new, num(PRICE)).alias("current"),
        sum_if(old, num(PRICE)).alias("previous"),
        count_if(new).alias("_a"),
        count_if(old).alias("_b"),
    )
    both = table.where("_a > 0 AND _b > 0 AND previous > 0").drop("_a", "_b")
    return both.withColumn("change_percentage", growth(F.col("current"), F.col("previous")))


def declining_category(df: DataFrame, as_of=None, drop: float = 20.0) -> DataFrame:
    """If sales of the last 30 days fell by more than 10 percent: the category that fell most, if by
    more than ``drop`` percent."""
    now = as_of_date(df, as_of)
    table = _category_change(df, 30, now)
    rows, new, old = recent_periods(df, 30, now)
    total = rows.agg(growth(sum_if(new, num(PRICE)), sum_if(old, num(PRICE))).alias("total_change"))
    worst = table.agg(F.min_by(F.struct(CATEGORY, "change_percentage"), F.struct("change_percentage", CATEGORY)).alias("_w"))
    return (
        beside(worst, total)
        .select(F.col(f"_w.{CATEGORY}").alias("category"), F.col("_w.change_percentage").alias("change_percentage"), "total_change")
        .where((F.col("total_change") < -10) & (F.col("change_percentage") < -drop))
    )


def category_growth(df: DataFrame, as_of=None) -> DataFrame:
    """Sales of the last 90 days over the 90 before by category: the fastest one above 30 percent
    and the worst one below minus 20."""
    table = _category_change(df, 90, as_of)
    ends = table.agg(
        F.min_by(F.struct(CATEGORY, "change_percentage"), F.struct(-F.col("change_percentage"), F.col(CATEGORY))).alias("top"),
        F.min_by(F.struct(CATEGORY, "change_percentage"), F.struct("change_percentage", CATEGORY)).alias("low"),
    )
    both = ends.select(
        F.explode(F.array(F.struct(F.lit("fastest_growing").alias("rule"), "top"), F.struct(F.lit("steepest_decline").alias("rule"), F.col("low").alias("top")))).alias("_e")
    ).select("_e.rule", f"_e.top.{CATEGORY}", "_e.top.change_percentage")
    change = F.col("change_percentage")
    keep = ((F.col("rule") == "fastest_growing") & (change > 30)) | ((F.col("rule") == "steepest_decline") & (change < -20))
    return both.where(keep)


def top_category_shift(df: DataFrame, as_of=None, days: int = 90) -> DataFrame:
    """Best category overall with its share, best category lately, and whether they differ."""
    now = as_of_date(df, as_of)
    df, new = df.where(col(DATE) <= at(now)), col(DATE) >= at(now - timedelta(days=days))
    table = df.where(col(CATEGORY).isNotNull()).groupBy(col(CATEGORY)).agg(
        F.coalesce(F.sum(num(PRICE)), F.lit(0.0)).alias("_all"), F.sum(F.when(new, num(PRICE))).alias("_new")
    )
    return table.agg(
        F.min_by(CATEGORY, F.struct(-F.col("_all"), F.col(CATEGORY))).alias("top_category"),
        percent(F.max("_all"), F.sum("_all")).alias("top_percentage"),
        F.min_by(F.when(F.col("_new").isNotNull(), col(CATEGORY)), F.struct(-F.coalesce("_new", F.lit(float("-inf"))), F.col(CATEGORY))).alias("recent_top_category"),
    ).withColumn("shifted", F.col("top_category") != F.col("recent_top_category"))


def cross_sell_pairs(df: DataFrame, top: int = 1) -> DataFrame:
    """Category pairs bought by the most users.

    Users with the same set of categories collapse into one weighted set before any pair is made, so
    pairs are formed per distinct set of categories and never per user.
    """
    sets = (
        df.where(col(USER).isNotNull() & col(CATEGORY).isNotNull())
        .groupBy(col(USER))
        .agg(F.array_sort(F.collect_set(col(CATEGORY))).alias("_s"))
        .where(F.size("_s") >= 2)
        .groupBy("_s")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    first = sets.select("_n", "_s", F.posexplode("_s").alias("_i", "category1"))
    pairs = first.select("_n", "category1", F.explode(F.expr("slice(_s, _i + 2, size(_s))")).alias("category2"))
    counts = pairs.groupBy("category1", "category2").agg(F.sum("_n").alias("users"))
    return counts.orderBy(F.desc("users"), "category1", "category2").limit(top)


def price_dispersion(df: DataFrame, price: str, category: str, threshold: float = 0.5) -> DataFrame:
    """Categories whose price deviation exceeds half their mean price."""
    table = df.where(col(category).isNotNull()).groupBy(col(category)).agg(
        F.avg(num(price)).alias("mean_price"), F.stddev(num(price)).alias("std_price")
    )
    return table.withColumn("dispersion", ratio(F.col("std_price"), F.col("mean_price"))).where(F.col("dispersion") > threshold)


def price_band_share(df: DataFrame, price: str = PRICE) -> DataFrame:
    """(band, count, percentage, flag): share of each right-closed price band; flags more than 25
    percent in the top band or else more than 40 in the bottom one."""
    cells = df.select(_band_of(num(price), fixed.PRICE_BANDS).alias("band")).where("band IS NOT NULL").groupBy("band").agg(
        F.count(F.lit(1)).alias("count")
    )
    share = percent(F.col("count"), F.sum("count").over(Window.partitionBy(F.lit(1))))
    top, bottom = fixed.PRICE_BANDS[-1][2], fixed.PRICE_BANDS[0][2]
    out = cells.withColumn("percentage", share)
    top_share = F.max(F.when(F.col("band") == top, F.col("percentage"))).over(Window.partitionBy(F.lit(1)))
    high = (F.col("band") == top) & (F.col("percentage") > 25)
    low = (F.col("band") == bottom) & (F.col("percentage") > 40) & (F.coalesce(top_share, F.lit(0.0)) <= 25)
    return out.withColumn("flag", F.when(high, "many_expensive").when(low, "many_cheap"))


def best_sellers(df: DataFrame, top: int = 5) -> DataFrame:
    """Top products by revenue, with a name (the smallest one if there are several)."""
    names = [F.min("product_name").alias("product_name")] if "product_name" in df.columns else []
    return (
        df.where(col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.coalesce(F.sum(num(PRICE)), F.lit(0.0)).alias("revenue"), *names)
        .orderBy(F.desc("revenue"), "product_id")
        .limit(top)
    )


# ---- customers ---------------------------------------------------------------------------------

def churn_90d(df: DataFrame, as_of=None, days: int = 90, alert: float = 70.0) -> DataFrame:
    """Users of days 90 to 180 back who did not buy in the last 90."""
    rows, new, old = recent_periods(df, days, as_of)
    base = user_periods(rows, new, old).agg(
        count_if(F.col("before")).alias("older_users"), count_if(F.col("before") & ~F.col("now")).alias("churned_users")
    )
    return base.withColumn("churn_rate", percent(F.col("churned_users"), F.col("older_users"))).withColumn(
        "alert", F.coalesce(F.col("churn_rate") > alert, F.lit(False))
    )


def churned_top_category(df: DataFrame, as_of=None, days: int = 90) -> DataFrame:
    """Category in which the churned users spent most, over all their orders."""
    rows, new, old = recent_periods(df, days, as_of)
    gone = user_periods(rows, new, old).where(F.col("before") & ~F.col("now")).select(col(USER))
    sales = df.where(col(CATEGORY).isNotNull()).join(gone, USER, "left_semi").groupBy(col(CATEGORY)).agg(
        F.coalesce(F.sum(num(PRICE)), F.lit(0.0)).alias("sales")
    )
    return sales.orderBy(F.desc("sales"), CATEGORY).limit(1)


def repeat_rate(df: DataFrame) -> DataFrame:
    """Share of users with more than one row."""
    users = df.where(col(USER).isNotNull()).groupBy(col(USER)).agg(F.count(F.lit(1)).alias("_n"))
    return users.agg(
        F.count(F.lit(1)).alias("users"), count_if(F.col("_n") > 1).alias("repeat_users")
    ).withColumn("repeat_rate", percent(F.col("repeat_users"), F.col("users")))


def new_customer_share(df: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Buyers of the last 30 days never seen before, bands above 30 and below 10 percent."""
    now = as_of_date(df, as_of)
    df, new = df.where(col(DATE) <= at(now)), col(DATE) >= at(now - timedelta(days=days))
    base = user_periods(df, new, ~new).agg(
        count_if(F.col("now")).alias("recent_users"), count_if(F.col("now") & ~F.col("before")).alias("new_users")
    )
    share = F.col("new_percentage")
    return base.withColumn("new_percentage", percent(F.col("new_users"), F.col("recent_users"))).withColumn(
        "band", F.when(share > 30, "many_new").when(share < 10, "few_new")
    )


def segment_contribution(df: DataFrame, segment: str = "user_segment") -> DataFrame:
    """(segment, sales, sales and row share): revenue share of each segment, largest first, with an
    alert when at-risk customers hold more than 30 percent of the rows."""
    table = df.where(col(segment).isNotNull()).groupBy(col(segment)).agg(
        F.coalesce(F.sum(num(PRICE)), F.lit(0.0)).alias("sales"), F.count(F.lit(1)).alias("row_count")
    )
    one = Window.partitionBy(F.lit(1))
    out = table.withColumns(
        {
            "sales_percentage": percent(F.col("sales"), F.sum("sales").over(one)),
            "row_percentage": percent(F.col("row_count"), F.sum("row_count").over(one)),
        }
    )
    alert = (col(segment) == "at_risk_customers") & (F.col("row_percentage") > 30)
    return out.withColumn("alert", alert).orderBy(F.desc("sales_percentage"), segment)


def cluster_names(profile: DataFrame) -> DataFrame:
    """Name clusters by the ratio of their means to the overall ones. ``profile`` has per cluster the
    columns total_spent, avg_order, purchase_count and the same with ``all_``."""
    spent = F.col("total_spent") > 1.5 * F.col("all_total_spent")
    often = F.col("purchase_count") > 1.5 * F.col("all_purchase_count")
    small = F.col("avg_order") < 0.8 * F.col("all_avg_order")
    cheap = F.col("avg_order") < 0.6 * F.col("all_avg_order")
    name = (
        F.when(spent & often, "high_value_loyal")
        .when(spent, "big_spender")
        .when(often & small, "small_frequent")
        .when(often, "loyal")
        .when(cheap, "price_sensitive")
        .otherwise(F.concat(F.lit("cluster_"), (F.col("cluster") + 1).cast("string")))
    )
    return profile.withColumn("segment_name", name)


# ---- collected insights ------------------------------------------------------------------------

SHAPE = ["rule", "subject", "metric", "value", "threshold", "severity"]


def _rows(df: DataFrame, rule: str, subject: Column, metric: str, value: Column, threshold: float | None, severity: str | Column = "info") -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        subject.cast("string").alias("subject"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        F.lit(threshold).cast("double").alias("threshold"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
    )


def _missing_insights(df: DataFrame, severity: str) -> DataFrame:
    gaps = prof.schema_info(df, samples=1)
    return _rows(
        gaps.where(F.col("missing_percentage") > fixed.HIGH_MISSING), "high_missing", F.col("column"), "missing_percentage",
        F.col("missing_percentage"), fixed.HIGH_MISSING, severity,
    )


def quality_insights(df: DataFrame) -> DataFrame:
    """Missing cells above 5 percent, duplicates above 5 percent, one category above 90 percent,
    outliers above 5 percent (columns with more than ten values)."""
    dups = duplicate_count(df).withColumn("_p", percent(F.col("duplicate_rows"), F.col("row_count"))).where("_p > 5")
    parts = [
        _missing_insights(df, "warning"),
        _rows(dups, "duplicates", F.lit("rows"), "duplicate_percentage", F.col("_p"), 5.0, "warning"),
    ]
    if categorical_columns(df):
        parts.append(
            _rows(prof.dominant_category(df), "dominant_category", F.concat_ws("=", "column", "category"), "percentage", F.col("percentage"), 90.0, "warning")
        )
    if numeric_columns(df):
        bounds = prof.outlier_bounds(df, "iqr", 1.5)
        rules = {c: ((num(c) < lo) | (num(c) > hi), lo, hi) for c, (lo, hi) in bounds.items()}
        row = df.agg(
            F.lit(1),
            *[F.struct(count_if(cond).alias("out"), F.count(num(c)).alias("n")).alias(f"_s{i}") for i, (c, (cond, _, _)) in enumerate(rules.items())],
        )
        outs = stack_rows(
            row,
            [
                {"column": F.lit(c), "_p": F.when(F.col(f"_s{i}.n") > 10, percent(F.col(f"_s{i}.out"), F.col(f"_s{i}.n")))}
                for i, c in enumerate(rules)
            ],
        ).where(F.col("_p") > fixed.HIGH_OUTLIERS)
        parts.append(_rows(outs, "high_outliers", F.col("column"), "outlier_percentage", F.col("_p"), fixed.HIGH_OUTLIERS, "warning"))
    return reduce(DataFrame.unionByName, parts)


def basic_insights(df: DataFrame) -> DataFrame:
    """Missing cells, the five strongest correlations in (0.7, 1), skewed columns."""
    names = numeric_columns(df)
    parts = [_missing_insights(df, "info")]
    if len(names) > 1:
        strong = F.abs("correlation")
        pairs = pearson_pairs(df, names).where((strong > fixed.HIGH_CORRELATION) & (strong < 1.0))
        pairs = pairs.orderBy(F.desc(strong), "var1", "var2").limit(5)
        parts.append(_rows(pairs, "high_correlation", F.concat_ws("~", "var1", "var2"), "abs_correlation", strong, fixed.HIGH_CORRELATION))
    if names:
        row = df.agg(F.lit(1), *[sample_skew(num(c)).alias(f"_s{i}") for i, c in enumerate(names)])
        skews = stack_rows(row, [{"column": F.lit(c), "_v": F.col(f"_s{i}")} for i, c in enumerate(names)])
        parts.append(
            _rows(
                skews.where(F.abs("_v") > fixed.HIGH_SKEW), "skewed", F.col("column"), "skewness", F.col("_v"), fixed.HIGH_SKEW,
                F.when(F.col("_v") > 0, "right").otherwise("left"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


TOPICS = {
    "sales": ["monthly_sales_change", "monthly_aov_change", "revenue", "aov", "week_over_week"],
    "customer": ["repeat_rate", "new_customer_share", "segment", "retention", "churn"],
    "product": ["top_category", "category_growth", "best_seller", "price_band", "cross_sell", "price_dispersion"],
    "time": ["peak_time", "season_ratio", "weekday_sales"],
}


def insight_topics(insights: DataFrame) -> DataFrame:
    """Sort insights into sales, customer, product, time and other."""
    ladder = F
    for topic, rules in TOPICS.items():
        ladder = ladder.when(F.col("rule").isin(rules), topic)
    return insights.withColumn("topic", ladder.otherwise("other"))


def business_insights(df: DataFrame, as_of=None, reuse: bool = True) -> DataFrame:
    """The rules above that fire on one sales table (order_date, total_price, category, user_id,
    product_id, order_id), with their topics. ``as_of`` defaults to the last order.

    With ``reuse`` the needed columns are stored once, so a joined input is not joined again for
    every rule; switch it off when ``df`` is a plain table scan.
    """
    need = [DATE, PRICE, CATEGORY, USER, "product_id", ORDER]
    gone = [c for c in need if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    if reuse:
        extra = [c for c in ("product_name", "user_segment") if c in df.columns]
        df = stored(df.select(*[col(c) for c in [*need, *extra]]), "insights")
    now = as_of_date(df, as_of)
    change, aov = monthly_sales_change(df), monthly_aov_change(df)
    repeat, fresh = repeat_rate(df), new_customer_share(df, now)
    season, peak, shift = season_ratio(df), peak_weekday_daypart(df), top_category_shift(df, now)
    parts = [
        _rows(change.where("band IS NOT NULL"), "monthly_sales_change", F.col("band"), "change_percentage", F.col("change_percentage"), 5.0),
        _rows(aov.where("band IS NOT NULL"), "monthly_aov_change", F.col("band"), "change_percentage", F.col("change_percentage"), 10.0),
        _rows(repeat, "repeat_rate", F.lit("users"), "repeat_rate", F.col("repeat_rate"), None),
        _rows(fresh.where("band IS NOT NULL"), "new_customer_share", F.col("band"), "new_percentage", F.col("new_percentage"), 30.0),
        _rows(shift, "top_category", F.col("recent_top_category"), "top_percentage", F.col("top_percentage"), None),
        _rows(category_growth(df, now), "category_growth", F.col(CATEGORY), "change_percentage", F.col("change_percentage"), 30.0),
        _rows(price_band_share(df).where("flag IS NOT NULL"), "price_band", F.col("band"), "percentage", F.col("percentage"), 25.0),
        _rows(peak, "peak_time", F.concat_ws(" ", "peak_weekday", "peak_daypart"), "weekday_orders", F.col("weekday_orders"), None),
        _rows(season.where("is_seasonal"), "season_ratio", F.col("top_season"), "ratio", F.col("ratio"), 1.5),
        _rows(best_sellers(df, 1), "best_seller", F.col("product_id"), "revenue", F.col("revenue"), None),
    ]
    if "user_segment" in df.columns:
        parts.append(_rows(segment_contribution(df), "segment", F.col("user_segment"), "sales_percentage", F.col("sales_percentage"), None))
    return insight_topics(reduce(DataFrame.unionByName, parts))
