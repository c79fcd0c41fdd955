"""Business indicators. Every window of days is cut by literal bounds around ``as_of``, so the scan
reads only the days a rule needs, and all figures of a rule come from conditional aggregates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightlake.functions import fixed
from brightlake.functions.columns import col, count_if, growth, num, percent, ratio, sum_if

DATE, PRICE, USER, ORDER, CATEGORY = "order_date", "total_price", "user_id", "order_id", "category"


def as_of_date(df: DataFrame, as_of=None, date: str = DATE) -> datetime:
    """``as_of`` as a timestamp, by default the last order date (one aggregate)."""
    if as_of is None:
        as_of = df.agg(F.max(col(date)).cast("timestamp_ntz").alias("d")).first()["d"]
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    return as_of


def at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def recent_periods(df: DataFrame, days: int, as_of=None, date: str = DATE) -> tuple[DataFrame, Column, Column]:
    """Rows of the last two periods of ``days`` with the conditions (current, previous)."""
    now = as_of_date(df, as_of, date)
    if now is None:
        return df.where(F.lit(False)), F.lit(False), F.lit(False)
    cut, start = at(now - timedelta(days=days)), at(now - timedelta(days=2 * days))
    return df.where((col(date) >= start) & (col(date) <= at(now))), col(date) >= cut, col(date) < cut


def change_band(change: Column, *bands: tuple[float, str]) -> Column:
    """First matching band: positive bounds are passed upward, negative ones downward."""
    ladder = F
    for bound, label in bands:
        ladder = ladder.when(change > bound if bound >= 0 else change < bound, label)
    return ladder.otherwise(F.lit(None).cast("string"))


# ---- indicator cards ---------------------------------------------------------------------------

def kpi_half_split(df: DataFrame, date: str = DATE) -> DataFrame:
    """Revenue, orders, order value, customers and the conversion proxy of the second half of the
    date span against the first."""
    row = df.agg(F.min(col(date)).cast("timestamp_ntz").alias("lo"), F.max(col(date)).cast("timestamp_ntz").alias("hi")).first()
    if row["lo"] is None:
        middle = datetime(1970, 1, 1)
    else:
        middle = row["hi"] - (row["hi"] - row["lo"]) / 2
    new = col(date) >= at(middle)
    old = col(date) < at(middle)
    has_category = CATEGORY in df.columns
    kinds = F.count_distinct(col(CATEGORY)) if has_category else F.lit(0).cast("long")
    base = df.agg(
        *[sum_if(c, num(PRICE)).alias(f"{p}_revenue") for p, c in (("current", new), ("previous", old))],
        *[F.count_distinct(F.when(c, col(ORDER))).alias(f"{p}_orders") for p, c in (("current", new), ("previous", old))],
        *[F.count_distinct(F.when(c, col(USER))).alias(f"{p}_customers") for p, c in (("current", new), ("previous", old))],
        kinds.alias("_kinds"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = base
    for p in ("current", "previous"):
        out = out.withColumn(f"{p}_aov", zero(ratio(F.col(f"{p}_revenue"), F.col(f"{p}_orders")))).withColumn(
            f"{p}_conversion", zero(percent(F.col(f"{p}_orders"), F.col(f"{p}_customers") * F.col("_kinds")))
        )
    return out.withColumn("target_revenue", F.col("previous_revenue") * (1 + fixed.TARGET_REVENUE_GROWTH)).drop("_kinds")


def kpi_card(df: DataFrame, value: str, previous: str, target: str | None = None) -> DataFrame:
    """Add the change in percent and whether the target is met."""
    change = F.when(num(previous) != 0, percent(num(value) - num(previous), num(previous)))
    met = num(value) >= num(target) if target else F.lit(None).cast("boolean")
    return df.withColumns({"change_percentage": change, "target_met": met})


def kpi_30d_revenue(df: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Revenue of the last 30 days, its growth over the 30 before, against the growth target."""
    rows, new, old = recent_periods(df, days, as_of)
    base = rows.agg(sum_if(new, num(PRICE)).alias("current_revenue"), sum_if(old, num(PRICE)).alias("previous_revenue"))
    change = growth(F.col("current_revenue"), F.col("previous_revenue"))
    target = 100.0 * fixed.TARGET_REVENUE_GROWTH
    return base.withColumn("growth_percentage", change).withColumns(
        {"target_percentage": F.lit(target), "target_met": F.col("growth_percentage") >= target}
    )


def kpi_conversion(df: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Distinct orders per distinct user of the last 30 days, in percent."""
    rows, new, _ = recent_periods(df, days, as_of)
    base = rows.where(new).agg(F.count_distinct(col(ORDER)).alias("orders"), F.count_distinct(col(USER)).alias("users"))
    rate = percent(F.col("orders"), F.col("users"))
    target = fixed.TARGET_CONVERSION
    return base.withColumn("conversion_rate", rate).withColumns(
        {
            "target": F.lit(target),
            "target_met": F.col("conversion_rate") >= target,
            "gap": F.greatest(F.lit(0.0), target - F.col("conversion_rate")),
        }
    )


def kpi_aov(df: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Revenue per distinct order of the last 30 days against the target value."""
    rows, new, _ = recent_periods(df, days, as_of)
    base = rows.where(new).agg(F.coalesce(F.sum(num(PRICE)), F.lit(0.0)).alias("revenue"), F.count_distinct(col(ORDER)).alias("orders"))
    target = fixed.TARGET_ORDER_VALUE
    return base.withColumn("aov", F.coalesce(ratio(F.col("revenue"), F.col("orders")), F.lit(0.0))).withColumns(
        {
            "target": F.lit(target),
            "target_met": F.col("aov") >= target,
            "gap_percentage": F.greatest(F.lit(0.0), (target - F.col("aov")) / target * 100.0),
        }
    )


def user_periods(df: DataFrame, new: Column, old: Column) -> DataFrame:
    """(user, bought now, bought before): one row per user, so set questions become counts."""
    return df.where(col(USER).isNotNull()).groupBy(col(USER)).agg(
        F.max(new).alias("now"), F.max(old).alias("before")
    )


def kpi_retention(df: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Share of the buyers of the last 30 days who also bought in the 30 before."""
    rows, new, old = recent_periods(df, days, as_of)
    base = user_periods(rows, new, old).agg(
        count_if(F.col("now")).alias("current_buyers"),
        count_if(F.col("before")).alias("previous_buyers"),
        count_if(F.col("now") & F.col("before")).alias("returning_buyers"),
    )
    target = fixed.TARGET_RETENTION
    return base.withColumn("retention_rate", percent(F.col("returning_buyers"), F.col("current_buyers"))).withColumns(
        {"target": F.lit(target), "target_met": F.col("retention_rate") >= target}
    )


def month_of(date: str = DATE) -> Column:
    return F.to_date(F.date_trunc("month", col(date)))


def mau(df: DataFrame) -> DataFrame:
    """Distinct users per month, growth over the month before, and the growth target."""
    months = df.groupBy(month_of().alias("month")).agg(F.count_distinct(col(USER)).alias("active_users"))
    before = F.lag("active_users").over(Window.partitionBy(F.lit(1)).orderBy("month"))
    out = months.withColumn("growth_percentage", growth(F.col("active_users"), before))
    return out.withColumn("target_met", F.col("growth_percentage") >= 100.0 * fixed.TARGET_MAU_GROWTH)


# ---- users -------------------------------------------------------------------------------------

def user_stats(df: DataFrame, as_of=None) -> DataFrame:
    """Per user: orders, spend, order value, first and last date, days since, categories, reviews,
    main region (columns that exist)."""
    now = as_of_date(df, as_of)
    known = df.where(col(USER).isNotNull())
    parts = [
        F.count(F.lit(1)).alias("order_count"),
        F.coalesce(F.sum(num(PRICE)), F.lit(0.0)).alias("total_spent"),
        F.avg(num(PRICE)).alias("avg_order_value"),
        F.min(col(DATE)).alias("first_order_date"),
        F.max(col(DATE)).alias("last_order_date"),
    ]
    if CATEGORY in df.columns:
        parts.append(F.array_join(F.array_sort(F.collect_set(col(CATEGORY))), ", ").alias("interest_categories"))
    if "review_written" in df.columns:
        parts.append(count_if(col("review_written")).alias("review_count"))
    if "region" in df.columns:
        # counts per (user, region) first: nothing per user grows with its orders
        cells = known.groupBy(col(USER), col("region")).agg(F.count(F.lit(1)).alias("_n"))
        region = cells.where("region IS NOT NULL").groupBy(col(USER)).agg(
            F.min_by("region", F.struct(-F.col("_n"), F.col("region"))).alias("region")
        )
    stats = known.groupBy(col(USER)).agg(*parts)
    stats = stats.withColumn("days_since_last_order", F.datediff(at(now), F.col("last_order_date")))
    return stats.join(region, USER, "left") if "region" in df.columns else stats


def user_segment(stats: DataFrame, as_of) -> DataFrame:
    """Ordered rules over ``user_stats``: loyal, high value, new, at risk, else browsing."""
    now = as_of_date(stats, as_of)
    age = F.datediff(at(now), F.col("first_order_date"))
    idle = F.col("days_since_last_order")
    segment = (
        F.when((F.col("order_count") >= 3) & (idle <= 180), "loyal_customers")
        .when(F.col("avg_order_value") > 100000, "high_value_customers")
        .when(age <= 30, "new_customers")
        .when(idle > 90, "at_risk_customers")
        .otherwise("browsers")
    )
    return stats.withColumn("user_segment", segment)
