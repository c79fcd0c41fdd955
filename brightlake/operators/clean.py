"""Names, types, duplicates, redundant columns and row filters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brightlake.functions import fixed
from brightlake.functions.columns import (
    col,
    count_if,
    datetime_columns,
    categorical_columns,
    missing,
    num,
    numeric_columns,
    percent,
    ratio,
    short_form,
    stack_rows,
    string_columns,
)
from brightlake.plans.running import quantile_row
from brightlake.session import stored


# ---- names -------------------------------------------------------------------------------------

def simple_names(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case names with underscores for spaces."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def normal_name(name: str) -> str:
    words = re.split(r"\W+|_+", name.strip().lower())
    return "_".join(w for w in words if w)


def normalize_names(df: DataFrame) -> DataFrame:
    """Names made of word characters joined by single underscores."""
    return df.toDF(*[normal_name(c) for c in df.columns])


def _has_word(name: str, words: Sequence[str]) -> bool:
    return any(w in name.lower() for w in words)


# ---- types -------------------------------------------------------------------------------------

def date_of_text(text: Column) -> Column:
    """Timestamp of date text in any of the known formats, null if none fits.

    The shape of the text picks the format, so text that is no date costs no failed parse.
    """
    trimmed, ladder = F.trim(text), F
    for form, shape in fixed.DATE_FORMATS:
        ladder = ladder.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit(form)))
    return ladder.otherwise(F.lit(None)).cast("timestamp_ntz")


def number_of_text(text: Column) -> Column:
    """Number behind money text, null if it is not a number."""
    return F.regexp_replace(text, fixed.MONEY_SIGNS, "").try_cast("double")


def parse_date_columns(df: DataFrame, words: Sequence[str] = tuple(fixed.LOAD_DATE_WORDS)) -> DataFrame:
    """Text columns named like a date become timestamps; unreadable cells become null."""
    names = [c for c in string_columns(df) if _has_word(c, words)]
    return df.withColumns({c: date_of_text(col(c)) for c in names})


def parse_money_columns(df: DataFrame, words: Sequence[str] = tuple(fixed.MONEY_WORDS)) -> DataFrame:
    """Text columns named like money become doubles; unreadable cells become null."""
    names = [c for c in string_columns(df) if _has_word(c, words)]
    return df.withColumns({c: number_of_text(col(c)) for c in names})


def load_cleanup(df: DataFrame) -> DataFrame:
    """What every freshly read table goes through: names, dates, money."""
    return parse_money_columns(parse_date_columns(simple_names(df)))


def logical_types(df: DataFrame) -> DataFrame:
    """(column, logical_type): numeric columns with few values count as categorical, text columns
    named like a date whose values mostly parse count as datetime."""
    numbers, dates, texts = numeric_columns(df), datetime_columns(df), categorical_columns(df)
    dated = [c for c in string_columns(df) if _has_word(c, fixed.TYPE_DATE_WORDS)]
    stats = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_distinct(num(c)).alias(f"_d{i}") for i, c in enumerate(numbers)],
        *[
            (count_if(date_of_text(col(c)).isNotNull()) * 2 > F.count(col(c))).alias(f"_t{i}")
            for i, c in enumerate(dated)
        ],
    )
    entries = []
    for c in df.columns:
        if c in numbers:
            d = F.col(f"_d{numbers.index(c)}")
            few = (d <= 10) & (F.coalesce(ratio(d, F.col("_rows")), F.lit(1.0)) < 0.05)
            kind = F.when(few, "categorical").otherwise("numeric")
        elif c in dates:
            kind = F.lit("datetime")
        elif c in dated:
            kind = F.when(F.col(f"_t{dated.index(c)}"), "datetime").otherwise("categorical")
        elif c in texts:
            kind = F.lit("categorical")
        else:
            kind = F.lit("other")
        entries.append({"column": F.lit(c), "logical_type": kind})
    return stack_rows(stats, entries)


def looks_like_date(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in fixed.DATE_PATTERNS:
        hit = hit | text.rlike(pattern)
    return hit | date_of_text(text).isNotNull()


def detect_date_columns(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Text columns that hold dates: by content (over all rows) or by name."""
    names = string_columns(df)
    stats = df.agg(
        *[
            F.struct(count_if(looks_like_date(col(c))).alias("hit"), F.count(col(c)).alias("n")).alias(f"_c{i}")
            for i, c in enumerate(names)
        ]
    )
    entries = []
    for i, c in enumerate(names):
        hit = F.coalesce(ratio(F.col(f"_c{i}.hit"), F.col(f"_c{i}.n")), F.lit(0.0))
        by_name = F.lit(_has_word(c, fixed.TYPE_DATE_WORDS))
        entries.append(
            {
                "column": F.lit(c),
                "date_share": hit,
                "name_suggests_date": by_name,
                "is_date": (hit > share) | by_name,
            }
        )
    return stack_rows(stats, entries)


# ---- redundant columns and rows ----------------------------------------------------------------

def redundant_columns(df: DataFrame) -> DataFrame:
    """Columns with a single value, or with more than 90 % missing cells."""
    stats = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_distinct(F.when(~missing(df, c), short_form(df, c))).alias(f"_d{i}") for i, c in enumerate(df.columns)],
        *[F.min(col(c)).cast("string").alias(f"_v{i}") for i, c in enumerate(df.columns)],
        *[count_if(missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)],
    )
    entries = []
    for i, c in enumerate(df.columns):
        same = F.col(f"_d{i}") == 1
        pct = percent(F.col(f"_m{i}"), F.col("_rows"))
        entries.append(
            {
                "column": F.lit(c),
                "reason": F.when(same, "all_same").when(pct > 90, "mostly_na"),
                "value": F.when(same, F.col(f"_v{i}")),
                "percentage_na": F.when(~same & (pct > 90), pct),
            }
        )
    return stack_rows(stats, entries).where(F.col("reason").isNotNull())


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """(row_count, duplicate_rows): rows beyond the first of each set of equal rows."""
    copies = df.groupBy(*[short_form(df, c).alias(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def drop_zero_variance(df: DataFrame) -> DataFrame:
    """Drop numeric columns whose non-missing cells all hold one value."""
    names = numeric_columns(df)
    if not names:
        return df
    row = df.agg(*[(F.min(num(c)) == F.max(num(c))).alias(f"_c{i}") for i, c in enumerate(names)]).first()
    return df.drop(*[c for i, c in enumerate(names) if row[f"_c{i}"]])


def iqr_fences(df: DataFrame, columns: Sequence[str], threshold: float = 1.5) -> dict[str, tuple[float, float]]:
    fences = {}
    for c, (q1, q3) in quantile_row(df, columns, [0.25, 0.75]).items():
        if q1 is not None:
            fences[c] = (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
    return fences


def remove_outlier_rows(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5, min_percent: float = 5.0
) -> DataFrame:
    """Drop rows outside the IQR fences of every column in which such rows exceed ``min_percent``."""
    names = list(columns or numeric_columns(df))
    fences = iqr_fences(df, names, threshold)
    outside = {c: (num(c) < lo) | (num(c) > hi) for c, (lo, hi) in fences.items()}
    if not outside:
        return df
    shares = df.agg(
        *[percent(count_if(cond), F.count(F.lit(1))).alias(f"_c{i}") for i, cond in enumerate(outside.values())]
    ).first()
    drop = F.lit(False)
    for i, cond in enumerate(outside.values()):
        if (shares[f"_c{i}"] or 0.0) > min_percent:
            drop = drop | F.coalesce(cond, F.lit(False))
    return df.where(~drop)


# ---- row filters and projections ---------------------------------------------------------------

def date_bounds(df: DataFrame, date: str) -> tuple:
    """Smallest and largest calendar day of ``date`` (one aggregate, two values)."""
    row = df.agg(F.min(col(date)).cast("date").alias("lo"), F.max(col(date)).cast("date").alias("hi")).first()
    return row["lo"], row["hi"]


def period_filter(df: DataFrame, date: str, mode: str = "all", start=None, end=None, days: int = 30) -> DataFrame:
    """``all`` rows, an inclusive ``range`` of days, or the ``recent`` days before the last one.

    The bounds are literals on the raw column, so they reach the Parquet scan.
    """
    if mode == "all":
        return df
    if mode == "range":
        after = F.date_add(F.to_date(F.lit(end)), 1)
        return df.where((col(date) >= F.to_date(F.lit(start))) & (col(date) < after))
    if mode == "recent":
        last = date_bounds(df, date)[1]
        return df.where(col(date) >= F.date_add(F.lit(last), 1 - days))
    raise ValueError(f"unknown period mode: {mode}")


def derive_columns(
    df: DataFrame,
    date: str | None = None,
    positive: Sequence[str] = (),
    not_null: Sequence[str] = (),
    drop: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Year and month parts, ``value > 0`` and not-null filters, optional drops and renames."""
    for c in positive:
        df = df.where(num(c) > 0)
    for c in not_null:
        df = df.where(col(c).isNotNull())
    if date:
        df = df.withColumns({"year": F.year(col(date)), "month": F.month(col(date))})
    return df.drop(*drop).withColumnsRenamed(dict(rename or {}))


def drop_na_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null (or NaN) in ``subset``, or in any column."""
    return df.dropna(subset=list(subset) if subset else None)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent non-null values, ties by value."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(n)


def is_in_top(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose value is among the n most frequent; n values at most reach the join."""
    return df.join(top_values(df, column, n).select(col(column)), column, "left_semi")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))


# ---- the whole preparation ---------------------------------------------------------------------

def preprocess(
    df: DataFrame,
    normalize_columns: bool = True,
    remove_duplicates: bool = True,
    convert_dates: bool = True,
    encode_categorical: bool = False,
    handle_missing: bool = True,
    remove_outliers: bool = False,
    handle_low_variance: bool = True,
) -> DataFrame:
    """Names, duplicates, dates, one-hot, missing values, outliers, constant columns, in this order."""
    from brightlake.operators.encode import one_hot
    from brightlake.operators.impute import impute_smart

    if normalize_columns:
        df = normalize_names(df)
    if remove_duplicates:
        # several passes follow; without the copy each would repeat the full-row shuffle
        df = stored(drop_duplicate_rows(df), "deduplicated")
    if convert_dates and string_columns(df):
        dates = [r["column"] for r in detect_date_columns(df).where("is_date AND date_share > 0.5").collect()]  # a name alone converts nothing
        df = df.withColumns({c: date_of_text(col(c)) for c in dates})
    if encode_categorical:
        df = one_hot(df, max_categories=9)
    if handle_missing:
        df = impute_smart(df)
    if remove_outliers:
        df = remove_outlier_rows(df)
    if handle_low_variance:
        df = drop_zero_variance(df)
    return df


