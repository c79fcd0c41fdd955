"""Table overview, column profiles, quality scores, outliers and text statistics.

Moments of all columns come from one wide aggregate; anything about distinct values comes from
(column, value, count) cells, which collapse copies before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightlake.functions import fixed
from brightlake.functions.columns import (
    beside,
    categorical_columns,
    col,
    count_if,
    datetime_columns,
    missing,
    num,
    numeric_columns,
    percent,
    ratio,
    sample_kurtosis,
    sample_skew,
    short_form,
    stack_rows,
    string_columns,
)
from brightlake.operators.clean import duplicate_count, logical_types
from brightlake.plans.running import quantile_row, quantiles, value_cells


# ---- table level -------------------------------------------------------------------------------

def table_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, missing cells, duplicate rows and columns per logical type."""
    width = len(df.columns)
    gaps = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[count_if(missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)],
    )
    missing_cells = sum((F.col(f"_m{i}") for i in range(width)), F.lit(0).cast("long"))
    with_gaps = sum(((F.col(f"_m{i}") > 0).cast("long") for i in range(width)), F.lit(0).cast("long"))
    base = gaps.select(
        "row_count",
        F.lit(width).cast("long").alias("column_count"),
        (F.col("row_count") * width).alias("total_cells"),
        missing_cells.alias("missing_cells"),
        F.coalesce(percent(missing_cells, F.col("row_count") * width), F.lit(0.0)).alias("missing_percentage"),
        with_gaps.alias("columns_with_missing"),
    )
    kinds = logical_types(df).agg(
        *[count_if(F.col("logical_type") == k).alias(f"{k}_count") for k in ("numeric", "categorical", "datetime")]
    )
    return beside(beside(base, duplicate_count(df).drop("row_count")), kinds)


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: counts, moments, median, IQR fences and outliers.

    Columns that hold only 0 and 1 are exempt from the outlier part.
    """
    names = list(columns or numeric_columns(df))
    fences = {}
    for c, (q1, q2, q3) in quantile_row(df, names, [0.25, 0.5, 0.75]).items():
        fences[c] = (q2, None, None) if q1 is None else (q2, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(names):
        v, (_, lo, hi) = num(c), fences[c]
        aggs += [
            F.struct(
                F.count(v).alias("n"),
                F.min(v).alias("lo"),
                F.max(v).alias("hi"),
                F.avg(v).alias("mean"),
                F.stddev(v).alias("std"),
                sample_skew(v).alias("skew"),
                sample_kurtosis(v).alias("kurt"),
                count_if(v == 0).alias("zeros"),
                count_if(v < 0).alias("negative"),
                count_if(v.isin(0.0, 1.0)).alias("bits"),
                (count_if((v < lo) | (v > hi)) if lo is not None else F.lit(0).cast("long")).alias("out"),
            ).alias(f"_s{i}"),
        ]
    entries = []
    for i, c in enumerate(names):
        s, median = (lambda k, i=i: F.col(f"_s{i}.{k}")), fences[c][0]
        binary = (s("n") > 0) & (s("bits") == s("n"))
        rows = F.col("_rows")
        number = lambda x: F.lit(x).cast("double")
        entries.append(
            {
                "column": F.lit(c),
                "_rows": rows,
                "missing_count": rows - s("n"),
                "missing_percentage": percent(rows - s("n"), rows),
                "min": s("lo"),
                "max": s("hi"),
                "mean": s("mean"),
                "median": number(median),
                "std": s("std"),
                "zeros_count": s("zeros"),
                "zeros_percentage": percent(s("zeros"), s("n")),
                "negative_count": s("negative"),
                "skewness": s("skew"),
                "kurtosis": s("kurt"),
                "is_binary": binary,
                "outliers_count": F.when(~binary, s("out")),
                "outliers_percentage": F.when(~binary, F.coalesce(percent(s("out"), s("n")), F.lit(0.0))),
                "lower_bound": F.when(~binary, number(fences[c][1])),
                "upper_bound": F.when(~binary, number(fences[c][2])),
            }
        )
    # distinct counts come from value cells: counting them inside the aggregate above would send every
    # row through it once per column
    distinct = value_cells(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("_d"))
    d = F.coalesce(F.col("_d"), F.lit(0))
    joined = stack_rows(df.agg(*aggs), entries).join(distinct, "column", "left")
    return joined.withColumns({"unique_count": d, "unique_percentage": percent(d, F.col("_rows"))}).drop("_d", "_rows")


def datetime_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last instant and the whole days between them."""
    names = list(columns or datetime_columns(df))
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.struct(
                F.count(col(c)).alias("n"),
                F.min(col(c)).cast("timestamp_ntz").alias("lo"),
                F.max(col(c)).cast("timestamp_ntz").alias("hi"),
            ).alias(f"_s{i}")
            for i, c in enumerate(names)
        ],
    )
    return stack_rows(
        row,
        [
            {
                "column": F.lit(c),
                "missing_count": F.col("_rows") - F.col(f"_s{i}.n"),
                "min_date": F.col(f"_s{i}.lo"),
                "max_date": F.col(f"_s{i}.hi"),
                "range_days": F.floor(
                    (F.unix_seconds(F.col(f"_s{i}.hi").cast("timestamp")) - F.unix_seconds(F.col(f"_s{i}.lo").cast("timestamp")))
                    / F.lit(86400)
                ),
            }
            for i, c in enumerate(names)
        ],
    )


def _best_value(column: str = "column") -> Column:
    """Most frequent value of a cell frame, smallest on ties, without ordering the cells."""
    return F.min_by("value", F.struct(-F.col("n"), F.col("value")))


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most common value with its share, distinct and missing counts, empty strings."""
    names = list(columns or categorical_columns(df))
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    cells = value_cells(df, names, as_type="string")
    found = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.sum("n").alias("_valid"),
        _best_value().alias("most_common_value"),
        F.max("n").alias("most_common_count"),
        F.coalesce(F.sum(F.when(F.col("value") == "", F.col("n"))), F.lit(0)).alias("empty_strings"),
    )
    listed = stack_rows(total, [{"column": F.lit(c), "_rows": F.col("_rows")} for c in names])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return listed.join(found, "column", "left").select(
        "column",
        zero("unique_count").alias("unique_count"),
        (F.col("_rows") - zero("_valid")).alias("missing_count"),
        "most_common_value",
        "most_common_count",
        percent(F.col("most_common_count"), F.col("_valid")).alias("most_common_percentage"),
        zero("empty_strings").alias("empty_strings"),
        percent(zero("empty_strings"), F.col("_valid")).alias("empty_strings_percentage"),
    )


# ---- scores ------------------------------------------------------------------------------------

def grade_of(score: Column) -> Column:
    ladder = F
    for bound, grade in fixed.GRADES:
        ladder = ladder.when(score >= bound, grade)
    return ladder.otherwise("D")


def _penalties(df: DataFrame, outlier_from: float) -> DataFrame:
    outliers = numeric_profile(df).agg(
        F.coalesce(
            F.sum(
                F.when(
                    F.col("outliers_percentage") > outlier_from,
                    F.least(F.lit(10.0), F.col("outliers_percentage") * 0.5),
                )
            ),
            F.lit(0.0),
        ).alias("_out")
    )
    gaps = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[count_if(missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)],
    )
    missing_cells = sum((F.col(f"_m{i}") for i in range(len(df.columns))), F.lit(0).cast("long"))
    base = gaps.select(
        F.coalesce(percent(missing_cells, F.col("_rows") * len(df.columns)), F.lit(0.0)).alias("_miss")
    )
    dups = duplicate_count(df).select(
        F.coalesce(percent(F.col("duplicate_rows"), F.col("row_count")), F.lit(0.0)).alias("_dup")
    )
    return beside(beside(base, dups), outliers).select(
        F.least(F.lit(30.0), F.col("_miss") * 3).alias("missing_penalty"),
        F.least(F.lit(20.0), F.col("_dup") * 4).alias("duplicate_penalty"),
        F.least(F.lit(30.0), F.col("_out")).alias("outlier_penalty"),
    )


def quality_score(df: DataFrame) -> DataFrame:
    """100 minus penalties for missing cells, duplicate rows and outliers (columns above 5 %)."""
    score = F.lit(100.0) - F.col("missing_penalty") - F.col("duplicate_penalty") - F.col("outlier_penalty")
    return _penalties(df, 5.0).select(
        F.round(score, 1).alias("score"),
        grade_of(score).alias("grade"),
        *[F.round(c, 1).alias(c) for c in ("missing_penalty", "duplicate_penalty", "outlier_penalty")],
    )


def home_quality_score(df: DataFrame) -> DataFrame:
    """Variant for the overview page: outliers count above 10 %, date or money columns kept as text
    cost 5 points each (20 at most), the result stays in 0..100."""
    texts = [c.lower() for c in string_columns(df)]
    wrong = sum(any(w in c for w in fixed.QUALITY_DATE_WORDS + fixed.MONEY_WORDS) for c in texts)
    type_penalty = float(min(20, 5 * wrong))
    score = (
        F.lit(100.0)
        - F.col("missing_penalty")
        - F.col("duplicate_penalty")
        - F.lit(type_penalty)
        - F.col("outlier_penalty")
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return _penalties(df, 10.0).select(
        bounded.alias("score"), grade_of(bounded).alias("grade"), F.lit(type_penalty).alias("type_penalty")
    )


def analysis_readiness(df: DataFrame) -> DataFrame:
    """Share of the expected business columns that are present, with a level."""
    present = [c for c in fixed.READINESS_COLUMNS if c in df.columns]
    score = 100.0 * len(present) / len(fixed.READINESS_COLUMNS)
    level = "high" if score >= 80 else "medium" if score >= 50 else "low"
    return df.sparkSession.createDataFrame(
        [(score, level, ",".join(present))], "score double, level string, present_columns string"
    )


def schema_info(df: DataFrame, samples: int = 3) -> DataFrame:
    """Type, distinct and missing counts and a few smallest distinct values per column."""
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    cells = value_cells(df, df.columns, as_type="string")
    stats = cells.groupBy("column").agg(F.count(F.lit(1)).alias("_unique"), F.sum("n").alias("_valid"))
    first = Window.partitionBy("column").orderBy("value")
    picked = (
        cells.select("column", "value", F.row_number().over(first).alias("_r"))
        .where(F.col("_r") <= samples)
        .groupBy("column")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("sample_values"))
    )
    listed = stack_rows(
        total,
        [
            {"column": F.lit(c), "data_type": F.lit(df.schema[c].dataType.simpleString()), "_rows": F.col("_rows")}
            for c in df.columns
        ],
    )
    valid = F.coalesce(F.col("_valid"), F.lit(0)).cast("long")
    return (
        listed.join(stats, "column", "left")
        .join(picked, "column", "left")
        .select(
            "column",
            "data_type",
            F.coalesce(F.col("_unique"), F.lit(0)).alias("unique_count"),
            (F.col("_rows") - valid).alias("missing_count"),
            F.coalesce(percent(F.col("_rows") - valid, F.col("_rows")), F.lit(0.0)).alias("missing_percentage"),
            "sample_values",
        )
    )


# ---- statistics tables -------------------------------------------------------------------------

def basic_stats(
    df: DataFrame, columns: Sequence[str] | None = None, percentiles: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Mean, median, min, max, std, missing, percentiles, skewness, kurtosis, CV and a normality
    flag (D'Agostino-Pearson p above 0.05) per numeric column."""
    from brightlake.functions.tails import k2_statistic

    names = list(columns or numeric_columns(df))
    marks = quantiles(df, names, [0.5, *percentiles])
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.struct(
                F.count(num(c)).alias("n"),
                F.avg(num(c)).alias("mean"),
                F.min(num(c)).alias("min"),
                F.max(num(c)).alias("max"),
                F.stddev(num(c)).alias("std"),
                sample_skew(num(c)).alias("skewness"),
                sample_kurtosis(num(c)).alias("kurtosis"),
                F.skewness(num(c)).alias("g1"),
                F.kurtosis(num(c)).alias("g2"),
            ).alias(f"_s{i}")
            for i, c in enumerate(names)
        ],
    )
    entries = []
    for i, c in enumerate(names):
        s = lambda k, i=i: F.col(f"_s{i}.{k}")
        entries.append(
            {"column": F.lit(c), "missing_count": F.col("_rows") - s("n"), "_n": s("n"), "_g1": s("g1"), "_g2": s("g2")}
            | {k: s(k) for k in ("mean", "min", "max", "std", "skewness", "kurtosis")}
            | {"cv": ratio(s("std"), s("mean"))}
        )
    renamed = marks.select(
        "column",
        F.col("q0").alias("median"),
        *[F.col(f"q{i + 1}").alias(f"p{int(p * 100)}") for i, p in enumerate(percentiles)],
    )
    # the K^2 statistic follows a chi-square law with two degrees of freedom: p = exp(-k2 / 2)
    normal = F.exp(-k2_statistic("_n", "_g1", "_g2") / 2) > 0.05
    table = stack_rows(row, entries).withColumn("is_normal", normal).drop("_n", "_g1", "_g2")
    return table.join(renamed, "column")


def _entropy_terms() -> Column:
    """Entropy in bits from counts n of a cell frame: log2(N) - sum(n log2 n) / N."""
    n = F.col("n").cast("double")
    total = F.sum(n)
    return F.log2(total) - F.try_divide(F.sum(n * F.log2(n)), total)


def entropy(df: DataFrame, column: str) -> DataFrame:
    return value_cells(df, [column], as_type="string").groupBy("column").agg(_entropy_terms().alias("entropy"))


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct count, three most frequent values, top count and share, missing, entropy."""
    names = list(columns or categorical_columns(df))
    cells = value_cells(df, names, as_type="string")
    rank = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = (
        cells.withColumn("_r", F.row_number().over(rank))
        .where("_r <= 3")
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("_r", "value"))).alias("_t"))
        .select("column", F.array_join(F.transform("_t", lambda x: x["value"]), ", ").alias("top_values"))
    )
    return (
        categorical_profile(df, names)
        .select(
            "column",
            "unique_count",
            F.col("most_common_count").alias("top_count"),
            F.round("most_common_percentage", 2).alias("top_percentage"),
            "missing_count",
        )
        .join(top, "column", "left")
        .join(cells.groupBy("column").agg(_entropy_terms().alias("entropy")), "column", "left")
    )


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """Count, moments, median, zeros, negatives, IQR fences and outliers of one column."""
    return numeric_profile(df, [column]).select(
        "column",
        "missing_count",
        "missing_percentage",
        "unique_count",
        "min",
        "max",
        "mean",
        "median",
        "std",
        "skewness",
        "kurtosis",
        "zeros_count",
        "negative_count",
        ((F.col("upper_bound") - F.col("lower_bound")) / 4.0).alias("iqr"),
        "lower_bound",
        "upper_bound",
        "outliers_count",
        "outliers_percentage",
    )


def describe_categorical(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The most frequent values, one row each, with entropy, mode and a two-values flag."""
    cells = value_cells(df, [column], as_type="string")
    whole = cells.groupBy("column").agg(
        _entropy_terms().alias("entropy"),
        (F.count(F.lit(1)) == 2).alias("is_binary"),
        _best_value().alias("mode"),
        F.max("n").alias("mode_count"),
        F.sum("n").alias("_valid"),
    )
    ranked = cells.orderBy(F.desc("n"), F.asc("value")).limit(top)
    return ranked.join(whole, "column").select(
        "column",
        F.col("value").alias("category"),
        F.col("n").alias("count"),
        "entropy",
        "is_binary",
        "mode",
        "mode_count",
        percent(F.col("mode_count"), F.col("_valid")).alias("mode_percentage"),
    )


def describe_datetime(df: DataFrame, column: str) -> DataFrame:
    """(part, value, count) for weekdays (Monday = 0) and months, with first, last and range."""
    days = df.where(col(column).isNotNull()).groupBy(F.to_date(col(column)).alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(col(column)).alias("_lo"), F.max(col(column)).alias("_hi")
    )
    ends = days.agg(F.min("_lo").alias("min_date"), F.max("_hi").alias("max_date"))
    parts = days.select(
        "_n",
        F.explode(
            F.array(
                F.struct(F.lit("weekday").alias("part"), F.weekday("_d").alias("value")),
                F.struct(F.lit("month").alias("part"), F.month("_d").alias("value")),
            )
        ).alias("_p"),
    )
    counts = parts.groupBy("_p.part", "_p.value").agg(F.sum("_n").alias("count"))
    return beside(counts, ends).withColumn("range_days", F.datediff("max_date", "min_date"))


# ---- outliers ----------------------------------------------------------------------------------

def _outlier_table(df: DataFrame, rules: dict[str, tuple[Column, float | None, float | None]], of_valid: bool) -> DataFrame:
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.struct(count_if(cond).alias("out"), F.count(num(c)).alias("n")).alias(f"_s{i}")
            for i, (c, (cond, _, _)) in enumerate(rules.items())
        ],
    )
    return stack_rows(
        row,
        [
            {
                "column": F.lit(c),
                "outlier_count": F.col(f"_s{i}.out"),
                "outlier_percentage": percent(F.col(f"_s{i}.out"), F.col(f"_s{i}.n") if of_valid else F.col("_rows")),
                "lower_bound": F.lit(lo).cast("double"),
                "upper_bound": F.lit(hi).cast("double"),
            }
            for i, (c, (_, lo, hi)) in enumerate(rules.items())
        ],
    )


def outlier_bounds(
    df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns: Sequence[str] | None = None
) -> dict[str, tuple[float, float]]:
    """Fences per column for ``iqr``, ``zscore`` or ``quantile`` (threshold in percent)."""
    names = list(columns or numeric_columns(df))
    if method == "iqr":
        marks = quantile_row(df, names, [0.25, 0.75])
        return {
            c: (a - threshold * (b - a), b + threshold * (b - a)) for c, (a, b) in marks.items() if a is not None
        }
    if method == "quantile":
        marks = quantile_row(df, names, [threshold / 100.0, 1.0 - threshold / 100.0])
        return {c: (a, b) for c, (a, b) in marks.items() if a is not None}
    if method == "zscore":
        row = df.agg(
            F.lit(1),
            *[F.struct(F.avg(num(c)).alias("m"), F.stddev_pop(num(c)).alias("s")).alias(f"_c{i}") for i, c in enumerate(names)],
        ).first()
        got = {c: row[f"_c{i}"] for i, c in enumerate(names)}
        return {
            c: (v["m"] - threshold * v["s"], v["m"] + threshold * v["s"]) for c, v in got.items() if v["s"] is not None
        }
    raise ValueError(f"unknown outlier method: {method}")


def outliers(
    df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns: Sequence[str] | None = None
) -> DataFrame:
    """Outlier count and share per column. Shares are of all rows, for ``zscore`` of valid ones."""
    rules = {
        c: ((num(c) < lo) | (num(c) > hi), lo, hi)
        for c, (lo, hi) in outlier_bounds(df, method, threshold, columns).items()
    }
    return _outlier_table(df, rules, of_valid=method == "zscore")


def outlier_rows(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """All rows of ``df`` outside the fences of ``column``."""
    found = outlier_bounds(df, method, threshold, [column])
    if column not in found:
        return df.where(F.lit(False))
    lo, hi = found[column]
    return df.where((num(column) < lo) | (num(column) > hi))


# ---- text --------------------------------------------------------------------------------------

def text_columns(df: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """Text columns with more distinct values than ``min_ratio`` of the rows."""
    names = string_columns(df)
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_distinct(short_form(df, c)).alias(f"_d{i}") for i, c in enumerate(names)]
    )
    listed = stack_rows(
        row,
        [{"column": F.lit(c), "unique_ratio": ratio(F.col(f"_d{i}"), F.col("_rows"))} for i, c in enumerate(names)],
    )
    return listed.where(F.col("unique_ratio") > min_ratio)


def text_stats(df: DataFrame, column: str) -> DataFrame:
    """Lengths, word counts, empties and digits of a text column, over whole texts."""
    text = col(column)
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    measured = df.select(
        text.alias("_t"), F.when(text.isNotNull(), F.length(text)).alias("_len"), F.when(text.isNotNull(), words).alias("_w")
    )
    marks = quantile_row(measured, ["_len", "_w"], [0.5])
    t = F.col("_t")
    digits = t.rlike(r"(?U)\d")
    n = F.count(t)
    # distinct texts are counted by their SHA-256, so whole texts never enter the shuffle
    unique = F.count_distinct(F.unhex(F.sha2(t.cast("binary"), 256)))
    return measured.agg(
        n.alias("count"),
        count_if(t.isNull()).alias("missing_count"),
        unique.alias("unique_count"),
        F.coalesce(ratio(unique, n), F.lit(0.0)).alias("unique_ratio"),
        F.min("_len").alias("min_length"),
        F.max("_len").alias("max_length"),
        F.avg("_len").alias("mean_length"),
        F.lit(marks["_len"][0]).cast("double").alias("median_length"),
        F.min("_w").alias("min_words"),
        F.max("_w").alias("max_words"),
        F.avg("_w").alias("mean_words"),
        F.lit(marks["_w"][0]).cast("double").alias("median_words"),
        count_if(t == "").alias("empty_count"),
        count_if(t.rlike(r"(?U)^\s+$")).alias("whitespace_only_count"),
        count_if(digits).alias("contains_numbers_count"),
        ratio(count_if(digits), n).alias("contains_numbers_ratio"),
    )


def word_frequencies(
    df: DataFrame,
    column: str,
    top_n: int = 20,
    min_freq: int = 2,
    language: str | None = "english",
) -> DataFrame:
    """Most frequent words of Latin and Hangul letters, lower case, stop words left out."""
    stop = {"english": fixed.ENGLISH_STOP_WORDS, "korean": fixed.KOREAN_STOP_WORDS}.get(language or "", [])
    words = df.select(
        F.explode(F.regexp_extract_all(F.lower(col(column)), F.lit(r"(?U)\b([a-zA-Z가-힣]+)\b"), F.lit(1))).alias("word")
    )
    if stop:
        words = words.where(~F.col("word").isin(*stop))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") >= min_freq)
    return counts.orderBy(F.desc("frequency"), F.asc("word")).limit(top_n)


def dominant_category(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 90.0, few_threshold: float | None = None
) -> DataFrame:
    """Columns with two or more values of which one holds more than ``threshold`` percent.

    With ``few_threshold`` the rule is instead that share among columns of two to nine values.
    """
    found = categorical_profile(df, columns)
    share = F.col("most_common_percentage")
    if few_threshold is None:
        rule = (F.col("unique_count") > 1) & (share > threshold)
    else:
        rule = F.col("unique_count").between(2, 9) & (share > few_threshold)
    return found.where(rule).select(
        "column", F.col("most_common_value").alias("category"), share.alias("percentage")
    )
