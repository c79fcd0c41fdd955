"""Scaling, categorical encoding and class rebalancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from brightlake.functions.columns import col, num, numeric_columns, string_columns
from brightlake.plans.running import quantile_row, running_totals
from brightlake.plans.sampling import lowest_by_hash
from brightlake.session import materialize, small_side


# ---- scaling -----------------------------------------------------------------------------------

def _unit(x: float | None) -> float:
    """Divisor for a constant column is 1, so it scales to 0."""
    return x if x else 1.0


def scale_parameters(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    """(centre, width) per column: a bounded set of driver values."""
    if method == "robust":
        return {
            c: (v[1], _unit(v[2] - v[0])) for c, v in quantile_row(df, columns, [0.25, 0.5, 0.75]).items() if v[1] is not None
        }
    if method == "standard":
        pair = lambda c: F.struct(F.avg(num(c)).alias("a"), F.stddev_pop(num(c)).alias("b"))
    elif method == "minmax":
        pair = lambda c: F.struct(F.min(num(c)).alias("a"), (F.max(num(c)) - F.min(num(c))).alias("b"))
    else:
        raise ValueError(f"unknown scaling method: {method}")
    row = df.agg(F.lit(1), *[pair(c).alias(f"_c{i}") for i, c in enumerate(columns)]).first()
    got = {c: row[f"_c{i}"] for i, c in enumerate(columns)}
    return {c: (v["a"], _unit(v["b"])) for c, v in got.items() if v["a"] is not None}


def scale(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or numeric_columns(df))
    found = scale_parameters(df, names, method)
    return df.withColumns({c: (num(c) - F.lit(a)) / F.lit(b) for c, (a, b) in found.items()})


def scale_standard(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / population standard deviation."""
    return scale(df, "standard", columns)


def scale_minmax(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - min) / (max - min)."""
    return scale(df, "minmax", columns)


def scale_robust(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - median) / interquartile range."""
    return scale(df, "robust", columns)


# ---- encoding ----------------------------------------------------------------------------------

def _few_values(df: DataFrame, column: str, at_most: int) -> list[str] | None:
    """Sorted distinct values, or None once there are more than ``at_most``."""
    rows = df.select(col(column).alias("v")).where("v IS NOT NULL").distinct().limit(at_most + 1).collect()
    return sorted(r["v"] for r in rows) if len(rows) <= at_most else None


def one_hot(df: DataFrame, columns: Sequence[str] | None = None, max_categories: int = 10) -> DataFrame:
    """Indicator columns ``<column>_<value>`` in place of text columns with few values."""
    for c in columns or string_columns(df):
        values = _few_values(df, c, max_categories)
        if values is None:
            continue
        df = df.withColumns({f"{c}_{v}": F.coalesce(col(c) == v, F.lit(False)).cast("int") for v in values}).drop(c)
    return df


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): rank of each distinct value in sorted order, from 0."""
    values = materialize(df.where(col(column).isNotNull()).select(col(column)).distinct().withColumn("_one", F.lit(1)))
    coded = running_totals(values, [], column, ["_one"])
    return coded.select(col(column), F.col("_one_before").cast("int").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text replaced by its rank among the sorted distinct values; null becomes -1."""
    order = df.columns
    for c in columns or string_columns(df):
        codes = category_codes(df, c)
        df = df.join(small_side(codes), c, "left").withColumn(c, F.coalesce(F.col("code"), F.lit(-1))).drop("code")
    return df.select(*[col(c) for c in order])


def frequency_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text replaced by the relative frequency of its value; null stays null."""
    order = df.columns
    for c in columns or string_columns(df):
        total = df.where(col(c).isNotNull()).count()
        counts = df.where(col(c).isNotNull()).groupBy(col(c)).agg((F.count(F.lit(1)) / F.lit(total)).alias("_f"))
        df = df.join(small_side(counts), c, "left").withColumn(c, F.col("_f")).drop("_f")
    return df.select(*[col(c) for c in order])


def binary_encode(df: DataFrame, column: str, max_categories: int = 10) -> DataFrame:
    """1-based sorted code written as bit columns, highest bit first; only above ``max_categories``."""
    codes = category_codes(df, column).withColumn("code", F.col("code") + 1)
    size = codes.count()
    if size <= max_categories:
        return df
    bits = size.bit_length()
    joined = df.join(small_side(codes), column, "left").withColumn("code", F.coalesce(F.col("code"), F.lit(0)))
    return joined.withColumns(
        {
            f"{column}_{i}": F.shiftright(F.col("code"), bits - 1 - i).bitwiseAND(F.lit(1)).cast("int")
            for i in range(bits)
        }
    ).drop("code", column)




# ---- rebalancing -------------------------------------------------------------------------------

MIN_IMBALANCE = 1.5


def class_sizes(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))


def _extremes(df: DataFrame, target: str) -> tuple[int, int]:
    row = class_sizes(df, target).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    return row["lo"] or 0, row["hi"] or 0


def undersample(df: DataFrame, target: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest one; unchanged below a ratio of 1.5."""
    low, high = _extremes(df, target)
    if low == 0 or high / low < MIN_IMBALANCE:
        return df
    quota = class_sizes(df, target).select(col(target), F.lit(low).alias("take"))
    return lowest_by_hash(df, quota, [target], key, seed)


def oversample(df: DataFrame, target: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Every class raised to the size of the largest one by repeating rows."""
    low, high = _extremes(df, target)
    if low == 0 or high / low < MIN_IMBALANCE:
        return df
    sizes = class_sizes(df, target).select(
        col(target), F.expr(f"{high} div n").alias("_times"), (F.lit(high) % F.col("n")).alias("take")
    )
    whole = df.join(small_side(sizes.drop("take")), target).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    extra = lowest_by_hash(df, sizes.where("take > 0").select(col(target), "take"), [target], key, seed)
    return whole.select(*[col(c) for c in df.columns]).unionByName(extra)
