"""Column families and null-safe numeric expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def q(name: str) -> str:
    """Quote a column name for use in ``F.col`` or an SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def _named(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _named(df, T.NumericType)


def categorical_columns(df: DataFrame) -> list[str]:
    return _named(df, T.StringType, T.BooleanType)


def string_columns(df: DataFrame) -> list[str]:
    return _named(df, T.StringType)


def datetime_columns(df: DataFrame) -> list[str]:
    return _named(df, T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def num(name: str) -> Column:
    """Column as double with NaN read as missing, the way every statistic here wants it."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null on the floating columns of ``df``."""
    floats = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns({n: F.nanvl(col(n), F.lit(None).cast(t)) for n, t in floats.items()})


def missing(df: DataFrame, name: str) -> Column:
    """True where the cell is null or NaN."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


LONG_TEXT = 64


def short_form(df: DataFrame, name: str) -> Column:
    """Stand-in for a column where only equality matters: long text as its SHA-256, so whole texts
    never enter a shuffle."""
    if df.schema[name].dataType.typeName() != "string":
        return col(name)
    return F.when(F.length(col(name)) > LONG_TEXT, F.sha2(col(name).cast("binary"), 256)).otherwise(col(name))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_if(condition: Column, value: Column) -> Column:
    """Conditional sum where the sum of nothing is 0."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where the whole is zero."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def growth(current: Column, previous: Column) -> Column:
    """Percentage change against a positive previous value, else null."""
    return F.when(previous > 0, percent(current - previous, previous))


def sample_skew(value: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant column, null below three values."""
    n = F.count(value).cast("double")
    corrected = F.try_divide(F.skewness(value) * F.sqrt(n * (n - 1.0)), n - 2.0)
    return F.when(n > 2, F.when(F.stddev_pop(value) == 0, F.lit(0.0)).otherwise(corrected))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column, null below four values."""
    n = F.count(value).cast("double")
    corrected = F.try_divide(
        (n - 1.0) * ((n + 1.0) * F.kurtosis(value) + 6.0), (n - 2.0) * (n - 3.0)
    )
    return F.when(n > 3, F.when(F.stddev_pop(value) == 0, F.lit(0.0)).otherwise(corrected))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; null where either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    n = F.count(x).cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(n > 1, F.try_divide(F.covar_pop(x, y), spread))


def beside(left: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row of ``left``, as a scalar subquery: no join.
    Without that row its columns are null."""
    one = row.select(F.struct("*").alias("_row")).scalar()
    return left.withColumn("_row", one).select(*[col(c) for c in left.columns], "_row.*")


def stack_rows(df: DataFrame, entries: Sequence[dict[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """One output row per entry and input row; all entries share the same field names."""
    structs = [F.struct(*[c.alias(k) for k, c in e.items()]) for e in entries]
    return df.select(*[col(k) for k in keep], F.explode(F.array(*structs)).alias("_e")).select(
        *[col(k) for k in keep], "_e.*"
    )


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), as_type: str = "double") -> DataFrame:
    """Tall (keep..., column, value) form with missing cells left out."""
    value = num if as_type == "double" else (lambda n: col(n).cast(as_type))
    wide = df.select(*[col(k) for k in keep], *[value(c).alias(c) for c in columns])
    tall = wide.unpivot([col(k) for k in keep], [col(c) for c in columns], "column", "value")
    return tall.where(F.col("value").isNotNull())
