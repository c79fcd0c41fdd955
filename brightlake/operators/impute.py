"""Missing-value treatment. Statistics come from one aggregate, replacement is one ``select``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from brightlake.functions.columns import (
    col,
    count_if,
    datetime_columns,
    is_numeric,
    missing,
    nan_to_null,
    num,
    numeric_columns,
    sample_skew,
    string_columns,
)
from brightlake.plans import halo
from brightlake.plans.running import quantile_row


def _fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace missing cells by literals; integer columns widen when the literal has a fraction."""
    new: dict[str, Column] = {}
    for c, v in values.items():
        if v is None:
            continue
        kind = df.schema[c].dataType
        if isinstance(v, float) and not isinstance(kind, (T.FloatType, T.DoubleType)):
            kind = T.LongType() if v.is_integer() else T.DoubleType()
            v = int(v) if v.is_integer() else v
        new[c] = F.coalesce(
            F.when(~missing(df, c), col(c).cast(kind) if isinstance(df.schema[c].dataType, T.NumericType) else col(c)),
            F.lit(v).cast(kind),
        )
    return df.withColumns(new)


def with_gaps(df: DataFrame, columns: Sequence[str], at_most: float = 1.0) -> list[str]:
    """Columns with missing cells, up to a share; only these need a statistic and a rewrite."""
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[count_if(missing(df, c)).alias(f"_c{i}") for i, c in enumerate(columns)]
    ).first()
    return [c for i, c in enumerate(columns) if 0 < row[f"_c{i}"] <= at_most * row["_rows"]]


def _numbers(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return with_gaps(df, [c for c in (columns or numeric_columns(df)) if is_numeric(df, c)])


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantile_row(df, columns, [0.5]).items()}


def impute_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _fill(df, medians(df, _numbers(df, columns)))


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = _numbers(df, columns)
    row = df.agg(F.lit(1), *[F.avg(num(c)).alias(f"_c{i}") for i, c in enumerate(names)]).first()
    return _fill(df, {c: row[f"_c{i}"] for i, c in enumerate(names)})


def impute_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _fill(df, {c: 0.0 for c in _numbers(df, columns)})


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, smallest on ties, in one job for all columns.

    Each row gives a cell per column, which keeps its type in a field of its own. Cells are counted with a
    shuffle and the best one is picked by an aggregate, so a column with very many distinct values needs
    no large buffer.
    """
    if not columns:
        return {}
    fields = [f"v{i}" for i in range(len(columns))]
    known = df.select(*[F.when(~missing(df, c), col(c)).alias(v) for c, v in zip(columns, fields)])
    cells = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(fields) - 1))).alias("at"))
    own = [F.when(F.col("at") == i, F.col(v)).alias(v) for i, v in enumerate(fields)]
    counts = cells.select("at", *own).groupBy("at", *fields).agg(F.count(F.lit(1)).alias("n"))
    best = [F.min_by(v, F.when(F.col(v).isNotNull(), F.struct(-F.col("n"), F.col(v)))).alias(v) for v in fields]
    row = counts.agg(*best).first()
    return {c: row[v] for c, v in zip(columns, fields)}


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mode of any column type; text without any value becomes 'Unknown'."""
    names = with_gaps(df, list(columns or df.columns))
    texts = set(string_columns(df))
    return _fill(df, {c: ("Unknown" if v is None and c in texts else v) for c, v in modes(df, names).items()})


def impute_auto(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Skewed numbers take the median, other numbers the mean, text the mode or 'Unknown'.

    Date columns keep their gaps here: they need an order, see ``interpolate_time`` and ``ffill``.
    """
    names = with_gaps(df, [c for c in (columns or df.columns) if c not in datetime_columns(df)])
    numbers = [c for c in names if is_numeric(df, c)]
    row = df.agg(
        F.lit(1),
        *[F.avg(num(c)).alias(f"_m{i}") for i, c in enumerate(numbers)],
        *[sample_skew(num(c)).alias(f"_s{i}") for i, c in enumerate(numbers)],
    ).first()
    skewed = [c for i, c in enumerate(numbers) if abs(row[f"_s{i}"] or 0.0) > 1]
    values: dict[str, object] = {c: row[f"_m{i}"] for i, c in enumerate(numbers) if c not in skewed}
    values |= medians(df, skewed)
    texts = set(string_columns(df))
    others = [c for c in names if c not in numbers]
    values |= {c: ("Unknown" if v is None and c in texts else v) for c, v in modes(df, others).items()}
    return _fill(df, values)


def impute_smart(df: DataFrame) -> DataFrame:
    """``impute_auto`` on every column with gaps, leaving columns over 80 % missing as they are."""
    names = with_gaps(df, df.columns, at_most=0.8)
    return impute_auto(df, names) if names else df


STRATEGIES = {
    "auto": impute_auto,
    "median": impute_median,
    "mean": impute_mean,
    "zero": impute_zero,
    "mode": impute_mode,
}


def impute_by_column(df: DataFrame, plan: Mapping[str, str]) -> DataFrame:
    """One strategy per column; columns that do not exist are ignored."""
    for strategy in dict.fromkeys(plan.values()):
        names = [c for c, s in plan.items() if s == strategy and c in df.columns]
        if strategy == "knn":
            from brightlake.operators.neighbors import impute_knn

            df = impute_knn(df, names)
        elif strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {strategy}")
        elif strategy in ("median", "mean", "zero"):
            names = [c for c in names if is_numeric(df, c)]
            df = STRATEGIES[strategy](df, names) if names else df
        elif names:
            df = STRATEGIES[strategy](df, names)
    return df


# ---- ordered fills, per series -----------------------------------------------------------------
# ``df`` holds one row per (key, time step): series.prepare_series collapses raw rows first. A long
# series is cut into ranges, and each range hands its last known value on.

def _nearest(df: DataFrame, key: Sequence[str], ts: str, known: Mapping[str, Column], forward: bool, long: bool) -> DataFrame:
    """Add per entry the last known value up to each row, or the first one from it on."""
    if long:
        return halo.carried(df, key, ts, {n: (c, "last") for n, c in known.items()}, forward)
    # looking ahead is looking back in falling time: a frame up to the last row would be read anew for every row
    w = Window.partitionBy(*[col(k) for k in key]).orderBy(col(ts) if forward else col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.last(c, True).over(w) for n, c in known.items()})


def _filled(df: DataFrame, key: Sequence[str], ts: str, columns: Sequence[str], forward: bool) -> DataFrame:
    df, names = nan_to_null(df), [f"_near{i}" for i in range(len(columns))]
    found = _nearest(df, key, ts, {n: col(c) for n, c in zip(names, columns)}, forward, halo.is_long(df, key))
    near = dict(zip(columns, names))
    return found.select(*[(col(near[c]) if c in near else col(c)).alias(c) for c in df.columns])


def ffill(df: DataFrame, key: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """Carry the last known value forward in time."""
    return _filled(df, key, ts, columns, True)


def bfill(df: DataFrame, key: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """Carry the next known value backward in time."""
    return _filled(df, key, ts, columns, False)


def interpolate_time(df: DataFrame, key: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """Linear in time between the neighbours; after the last value it is carried forward, before
    the first one the gap stays."""
    df = nan_to_null(df)
    long = halo.is_long(df, key)
    at = F.unix_micros(col(ts).cast("timestamp")).cast("double")
    back, ahead, new = {}, {}, {}
    for i, c in enumerate(columns):
        v = num(c)
        back |= {f"_v0{i}": v, f"_t0{i}": F.when(v.isNotNull(), at)}
        ahead |= {f"_v1{i}": v, f"_t1{i}": F.when(v.isNotNull(), at)}
        v0, t0, v1, t1 = (F.col(f"_{n}{i}") for n in ("v0", "t0", "v1", "t1"))
        new[c] = F.coalesce(v, F.when(v1.isNull(), v0), v0 + (v1 - v0) * F.try_divide(at - t0, t1 - t0))
    found = _nearest(_nearest(df, key, ts, back, True, long), key, ts, ahead, False, long)
    return found.select(*[(new[c] if c in new else col(c)).alias(c) for c in df.columns])
