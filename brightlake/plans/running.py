"""Ordered running totals and exact quantiles that no single task has to sort.

Running totals of few rows (counted) use a plain window. Beyond the bound the rows are range-partitioned on
(keys, order), each partition is summed, and the partition sums give every row its offset: the only
ordered windows left run inside one range partition.

Quantiles are found by selection in two scans: a sketch brackets every wanted rank, then the values inside
the brackets are counted one by one and those between brackets all together. Only the counts inside the
brackets, a few thousandths of the rows, are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightlake.functions.columns import col, num, unpivot
from brightlake.session import materialize, small_side

SMALL_ROWS = 2_000_000


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    rows: int | None = None,
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Add ``<v>_before`` (sum over smaller ``order``) and ``<v>_total`` within ``keys``.

    ``df`` must hold one row per (keys, order); aggregate first. ``rows`` is an upper bound of its
    row count if the caller knows one.
    """
    if rows is None:
        rows = df.count()
    if not keys:
        df, keys, added = df.withColumn("_all", F.lit(0)), ["_all"], ["_all"]
    else:
        added = []
    past = (Window.unboundedPreceding, -1)
    if rows <= small:
        by = Window.partitionBy(*[col(k) for k in keys])
        ordered = by.orderBy(col(order)).rowsBetween(*past)
        return df.withColumns(
            {f"{v}_before": F.coalesce(F.sum(col(v)).over(ordered), F.lit(0)) for v in values}
            | {f"{v}_total": F.sum(col(v)).over(by) for v in values}
        ).drop(*added)

    parts = materialize(
        df.repartitionByRange(*[col(k) for k in keys], col(order)).withColumn("_part", F.spark_partition_id())
    )
    sums = parts.groupBy(*keys, "_part").agg(*[F.sum(col(v)).alias(f"{v}_sum") for v in values])
    by = Window.partitionBy(*[col(k) for k in keys])
    offsets = sums.select(
        *keys,
        "_part",
        *[
            F.coalesce(F.sum(f"{v}_sum").over(by.orderBy("_part").rowsBetween(*past)), F.lit(0)).alias(f"{v}_off")
            for v in values
        ],
        *[F.sum(f"{v}_sum").over(by).alias(f"{v}_total") for v in values],
    )
    inside = Window.partitionBy(*[col(k) for k in keys], "_part").orderBy(col(order)).rowsBetween(*past)
    return (
        parts.join(offsets, [*keys, "_part"])
        .withColumns(
            {
                f"{v}_before": F.col(f"{v}_off") + F.coalesce(F.sum(col(v)).over(inside), F.lit(0))
                for v in values
            }
        )
        .drop("_part", *[f"{v}_off" for v in values], *added)
    )


def value_cells(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), as_type: str = "double") -> DataFrame:
    """Distinct values with their counts: (by..., column, value, n). Copies collapse map-side."""
    tall = unpivot(df, columns, by, as_type)
    for key in by:
        tall = tall.where(col(key).isNotNull())
    return tall.groupBy(*[col(k) for k in by], "column", "value").agg(F.count(F.lit(1)).alias("n"))


ACCURACY = 1000
#: Half the width of a bracket, in shares of the rows: twice the largest error of the sketch's ranks.
MARGIN = 2.0 / ACCURACY
#: Beyond this many ranks the sketch gets finer with their number, so brackets hold no larger share of the rows.
FEW_RANKS = 5


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles: (by..., column, q0, q1, ...) in the order of probs."""
    by, names = list(by), [f"q{i}" for i in range(len(probs))]
    keys = [col(k) for k in by]
    values = [f"_v{i}" for i in range(len(columns))]
    wide = df.select(*keys, *[num(c).alias(v) for c, v in zip(columns, values)])
    for key in by:
        wide = wide.where(col(key).isNotNull())
    ranks = sorted(set(map(float, probs)))
    finer = 1 if by else max(1, -(-len(ranks) // FEW_RANKS))
    accuracy, margin = ACCURACY * finer, MARGIN / finer
    brackets = _merged([(max(p - margin, 0.0), min(p + margin, 1.0)) for p in ranks])
    marks = sorted({m for bracket in brackets for m in bracket} - {0.0, 1.0})
    # of few values a bracket would be narrower than the places of two neighbours: all of them are put in order
    enough = lambda v: F.count(v) * margin >= 4
    sketches = [F.when(enough(v), F.percentile_approx(v, marks or [0.5], accuracy)).alias(f"_c{i}") for i, v in enumerate(values)]
    # a row per value: the number of its column, and the points of that column's brackets
    tall = wide.unpivot(keys, [F.col(v) for v in values], "_name", "at").where("at IS NOT NULL")
    tall = tall.select(*keys, F.substring("_name", 3, 9).cast("int").alias("_at"), "at")
    named = F.posexplode(F.array(*map(F.lit, columns))).alias("_at", "column")
    if by:
        groups = small_side(wide.groupBy(*keys).agg(*sketches))
        every = groups.select(*keys, named)
        points = groups.select(*keys, F.posexplode(F.array(*[F.col(f"_c{i}") for i in range(len(columns))])).alias("_at", "_points"))
        tall = tall.join(small_side(points), [*by, "_at"])
        point = lambda m: F.col("_points")[marks.index(m)]
    else:
        found, every = wide.agg(*sketches).first(), df.sparkSession.range(1).select(named)
        point = lambda m: F.array(*[F.lit(x[marks.index(m)] if x else None).cast("double") for x in found])[F.col("_at")]
    gap = _gap(F.col("at"), [(point(lo) if lo > 0 else None, point(hi) if hi < 1 else None) for lo, hi in brackets])
    # a value inside a bracket is a cell of its own, the values of a gap are one
    cells = tall.select(*keys, "_at", "at", gap.alias("gap"))
    cells = cells.withColumn("value", F.when(F.col("gap").isNull(), F.col("at"))).groupBy(*keys, "_at", "gap", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("at")
    )
    cells = running_totals(materialize(cells), [*by, "_at"], "at", ["n"], small=small)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    missed = F.raise_error(F.lit("a quantile lies outside its bracket"))

    def at(rank):
        return F.max(F.when((first <= rank) & (rank <= last), F.when(F.col("gap").isNotNull(), missed.cast("double")).otherwise(F.col("value"))))

    picks = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("n_total") - 1)
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_w{i}")]
    # a column without values has a row of nulls
    chosen = every.join(cells.groupBy(*keys, "_at").agg(*picks), [*by, "_at"], "left")
    between = lambda i: F.col(f"_lo{i}") + F.col(f"_w{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
    return chosen.select(*keys, "column", *[between(i).alias(n) for i, n in enumerate(names)])


def _gap(x: Column, brackets: list[tuple[Column | None, Column | None]]) -> Column:
    """How many of the ascending brackets lie below ``x``; null inside one, or if the brackets have no points. ``None`` is an
    open end. Found by halving, so a value is compared with few of them."""

    def among(first: int, last: int) -> Column:
        if first == last:  # above bracket first - 1 and not above bracket first
            if first == len(brackets):
                return F.lit(first)
            low = brackets[first][0]
            return F.lit(None).cast("int") if low is None else F.when(x < low, F.lit(first))
        mid = (first + last) // 2
        high = brackets[mid][1]
        return among(first, mid) if high is None else F.when(x > high, among(mid + 1, last)).otherwise(among(first, mid))

    return among(0, len(brackets))


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Ascending brackets with those that overlap made one."""
    out: list[tuple[float, float]] = []
    for lo, hi in brackets:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def quantile_row(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles as driver values, one short list per column (bounded by the schema width)."""
    if not columns:
        return {}
    rows = quantiles(df, columns, probs).collect()
    found = {r["column"]: [r[f"q{i}"] for i in range(len(probs))] for r in rows}
    return {c: found.get(c, [None] * len(probs)) for c in columns}
