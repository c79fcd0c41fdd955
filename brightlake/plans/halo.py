"""Halo partitions: ordered windows over a long series without one task for it.

A series of up to ``LONG_ROWS`` time steps (counted) is a plain window. If any series is longer, rows are
numbered per key from the sizes of range partitions, cut into ranges of ``RANGE_ROWS`` numbers, and every
range is lent the border rows that its windows reach into. Windows then run inside (key, range), and
lent rows are dropped again. What depends on the whole series is an aggregate that is joined; running states
(last known value, cumulative sums) carry one state per range.

Frames hold one row per (key, time step), as ``series.prepare_series`` makes them. Null keys are a key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightlake.functions.columns import col
from brightlake.session import materialize, small_side

RANGE_ROWS = 1 << 15
LONG_ROWS = 1 << 18
MOST_RANGES = 20_000  # range partitions of the numbering, whatever the size
#: Columns that the long form adds: range, whether the row is the range's own, number in the series from 0, length.
RANGE, OWN, NUMBER, LENGTH = "_range", "_own", "_number", "_length"


def _cols(names: Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


def is_long(df: DataFrame, key: Sequence[str]) -> bool:
    """Whether any series has more than LONG_ROWS rows."""
    most = df.groupBy(*_cols(key)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > LONG_ROWS


def by_key(df: DataFrame, other: DataFrame, key: Sequence[str], how: str = "left") -> DataFrame:
    """Join on the key columns, where null equals null; the columns of ``other`` follow those of ``df``."""
    renamed = other.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(key)})
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & col(k).eqNullSafe(F.col(f"_key{i}"))
    return df.join(renamed, same, how).drop(*[f"_key{i}" for i in range(len(key))])


def with_whole(df: DataFrame, key: Sequence[str], stats: Mapping[str, Column], long: bool) -> DataFrame:
    """Add aggregates of every whole series: windows over short ones, else a join that splits a hot key."""
    if not long:
        return df.withColumns({n: c.over(Window.partitionBy(*_cols(key))) for n, c in stats.items()})
    found = df.groupBy(*_cols(key)).agg(*[c.alias(n) for n, c in stats.items()])
    return by_key(df, small_side(found), key)


def numbered(df: DataFrame, key: Sequence[str], ts: str, long: bool) -> DataFrame:
    """Add the number of the row in its series, from 0, and the length of the series."""
    if not long:
        w = Window.partitionBy(*_cols(key))
        return df.withColumns({NUMBER: F.row_number().over(w.orderBy(col(ts))).cast("long") - 1, LENGTH: F.count(F.lit(1)).over(w)})
    parts = min(df.count() // RANGE_ROWS + 1, MOST_RANGES)
    dealt = materialize(df.repartitionByRange(parts, *_cols(key), col(ts)).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*_cols(key), "_part").agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*_cols(key))
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*_cols(key), "_part", before.alias("_before"), F.sum("_rows").over(w).alias(LENGTH))
    inside = Window.partitionBy("_part", *_cols(key)).orderBy(col(ts))
    counted = dealt.withColumn(NUMBER, F.row_number().over(inside).cast("long") - 1)
    found = by_key(counted, small_side(sizes), [*key, "_part"])
    return found.withColumn(NUMBER, F.col(NUMBER) + F.col("_before")).drop("_part", "_before")


def in_ranges(df: DataFrame, key: Sequence[str], ts: str, back: int = 0, ahead: int = 0) -> DataFrame:
    """Every row in its range, and in the next or previous one if it lies within ``back`` rows of the next or ``ahead`` of the previous."""
    rows = df if NUMBER in df.columns else numbered(df, key, ts, True)
    size = max(RANGE_ROWS, back, ahead)
    own, place = F.floor(F.col(NUMBER) / size).cast("long"), F.col(NUMBER) % size
    if not back and not ahead:
        return rows.withColumns({RANGE: own, OWN: F.lit(True)})
    at = F.array_compact(F.array(own, F.when(place >= size - back, own + 1), F.when((place < ahead) & (own > 0), own - 1)))
    lent = rows.withColumn(RANGE, F.explode(at))
    return lent.withColumn(OWN, F.col(RANGE) == own)


def windowed(
    df: DataFrame, key: Sequence[str], ts: str, back: int, ahead: int, add: Callable[[DataFrame, list[str]], DataFrame], long: bool
) -> DataFrame:
    """``add(rows, keys)`` adds columns by windows over ``keys`` that reach ``back`` rows back and ``ahead`` on."""
    if not long:
        return add(df, list(key))
    had = NUMBER in df.columns
    out = add(in_ranges(df, key, ts, back, ahead), [*key, RANGE]).where(OWN)
    return out.drop(RANGE, OWN) if had else out.drop(RANGE, OWN, NUMBER, LENGTH)


def carried(df: DataFrame, key: Sequence[str], ts: str, states: Mapping[str, tuple[Column, str]], forward: bool = True) -> DataFrame:
    """Add a running state per entry: {name: (column, "last" known value or "sum")} up to the row in time order, or from it on.

    Inside a range it is a plain window; a range hands on one state, its last known value or its sum.
    """
    ranged = in_ranges(df, key, ts)
    made = ranged.withColumns({f"_in_{n}": c for n, (c, _) in states.items()})
    order = F.col(NUMBER) if forward else -F.col(NUMBER)
    inside = Window.partitionBy(*_cols(key), RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.col(RANGE) if forward else -F.col(RANGE)
    earlier = Window.partitionBy(*_cols(key)).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    ends, before, both = [], [], {}
    for n, (_, kind) in states.items():
        x = F.col(f"_in_{n}")
        if kind == "sum":
            ends.append(F.sum(x).alias(f"_end_{n}"))
            before.append(F.sum(f"_end_{n}").over(earlier).alias(f"_from_{n}"))
            own = F.sum(x).over(inside)
            both[n] = F.when(own.isNotNull() | F.col(f"_from_{n}").isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(F.col(f"_from_{n}"), F.lit(0)))
        else:
            ends.append(F.max_by(x, F.when(x.isNotNull(), order)).alias(f"_end_{n}"))
            before.append(F.last(f"_end_{n}", True).over(earlier).alias(f"_from_{n}"))
            both[n] = F.coalesce(F.last(x, True).over(inside), F.col(f"_from_{n}"))
    table = made.groupBy(*_cols(key), RANGE).agg(*ends)
    table = table.select(*_cols(key), RANGE, *before)
    joined = by_key(made, small_side(table), [*key, RANGE])
    spare = [f"{p}{n}" for n in states for p in ("_in_", "_from_")]
    return joined.withColumns(both).drop(*spare, RANGE, OWN)


def drop_numbers(df: DataFrame) -> DataFrame:
    return df.drop(NUMBER, LENGTH)
