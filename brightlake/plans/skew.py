"""Joins that split hot keys, and only those.

One aggregate per side keeps counters for its heaviest keys, a heavy-hitter sketch of bounded size over all
rows. A key is hot if it holds more rows than a fair share of a shuffle partition. Its rows are dealt over
as many sub-keys as it holds such shares, and the rows of that key on the other side are copied once per
sub-key; all other rows join as usual. The result does not depend on which keys the sketch finds.

A key with few rows on either side may still give many pairs. The two sketches tell how many: a key beyond
``PAIRS`` is split on its larger side, and the join is shuffled even where one side is small enough to be sent
whole to every task, as the other side then stays in the few tasks that read it. Sub-keys stay in proportion to the
shuffle partitions, so the copies grow with the rows and not with the pairs. Where such pairs outnumber all rows,
tasks pair blocks of rows: each row streams past one block of the other side at a time and not past all of its
key, so neighbours in the result share their values and columnar files of it stay small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from brightlake.functions.columns import col

HOT_ROWS = 250_000  # a key below this is never worth splitting
MOST_KEYS = 1000  # keys beyond hold under a thousandth of the rows each
COUNTERS = 10_000
PAIRS = 1 << 21  # pairs of one key that are worth a task of their own
MOST_WAYS = 1024
WAVES = 4  # sub-keys of crowded keys for each shuffle partition,
FEWEST = 256  # and at least so many in all, for hashing to deal them evenly
BLOCK = 64  # rows that are paired at once; Spark holds the pairs of two blocks in memory
Ways = Mapping[int, int]


class Hot(dict):
    """Hash of a hot key -> number of sub-keys; ``seen``: rows of the heaviest keys, hot or not; ``rows``: all rows."""

    seen: Mapping[int, int] = {}
    rows = 0


def _number(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def comparable(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> bool:
    """Whether equal keys have equal hashes: one type on both sides, or whole numbers of any width."""
    kinds = [(left.schema[a].dataType, right.schema[b].dataType) for a, b in on]
    return all(x == y or (_number(x) and _number(y)) for x, y in kinds)


def key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.xxhash64(*[col(k).cast("long") if _number(df.schema[k].dataType) else col(k) for k in keys])


def hot_keys(df: DataFrame, key_lists: Sequence[Sequence[str]], rows: int | None = None) -> list[Ways]:
    """For each list of key columns: hash of a hot key -> number of sub-keys. One aggregate in all, which
    reads the key columns only; null keys count like any other."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = df.select(*[key_hash(df, keys).alias(f"_h{i}") for i, keys in enumerate(key_lists)])
    top = [F.expr(f"approx_top_k(_h{i}, {MOST_KEYS}, {COUNTERS})").alias(f"_t{i}") for i in range(len(key_lists))]
    found = hashed.agg(F.count(F.lit(1)).alias("_n"), *top).first()
    fair = max(HOT_ROWS if rows is None else rows, found["_n"] / parts)
    out = []
    for i in range(len(key_lists)):
        hot = Hot({r["item"]: min(parts, -int(-r["count"] // fair)) for r in found[f"_t{i}"] if r["count"] > fair})
        hot.seen = {r["item"]: r["count"] for r in found[f"_t{i}"]}
        hot.rows = found["_n"]
        out.append(hot)
    return out


def crowded(left: Ways, right: Ways, parts: int | None = None) -> tuple[Ways, Ways, int]:
    """Sub-keys of both sides with those for keys of many pairs, and how many pairs such keys give. With ``parts``
    such sub-keys are bounded by it, not by the pairs."""
    a, b = getattr(left, "seen", {}), getattr(right, "seen", {})
    pairs = {h: n * b[h] for h, n in a.items() if n * b.get(h, 0) > PAIRS}
    total = sum(pairs.values())
    fair = max(PAIRS, -(-total // max(WAVES * parts, FEWEST)) if parts else 0)
    left, right = dict(left), dict(right)
    for h, n in pairs.items():
        ways = left if a[h] >= b[h] else right
        ways[h] = max(ways.get(h, 1), min(-(-n // fair), max(a[h], b[h]), MOST_WAYS))
    return left, right, total


def many_pairs(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> bool:
    """Whether crowded keys give more pairs than both frames have rows."""
    if not comparable(left, right, on):
        return False
    a, b = hot_keys(left, [[k for k, _ in on]])[0], hot_keys(right, [[k for _, k in on]])[0]
    return crowded(a, b)[2] > a.rows + b.rows


def _ways(hashed: Column, ways: Ways) -> Column:
    """Number of sub-keys of a row, rounded up to a power of two: a few set lookups."""
    classes: dict[int, list[int]] = {}
    for h, n in ways.items():
        classes.setdefault(1 << (n - 1).bit_length(), []).append(h)
    found = F.lit(1)
    for n, hashes in sorted(classes.items()):
        found = F.when(hashed.isin(hashes), n).otherwise(found)
    return found


def _hashable(df: DataFrame) -> list[Column]:
    return [col(f.name) for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def _dealt(df: DataFrame, keys: Sequence[str], ways: Ways, name: str) -> DataFrame:
    """Each row in one sub-key of its key, by the hash of its content, so a task that runs again deals alike."""
    if not ways:
        return df.withColumn(name, F.lit(0))
    return df.withColumn(name, F.pmod(F.xxhash64(*_hashable(df), F.lit("deal")), _ways(key_hash(df, keys), ways)).cast("int"))


def _copied(df: DataFrame, keys: Sequence[str], ways: Ways, name: str) -> DataFrame:
    """Each row once per sub-key of its key."""
    if not ways:
        return df.withColumn(name, F.lit(0))
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), _ways(key_hash(df, keys), ways) - 1)))


def spread(df: DataFrame, sub_key: str) -> DataFrame:
    """One side of a join with many more pairs than rows. The sub-key is one of the join's keys: Spark widens the
    repartition to all of them and, as it was asked for by number, keeps partitions apart however few their rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sub_key)


def _blocks(df: DataFrame, keys: Sequence[str], sub_keys: Sequence[str], name: str) -> DataFrame:
    """Rows of a key and its sub-keys, without the latter, in arrays of at most ``BLOCK``.

    Structs are equal with nulls in the same places, so one serves as a null-safe key as it stands, and the one shuffle
    here is the join's, too. It is cast as the join would shuffle again for a field that is nullable on one side only.
    """
    kinds = [df.schema[k].dataType for k in [*keys, *sub_keys]]
    fields = [T.StructField(f"_{i}", T.LongType() if _number(kind) else kind) for i, kind in enumerate(kinds)]
    key = F.struct(*[col(k) for k in [*keys, *sub_keys]]).cast(T.StructType(fields)).alias(f"{name}_key")
    rows = df.select(key, F.struct(*[col(c) for c in df.columns if c not in sub_keys]).alias("_row"))
    rows = rows.repartition(WAVES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"{name}_key")
    at = F.row_number().over(Window.partitionBy(f"{name}_key").orderBy(f"{name}_key"))
    blocks = rows.withColumn("_block", F.floor((at - 1) / BLOCK)).groupBy(f"{name}_key", "_block")
    return blocks.agg(F.collect_list("_row").alias(name)).drop("_block")


def block_join(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], sub_keys: Sequence[tuple[str, str]], kind: str
) -> DataFrame:
    """Null-safe equi-join (``inner left right``) for many more pairs than rows, by blocks of rows. Which block a row is
    in changes the order of the result only."""
    a = _blocks(left, [x for x, _ in on], [x for x, _ in sub_keys], "_lrows")
    b = _blocks(right, [y for _, y in on], [y for _, y in sub_keys], "_rrows")
    joined = a.join(b.hint("merge"), F.col("_lrows_key") == F.col("_rrows_key"), kind)
    each = joined.select("_rrows", F.inline_outer("_lrows"))
    return each.select(*[col(c) for c in each.columns[1:]], F.inline_outer("_rrows"))


def split_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    kind: str,
    hot_left: Ways | None = None,
    hot_right: Ways | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Null-safe equi-join (``inner left right full``) of frames without shared column names.

    ``hot_left`` and ``hot_right`` are taken from the frames if not given. Rows without a partner are never
    copied: where the other side is hot they are found by an anti join with its distinct keys.
    Rows that are equal in every column stay in one sub-key.
    """
    lk, rk = [a for a, _ in on], [b for _, b in on]
    condition = reduce(lambda x, y: x & y, [col(a).eqNullSafe(col(b)) for a, b in on])
    if not comparable(left, right, on):
        return left.join(right, condition, kind)
    if hot_left is None:
        hot_left = hot_keys(left, [lk], rows)[0]
    if hot_right is None:
        hot_right = hot_keys(right, [rk], rows)[0]
    rows = getattr(hot_left, "rows", 0) + getattr(hot_right, "rows", 0)
    hot_left, hot_right, many = crowded(hot_left, hot_right, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not hot_left and not hot_right:
        return left.join(right, condition, kind)
    columns = [col(c) for c in left.columns + right.columns]

    def met(how: str) -> DataFrame:
        a = _copied(_dealt(left, lk, hot_left, "_la"), lk, hot_right, "_lb")
        b = _copied(_dealt(right, rk, hot_right, "_rb"), rk, hot_left, "_ra")
        same = (F.col("_la") == F.col("_ra")) & (F.col("_lb") == F.col("_rb"))
        if many > rows:
            return block_join(a, b, on, [("_la", "_ra"), ("_lb", "_rb")], how).select(*columns)
        if many:
            by = "a" if hot_left else "b"
            a, b = spread(a, f"_l{by}"), spread(b, f"_r{by}").hint("merge")
        return a.join(b, condition & same, how).select(*columns)

    def alone(side: DataFrame, keys: list[str], ways: Ways, other: DataFrame, others: list[str]) -> DataFrame:
        known = _copied(other.select(*[col(c) for c in others]).distinct(), others, ways, "_k")
        return _dealt(side, keys, ways, "_d").join(known, condition & (F.col("_d") == F.col("_k")), "left_anti").drop("_d")

    if kind == "inner" or (kind == "left" and not hot_right) or (kind == "right" and not hot_left):
        return met(kind)
    # one outer join keeps the rows of the side that is not copied; the other side's come from an anti join
    if kind == "full" and not hot_right:
        out, missing = met("left"), ["right"]
    elif kind == "full" and not hot_left:
        out, missing = met("right"), ["left"]
    else:
        out, missing = met("inner"), {"left": ["left"], "right": ["right"], "full": ["left", "right"]}[kind]
    for side in missing:
        rest = alone(left, lk, hot_left, right, rk) if side == "left" else alone(right, rk, hot_right, left, lk)
        out = out.unionByName(rest, allowMissingColumns=True)
    return out.select(*columns)
