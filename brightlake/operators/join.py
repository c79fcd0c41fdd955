"""Merges with null-safe keys, chained joins, key discovery, summaries and set logic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from brightlake.functions.columns import col, ratio, short_form, stack_rows
from brightlake.plans.skew import Ways, block_join, hot_keys, many_pairs, split_join, spread

SUFFIXES = {"both": ("_left", "_right"), "left": ("", "_right"), "right": ("_left", "")}
HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def key_pairs(on: str | Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    if isinstance(on, str):
        on = [on]
    return [(k, k) if isinstance(k, str) else tuple(k) for k in on]


def _salted(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str, salt: int, blocks: bool = False
) -> DataFrame:
    """Spread every key of the side that keeps its rows over ``salt`` sub-keys.

    The other side is repeated ``salt`` times, so a key that holds a third of all rows is joined by
    many tasks. The join is shuffled: a broadcast would leave the salted side in the few tasks that read it.
    Right joins swap the sides; outer joins add the unmatched right rows. ``blocks``: see ``block_join``.
    """
    condition = reduce(lambda x, y: x & y, [col(a).eqNullSafe(col(b)) for a, b in on])
    if how in ("inner", "left"):
        dealt = F.pmod(F.xxhash64(*[col(c) for c in left.columns]), F.lit(salt)).cast("int")
        a, b = left.withColumn("_sl", dealt), right.withColumn("_sr", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        if blocks:
            return block_join(a, b, on, [("_sl", "_sr")], how)
        a, b = spread(a, "_sl"), spread(b, "_sr")
        return a.join(b.hint("merge"), condition & (F.col("_sl") == F.col("_sr")), how).drop("_sl", "_sr")
    if how == "right":
        joined = _salted(right, left, [(b, a) for a, b in on], "left", salt, blocks)
        return joined.select(*[col(c) for c in left.columns + right.columns])
    matched = _salted(left, right, on, "left", salt, blocks)
    known = left.select(*[col(a) for a, _ in on]).distinct()
    return matched.unionByName(right.join(known, condition, "left_anti"), allowMissingColumns=True)


def merge(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str | tuple[str, str]],
    how: str = "inner",
    clash: str = "both",
    salt: int | None = None,
    hot: tuple[Ways | None, Ways | None] = (None, None),
) -> DataFrame:
    """Equi-join in which null keys match each other.

    Hot keys are found and split by themselves (``plans/skew.py``), for all four types and on both
    sides; ``hot`` hands over what is known of either side already.

    Keys of one name give one column, coalesced in right and outer merges; keys of different names
    are both kept. ``clash`` names the remaining shared columns: ``both`` sides suffixed, or the
    ``left`` or ``right`` side keeps the plain name. ``salt`` spreads every key over so many sub-keys instead.
    """
    pairs = key_pairs(on)
    same = [a for a, b in pairs if a == b]
    shared = (set(left.columns) & set(right.columns)) - set(same)
    ls, rs = SUFFIXES[clash]
    lname = {c: c + (ls if c in shared else "") for c in left.columns}
    rname = {c: (f"_right_key_{c}" if c in same else c + (rs if c in shared else "")) for c in right.columns}
    left, right = left.withColumnsRenamed(lname), right.withColumnsRenamed(rname)
    kind = HOW[how]
    named = [(lname[a], rname[b]) for a, b in pairs]
    if salt and salt > 1:
        joined = _salted(left, right, named, kind, salt, many_pairs(left, right, named))
    else:
        joined = split_join(left, right, named, kind, *hot)
    if how in ("right", "outer"):
        joined = joined.withColumns({k: F.coalesce(col(k), col(f"_right_key_{k}")) for k in same})
    return joined.drop(*[f"_right_key_{k}" for k in same])


def merge_chain(first: DataFrame, steps: Sequence[tuple[DataFrame, str | Sequence]], how: str = "left") -> DataFrame:
    """Merge further tables one after the other: steps of (table, keys).

    Hot keys on columns of the first table are looked for in it alone and all at once, so a step does
    not run the steps before it again.
    """
    keys = [[a for a, _ in key_pairs(on)] for _, on in steps]
    own = [i for i, names in enumerate(keys) if how in ("inner", "left") and set(names) <= set(first.columns)]
    known = dict(zip(own, hot_keys(first, [keys[i] for i in own]))) if own else {}
    for i, (other, on) in enumerate(steps):
        first = merge(first, other, on, how, hot=(known.get(i), None))
    return first


def denormalize(
    facts: DataFrame,
    dimensions: Sequence[tuple[DataFrame, str, Sequence[str]]],
) -> DataFrame:
    """Left-join the chosen columns of each (dimension, key, columns) to the facts. Hot keys of the facts'
    own columns are found in one aggregate."""
    own = [key for _, key, _ in dimensions if key in facts.columns]
    known = dict(zip(own, hot_keys(facts, [[key] for key in own]))) if own else {}
    for dim, key, columns in dimensions:
        facts = merge(facts, dim.select(col(key), *[col(c) for c in columns]), key, "left", clash="left", hot=(known.get(key), None))
    return facts


# ---- key discovery -----------------------------------------------------------------------------

def looks_like_id(name: str, words: Sequence[str] = ("id",)) -> bool:
    return any(w in name.lower() for w in words)


def common_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(left, right, column, left_ratio, right_ratio): shared columns that can serve as a key, by an
    id-like name or by more distinct values than half the rows on either side. One aggregate per
    table."""
    shared = {
        n: [c for c in t.columns if any(c in o.columns for m, o in tables.items() if m != n)] for n, t in tables.items()
    }
    shares = None
    for n, t in tables.items():
        if not shared[n]:
            continue
        row = t.agg(
            F.count(F.lit(1)).alias("_rows"), *[F.count_distinct(short_form(t, c)).alias(f"_d{i}") for i, c in enumerate(shared[n])]
        )
        part = stack_rows(
            row,
            [
                {"table": F.lit(n), "column": F.lit(c), "share": F.coalesce(ratio(F.col(f"_d{i}"), F.col("_rows")), F.lit(0.0))}
                for i, c in enumerate(shared[n])
            ],
        )
        shares = part if shares is None else shares.unionByName(part)
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (a, b, c, looks_like_id(c))
        for a, b in combinations(tables, 2)
        for c in tables[a].columns
        if c in tables[b].columns
    ]
    names = spark.createDataFrame(rows, "`left` string, `right` string, `column` string, id_like boolean")
    if shares is None:
        return names.limit(0)
    side = lambda s: shares.select(F.col("table").alias(s), "column", F.col("share").alias(f"{s}_ratio"))
    found = names.join(side("left"), ["left", "column"]).join(side("right"), ["right", "column"])
    keep = F.col("id_like") | (F.col("left_ratio") > 0.5) | (F.col("right_ratio") > 0.5)
    return found.where(keep).select("left", "right", "column", "left_ratio", "right_ratio")


def relationship_edges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(left, right, column, strength): per pair of tables the first shared id-like column, or else a
    weak edge on the first shared column."""
    rows = []
    for a, b in combinations(tables, 2):
        both = [c for c in tables[a].columns if c in tables[b].columns]
        ids = [c for c in both if looks_like_id(c)]
        if both:
            rows.append((a, b, (ids or both)[0], "id" if ids else "weak"))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "`left` string, `right` string, `column` string, strength string")


def default_join_key(left: DataFrame, right: DataFrame) -> str | None:
    """First shared column that looks like an id or key, else the first shared column."""
    both = [c for c in left.columns if c in right.columns]
    return next((c for c in both if looks_like_id(c, ("id", "key"))), both[0] if both else None)


# ---- summaries ---------------------------------------------------------------------------------

FUNCTIONS = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev}


def group_summary(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Sequence[str]]) -> DataFrame:
    """``<column>_<function>`` per key group; rows with a null key are left out."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*[col(k) for k in keys])
        .agg(*[FUNCTIONS[f](col(c)).alias(f"{c}_{f}") for c, fs in measures.items() for f in fs])
    )


def pivot_table(
    df: DataFrame, index: str, columns: str, values: str, fill: float = 0.0, max_columns: int = 1000
) -> DataFrame:
    """Cross table of sums, one column per value of ``columns``, empty cells filled.

    Sums are taken first, so what is pivoted is one row per cell.
    """
    cells = df.dropna(subset=[index, columns]).groupBy(col(index), col(columns).cast("string").alias("_c")).agg(
        F.sum(col(values)).alias("_v")
    )
    names = sorted(r["_c"] for r in cells.select("_c").distinct().limit(max_columns + 1).collect())
    if len(names) > max_columns:
        raise ValueError(f"{columns} has more than {max_columns} values; group it first")
    return cells.groupBy(col(index)).pivot("_c", names).agg(F.sum("_v")).fillna(fill, subset=names)


# ---- set logic ---------------------------------------------------------------------------------

def only_in_first(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct non-null keys of ``a`` that do not occur in ``b``."""
    keys = a.select(col(column)).where(col(column).isNotNull()).distinct()
    return keys.join(b.select(col(column)).distinct(), column, "left_anti")


def in_both(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct non-null keys that occur in both."""
    keys = a.select(col(column)).where(col(column).isNotNull()).distinct()
    return keys.join(b.select(col(column)).distinct(), column, "left_semi")


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, matched by name; columns missing somewhere are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
