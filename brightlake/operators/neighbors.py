"""Operators built on exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from brightlake.functions.columns import col, is_numeric, num, numeric_columns
from brightlake.operators.encode import MIN_IMBALANCE, class_sizes
from brightlake.operators.reduce import scaled_columns
from brightlake.plans.nearest import BLOCK, k_nearest
from brightlake.plans.running import running_totals
from brightlake.plans.sampling import hash_order, lowest_by_hash
from brightlake.session import materialize


def impute_knn(
    df: DataFrame, columns: Sequence[str] | None = None, features: Sequence[str] | None = None, k: int = 5, block: int = BLOCK
) -> DataFrame:
    """Mean of the k nearest rows that have the value; distances over all numeric columns, missing
    coordinates scaled out. A row without any comparable neighbour takes the column mean.

    Rows with equal features have equal neighbours, so only distinct incomplete rows are searched.
    """
    feats = list(features or numeric_columns(df))
    names = [c for c in (columns or feats) if c in feats and is_numeric(df, c)]
    axes = [f"_a{i}" for i in range(len(feats))]
    base = df.withColumns({a: num(c) for a, c in zip(axes, feats)})
    out = base
    for c in names:
        target = axes[feats.index(c)]
        holes = materialize(base.where(F.col(target).isNull()).select(*axes).distinct().withColumn("qid", F.monotonically_increasing_id()))
        if holes.limit(1).count() == 0:
            continue
        donors = base.where(F.col(target).isNotNull()).select(*axes, F.col(target).alias("value"))
        # the target axis is missing in every query, so it never enters a distance
        found = k_nearest(holes, donors, axes, k, block=block).groupBy("qid").agg(F.avg("value").alias("_fill"))
        mean = donors.agg(F.avg("value").alias("m")).first()["m"]
        filled = materialize(
            holes.join(found, "qid", "left").select("_fill", *[F.col(a).alias(f"{a}_q") for a in axes])
        )
        match = reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(f"{a}_q")) for a in axes])
        out = out.join(filled, match, "left").drop(*[f"{a}_q" for a in axes])
        out = out.withColumn(f"_new_{c}", F.coalesce(F.col(target), F.col("_fill"), F.lit(mean).cast("double"))).drop("_fill")
    done = [c for c in names if f"_new_{c}" in out.columns]
    return out.withColumns({c: F.col(f"_new_{c}") for c in done}).select(*[col(c) for c in df.columns])


def smote(
    df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None = None, k: int = 5, seed: int = 42, block: int = BLOCK
) -> DataFrame:
    """(features..., target, synthetic): every class raised to the largest one by points on the line
    between a row and one of its k nearest rows of the same class; unchanged below a ratio of 1.5."""
    feats = list(features or [c for c in numeric_columns(df) if c not in (target, *key)])
    rows = df.select(*[col(c) for c in key], *[num(c).alias(c) for c in feats], col(target)).dropna()
    plain = rows.select(*[col(c) for c in feats], col(target), F.lit(False).alias("synthetic"))
    sizes = {r[target]: r["n"] for r in class_sizes(rows, target).collect()}
    high = max(sizes.values(), default=0)
    if not sizes or high / min(sizes.values()) < MIN_IMBALANCE:
        return plain
    out = plain
    for label, n in sorted(sizes.items(), key=lambda s: str(s[0])):
        need = high - n
        if need <= 0:
            continue
        mine = materialize(rows.where(col(target) == label).withColumn("qid", F.monotonically_increasing_id()))
        if n == 1:  # a row alone has no neighbour: the line ends in itself
            copies = mine.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(need))))
            out = out.unionByName(copies.select(*[col(c) for c in feats], col(target), F.lit(True).alias("synthetic")))
            continue
        numbered = mine.select("qid", *feats)
        near = k_nearest(numbered, numbered.withColumn("value", F.col("qid")), feats, min(k, n - 1) + 1, block=block)
        order = Window.partitionBy("qid").orderBy("rank")
        ranked = near.where("value <> qid").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(k, n - 1))
        ends = numbered.select(F.col("qid").alias("value"), *[col(c).alias(f"_n_{c}") for c in feats])
        neighbours = ranked.select("qid", "rank", "value").join(ends, "value").drop("value")
        times, rest = divmod(need, n)
        named = [*key, "qid", *feats]
        whole = mine.select(*named, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_c")) if times else None
        quota = df.sparkSession.createDataFrame([(1, rest)], "_all int, take long")
        part = lowest_by_hash(mine.withColumn("_all", F.lit(1)), quota, ["_all"], key, seed).select(*named, F.lit(0).alias("_c"))
        seeds = part if whole is None else whole.unionByName(part)
        u = F.pmod(hash_order([*key, "_c"], seed), F.lit(1_000_003))
        pick = seeds.withColumn("rank", (u % min(k, n - 1) + 1).cast("int"))
        step = F.pmod(hash_order([*key, "_c"], seed + 1), F.lit(1_000_003)) / F.lit(1_000_003.0)
        made = pick.join(neighbours, ["qid", "rank"]).select(
            *[(col(c) + step * (F.col(f"_n_{c}") - col(c))).alias(c) for c in feats],
            F.lit(label).cast(df.schema[target].dataType).alias(target),
            F.lit(True).alias("synthetic"),
        )
        out = out.unionByName(made)
    return out


def k_distances(
    df: DataFrame, k: int = 5, columns: Sequence[str] | None = None, scaler: str = "standard", block: int = BLOCK
) -> DataFrame:
    """(distance, n): distance to the k-th nearest row, itself included, with the number of rows."""
    names = list(columns or numeric_columns(df))
    axes = [f"_f_{c}" for c in names]
    points = scaled_columns(df, names, scaler).select(*axes)
    distinct = points.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))
    distinct = materialize(distinct.withColumn("qid", F.monotonically_increasing_id()))
    near = k_nearest(distinct.select("qid", *axes), points.withColumn("value", F.lit(0.0)), axes, k, block=block)
    last = near.groupBy("qid").agg(F.max("distance").alias("distance"))
    return distinct.join(last, "qid").groupBy("distance").agg(F.sum("n").alias("n"))


def k_distance_eps(
    df: DataFrame, k: int = 5, columns: Sequence[str] | None = None, scaler: str = "standard", block: int = BLOCK
) -> DataFrame:
    """(eps, median_distance, rows): the sorted k-distance curve bends most at ``eps``, the point
    farthest below the chord between its ends; a flat curve gives its median."""
    table = materialize(k_distances(df, k, columns, scaler, block))
    ends = table.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.sum("n").alias("n")).first()
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return table.agg(F.min("distance").alias("eps"), F.min("distance").alias("median_distance"), F.sum("n").alias("rows"))
    placed = running_totals(table, [], "distance", ["n"])
    along = (F.col("n_before") + F.col("n") - 1) / F.lit(float(max(ends["n"] - 1, 1)))
    up = (F.col("distance") - F.lit(ends["lo"])) / F.lit(ends["hi"] - ends["lo"])
    mid = F.lit((ends["n"] - 1) / 2.0)
    low = (F.col("n_before") <= F.floor(mid)) & (F.floor(mid) < F.col("n_before") + F.col("n"))
    high = (F.col("n_before") <= F.ceil(mid)) & (F.ceil(mid) < F.col("n_before") + F.col("n"))
    return placed.agg(
        F.max_by("distance", F.struct((along - up).alias("b"), (-F.col("distance")).alias("d"))).alias("eps"),
        ((F.max(F.when(low, F.col("distance"))) + F.max(F.when(high, F.col("distance")))) / 2).alias("median_distance"),
        F.sum("n").alias("rows"),
    )
