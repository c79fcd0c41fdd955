"""Exact-size, repeatable samples without sorting a whole class in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from brightlake.functions.columns import col
from brightlake.session import small_side

BUCKET_BITS = 16


def hash_order(key: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[col(k) for k in key])


def lowest_by_hash(df: DataFrame, quota: DataFrame, by: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """Per ``by`` group the ``quota.take`` rows of lowest key hash, exactly that many.

    Rows are counted in 65,536 hash buckets; whole buckets below the cut are kept by a filter and
    only the one bucket at the cut is ranked. ``key`` must identify a row.
    """
    by = list(by)
    hashed = df.withColumn("_h", hash_order(key, seed)).withColumn(
        "_b", F.shiftrightunsigned(F.col("_h"), 64 - BUCKET_BITS)
    )
    counts = hashed.groupBy(*[col(k) for k in by], "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*[col(k) for k in by]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    cut = (
        counts.join(quota, by)
        .where(F.col("_before") < F.col("take"))
        .groupBy(*[col(k) for k in by])
        .agg(
            F.max("_b").alias("_cut"),
            F.max_by("_before", "_b").alias("_kept"),
            F.max("take").alias("_take"),
        )
    )
    rows = hashed.join(small_side(cut), by)
    edge = Window.partitionBy(*[col(k) for k in by], "_b").orderBy("_h", *[col(k) for k in key])
    at_cut = (
        rows.where(F.col("_b") == F.col("_cut"))
        .withColumn("_r", F.row_number().over(edge))
        .where(F.col("_r") <= F.col("_take") - F.col("_kept"))
    )
    below = rows.where(F.col("_b") < F.col("_cut"))
    return below.select(*[col(c) for c in df.columns]).unionByName(at_cut.select(*[col(c) for c in df.columns]))
