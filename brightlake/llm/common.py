"""Shared pieces: whole texts, slices of Arrow batches, components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from brightlake.session import bounded_batches, stored

SLICE_BYTES = 4 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of every row; other columns go, so none can clash. Python gets them in small batches."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", *keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def key128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns, for keys that must not collide."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of ``column`` (one row at least).

    Rows stay whole; only the number of rows held as Python objects at a time is bounded.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            held += n or 0
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def summed(parts: DataFrame, dtype: str) -> DataFrame:
    """(slot, values): element-wise sums of arrays given as bytes, one per task and slot; streamed, so a slot's rows are never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, raw in zip(b.column("slot").to_pylist(), b.column("values").to_pylist()):
                x = np.frombuffer(raw, dtype)
                total[slot] = total[slot] + x if slot in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slot", "values"])

    return parts.select("slot", "values").repartition("slot").mapInArrow(run, "slot int, values binary")


def range_of(column: Column, cuts: list, low: int = 0) -> Column:
    """Number of the ascending cut points that are at most the value, by a balanced tree of CASEs."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    below = range_of(column, cuts[:mid], low)
    return F.when(column >= F.lit(cuts[mid]), range_of(column, cuts[mid + 1 :], low + mid + 1)).otherwise(below)


def cut_points(df: DataFrame, column: str) -> list:
    """Ascending values that deal the rows into about as many ranges as shuffles have partitions."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    return sorted({x for x in found or [] if x is not None})


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected links (a, b); nodes with links only.

    Every round takes the smallest root among the neighbours and then follows the root's own root, so
    chains halve; a round's table is written to the shared folder as Parquet, which computes it once. Stops when nothing changes.
    """
    links = links.select("a", "b").where("a <> b")
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    while True:
        near = (
            both.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        step = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        # hook: a root whose member saw a smaller root moves there as well
        hooks = step.groupBy(F.col("root").alias("node")).agg(F.min("next").alias("hook"))
        moved = step.join(hooks, "node", "left").select("node", "root", F.least("next", F.coalesce("hook", "next")).alias("next"))
        jump = moved.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = stored(moved.join(jump, "next", "left").select("node", F.col("root").alias("was"), F.least("next", F.coalesce("far", "next")).alias("root")), "roots")
        changed = after.where("root <> was").limit(1).count()
        roots = after.select("node", "root")
        if not changed:
            return roots
