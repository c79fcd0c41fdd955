"""Embedding whitening on a covariance weighted by multiplicity.

Every entry c becomes the integer x = floor(1024 c) + 100000. Identical x vectors are grouped, with their number of
rows (or one: ``weights="distinct"``) as fit weight. Weighted sums give the mean, exactly; a centred weighted GEMM
per task gives the covariance, whose leading eigenvectors are the components. Each distinct vector is whitened
once; rows find their vector again by its SHA-256. Vectors that hold more than a thousandth of all rows (so a
thousand at most) are joined by broadcast, so no frequent vector is a key of the shuffle.

Rows whose vector is null, or holds null or non-finite entries, are left out; so are empty vectors, vectors of
another length than the most rows have (ties: the shorter) and entries whose x does not fit a long. Null and
repeated ids stay, a row each. ``deviation`` is computed in integers; it is null where it exceeds a long. Components
whose eigenvalue is zero within rounding (below 1e-14 of the largest) have no direction and are left out, so one
vector, or only equal ones, gives no rows; so does an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from brightlake.llm.common import summed
from brightlake.session import stored

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
HEAVY = 1000  # a vector with more than 1 / HEAVY of the rows is joined by broadcast
BATCH = 4096
_LONG = (1 << 63) - 1


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers of the usable vectors and their x; vectors of equal length are computed together."""
    sizes = np.array(pc.fill_null(pc.list_value_length(vectors), 0).to_pylist(), np.int64)
    flat = pc.list_flatten(vectors).cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * SCALE)
    good = np.isfinite(scaled) & (np.abs(scaled) < 2.0**62)
    x = np.where(good, scaled, 0).astype(np.int64) + SHIFT
    start = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~good)])
    rows = np.flatnonzero((sizes > 0) & (bad[start + sizes] == bad[start]))
    return rows, [x[start[i] : start[i] + sizes[i]] for i in rows.tolist()]


def vectors_of(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(x) of every usable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                _, x = whole_numbers(batch.column(0).slice(at, BATCH))
                yield pa.RecordBatch.from_arrays([_lists(x, pa.int64())], ["x"])

    return rows.select(vector).mapInArrow(run, "x array<long>")


def keys_of(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """(row_id, key) of every usable row: the digest of its x."""
    schema = T.StructType([T.StructField(row_id, rows.schema[row_id].dataType), T.StructField("key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                b = batch.slice(at, BATCH)
                own, x = whole_numbers(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array([_key(v) for v in x], pa.binary())], schema.names)

    return rows.select(row_id, vector).mapInArrow(run, schema)


def _key(x: np.ndarray) -> bytes:
    return sha256(x.astype("<i8").tobytes()).digest()


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices of x with their weights."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            b = batch.slice(at, BATCH)
            if b.num_rows:
                yield b.column("x").flatten().to_numpy().reshape(b.num_rows, -1), b.column("weight").to_numpy()


def distinct_vectors(rows: DataFrame, vector: str = "embedding", weights: str = "rows") -> DataFrame:
    """(x, n, weight): every distinct vector of the usual length, its rows and its fit weight; stored."""
    groups = stored(vectors_of(rows, vector).groupBy("x").agg(F.count(F.lit(1)).alias("n")), "vectors")
    usual = groups.groupBy(F.size("x").alias("size")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "size").first()
    weight = F.col("n") if weights == "rows" else F.lit(1).cast("long")
    return groups.where(F.size("x") == (usual["size"] if usual else 0)).withColumn("weight", weight)


@dataclass
class Whitening:
    """Weight of the fit list, exact sums, components as rows, their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def fit(groups: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors; None without any."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for x, w in _blocks(batches):
            small = float(np.abs(x).max()) * float(w.sum()) < 2.0**62
            part = (w @ x).tolist() if small else [sum(int(a) * int(c) for a, c in zip(column, w)) for column in x.T]
            part = [int(w.sum()), *part]
            total = [a + c for a, c in zip(total, part)] if total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))], ["slot", "total"])

    found = groups.select("x", "weight").mapInArrow(totals, "slot int, total decimal(38,0)").groupBy("slot").agg(F.sum("total").alias("total"))
    got = [int(r["total"]) for r in found.orderBy("slot").collect()]  # a number per dimension
    if not got:
        return None
    n, sums = got[0], got[1:]
    mean = np.array([s / n for s in sums])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for x, w in _blocks(batches):
            centred = x - mean
            total += (centred * w[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(len(mean)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["slot", "values"])

    parts = summed(groups.select("x", "weight").mapInArrow(products, "slot int, values binary"), "<f8")
    rows = {r["slot"]: np.frombuffer(r["values"], "<f8") for r in parts.collect()}  # the covariance: dimensions squared
    v = np.array([rows[i] for i in range(len(mean))]) / n
    v = (v + v.T) / 2
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    order = order[e[order] > 1e-14 * max(e[-1], 0)]
    axes = u[:, order].T
    # either sign will do; the largest entry of each is made positive so that equal fits give equal rows
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None] if len(axes) else 1
    return Whitening(n, sums, axes, e[order], e[order] / np.trace(v) if len(order) else e[order])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 in integers; None beyond a long."""
    reach = n * float(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if reach < 2.0**62:
        gap = x * n - np.array(sums, np.int64)
        if float(np.abs(gap).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (gap * gap).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [v if v <= _LONG else None for v in exact]


def whitened(groups: DataFrame, by: Whitening) -> DataFrame:
    """(key, n, weight, deviation, whitened) of every distinct vector."""
    fraction = np.array([s / by.n for s in by.sums])
    project = by.axes.T / np.sqrt(by.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                out = (x - fraction) @ project
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_key(v) for v in x], pa.binary()), part.column("n"), part.column("weight"), pa.array(deviations(x, by.n, by.sums), pa.int64()), _lists(list(out), pa.float64())],
                    ["key", "n", "weight", "deviation", "whitened"],
                )

    return groups.select("x", "n", "weight").mapInArrow(run, "key binary, n long, weight long, deviation long, whitened array<double>")


def identity_error(table: DataFrame, n: int, size: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    at = lambda i: F.element_at("whitened", i + 1)
    means = table.agg(*[(F.sum(F.col("weight") * at(i)) / n).alias(f"m{i}") for i in range(size)]).first()
    cells = [(i, j) for i in range(size) for j in range(i + 1)]
    row = table.agg(*[F.sum(F.col("weight") * (at(i) - means[i]) * (at(j) - means[j])).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(c / n - (i == j)) for (i, j), c in zip(cells, row))


def whiten(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS, weights: str = "rows") -> DataFrame:
    """(row_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    names = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    groups = distinct_vectors(rows, vector, weights)
    by = fit(groups, components)
    if by is None or not len(by.values):
        empty = rows.where("false").select(row_id)
        return empty.select(row_id, *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in names.split(", "))])
    table = stored(whitened(groups, by), "whitened")
    error = identity_error(table, by.n, len(by.values))
    heavy = table.where(F.col("n") * HEAVY > table.agg(F.sum("n")).first()[0]).select("key", "deviation", "whitened")
    keyed = keys_of(rows, vector, row_id)
    found = keyed.join(F.broadcast(heavy), "key").unionByName(
        keyed.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(table.join(F.broadcast(heavy.select("key")), "key", "left_anti").select("key", "deviation", "whitened"), "key")
    )
    shares = F.array(*[F.lit(float(s)) for s in by.shares])
    each = found.select(row_id, "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        row_id, (F.col("at") + 1).cast("int").alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
