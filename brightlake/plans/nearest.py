"""Exact k nearest neighbours over k-d boxes, best box first.

Points are cut into boxes of about ``block`` points: in every pass each box that is still too large is
split at the quartiles of its widest axis, and points without that coordinate go to a box of their own,
so a box also knows which coordinates its points lack. A query first meets the closest boxes that hold
k points, which bounds the distance of its k-th neighbour; it is then copied only to the other boxes
within that bound. In a box the points come first in the sort order and are held, the queries stream past
them. Points are copied only for a box that over SHARE queries visit. Pairs are never written out, and
nothing is cut off: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from brightlake.functions.columns import col
from brightlake.session import materialize

BLOCK = 4000
MAX_BOXES = 4096  # rows of the driver's table of boxes; larger boxes are dealt by hash
PASSES = 16
WAYS = 4  # parts of a box per pass
SHARE = 64_000  # queries of one box that a task answers
TASKS = 4  # per core
LEAF = 64  # points of a box that are looked at together
GROUP = 16  # queries that look at the same leaves


@dataclass
class Split:
    """Inner node: the box is cut along one axis; ``missing`` takes rows without that coordinate."""

    axis: int
    cuts: np.ndarray
    kids: list[int]
    missing: int


class Boxes:
    """Tree of boxes. Per node: bounds, axes all of whose rows lack a coordinate, and number of points."""

    def __init__(self, axes: int):
        self.splits: dict[int, Split] = {}
        self.low = [np.full(axes, -np.inf)]
        self.high = [np.full(axes, np.inf)]
        self.absent = [np.zeros(axes, bool)]
        self.size = [0]

    def split(self, box: int, axis: int, cuts: np.ndarray) -> None:
        kids = []
        ends = [self.low[box][axis], *cuts, self.high[box][axis]]
        for i in range(len(cuts) + 2):
            low, high, absent = self.low[box].copy(), self.high[box].copy(), self.absent[box].copy()
            if i <= len(cuts):
                low[axis], high[axis] = ends[i], ends[i + 1]
            else:
                absent[axis] = True
            kids.append(len(self.low))
            self.low.append(low)
            self.high.append(high)
            self.absent.append(absent)
            self.size.append(0)
        self.splits[box] = Split(axis, np.asarray(cuts, float), kids[:-1], kids[-1])

    def leaves(self) -> list[int]:
        return [b for b in range(len(self.low)) if b not in self.splits and self.size[b]]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of coordinates (NaN: missing)."""
        at = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            box, rows = todo.pop()
            s = self.splits.get(box)
            if s is None:
                at[rows] = box
                continue
            v = x[rows, s.axis]
            part = np.where(np.isnan(v), len(s.kids), np.searchsorted(s.cuts, v, side="right"))
            for i, kid in enumerate([*s.kids, s.missing]):
                if (inside := rows[part == i]).size:
                    todo.append((kid, inside))
        return at

    def nearest(self, x: np.ndarray, leaves: list[int]) -> np.ndarray:
        """Least possible distance of each query to each leaf; infinite where no coordinate is shared."""
        low, high = np.array([self.low[b] for b in leaves]), np.array([self.high[b] for b in leaves])
        there = ~np.array([self.absent[b] for b in leaves])
        known = ~np.isnan(x)
        gap = np.zeros((len(x), len(leaves)))
        for i in range(x.shape[1]):
            v = np.where(known[:, i], x[:, i], 0.0)[:, None]
            d = np.maximum(np.maximum(low[None, :, i] - v, v - high[None, :, i]), 0.0)
            gap += np.where(known[:, i, None] & there[None, :, i], d * d, 0.0)
        shared = known.astype(float) @ there.T.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, np.sqrt(gap * x.shape[1] / shared), np.inf)


def matrix(batch: pa.RecordBatch, axes: Sequence[str]) -> np.ndarray:
    """Coordinates of a batch, NaN where missing."""
    return np.column_stack([batch.column(a).to_numpy(zero_copy_only=False).astype(float) for a in axes])


def _placed(points: DataFrame, axes: list[str], boxes: Boxes) -> DataFrame:
    """Points with their box ``_s``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(boxes.find(matrix(b, axes)), pa.int32())], [*b.schema.names, "_s"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{kinds}, _s int")


def _cuts(row, axis: int) -> np.ndarray:
    """Distinct cut points above the least value; just above it where the quartiles all equal it."""
    found = np.unique([c for c in row[f"_q{axis}"] or [] if c > row[f"_l{axis}"]])
    if not len(found) and row[f"_l{axis}"] < row[f"_h{axis}"]:
        found = np.array([np.nextafter(row[f"_l{axis}"], np.inf)])
    return found


def build_boxes(points: DataFrame, axes: list[str], weights: Sequence[int], block: int) -> Boxes:
    """Split until no box holds over ``block`` points. ``weights``: on how many queries an axis is known;
    axes that no query knows are never cut. The driver sees one row per box."""
    boxes = Boxes(len(axes))
    useful = [i for i, w in enumerate(weights) if w]
    parts = [i / WAYS for i in range(1, WAYS)]
    stats = [
        s
        for i in useful
        for s in (
            F.count(axes[i]).alias(f"_c{i}"),
            F.min(axes[i]).alias(f"_l{i}"),
            F.max(axes[i]).alias(f"_h{i}"),
            F.percentile_approx(axes[i], parts, 1000).alias(f"_q{i}"),
        )
    ]
    for turn in range(PASSES + 1):
        rows = _placed(points, axes, boxes).groupBy("_s").agg(F.count(F.lit(1)).alias("_n"), *stats).collect()
        for b in range(len(boxes.size)):
            boxes.size[b] = 0
        for r in rows:
            boxes.size[r["_s"]] = r["_n"]
        room = (MAX_BOXES - len(rows)) // WAYS
        grew = False
        for r in sorted(rows, key=lambda r: -r["_n"])[: max(room, 0) if turn < PASSES else 0]:
            if r["_n"] <= block:
                break
            best = None
            for i in useful:
                c, q = r[f"_c{i}"], r[f"_q{i}"]
                if not c or (r[f"_l{i}"] == r[f"_h{i}"] and c == r["_n"]):
                    continue  # nothing to cut: no value, or one value in all rows
                wide = np.nan_to_num(np.array([q[-1] - q[0], r[f"_h{i}"] - r[f"_l{i}"]])) * weights[i]
                best = max(best or (-1.0, -1.0, 0), (float(wide[0]), float(wide[1]), i))
            if best:
                boxes.split(r["_s"], best[2], _cuts(r, best[2]))
                grew = True
        if not grew:
            return boxes
    return boxes


def _first(bound: np.ndarray, sizes: np.ndarray, k: int, turn: np.ndarray) -> np.ndarray:
    """Boxes each query meets first: the closest ones that hold k points together. Equally close boxes
    are taken in an order that starts at another box for each query, so none becomes hot."""
    n = bound.shape[1]
    # mostly one box is the closest and holds k points: only the other queries put their boxes in order
    alone = (bound == bound.min(axis=1)[:, None]).sum(axis=1) == 1
    closest = bound.argmin(axis=1)
    alone &= sizes[closest] >= k
    first = np.zeros(bound.shape, bool)
    first[np.flatnonzero(alone), closest[alone]] = True
    rest = np.flatnonzero(~alone)
    if rest.size:
        first[rest] = _in_turn(bound[rest], sizes, k, turn[rest])
    return first & np.isfinite(bound)


def _in_turn(bound: np.ndarray, sizes: np.ndarray, k: int, turn: np.ndarray) -> np.ndarray:
    """The closest boxes that hold k points, of each query's boxes in order."""
    n = bound.shape[1]
    order = (np.arange(n)[None, :] + (turn % n)[:, None]) % n
    rolled = np.take_along_axis(bound, order, axis=1)
    rank = np.take_along_axis(order, np.argsort(rolled, axis=1, kind="stable"), axis=1)
    held = sizes[rank]
    first = np.zeros(bound.shape, bool)
    np.put_along_axis(first, rank, np.cumsum(held, axis=1) - held < k, axis=1)
    return first


def _visits(queries: DataFrame, qid: str, axes: list[str], boxes: Boxes, k: int, reach: bool) -> DataFrame:
    """Queries once per box to visit: the first ones, or with ``reach`` the others within ``_r``."""
    leaves = boxes.leaves()
    numbers, sizes = np.array(leaves, np.int32), np.array([boxes.size[b] for b in leaves], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                turn = pd.util.hash_array(b.column(qid).to_numpy(zero_copy_only=False)) >> np.uint64(33)
                bound = boxes.nearest(matrix(b, axes), leaves)
                go = _first(bound, sizes, k, turn.astype(np.int64))
                if reach:
                    r = b.column("_r").to_numpy(zero_copy_only=False).astype(float)
                    go = ~go & np.isfinite(bound) & ~(bound > np.where(np.isnan(r), np.inf, r)[:, None])
                row, leaf = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([*b.select(names).take(pa.array(row)).columns, pa.array(numbers[leaf])], [*names, "_s"])

    names = [qid, *axes]
    kinds = ", ".join(f"`{n}` {queries.schema[n].dataType.simpleString()}" for n in names)
    return queries.mapInArrow(run, f"{kinds}, _s int")


def _best_of(x: np.ndarray, p: np.ndarray, known_p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and positions of the k best points, ties to the earlier point."""
    known = ~np.isnan(x)
    gap = np.zeros((len(x), len(p)))
    for i in range(p.shape[1]):
        d = x[:, i, None] - p[None, :, i]
        gap += np.nan_to_num(d * d)
    if not (known_p.all() and known.all()):
        shared = known.astype(float) @ known_p.T
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.where(shared > 0, gap * p.shape[1] / shared, np.inf)
    n = min(k, len(p))
    best = np.argpartition(gap, n - 1, axis=1)[:, :n]
    worst = np.take_along_axis(gap, best, axis=1).max(axis=1)
    for r in np.flatnonzero((gap <= worst[:, None]).sum(axis=1) > n):
        tied = np.flatnonzero(gap[r] <= worst[r])
        best[r] = tied[np.argsort(gap[r, tied], kind="stable")[:n]]
    return np.take_along_axis(gap, best, axis=1), best


class Held:
    """Points of a box, cut by halves into leaves of about LEAF, so a query is compared with the few leaves in its reach only."""

    def __init__(self, p: np.ndarray):
        self.p, self.known = p, (~np.isnan(p)).astype(float)
        self.leaves: list[np.ndarray] = []
        # bounds tell distances only where all points lack the same coordinates
        if len(p) <= 4 * LEAF or not (self.known == self.known[0]).all() or not self.known[0].any():
            return
        self.axes = np.flatnonzero(self.known[0])
        x = p[:, self.axes]
        todo = [np.arange(len(p))]
        while todo:
            rows = todo.pop()
            wide = np.ptp(x[rows], axis=0)
            if len(rows) <= LEAF or wide.max() == 0:
                self.leaves.append(np.sort(rows))
                continue
            half = len(rows) // 2
            rows = rows[np.argpartition(x[rows, wide.argmax()], half)]
            todo += [rows[:half], rows[half:]]
        self.low = np.array([x[r].min(axis=0) for r in self.leaves])
        self.high = np.array([x[r].max(axis=0) for r in self.leaves])

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Least possible squared distance of each query to each leaf, on the scale of ``_best_of``."""
        gap, shared = np.zeros((len(x), len(self.leaves))), np.zeros(len(x))
        for i, a in enumerate(self.axes):
            v = x[:, a, None]
            d = np.nan_to_num(np.maximum(np.maximum(self.low[None, :, i] - v, v - self.high[None, :, i]), 0.0))
            gap += d * d
            shared += ~np.isnan(x[:, a])
        return gap * (x.shape[1] / np.maximum(shared, 1))[:, None]

    def best(self, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of queries, squared distances, positions) of the k best points, as ``_best_of`` for all of them."""
        if not self.leaves:
            for at in range(0, len(x), 256):
                rows = np.arange(at, min(at + 256, len(x)))
                yield (rows, *_best_of(x[rows], self.p, self.known, k))
            return
        home = np.concatenate([self.bounds(x[at : at + 256]).argmin(axis=1) for at in range(0, len(x), 256)])
        order = np.argsort(home, kind="stable")
        for at in range(0, len(x), GROUP):
            rows = order[at : at + GROUP]
            some, near = x[rows], np.unique(home[rows])
            gap, _ = self._among(some, near, k)
            reach = gap.max(axis=1) * (1 + 1e-9) if gap.shape[1] >= min(k, len(self.p)) else np.full(len(rows), np.inf)
            near = np.flatnonzero((self.bounds(some) <= reach[:, None]).any(axis=0))
            yield (rows, *self._among(some, near, k))

    def _among(self, x: np.ndarray, leaves: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.sort(np.concatenate([self.leaves[i] for i in leaves]))
        gap, best = _best_of(x, self.p[at], self.known[at], k)
        return gap, at[best]


def _meet(visits: DataFrame, points: DataFrame, boxes: Boxes, qid: str, axes: list[str], value: str, k: int, block: int) -> DataFrame:
    """Top k per query and block. ``points`` carry box and chunk, ``visits`` the box."""
    asked = {r["_s"]: r["count"] for r in visits.groupBy("_s").count().collect()}
    chunks, shares = np.ones(len(boxes.size), int), np.ones(len(boxes.size), int)
    for b in range(len(boxes.size)):
        chunks[b] = _chunk_count(boxes, b, block)
        shares[b] = max(1, -(-asked.get(b, 0) // SHARE))
    many_chunks, many_shares = _per_box(chunks), _per_box(shares)
    left = visits.select(
        "_s",
        F.explode(F.sequence(F.lit(0), many_chunks - 1)).alias("_p"),
        F.pmod(F.xxhash64(F.col(qid), F.lit(1)), many_shares).cast("int").alias("_g"),
        F.lit(1).alias("_side"),
        col(qid).alias("_id"),
        F.lit(None).cast(points.schema[value].dataType).alias("_value"),
        *[col(a).alias(f"_x{i}") for i, a in enumerate(axes)],
    )
    right = points.select(
        "_s",
        "_p",
        F.explode(F.sequence(F.lit(0), many_shares - 1)).alias("_g"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(visits.schema[qid].dataType).alias("_id"),
        col(value).alias("_value"),
        *[col(a).alias(f"_x{i}") for i, a in enumerate(axes)],
    )
    key = ["_s", "_p", "_g"]
    both = left.unionByName(right).repartition(_share_out(points), *key).sortWithinPartitions(*key, "_side", "_value")
    coordinates = [f"_x{i}" for i in range(len(axes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, values, ready = None, [], [], None
        for b in batches:
            keys = np.column_stack([b.column(c).to_numpy() for c in [*key, "_side"]])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                part = b.slice(start, end - start)
                if tuple(keys[start, :3]) != now:
                    now, held, values, ready = tuple(keys[start, :3]), [], [], None
                if keys[start, 3] == 0:
                    held.append(matrix(part, coordinates))
                    values.append(part.column("_value"))
                elif held:
                    if ready is None:
                        ready = Held(np.concatenate(held)), pa.concat_arrays(values)
                    box, pv = ready
                    for rows, gap, best in box.best(matrix(part, coordinates), k):
                        keep = np.isfinite(gap)
                        row = np.repeat(rows, keep.sum(axis=1))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("_id").take(pa.array(row)), pa.array(np.sqrt(gap[keep])), pv.take(pa.array(best[keep]))], [qid, "distance", "value"]
                        )

    return both.mapInArrow(run, _shape(visits, points, qid, value))


def _share_out(df: DataFrame) -> int:
    """Tasks of a search. Its rows are narrow and its work is not: left to their bytes, they would be put into one task."""
    return TASKS * df.sparkSession.sparkContext.defaultParallelism


def _chunk_count(boxes: Boxes, box: int, block: int) -> int:
    """Parts by hash of a box that could not be cut further; boxes up to twice the block stay whole."""
    return 1 if boxes.size[box] <= 2 * block else -(-boxes.size[box] // block)


def _per_box(numbers: np.ndarray):
    """Column: the number of the row's box ``_s``, where only numbers above one are written out."""
    many = [(b, int(n)) for b, n in enumerate(numbers) if n > 1]
    if not many:
        return F.lit(1)
    table = F.create_map(*[F.lit(v) for pair in many for v in pair])
    return F.coalesce(F.try_element_at(table, F.col("_s")), F.lit(1))


def _shape(queries: DataFrame, points: DataFrame, qid: str, value: str) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"`{qid}` {kind(queries, qid)}, distance double, value {kind(points, value)}"


def _best(found: DataFrame, qid: str, k: int) -> DataFrame:
    """k smallest distances per query; Spark trims each partition to k rows per query first."""
    w = Window.partitionBy(qid).orderBy("distance", "value")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def k_nearest(
    queries: DataFrame, points: DataFrame, axes: Sequence[str], k: int, qid: str = "qid", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """(qid, distance, value, rank) of the k nearest points of every query.

    Distances use the coordinates both sides have, scaled up for the missing ones. Copies of a point
    count as often as they occur (k copies are all that can matter). Queries should be distinct.
    """
    axes = list(axes)
    spark = points.sparkSession
    collapsed = points.groupBy(*[col(a) for a in axes], col(value)).agg(F.count(F.lit(1)).alias("_n"))
    copies = collapsed.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_n"), F.lit(k).cast("long"))))).drop("_n")
    tasks = _share_out(points)
    points = materialize(copies.repartition(tasks, *[col(a) for a in axes], col(value)))
    queries = materialize(queries.select(qid, *[col(a) for a in axes]).repartition(tasks, col(qid)))
    asked = queries.agg(*[F.count(col(a)).alias(f"_c{i}") for i, a in enumerate(axes)]).first()
    boxes = build_boxes(points, axes, [asked[f"_c{i}"] for i in range(len(axes))], block)
    if not boxes.leaves():
        return spark.createDataFrame([], _shape(queries, points, qid, value) + ", rank int")
    chunks = _per_box(np.array([_chunk_count(boxes, b, block) for b in range(len(boxes.size))]))
    spread = F.pmod(F.xxhash64(*[col(a) for a in axes], col(value), F.col("_i")), chunks).cast("int")
    placed = _placed(points, axes, boxes).withColumn("_p", spread)

    home = materialize(_visits(queries, qid, axes, boxes, k, reach=False))
    found = _meet(home, placed, boxes, qid, axes, value, k, block)
    if len(boxes.leaves()) == 1:
        return _best(found, qid, k)
    near = materialize(_best(found, qid, k).drop("rank"))
    # the k-th distance so far bounds the boxes worth a visit; without k points all of them are
    reach = near.groupBy(qid).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance") * (1 + 1e-9)).alias("_r"))
    bounded = queries.join(reach, qid, "left")
    rest = materialize(_visits(bounded, qid, axes, boxes, k, reach=True))
    far = _meet(rest, placed, boxes, qid, axes, value, k, block)
    return _best(near.unionByName(far), qid, k)
