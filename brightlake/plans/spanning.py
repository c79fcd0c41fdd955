"""Exact minimum spanning tree of the distinct points, without a distance matrix.

Points are cut into k-d boxes. Every box first builds the tree of its own points: no other edge inside
the box can be in the whole tree, and an edge is already final where one of its two parts is farther from
the box's border than the edge is long. What is left are Boruvka rounds: every component takes its least
outgoing edge. The edges still open inside boxes, or a probe into the closest foreign box, bound its length,
and only points within that bound of a box with foreign points look into it. Components are joined along the
chosen edges until one is left; each round at least halves them.

In one column the tree joins every value to the next (``Tree.chain``): no boxes and no rounds, but the order of the
values, inside range partitions and across their ends. Its components are runs of that order.

Equal lengths are ordered by the two points, which are numbered in the order of their coordinates, so the
tree does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brightlake.functions.columns import col, num
from brightlake.plans.nearest import SHARE, Boxes, _chunk_count, _per_box, _placed, build_boxes, matrix
from brightlake.plans.skew import split_join
from brightlake.session import BROADCAST_ROWS, stored

BLOCK = 2000
EDGE = "distance double, a long, b long, to long"
INSIDE = 1 - 1e-12  # an edge must be shorter than the way to the border by more than rounding


@dataclass
class Tree:
    """``points``: (id, axes..., n copies); ``edges``: (a, b, distance) with a < b; ``chain``: ids in order are the tree."""

    points: DataFrame
    edges: DataFrame
    chain: bool = False


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all rows of ``y``, the same number from either side."""
    total = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d = x[:, i, None] - y[None, :, i]
        total += d * d
    return np.sqrt(total)


def box_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree of a few thousand points in id order: (a, b, length) by rising length, then a, then b."""
    n = len(x)
    length, pair = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)
    outside = np.ones(n, bool)
    every = np.arange(n)
    a, b, d = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(n - 1)
    new = 0
    for step in range(n - 1):
        outside[new] = False
        far = _lengths(x, x[new : new + 1])[:, 0]
        name = np.minimum(every, new) * n + np.maximum(every, new)
        better = outside & ((far < length) | ((far == length) & (name < pair)))
        length[better], pair[better] = far[better], name[better]
        tied = np.flatnonzero(outside & (length == length[outside].min()))
        new = tied[pair[tied].argmin()]
        a[step], b[step], d[step] = pair[new] // n, pair[new] % n, length[new]
    order = np.lexsort((b, a, d))
    return a[order], b[order], d[order]


def settle(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first point of each point's component, whether each edge is final). ``border``: way of each point to
    the border of the box. An edge is final if it is the least one out of one of its parts: no shorter one of
    the box is open there, and nothing beyond the border can be as close."""
    parent, reach, open_edge = np.arange(n), border.copy(), np.zeros(n, bool)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    final = np.zeros(len(d), bool)
    for e in range(len(d)):
        p, q = sorted((top(a[e]), top(b[e])))
        final[e] = any(not open_edge[r] and d[e] < reach[r] * INSIDE for r in (p, q))
        if final[e]:
            parent[q] = p
            reach[p], open_edge[p] = min(reach[p], reach[q]), open_edge[p] or open_edge[q]
        else:
            open_edge[p] = open_edge[q] = True
    return np.array([top(i) for i in range(n)], np.int64), final


def _in_boxes(placed: DataFrame, axes: list[str], boxes: Boxes, whole: set[int]) -> DataFrame:
    """(kind, a, b, distance): point a and its component b (0), final edges (1), open edges (2)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, x = rows["id"].to_numpy(), rows[axes].to_numpy(float)
        border = np.zeros(len(x))
        if key[0] in whole:
            border = np.minimum(x - boxes.low[key[0]], boxes.high[key[0]] - x).min(axis=1)
        a, b, d = box_tree(x)
        root, final = settle(len(x), a, b, d, border)
        return pd.DataFrame(
            {
                "kind": np.r_[np.zeros(len(x), np.int32), np.where(final, 1, 2).astype(np.int32)],
                "a": np.r_[ids, ids[a]],
                "b": np.r_[ids[root], ids[b]],
                "distance": np.r_[np.zeros(len(x)), d],
            }
        )

    return placed.groupBy("_s", "_p").applyInPandas(run, "kind int, a long, b long, distance double")


def _look_up(df: DataFrame, key: str, table: DataFrame, on: str, few: bool) -> DataFrame:
    """Left join of ``df`` with one row per key: broadcast if they are counted and few, else hot keys are split."""
    if few:
        return df.join(F.broadcast(table), F.col(key) == F.col(on), "left")
    return split_join(df, table, [(key, on)], "left")


def _least(offers: DataFrame) -> DataFrame:
    """(root, distance, a, b, to): the least offered edge of every component."""
    return offers.groupBy("root").agg(F.min(F.struct("distance", "a", "b", "to")).alias("_e")).select("root", "_e.*")


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_joined`` for a bounded table in one task."""
    rows = pd.concat(list(batches))
    old = rows["root"].to_numpy()
    order = old.argsort()
    up = order[np.searchsorted(old, rows["to"].to_numpy(), sorter=order)]
    every = np.arange(len(old))
    up = np.where((up[up] == every) & (old < old[up]), every, up)
    while (up[up] != up).any():
        up = up[up]
    yield pd.DataFrame({"old": old, "new": old[up]})


def _joined(chosen: DataFrame, few: bool) -> DataFrame:
    """(old, new): where each component goes when all chosen edges are drawn. The edges form trees around one
    edge that both its ends chose; the smaller end of that is the name."""
    if few:
        return chosen.select("root", "to").coalesce(1).mapInPandas(_followed, "old long, new long")
    hops = chosen.select(F.col("root").alias("old"), F.col("to").alias("up"))
    back = hops.select(F.col("old").alias("_o"), F.col("up").alias("_u"))
    mutual = (F.col("_u") == F.col("old")) & (F.col("old") < F.col("up"))
    up = stored(_look_up(hops, "up", back, "_o", few).select("old", F.when(mutual, F.col("old")).otherwise(F.col("up")).alias("up")))
    while True:
        above = up.select(F.col("old").alias("_o"), F.col("up").alias("_u"))
        new = stored(_look_up(up, "up", above, "_o", few).select("old", F.col("_u").alias("up"), (F.col("_u") != F.col("up")).alias("_moved")))
        up = new.select("old", "up")
        if new.where("_moved").limit(1).count() == 0:
            return up.withColumnRenamed("up", "new")


def _renamed(df: DataFrame, columns: Sequence[str], names: DataFrame, few: bool) -> DataFrame:
    """``df`` with component names replaced; names without a row stay."""
    for c in columns:
        found = _look_up(df, c, names, "old", few)
        df = found.select(*[F.coalesce("new", x).alias(x) if x == c else col(x) for x in df.columns])
    return df


def _both_ways(edges: DataFrame) -> DataFrame:
    """Open edges (a, b, distance, ra, rb) as offers to the components at both ends."""
    ends = F.explode(F.array(F.struct(F.col("ra").alias("root"), F.col("rb").alias("to")), F.struct(F.col("rb").alias("root"), F.col("ra").alias("to"))))
    return edges.select("distance", "a", "b", ends.alias("_x")).select("_x.root", "distance", "a", "b", "_x.to")


def _outward(asking: DataFrame, axes: list[str], boxes: Boxes, pure: dict[int, int | None], chunked: set[int], nearest: bool) -> DataFrame:
    """Points (id, root, home, bound, axes) once per box to look into: boxes with foreign points within
    ``bound``, or with ``nearest`` the closest one."""
    leaves = boxes.leaves()
    numbers = np.array(leaves, np.int32)
    only = np.array([-1 if pure.get(b) is None else pure[b] for b in leaves], np.int64)  # ids are not negative
    shared = np.array([b in chunked for b in leaves])
    names = ["id", "root", *axes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                gap = boxes.nearest(matrix(b, axes), leaves)
                foreign = only[None, :] != b.column("root").to_numpy()[:, None]
                foreign &= shared[None, :] | (numbers[None, :] != b.column("home").to_numpy()[:, None])
                if nearest:
                    gap = np.where(foreign, gap, np.inf)
                    go = foreign & (np.arange(len(leaves))[None, :] == gap.argmin(axis=1)[:, None])
                else:
                    go = foreign & (gap <= b.column("bound").to_numpy()[:, None] * (1 + 1e-9))
                row, leaf = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([*b.select(names).take(pa.array(row)).columns, pa.array(numbers[leaf])], [*names, "_s"])

    kinds = ", ".join(f"`{a}` double" for a in axes)
    return asking.mapInArrow(run, f"id long, root long, {kinds}, _s int")


def _foreign(visits: DataFrame, points: DataFrame, axes: list[str], boxes: Boxes, block: int) -> DataFrame:
    """(root, distance, a, b, to): nearest point of another component for every visit of a box."""
    visits = stored(visits)
    asked = {r["_s"]: r["count"] for r in visits.groupBy("_s").count().collect()}
    if not asked:
        return visits.sparkSession.createDataFrame([], f"root long, {EDGE}")
    chunks, shares = np.ones(len(boxes.size), int), np.ones(len(boxes.size), int)
    for b in range(len(boxes.size)):
        chunks[b] = _chunk_count(boxes, b, block)
        shares[b] = max(1, -(-asked.get(b, 0) // SHARE))
    left = visits.withColumns(
        {"_p": F.explode(F.sequence(F.lit(0), _per_box(chunks) - 1)), "_g": F.pmod(F.xxhash64("id"), _per_box(shares)).cast("int"), "_side": F.lit(1)}
    )
    right = points.select("id", "root", *axes, "_s", "_p").withColumns(
        {"_g": F.explode(F.sequence(F.lit(0), _per_box(shares) - 1)), "_side": F.lit(0)}
    )
    key = ["_s", "_p", "_g"]
    both = left.unionByName(right.where(F.col("_s").isin([int(b) for b in asked]))).repartition(*key).sortWithinPartitions(*key, "_side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for b in batches:
            keys = np.column_stack([b.column(c).to_numpy() for c in [*key, "_side"]])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                part = b.slice(start, end - start)
                if tuple(keys[start, :3]) != now:
                    now, held, ready = tuple(keys[start, :3]), [], None
                ids, roots, x = part.column("id").to_numpy(), part.column("root").to_numpy(), matrix(part, axes)
                if keys[start, 3] == 0:
                    held.append((ids, roots, x))
                elif held:
                    ready = ready or tuple(np.concatenate(h) for h in zip(*held))
                    for at in range(0, len(ids), 256):
                        some = slice(at, at + 256)
                        far = np.where(roots[some, None] == ready[1][None, :], np.inf, _lengths(x[some], ready[2]))
                        best = far.argmin(axis=1)  # the first: the smallest id among equally close ones
                        least = far[np.arange(len(best)), best]
                        ok = np.isfinite(least)
                        mine, other = ids[some][ok], ready[0][best[ok]]
                        columns = [roots[some][ok], least[ok], np.minimum(mine, other), np.maximum(mine, other), ready[1][best[ok]]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["root", "distance", "a", "b", "to"])

    return both.mapInArrow(run, f"root long, {EDGE}")


def _range() -> Column:
    """Range partition of an id, from ``monotonically_increasing_id``: later partitions hold larger ids."""
    return F.shiftright("id", 33).alias("_p")


def _chain(points: DataFrame, axis: str) -> DataFrame:
    """(a, b, distance) of every value and the next. Only the ends of the range partitions meet in one window."""
    rows = points.select("id", col(axis).alias("x"), _range()).withColumn("_e", F.struct("id", "x"))
    ends = rows.groupBy("_p").agg(F.max("_e").alias("_e"))  # a row per range partition
    ends = ends.select("_p", F.lag("_e").over(Window.orderBy("_p")).alias("_l"))
    before = F.coalesce(F.lag("_e").over(Window.partitionBy("_p").orderBy("id")), F.col("_l"))
    steps = rows.join(F.broadcast(ends), "_p").select("id", "x", before.alias("_b")).where(F.col("_b").isNotNull())
    return steps.select(F.col("_b.id").alias("a"), F.col("id").alias("b"), (F.col("x") - F.col("_b.x")).alias("distance"))


def _runs(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): components of a chain. An id without an edge to the one before begins a component."""
    joined = edges.select(F.col("b").alias("_b"))
    rows = stored(ids.join(joined, F.col("id") == F.col("_b"), "left").select("id", _range(), F.when(F.col("_b").isNull(), F.col("id")).alias("_s")))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    begun = rows.groupBy("_p").agg(F.max("_s").alias("_s")).select("_p", F.max("_s").over(earlier).alias("_c"))  # a row per range partition
    own = F.max("_s").over(Window.partitionBy("_p").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return stored(rows.join(F.broadcast(begun), "_p").select("id", F.coalesce(own, F.col("_c")).alias("root")))


def spanning_tree(df: DataFrame, axes: Sequence[str], block: int = BLOCK) -> Tree:
    """Tree of the distinct points of ``df``. Rows with a missing or infinite coordinate are left out; no
    point or a single one has no edge."""
    axes = list(axes)
    if not axes:
        raise ValueError("a spanning tree needs a column")
    known = df.select(*[num(a).cast("double").alias(a) for a in axes]).dropna()
    for a in axes:
        known = known.where(F.abs(col(a)) < float("inf"))
    points = known.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))
    # numbers rise with the coordinates, however many partitions the sort has
    points = stored(points.orderBy(*axes).withColumn("id", F.monotonically_increasing_id()))
    if len(axes) == 1:
        return Tree(points, stored(_chain(points, axes[0])), chain=True)
    boxes = build_boxes(points, axes, [1] * len(axes), block)
    chunks = {b: _chunk_count(boxes, b, block) for b in boxes.leaves()}
    chunked = {b for b, c in chunks.items() if c > 1}
    per_box = _per_box(np.array([chunks.get(b, 1) for b in range(len(boxes.size))]))
    placed = stored(_placed(points, axes, boxes).withColumn("_p", F.pmod(F.xxhash64("id"), per_box).cast("int")))
    inside = stored(_in_boxes(placed, axes, boxes, set(chunks) - chunked))
    trees = [inside.where("kind = 1").select("a", "b", "distance")]
    names = inside.where("kind = 0").select(F.col("a").alias("_id"), F.col("b").alias("root"))
    state = stored(placed.join(names, F.col("id") == F.col("_id")).drop("_id"))
    ends = names.select(F.col("_id").alias("_j"), F.col("root").alias("rb"))
    edges = stored(
        inside.where("kind = 2").join(names.withColumnRenamed("root", "ra"), F.col("a") == F.col("_id")).join(ends, F.col("b") == F.col("_j"))
        .select("a", "b", "distance", "ra", "rb")
    )
    while True:
        rows = state.groupBy("_s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).collect()
        if len({r[c] for r in rows for c in ("lo", "hi")}) <= 1:
            break
        pure = {r["_s"]: r["lo"] if r["lo"] == r["hi"] else None for r in rows}
        offers = _both_ways(edges)
        known_roots = _least(offers)
        # components without an open edge of their own box: one point per box looks into the closest foreign box
        cells = state.groupBy("root", "_s").agg(F.min(F.struct("id", *axes)).alias("_e")).select("root", F.col("_s").alias("home"), "_e.*")
        blind = cells.join(known_roots.select("root"), "root", "left_anti").withColumn("bound", F.lit(0.0))
        probes = _foreign(_outward(blind, axes, boxes, pure, chunked, nearest=True), state, axes, boxes, block)
        bounds = stored(_least(offers.unionByName(probes)))
        few = bounds.count() <= BROADCAST_ROWS
        asking = _look_up(state, "root", bounds.select(F.col("root").alias("_r"), F.col("distance").alias("bound")), "_r", few)
        asking = asking.select("id", "root", F.col("_s").alias("home"), "bound", *axes)
        found = _foreign(_outward(asking, axes, boxes, pure, chunked, nearest=False), state, axes, boxes, block)
        chosen = stored(_least(bounds.unionByName(found)))
        trees.append(chosen.select("a", "b", "distance").distinct())
        new = _joined(chosen, few)
        state = stored(_renamed(state, ["root"], new, few))
        edges = stored(_renamed(edges, ["ra", "rb"], new, few).where("ra <> rb"))
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return Tree(points, out)


def _tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(old, new): smallest end of the component of every end of a bounded list of edges, in one task."""
    rows = pd.concat([pd.DataFrame({"ra": [], "rb": []}, dtype="int64"), *batches])
    ends, at = np.unique(np.r_[rows["ra"], rows["rb"]], return_inverse=True)
    parent = np.arange(len(ends))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for p, q in zip(at[: len(rows)], at[len(rows) :]):
        p, q = sorted((top(p), top(q)))
        parent[q] = p
    yield pd.DataFrame({"old": ends, "new": ends[[top(i) for i in range(len(ends))]]}).astype("int64")


def tree_parts(ids: DataFrame, edges: DataFrame, chain: bool = False) -> DataFrame:
    """(id, root): components of a forest (a, b, distance), contracted round by round along the least edges
    until the edges left are few enough for one task. What is left of a ``chain`` needs no rounds."""
    if chain:
        return _runs(ids, edges)
    state = ids.select("id", F.col("id").alias("root"))
    edges = stored(edges.select("a", "b", "distance", F.col("a").alias("ra"), F.col("b").alias("rb")))
    while edges.count() > BROADCAST_ROWS:
        chosen = stored(_least(_both_ways(edges)))
        few = chosen.count() <= BROADCAST_ROWS
        new = _joined(chosen, few)
        state = stored(_renamed(state, ["root"], new, few))
        edges = stored(_renamed(edges, ["ra", "rb"], new, few).where("ra <> rb"))
    return stored(_renamed(state, ["root"], edges.select("ra", "rb").coalesce(1).mapInPandas(_tops, "old long, new long"), True))
