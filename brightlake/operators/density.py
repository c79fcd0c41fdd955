"""DBSCAN on a grid, exact, in any number of dimensions.

The grid side is eps / sqrt(d), so two points of one cell are always neighbours. Hence a cell with
``min_samples`` points is dense: all its points are core and in one cluster, and none of its pairs is
ever looked at. Only points of thin cells count their neighbours, each against the cells in reach.

Up to ``OFFSET_AXES`` dimensions the cells in reach are a fixed list of offsets. Its length grows as a power of the
dimensions, so beyond that they are looked up among the occupied cells: these form a tree by halving, and pairs of
tree nodes whose bounding boxes lie within eps are followed down, from one node at the top to pairs of cells.

Clusters are components of the graph of core cells. Whether two near cells are connected is decided on
bounding boxes of ever finer sub-cells: boxes close enough prove the link, or one core point of each that are, boxes too far
apart disprove it, and only the undecided ones are split again, at last down to single points. Cells already in one
component need no further link, so their pairs are left undecided. So two crowded cells never meet point by point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from brightlake.functions.columns import col, num, numeric_columns
from brightlake.operators.reduce import scaled_columns
from brightlake.plans.running import running_totals
from brightlake.session import materialize, small_side

OFFSET_AXES = 3
LABEL = "cluster"
SPLIT = 8
LEVELS = 5
CROWDED = 4096  # distinct points of a cell that are dealt over salts


def _square(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0))


def _cells(axes: Sequence[str], side: float) -> list[Column]:
    return [F.floor(col(a) / F.lit(side)).cast("long") for a in axes]


def _offsets(d: int) -> Column:
    """Relative cells that can hold a neighbour, one literal list (25 in the plane, 117 in space)."""
    reach = math.ceil(math.sqrt(d))
    keep = [
        o for o in product(range(-reach, reach + 1), repeat=d) if sum(max(abs(x) - 1, 0) ** 2 for x in o) < d + 1e-9
    ]
    return F.array(*[F.array(*[F.lit(x).cast("long") for x in o]) for o in keep])


def _box_gap(lo: Sequence[Column], hi: Sequence[Column], olo: Sequence[Column], ohi: Sequence[Column]) -> Column:
    """Square of the least distance between points of two boxes."""
    zero = [F.lit(0.0)] * len(lo)
    return _square([F.greatest(F.lit(0.0), ol - h, l - oh) for l, h, ol, oh in zip(lo, hi, olo, ohi)], zero)


def near_cells(points: DataFrame, axes: Sequence[str], cell: Sequence[str], eps: float) -> DataFrame:
    """(cell..., _h...): every pair of occupied cells, both ways and each with itself, whose points' boxes lie within eps.

    A node of the tree is a block of 2^level cells a side. A pair of nodes is replaced by the pairs of their halves that are near
    enough, so a level holds no more pairs than are near one another, and no cell is compared with those far away.
    """
    d = range(len(axes))
    other = [f"_h{i}" for i in d]
    ends = points.agg(*[F.min(c).alias(f"l{i}") for i, c in enumerate(cell)], *[F.max(c).alias(f"h{i}") for i, c in enumerate(cell)]).first()
    if ends["l0"] is None:
        return points.select(*cell, *[F.col(c).alias(o) for c, o in zip(cell, other)])
    levels = max((ends[f"h{i}"] - ends[f"l{i}"]).bit_length() for i in d)
    # a node is named by one array, so joins have one key whatever the number of dimensions
    boxes = points.groupBy(F.array(*[F.col(c) - F.lit(ends[f"l{i}"]) for i, c in enumerate(cell)]).alias("node"))
    boxes = materialize(boxes.agg(*[F.min(col(x)).alias(f"lo{i}") for i, x in enumerate(axes)], *[F.max(col(x)).alias(f"hi{i}") for i, x in enumerate(axes)]))
    top = F.array(*[F.lit(0).cast("long") for _ in d])
    pairs = points.sparkSession.range(1).select(top.alias("a"), top.alias("b"))
    names = [f"{e}{i}" for e in ("lo", "hi") for i in d]
    gap = _box_gap(*[[F.col(f"{e}{i}") for i in d] for e in ("lo", "hi", "olo", "ohi")])
    for level in range(levels - 1, -1, -1):
        tree = boxes.groupBy(F.transform("node", lambda c: F.shiftright(c, level)).alias("node"))
        tree = tree.agg(*[F.min(f"lo{i}").alias(f"lo{i}") for i in d], *[F.max(f"hi{i}").alias(f"hi{i}") for i in d])
        up = F.transform("node", lambda c: F.shiftright(c, 1))
        left = tree.select(up.alias("a"), F.col("node").alias("x"), *names)
        right = tree.select(up.alias("b"), F.col("node").alias("y"), *[F.col(n).alias(f"o{n}") for n in names])
        once = (F.col("a") != F.col("b")) | (F.col("x") <= F.col("y"))  # of one node with itself each pair of halves once
        met = pairs.join(left, "a").join(right, "b").where(once & (gap <= eps * eps))
        pairs = materialize(met.select(F.col("x").alias("a"), F.col("y").alias("b")))
    both = pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    back = lambda side, out: [(F.col(side)[i] + F.lit(ends[f"l{i}"])).alias(o) for i, o in enumerate(out)]
    return materialize(both.select(*back("a", cell), *back("b", other)))


def _shifted(df: DataFrame, d: int, names: Sequence[str], out: Sequence[str], near: DataFrame | None = None) -> DataFrame:
    """One row per neighbouring cell, its key in ``out``: by the offsets, or by the table of near cells."""
    if near is not None:
        return df.join(near.select(*names, *[F.col(f"_h{i}").alias(o) for i, o in enumerate(out)]), list(names))
    moved = df.withColumn("_o", F.explode(_offsets(d)))
    return moved.withColumns({o: F.col(n) + F.element_at("_o", i + 1) for i, (n, o) in enumerate(zip(names, out))}).drop("_o")


def _crowded(points: DataFrame, cell: list[str], salt: int) -> DataFrame | None:
    """(cell..., _parts) of the cells whose points are spread; no table if there are none."""
    cells = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED)
    cells = small_side(cells.select(*cell, F.least(F.lit(salt), F.ceil(F.col("_n") / CROWDED)).cast("int").alias("_parts")))
    return cells if cells.limit(1).count() else None


def _asked(asks: DataFrame, near: list[str], cell: list[str], crowded: DataFrame | None) -> DataFrame:
    """Rows with a ``_salt``: one per part of the cell in ``near``."""
    if crowded is None:
        return asks.withColumn("_salt", F.lit(0))
    parts = asks.join(crowded.withColumnsRenamed(dict(zip(cell, near))), near, "left")
    return parts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def _dealt(have: DataFrame, near: list[str], axes: list[str], cell: list[str], crowded: DataFrame | None) -> DataFrame:
    """Points with the ``_salt`` of their part of their cell ``near``."""
    if crowded is None:
        return have.withColumn("_salt", F.lit(0))
    parts = have.join(crowded.withColumnsRenamed(dict(zip(cell, near))), near, "left")
    return parts.withColumn("_salt", F.pmod(F.xxhash64(*axes), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def _core_points(points: DataFrame, axes: list[str], cell: list[str], eps: float, min_samples: int, crowded: DataFrame | None, close_cells: DataFrame | None) -> DataFrame:
    """Distinct points with their weight and whether they are core."""
    d = len(axes)
    weights = points.groupBy(*cell).agg(F.sum("_n").alias("_w"))
    placed = points.join(weights, cell)
    thin = placed.where(F.col("_w") < min_samples).drop("_w")
    near = [f"_h{i}" for i in range(d)]
    asks = _asked(_shifted(thin.select(*axes, *cell), d, cell, near, close_cells), near, cell, crowded)
    asks = asks.select(*[col(a).alias(f"_p{a}") for a in axes], *near, "_salt")
    # a crowded cell is spread over salts, the thin side (under min_samples rows a cell) is repeated for it
    have = _dealt(points.select(*axes, "_n", *[F.col(c).alias(h) for c, h in zip(cell, near)]), near, axes, cell, crowded)
    close = _square([col(f"_p{a}") for a in axes], [col(a) for a in axes]) <= eps * eps
    counts = (
        asks.join(have, [*near, "_salt"])
        .where(close)
        .groupBy(*[col(f"_p{a}").alias(a) for a in axes])
        .agg(F.sum("_n").alias("_near"))
    )
    dense = placed.where(F.col("_w") >= min_samples).withColumn("core", F.lit(True)).drop("_w")
    counted = thin.join(counts, axes, "left").withColumn("core", F.coalesce(F.col("_near") >= min_samples, F.lit(False)))
    return dense.unionByName(counted.drop("_near"))


def _boxes(core: DataFrame, axes: list[str], cell: list[str], side: float, level: int) -> DataFrame:
    """Bounding boxes of the core points in the sub-cells of a level: one row per filled sub-cell."""
    fine = side / SPLIT**level
    sub = [f"_u{i}" for i in range(len(axes))]
    return (
        core.withColumns({s: c for s, c in zip(sub, _cells(axes, fine))})
        .groupBy(*cell, *sub)
        .agg(
            *[F.min(col(a)).alias(f"lo_{a}") for a in axes], *[F.max(col(a)).alias(f"hi_{a}") for a in axes],
            F.min(F.struct(*[col(a).alias(f"x{i}") for i, a in enumerate(axes)])).alias("one"),
        )
    )


def _cell_roots(core: DataFrame, names: DataFrame, axes: list[str], cell: list[str], eps: float, side: float, close_cells: DataFrame | None) -> DataFrame:
    """(id, root) of the cells in ``names``: the components of cells with at least one pair of core points within eps."""
    d = len(axes)
    other = [f"_h{i}" for i in range(d)]
    sub, osub = [f"_u{i}" for i in range(d)], [f"_v{i}" for i in range(d)]
    pair = [*cell, *other]
    roots = names.select("id", F.col("id").alias("root"))

    def joined(links: DataFrame) -> DataFrame:
        """Components with new pairs of cells: those so far stand for the pairs found before."""
        here = names.select(*cell, F.col("id").alias("a"))
        there = names.select(*[F.col(c).alias(o) for c, o in zip(cell, other)], F.col("id").alias("b"))
        new = links.join(here, cell).join(there, other).select("a", "b")
        return connected_components(names, new.unionByName(roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))))

    undecided = None  # pairs of sub-cells still open, by parent level
    for level in range(LEVELS + 1):
        boxes = materialize(_boxes(core, axes, cell, side, level))
        left = boxes
        right = boxes.select(
            *[F.col(c).alias(o) for c, o in zip(cell, other)], *[F.col(u).alias(v) for u, v in zip(sub, osub)],
            *[F.col(f"{e}_{a}").alias(f"o{e}_{a}") for e in ("lo", "hi") for a in axes], F.col("one").alias("oone"),
        )
        ahead = F.struct(*[F.col(c) for c in cell]) < F.struct(*[F.col(o) for o in other])
        if undecided is None:
            met = _shifted(left, d, cell, other, close_cells).where(ahead).join(right, other)
        else:
            up = lambda names: [F.floor(F.col(n) / F.lit(SPLIT)).cast("long") for n in names]
            parents, oparents = [f"_pu{i}" for i in range(d)], [f"_pv{i}" for i in range(d)]
            a = left.withColumns(dict(zip(parents, up(sub))))
            b = right.withColumns(dict(zip(oparents, up(osub))))
            met = undecided.join(a, [*cell, *parents]).join(b, [*other, *oparents])
        far = _square(
            [F.greatest(F.abs(F.col(f"ohi_{a}") - F.col(f"lo_{a}")), F.abs(F.col(f"hi_{a}") - F.col(f"olo_{a}"))) for a in axes],
            [F.lit(0.0)] * d,
        )
        near = _box_gap(*[[F.col(f"{e}_{a}") for a in axes] for e in ("lo", "hi", "olo", "ohi")])
        touch = _square([F.col(f"one.x{i}") for i in range(d)], [F.col(f"oone.x{i}") for i in range(d)])
        scored = met.withColumns({"_far": F.least(far, touch), "_close": near}).where(F.col("_close") <= eps * eps)
        scored = materialize(scored.select(*pair, *sub, *osub, (F.col("_far") <= eps * eps).alias("_sure")))
        roots = joined(scored.where("_sure").select(*pair).distinct())
        root = names.join(roots, "id")
        open_pairs = (
            scored.where("NOT _sure")
            .join(root.select(*cell, F.col("root").alias("_ra")), cell)
            .join(root.select(*[F.col(c).alias(o) for c, o in zip(cell, other)], F.col("root").alias("_rb")), other)
            .where("_ra <> _rb")
        )
        undecided = materialize(open_pairs.select(
            *pair,
            *[F.col(u).alias(f"_pu{i}") for i, u in enumerate(sub)],
            *[F.col(v).alias(f"_pv{i}") for i, v in enumerate(osub)],
        ))
        if undecided.limit(1).count() == 0:
            return roots
    # what is still open differs by less than side / SPLIT^LEVELS: settle it on the points
    fine = side / SPLIT**LEVELS
    a = core.withColumns(dict(zip([f"_pu{i}" for i in range(d)], _cells(axes, fine))))
    b = core.select(
        *[F.col(c).alias(o) for c, o in zip(cell, other)],
        *[c.alias(f"_pv{i}") for i, c in enumerate(_cells(axes, fine))],
        *[col(x).alias(f"o_{x}") for x in axes],
    )
    met = undecided.join(a, [*cell, *[f"_pu{i}" for i in range(d)]]).join(b, [*other, *[f"_pv{i}" for i in range(d)]])
    return joined(met.where(_square([col(x) for x in axes], [col(f"o_{x}") for x in axes]) <= eps * eps).select(*pair).distinct())


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root): smallest id of the component. ``links`` are (a, b); every round takes the smallest
    label among the neighbours and then the label of that label, so long chains shrink fast."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = materialize(nodes.select("id", F.col("id").alias("root")))
    while True:
        offered = edges.join(state, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("_m"))
        lower = state.join(offered, "id", "left").select("id", F.least(F.col("root"), F.coalesce("_m", F.col("root"))).alias("root"), F.col("root").alias("_old"))
        jump = lower.select(F.col("id").alias("root"), F.col("root").alias("_top"))
        new = materialize(
            lower.join(jump, "root", "left").select("id", F.least(F.col("root"), F.coalesce("_top", F.col("root"))).alias("root"), "_old")
        )
        state = new.select("id", "root")
        if new.where("root <> _old").limit(1).count() == 0:
            return state


def dbscan_points(df: DataFrame, axes: Sequence[str], eps: float = 0.5, min_samples: int = 5, salt: int = 8) -> DataFrame:
    """(axes..., n, core, cluster) for the distinct points of ``df``.

    Clusters are numbered from 0 by their smallest core point; noise is -1. A border point joins the
    smallest of the clusters it touches.
    """
    axes = list(axes)
    d = len(axes)
    if not d:
        raise ValueError("dbscan needs a column")
    side = eps / math.sqrt(d) * (1 - 1e-12)
    cell = [f"_g{i}" for i in range(d)]
    points = df.select(*[num(a).alias(a) for a in axes]).dropna().groupBy(*axes).agg(F.count(F.lit(1)).alias("_n"))
    points = materialize(points.withColumns(dict(zip(cell, _cells(axes, side)))))
    close_cells = near_cells(points, axes, cell, eps) if d > OFFSET_AXES else None
    crowded = _crowded(points, cell, salt)
    marked = materialize(_core_points(points, axes, cell, eps, min_samples, crowded, close_cells))
    core = marked.where("core").select(*axes, *cell)
    # cells are named by their smallest core point, so the smallest name of a component orders clusters
    names = materialize(core.groupBy(*cell).agg(F.min(F.struct(*axes)).alias("id")))
    roots = _cell_roots(core, names, axes, cell, eps, side, close_cells)
    order = running_totals(roots.select("root").distinct().withColumn("one", F.lit(1)), [], "root", ["one"])
    numbered = roots.join(order, "root").select("id", F.col("one_before").cast("int").alias(LABEL))
    cell_label = materialize(names.join(numbered, "id").select(*cell, LABEL))

    inside = marked.where("core").join(cell_label, cell)
    loose = marked.where("NOT core")
    near = [f"_h{i}" for i in range(d)]
    asks = _asked(_shifted(loose.select(*axes, *cell), d, cell, near, close_cells), near, cell, crowded)
    asks = asks.select(*[col(a).alias(f"_p{a}") for a in axes], *near, "_salt")
    have = _dealt(inside.select(*axes, LABEL, *[F.col(c).alias(h) for c, h in zip(cell, near)]), near, axes, cell, crowded)
    close = _square([col(f"_p{a}") for a in axes], [col(a) for a in axes]) <= eps * eps
    touched = (
        asks.join(have, [*near, "_salt"])
        .where(close)
        .groupBy(*[col(f"_p{a}").alias(a) for a in axes])
        .agg(F.min(LABEL).alias(LABEL))
    )
    border = loose.join(touched, axes, "left").withColumn(LABEL, F.coalesce(F.col(LABEL), F.lit(-1)))
    return inside.unionByName(border).select(*axes, F.col("_n").alias("n"), "core", LABEL)


def dbscan(
    df: DataFrame, eps: float = 0.5, min_samples: int = 5, columns: Sequence[str] | None = None, scaler: str = "standard"
) -> DataFrame:
    """``df`` with a ``cluster`` column (noise -1), found on the scaled columns."""
    names = list(columns or numeric_columns(df))
    axes = [f"_f_{c}" for c in names]
    wide = scaled_columns(df, names, scaler)
    labels = dbscan_points(wide, axes, eps, min_samples).select(*axes, LABEL)
    return wide.join(labels, axes, "left").select(*[col(c) for c in df.columns], F.coalesce(LABEL, F.lit(-1)).alias(LABEL))


def dbscan_centres(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """Mean of every column per cluster, noise left out."""
    return df.where(col(label) >= 0).groupBy(col(label)).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(num(c)).alias(c) for c in columns]
    )
