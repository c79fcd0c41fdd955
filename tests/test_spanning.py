"""Spanning tree and single linkage against dense brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightlake.operators import cluster as cl
from brightlake.plans import nearest, spanning
from brightlake.plans.spanning import spanning_tree, tree_parts


def dense_lengths(x):
    """Edge lengths of the tree by Prim's method on the whole distance matrix."""
    x = np.unique(x, axis=0)
    near, out = np.sqrt(((x - x[0]) ** 2).sum(axis=1)), []
    left = np.ones(len(x), bool)
    left[0] = False
    while left.any():
        new = np.flatnonzero(left)[near[left].argmin()]
        out.append(near[new])
        left[new] = False
        near = np.minimum(near, np.sqrt(((x - x[new]) ** 2).sum(axis=1)))
    return np.sort(out)


def frame(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{i} double" for i in range(x.shape[1])))


def lengths(tree):
    return np.sort([r["distance"] for r in tree.edges.collect()])


def islands(seed, n, d):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 40, (4, d))
    return centres[rng.integers(0, 4, n)] + rng.normal(0, 1, (n, d))


@pytest.mark.parametrize("d, block", [(1, 200), (3, 200), (2, 5000)])
def test_tree_equals_dense(spark, d, block):
    x = islands(d, 700, d)
    tree = spanning_tree(frame(spark, x), [f"x{i}" for i in range(d)], block=block)
    assert lengths(tree) == pytest.approx(dense_lengths(x))
    ids = tree.points.select("id")
    assert tree_parts(ids, tree.edges).select("root").distinct().count() == 1


def test_ties_on_a_grid(spark):
    x = np.array([(i, j) for i in range(15) for j in range(15)] * 2)
    trees = [spanning_tree(frame(spark, x).repartition(n), ["x0", "x1"], block=b) for n, b in ((1, 120), (5, 5000))]
    assert lengths(trees[0]) == pytest.approx(np.ones(224))
    drawn = []
    for t in trees:  # the same edges, however rows are dealt and boxes cut
        at = {r["id"]: (r["x0"], r["x1"]) for r in t.points.collect()}
        drawn.append({(at[r["a"]], at[r["b"]]) for r in t.edges.collect()})
        assert t.points.agg(F.sum("n")).first()[0] == 450
    assert drawn[0] == drawn[1] and len(drawn[0]) == 224


def test_boxes_dealt_by_hash(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MAX_BOXES", 4)
    x = islands(9, 500, 2)
    assert lengths(spanning_tree(frame(spark, x), ["x0", "x1"], block=60)) == pytest.approx(dense_lengths(x))


def test_lookups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spanning, "BROADCAST_ROWS", 0)
    x = islands(5, 300, 2)
    assert lengths(spanning_tree(frame(spark, x), ["x0", "x1"], block=60)) == pytest.approx(dense_lengths(x))


def test_parts_by_rounds_equal_one_task(spark, monkeypatch):
    ids = spark.range(64)
    forest = spark.createDataFrame([(i, i + 1, float(i % 5)) for i in range(63) if i % 9], "a long, b long, distance double")
    one = {tuple(r) for r in tree_parts(ids, forest).collect()}
    monkeypatch.setattr(spanning, "BROADCAST_ROWS", 0)
    parts = {}
    for r in tree_parts(ids, forest).collect():
        parts.setdefault(r["root"], set()).add(r["id"])
    assert one == {(i, min(p)) for p in parts.values() for i in p} and len(parts) == 8


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(1.0, 2.0)] * 3, [(None, 1.0), (float("nan"), 1.0), (float("inf"), 0.0)]])
def test_tree_of_nothing(spark, rows):
    tree = spanning_tree(spark.createDataFrame(rows, "x0 double, x1 double"), ["x0", "x1"])
    assert tree.edges.count() == 0 and tree.points.count() == (1 if rows and rows[0][0] else 0)


def single_linkage_sets(x, n):
    """Merge the two closest clusters, pair by pair, until n are left."""
    parts = [{i} for i in range(len(x))]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    while len(parts) > n:
        pairs = [(min(far[i, j] for i in a for j in b), s, t) for s, a in enumerate(parts) for t, b in enumerate(parts) if s < t]
        _, s, t = min(pairs)
        parts[s] |= parts.pop(t)
    return {frozenset(p) for p in parts}


@pytest.mark.parametrize("n", [1, 7])
def test_single_linkage_equals_merging(spark, n):
    x = np.random.default_rng(3).normal(0, 1, (40, 2))
    df = frame(spark, x).withColumn("cluster_name", F.lit("kept"))
    rows = cl.single_linkage(df, n, ["x0", "x1"], scaler=None).collect()
    at = {tuple(r): i for i, r in enumerate(x)}
    found = {}
    for r in rows:
        found.setdefault(r["cluster"], set()).add(at[r["x0"], r["x1"]])
    assert {frozenset(p) for p in found.values()} == single_linkage_sets(x, n)
    assert sorted(found) == list(range(n)) and rows[0]["cluster_name"] == "kept"


def test_linkage_heights(spark):
    x = np.array([[0.0], [1.0], [3.0], [7.0], [7.0]])
    rows = cl.linkage_heights(frame(spark, x), ["x0"], scaler=None).orderBy("clusters").collect()
    assert [(r["clusters"], r["distance"]) for r in rows] == [(1, 4.0), (2, 2.0), (3, 1.0)]


def test_one_column_needs_no_boxes_and_no_rounds(spark, monkeypatch):
    def never(*_):
        raise AssertionError("not for one column")

    x = np.round(islands(8, 900, 1), 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several range partitions
    try:
        monkeypatch.setattr(spanning, "build_boxes", never)
        tree = spanning_tree(frame(spark, np.r_[x, x]).repartition(3), ["x0"])
        assert tree.points.select(F.shiftright("id", 33)).distinct().count() > 3
        assert lengths(tree) == pytest.approx(dense_lengths(x))
        kept = tree.edges.where("distance < 0.2")
        ids = tree.points.select("id")
        want = {tuple(r) for r in tree_parts(ids, kept).collect()}
        monkeypatch.setattr(spanning, "_joined", never)
        monkeypatch.setattr(spanning, "_tops", never)
        assert {tuple(r) for r in tree_parts(ids, kept, tree.chain).collect()} == want and len({r for _, r in want}) > 3
        for rows in ([], [(1.5,)]):
            few = spanning_tree(spark.createDataFrame(rows, "x0 double"), ["x0"])
            assert few.edges.count() == 0 and tree_parts(few.points.select("id"), few.edges, few.chain).count() == len(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
