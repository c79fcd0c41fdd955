"""Nearest neighbours inside a box: few points are looked at, with the same result as all of them."""

import numpy as np
import pytest

from brightlake.plans import nearest


def plain(x, p, k):
    return nearest._best_of(x, p, (~np.isnan(p)).astype(float), k)


@pytest.mark.parametrize("kind", ["even", "ties", "missing in queries", "missing in points", "no shared axis"])
def test_leaves_give_the_same_neighbours(kind, monkeypatch):
    rng = np.random.default_rng(1)
    p, x = rng.normal(size=(5000, 3)), rng.normal(size=(700, 3)) * 1.5
    if kind == "ties":
        p, x = np.round(p * 2), np.round(x * 2)
    if kind == "missing in queries":
        x[rng.random(x.shape) < 0.3] = np.nan
    if kind == "missing in points":
        p[rng.random(p.shape) < 0.1] = np.nan
    if kind == "no shared axis":
        p[:, 0], x[:, 1:] = np.nan, np.nan
    looked = []
    inner = nearest._best_of
    gap, best = plain(x, p, 5)
    monkeypatch.setattr(nearest, "_best_of", lambda x, p, known, k: looked.append(len(x) * len(p)) or inner(x, p, known, k))
    seen = set()
    for rows, g, b in nearest.Held(p).best(x, 5):
        seen |= set(rows.tolist())
        finite = np.isfinite(gap[rows])
        assert (np.isfinite(g) == finite).all()
        for r, gr, br in zip(rows, g, b):
            want = sorted(zip(gap[r][np.isfinite(gap[r])], best[r][np.isfinite(gap[r])]))
            assert sorted(zip(gr[np.isfinite(gr)], br[np.isfinite(gr)])) == want
    assert seen == set(range(len(x)))
    if kind in ("even", "ties"):
        assert sum(looked) < 0.4 * len(x) * len(p)


def test_first_boxes_are_those_in_order():
    rng = np.random.default_rng(2)
    bound = np.maximum(rng.normal(size=(300, 40)), 0).round(1)
    bound[rng.random(bound.shape) < 0.1] = np.inf
    sizes, turn = rng.integers(1, 9, 40), rng.integers(0, 1000, 300)
    assert (nearest._first(bound, sizes, 5, turn) == (nearest._in_turn(bound, sizes, 5, turn) & np.isfinite(bound))).all()


def test_a_search_is_shared_out(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2))
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "value long, x double, y double").coalesce(1)
    queries = points.withColumnRenamed("value", "qid")
    spread = nearest.k_nearest(queries, points, ["x", "y"], 3, block=300)
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") and "REPARTITION_BY_COL" not in plan  # by column they were joined to one task of few bytes
    got = {(r["qid"], r["rank"]): r["value"] for r in spread.collect()}
    far = ((x[:, None] - x[None]) ** 2).sum(2).argsort(1)[:, :3]
    assert all(got[i, j + 1] == far[i, j] for i in range(3000) for j in range(3))
