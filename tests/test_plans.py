"""The distributed forms (taken beyond a row bound) agree with the simple ones and with brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightlake.operators import density, neighbors
from brightlake.operators.inference import uniformity_ks
from brightlake.operators.relate import correlation
from brightlake.plans import running
from brightlake.plans import nearest
from brightlake.plans.nearest import k_nearest
from brightlake.plans.running import quantiles, running_totals
from brightlake.plans.sampling import lowest_by_hash

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_running_totals_large_equals_small(spark):
    df = table(spark, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    small = running_totals(df, ["o_orderpriority"], "o_custkey", ["n"])
    large = running_totals(df, ["o_orderpriority"], "o_custkey", ["n"], small=0)
    cols = ["o_orderpriority", "o_custkey", "n", "n_before", "n_total"]
    assert rows(small.select(cols)) == rows(large.select(cols))


def test_running_totals_without_keys(spark):
    df = spark.range(1000).select(F.col("id").alias("x"), F.lit(2).alias("v"))
    out = running_totals(df, [], "x", ["v"], small=0)
    assert out.where("v_before <> 2 * x OR v_total <> 2000").count() == 0


@pytest.mark.parametrize("by", [[], ["l_returnflag"]])
def test_quantiles_large_equals_small(spark, by):
    df = table(spark, "lineitem")
    cols, probs = ["l_quantity", "l_extendedprice"], [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    assert rows(quantiles(df, cols, probs, by)) == rows(quantiles(df, cols, probs, by, small=0))


def test_quantiles_of_few_rows(spark):
    data = [(n, float(i * i % 37)) for n in range(1, 60) for i in range(n)]
    df = spark.createDataFrame(data, "g int, x double")
    probs = [0.01, 0.25, 0.37, 0.5, 0.75, 0.99]
    for r in quantiles(df, ["x"], probs, ["g"]).collect():
        assert [r[f"q{i}"] for i in range(len(probs))] == pytest.approx(np.quantile([x for g, x in data if g == r["g"]], probs).tolist())


@pytest.mark.parametrize("accuracy", [2000, 50])
def test_quantiles_equal_sorting(spark, monkeypatch, accuracy):
    monkeypatch.setattr(running, "ACCURACY", accuracy)
    monkeypatch.setattr(running, "MARGIN", 2.0 / accuracy)
    rng = random.Random(5)
    kinds = {"smooth": lambda: rng.gauss(0, 1), "heavy": lambda: math.exp(4 * rng.gauss(0, 1)), "ties": lambda: float(rng.choice([1, 1, 1, 2, 9])), "gaps": lambda: rng.choice([None, float("nan"), rng.random()]), "none": lambda: None}
    data = [(rng.choice("ab"), *[f() for f in kinds.values()]) for _ in range(6000)] + [("c", 1.0, 2.0, 3.0, None, None)]
    df = spark.createDataFrame(data, "g string, " + ", ".join(f"{k} double" for k in kinds)).repartition(7)
    probs = [0.0, 0.001, 0.25, 0.5, 0.5, 0.9, 1.0]
    for by in ([], ["g"]):
        got = {(r["g"] if by else None, r["column"]): [r[f"q{i}"] for i in range(len(probs))] for r in quantiles(df, list(kinds), probs, by).collect()}
        assert len(got) == (3 if by else 1) * len(kinds)
        for (g, c), q in got.items():
            at = 1 + list(kinds).index(c)
            x = [r[at] for r in data if (g is None or r[0] == g) and r[at] is not None and not math.isnan(r[at])]
            assert q == (pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12, abs=1e-12) if x else [None] * len(probs))


def test_only_brackets_are_put_in_order(spark, monkeypatch):
    seen = []
    totals = running.running_totals
    monkeypatch.setattr(running, "running_totals", lambda cells, *a, **b: seen.append(cells.count()) or totals(cells, *a, **b))
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("x"))
    quantiles(df, ["x"], [0.25, 0.5, 0.75]).collect()
    assert seen[0] <= 200_000 * 6 * 2 * running.MARGIN


def test_quantiles_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1200, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    got = quantiles(df, ["x"], [0.1, 0.5], small=0).first()
    want = np.quantile([7.0] * 1200 + list(range(1200, 3000)), [0.1, 0.5])
    assert (got["q0"], got["q1"]) == pytest.approx(tuple(want))


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_correlation_large_equals_small(spark, method):
    df = table(spark, "lineitem").select("l_quantity", "l_discount", "l_tax")
    assert rows(correlation(df, method)) == rows(correlation(df, method, small=0))


def test_kendall_brute_force_with_gaps(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 9), None if rnd.random() < 0.2 else rnd.randint(0, 9)) for _ in range(80)]
    df = spark.createDataFrame(data, "x int, y int")
    got = {(r["var1"], r["var2"]): r["correlation"] for r in correlation(df, "kendall").collect()}[("x", "y")]
    full = [p for p in data if p[1] is not None]
    sign = lambda v: (v > 0) - (v < 0)
    s = n = tx = ty = 0
    for i, a in enumerate(full):
        for b in full[:i]:
            s += sign(a[0] - b[0]) * sign(a[1] - b[1])
            n, tx, ty = n + 1, tx + (a[0] == b[0]), ty + (a[1] == b[1])
    assert got == pytest.approx(s / math.sqrt((n - tx) * (n - ty)))


def test_uniformity_large_equals_small(spark):
    df = table(spark, "customer")
    assert rows(uniformity_ks(df, "c_acctbal")) == rows(uniformity_ks(df, "c_acctbal", small=0))


def test_lowest_by_hash_is_exact_and_repeatable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    quota = spark.createDataFrame([(0, 10), (1, 1666), (2, 5000)], "g long, take long")
    one = lowest_by_hash(df, quota, ["g"], ["id"], 1)
    assert {r["g"]: r["count"] for r in one.groupBy("g").count().collect()} == {0: 10, 1: 1666, 2: 1666}
    assert rows(one) == rows(lowest_by_hash(df.repartition(5), quota, ["g"], ["id"], 1))


@pytest.mark.parametrize("hot", [False, True])
def test_nearest_matches_brute_force(spark, hot):
    rnd = np.random.default_rng(5)
    pts = rnd.normal(size=(700, 2)).round(3)
    if hot:  # a third of all points share one coordinate, some are copies
        pts[:230, 0] = 0.5
        pts[:40] = pts[0]
    qs = rnd.normal(size=(60, 2)).round(3)
    points = spark.createDataFrame([(float(a), float(b), float(i)) for i, (a, b) in enumerate(pts)], "x double, y double, value double")
    queries = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(qs)], "qid long, x double, y double")
    got = {}
    for r in k_nearest(queries, points, ["x", "y"], 6, block=50).collect():
        got.setdefault(r["qid"], []).append(r["distance"])
    dist = np.sqrt(((qs[:, None] - pts[None]) ** 2).sum(axis=2))
    for i in range(len(qs)):
        assert sorted(got[i]) == pytest.approx(sorted(dist[i])[:6])


@pytest.mark.parametrize("most", [nearest.MAX_BOXES, 12])
def test_nearest_with_gaps_and_few_boxes(spark, monkeypatch, most):
    monkeypatch.setattr(nearest, "MAX_BOXES", most)  # beyond it boxes are dealt by hash
    monkeypatch.setattr(nearest, "SHARE", 25)
    rnd = np.random.default_rng(12)
    pts, qs = rnd.normal(size=(900, 4)), rnd.normal(size=(80, 4))
    pts[rnd.random(pts.shape) < 0.2] = np.nan
    qs[rnd.random(qs.shape) < 0.2] = np.nan
    qs[:, 3] = np.nan
    qs[0] = np.nan
    cell = lambda v: None if np.isnan(v) else float(v)
    axes = ["a", "b", "c", "d"]
    points = spark.createDataFrame([(*map(cell, r), f"p{i:03d}") for i, r in enumerate(pts)], "a double, b double, c double, d double, value string")
    queries = spark.createDataFrame([(i, *map(cell, r)) for i, r in enumerate(qs)], "qid long, a double, b double, c double, d double")
    got = {}
    for r in k_nearest(queries, points, axes, 5, block=40).collect():
        got.setdefault(r["qid"], []).append((round(r["distance"], 9), r["value"]))
    for i, x in enumerate(qs):
        both = ~np.isnan(x) & ~np.isnan(pts)
        n = both.sum(axis=1)
        gap = np.where(both, (x - pts) ** 2, 0).sum(axis=1)
        want = sorted((round(float(np.sqrt(g * 4 / m)), 9), f"p{j:03d}") for j, (g, m) in enumerate(zip(gap, n)) if m)[:5]
        assert sorted(got.get(i, [])) == want


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "x double, y double, value double")
    some = spark.createDataFrame([(1, 0.0, None)], "qid long, x double, y double")
    assert k_nearest(some, empty, ["x", "y"], 3).count() == 0
    assert k_nearest(some.limit(0), empty.unionByName(spark.createDataFrame([(1.0, 2.0, 3.0)], empty.schema)), ["x", "y"], 3).count() == 0


def test_queries_visit_few_boxes(spark):
    rnd = np.random.default_rng(3)
    pts = rnd.random((20_000, 3))
    points = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y", "z"])).repartition(4)
    boxes = nearest.build_boxes(points, ["x", "y", "z"], [1, 1, 1], 500)
    leaves = boxes.leaves()
    sizes = [boxes.size[b] for b in leaves]
    assert sum(sizes) == len(pts) and max(sizes) <= 500
    at = boxes.find(pts)
    assert [int((at == b).sum()) for b in leaves] == sizes
    # no point is closer than its box, and few boxes are within the reach of the fifth neighbour
    bound = boxes.nearest(pts[:300], leaves)
    dist = np.sqrt(((pts[:300, None] - pts[None]) ** 2).sum(axis=2))
    for i, b in enumerate(leaves):
        assert (bound[:, i] <= dist[:, at == b].min(axis=1) + 1e-12).all()
    fifth = np.sort(dist, axis=1)[:, 4]
    assert (bound <= fifth[:, None]).sum(axis=1).mean() < 2.5


def test_knn_imputation_matches_brute_force(spark):
    rnd = np.random.default_rng(8)
    data = rnd.normal(size=(300, 3))
    data[rnd.random(size=data.shape) < 0.15] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)], "id int, a double, b double, c double")
    out = neighbors.impute_knn(df, ["a"], ["a", "b", "c"], k=4, block=40).orderBy("id").collect()
    for i, r in enumerate(data):
        if not np.isnan(r[0]):
            continue
        best = []
        for o in data:
            if np.isnan(o[0]):
                continue
            both = ~np.isnan(r) & ~np.isnan(o)
            if both.any():
                best.append((3 / both.sum() * ((r[both] - o[both]) ** 2).sum(), o[0]))
        want = np.mean([v for _, v in sorted(best)[:4]]) if best else np.nanmean(data[:, 0])
        assert out[i]["a"] == pytest.approx(want)


def brute_dbscan(p, eps, m):
    near = [[j for j in range(len(p)) if ((p[i] - p[j]) ** 2).sum() <= eps * eps] for i in range(len(p))]
    core = [len(n) >= m for n in near]
    label = [-1] * len(p)
    order = sorted((i for i in range(len(p)) if core[i]), key=lambda i: tuple(p[i]))
    c = 0
    for s in order:
        if label[s] >= 0:
            continue
        todo = [s]
        while todo:
            i = todo.pop()
            if label[i] >= 0:
                continue
            label[i] = c
            todo += [j for j in near[i] if core[j] and label[j] < 0]
        c += 1
    for i in range(len(p)):
        if not core[i]:
            label[i] = min([label[j] for j in near[i] if core[j]], default=-1)
    return label


@pytest.mark.parametrize("seed,d", [(1, 2), (2, 2), (3, 3), (4, 1), (5, 5)])
def test_dbscan_matches_brute_force(spark, seed, d):
    rnd = np.random.default_rng(seed)
    parts = [rnd.normal(c, 0.25, size=(70, d)) for c in (0.0, 1.3, 4.0)]
    p = np.concatenate([*parts, np.tile(rnd.normal(2.2, 0.1, size=(1, d)), (60, 1)), rnd.uniform(-2, 6, size=(40, d))]).round(3)
    axes, eps = ["x", "y", "z", "u", "v"][:d], 0.3 if d < 4 else 0.5
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in p], ", ".join(f"{a} double" for a in axes))
    got = {tuple(r[a] for a in axes): r["cluster"] for r in density.dbscan_points(df, axes, eps, 6).collect()}
    want = brute_dbscan(p, eps, 6)
    assert [got[tuple(map(float, r))] for r in p] == want


def test_near_cells_equal_all_pairs(spark):
    rnd = np.random.default_rng(9)
    p = rnd.normal(0, 2, size=(150, 4))
    axes, cell = list("abcd"), [f"_g{i}" for i in range(4)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in p], axes).withColumns({g: F.floor(F.col(a) / 0.4).cast("long") for g, a in zip(cell, axes)})
    got = {tuple(r) for r in density.near_cells(df, axes, cell, 0.9).collect()}
    grid = np.floor(p / 0.4).astype(int)
    boxes = {}
    for g, x in zip(map(tuple, grid.tolist()), p):
        boxes.setdefault(g, []).append(x)
    ends = {g: (np.min(x, axis=0), np.max(x, axis=0)) for g, x in boxes.items()}
    gap = lambda a, b: (np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1])) ** 2).sum()
    assert got == {(*g, *h) for g in ends for h in ends if gap(ends[g], ends[h]) <= 0.81}
    assert density.near_cells(df.limit(0), axes, cell, 0.9).collect() == []
