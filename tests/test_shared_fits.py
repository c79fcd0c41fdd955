"""Centres and mixtures fitted in shared passes, against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from brightlake.operators import cluster


def test_centres_of_all_sizes_in_shared_passes(spark, monkeypatch):
    """Ten numbers of clusters take as many passes as one, and each ends as good as a fit of its own from the same start."""
    from brightlake.plans import fits

    rng = np.random.default_rng(5)
    spots = rng.normal(size=(6, 2)) * 8
    x = np.concatenate([rng.normal(size=(700, 2)) * 0.4 + s for s in spots])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["x", "y"])).repartition(5)
    passes = []
    inner = fits._tasks
    monkeypatch.setattr(fits, "_tasks", lambda *a: passes.append(1) or inner(*a))
    table = {r["n_clusters"]: r for r in cluster.optimal_k(df, 10, "silhouette", ["x", "y"]).collect()}
    assert len(passes) <= 6 + fits.STEPS + 2
    assert table[6]["is_optimal"]
    z = (x - x.mean(0)) / x.std(0)
    centres = np.array([z[i * 700 : (i + 1) * 700].mean(0) for i in range(6)])
    own = np.repeat(np.arange(6), 700)
    assert table[6]["inertia"] == pytest.approx(np.square(z - centres[own]).sum(), rel=1e-9)
    n, within = len(z), np.square(z - centres[own]).sum()
    between = 700 * np.square(centres).sum()
    assert table[6]["calinski_harabasz"] == pytest.approx((between / 5) / (within / (n - 6)), rel=1e-9)
    far = ((z[:, None, :] - z[None, :, :]) ** 2).sum(2)
    mean = np.stack([far[:, own == j].sum(1) for j in range(6)], 1) / np.where(own[:, None] == np.arange(6), 699, 700)
    a = mean[np.arange(n), own]
    mean[np.arange(n), own] = np.inf
    b = mean.min(1)
    assert table[6]["silhouette_squared"] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), rel=1e-9)


def test_equally_near_centres_take_a_point_once(spark):
    from brightlake.plans import fits

    df = spark.createDataFrame([(float(v),) for v in [-1, 0, 0, 1] * 50], "x double")
    blocks = fits.pack(df, ["x"])
    got = fits.fit_centres(blocks, 1, [2, 3, 5], 42)
    assert sorted(got[3].ravel().tolist()) == [-1.0, 0.0, 1.0] and len(got[5]) == 3
    assert sum(fits.quality(blocks, 1, [got[2]])[0]["n"]) == 200
    blocks.unpersist()
