"""DBSCAN: pairs of cells inside one component are not followed, crowded cells are dealt; same clusters as brute force."""

import numpy as np
import pandas as pd
import pytest

from brightlake.operators import density


def brute(x, eps, least):
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for n, i in enumerate(np.lexsort(x.T[::-1])):
        if core[i] and label[i] < 0:
            new, todo = label.max() + 1, [i]
            label[i] = new
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = new
                    todo.append(j)
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.min() if len(own) else -1
    return label


@pytest.mark.parametrize("d", [2, 5])
def test_links_are_not_followed_inside_a_component(spark, monkeypatch, d):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.uniform(0, 1, (900, d)) * [3.0, *[0.5] * (d - 1)], rng.uniform(0, 0.4, (300, d)) + 5, rng.uniform(-3, 8, (60, d))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{i}" for i in range(d)]))
    levels = []
    inner = density._boxes
    monkeypatch.setattr(density, "_boxes", lambda *a: levels.append(1) or inner(*a))
    monkeypatch.setattr(density, "CROWDED", 20)
    axes = [f"x{i}" for i in range(d)]
    got = density.dbscan_points(df, axes, 0.3, 5).toPandas().set_index(axes)["cluster"]
    assert [got[tuple(r)] for r in x.tolist()] == brute(x, 0.3, 5).tolist()
    assert len(levels) <= 2  # boxes of full cells prove next to nothing, so they went down four levels and more
