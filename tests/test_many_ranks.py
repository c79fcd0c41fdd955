"""Quantiles at many ranks: right, and with few values put in order."""

import numpy as np
import pandas as pd
import pytest

from brightlake.operators import inference
from brightlake.plans import running


def test_many_ranks_put_few_values_in_order(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=200_000)
    seen = []
    inner = running.running_totals
    monkeypatch.setattr(running, "running_totals", lambda df, *a, **k: seen.append(df.count()) or inner(df, *a, **k))
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    probs = [i / 100 for i in range(1, 100)]
    got = running.quantiles(df, ["v"], probs).first()
    assert [got[f"q{i}"] for i in range(99)] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)
    assert seen[0] <= 0.03 * len(x)  # 0.4 of the rows with a bracket as wide as for one rank
    rows = inference.qq_points(df, "v").orderBy("prob").collect()
    assert [r["sample"] for r in rows] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)


def test_many_ranks_of_crowded_and_few_values(spark):
    probs = [0.0, *[i / 40 for i in range(1, 40)], 1.0]
    x = np.r_[np.zeros(30_000), np.arange(20_000) // 7, np.full(9, 1e9)].astype(float)
    df = spark.createDataFrame(pd.DataFrame({"v": x, "w": np.where(np.arange(len(x)) < 30, x + np.arange(len(x)), np.nan)}))
    got = {r["column"]: r for r in running.quantiles(df, ["v", "w"], probs).collect()}
    for c, values in (("v", x), ("w", np.arange(30.0))):
        assert [got[c][f"q{i}"] for i in range(41)] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12, abs=1e-12)
