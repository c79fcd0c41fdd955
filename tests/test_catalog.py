"""Every registered query against its DuckDB oracle, over whole tables."""

import inspect
import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    from tests.compare import duck

    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert ok, note


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_best_numbers_are_looked_for_up_to_ten(spark):
    small = SF.replace("sf0.01", "sf0.001")
    assert sorted(r[0] for r in QUERIES["l8_optimal_k"](spark, small).select("n_clusters").collect()) == list(range(2, 11))
    assert sorted(r[0] for r in QUERIES["l14_optimal_gmm"](spark, small).select("n_components").collect()) == list(range(1, 11))


def test_models_have_their_full_sizes(spark, monkeypatch):
    from brightlake.operators import model, relate

    class Asked(Exception):
        pass

    def fit(data, key, estimator, classify):
        raise Asked(estimator.getMaxIter() if estimator.hasParam("maxIter") else estimator.getNumTrees())

    importance = inspect.signature(relate.forest_importance)

    def forest(*args, **named):
        bound = importance.bind(*args, **named)
        bound.apply_defaults()
        raise Asked(bound.arguments["trees"])

    monkeypatch.setattr(model, "_fit", fit)
    monkeypatch.setattr(relate, "forest_importance", forest)
    forests = ["m3_random_forest_regression", "m5_random_forest_classification", "m5_forest_feature_importance"]
    for name, size in [(n, 100) for n in forests] + [("m4_logistic_regression", 1000), ("f11_forest_importance", 50)]:
        with pytest.raises(Asked, match=f"^{size}$"):
            QUERIES[name](spark, SF)


def test_all_anomaly_methods_are_compared(spark):
    got = QUERIES["k7_compare_anomaly_methods_all"](spark, SF).select("method", "window").distinct().collect()
    want = {(m, w) for m in ("zscore", "std", "mad") for w in (None, 7, 30)} | {("iqr", None)}
    assert {(r["method"], r["window"]) for r in got} == want
