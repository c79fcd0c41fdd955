"""Windows cut into ranges with lent border rows equal plain windows."""

import math

import pytest
from pyspark.sql import functions as F

from brightlake.operators import anomaly, impute, series
from brightlake.plans import halo


def rows(df):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.8g}")
        return v

    names = sorted(df.columns)
    return sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def some(spark):
    """Series of 1, 12, 40 and 3,000 steps and one without a key, with gaps, zeros and a trend."""
    parts = [("a", 1), ("b", 12), ("c", 40), ("d", 3000), (None, 700)]
    frames = [spark.range(n).select(F.lit(k).cast("string").alias("k"), F.col("id").alias("i")) for k, n in parts]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    noise = F.pmod(F.xxhash64("k", "i"), F.lit(1000)) / 100
    value = F.when(F.pmod(F.xxhash64(F.lit(1), "k", "i"), F.lit(7)) == 0, F.lit(None)).otherwise(noise + F.sin(F.col("i") / 9.0) * 4 + F.col("i") / 500)
    step = F.make_dt_interval(F.lit(0), F.col("i").cast("int"))
    return every.select("k", (F.lit("2020-01-01").cast("timestamp_ntz") + step).alias("ts"), value.alias("value"), F.col("i").alias("keep")).checkpoint()


CASES = {
    "rolling": lambda s: series.rolling_stats(s, ["k"], 7),
    "rolling centred": lambda s: series.rolling_stats(s, ["k"], 30, center=True),
    "ewm": lambda s: series.ewm_mean(s, ["k"], 5),
    "decompose": lambda s: series.decompose(s.fillna(1.0, ["value"]), ["k"], 24),
    "frequency": lambda s: series.detect_frequency(s, ["k"]),
    "difference": lambda s: series.difference(s, ["k"], 3),
    "log difference": lambda s: series.log_difference(s, ["k"], 2),
    "change": lambda s: series.pct_change(s, ["k"], 5),
    "acf": lambda s: series.acf(s, ["k"], 20),
    "kpss": lambda s: series.kpss_statistic(s, ["k"]),
    "adf": lambda s: series.adf_statistic(s, ["k"], 2),
    "adf by criterion": lambda s: series.adf_statistic(s, ["k"], None),
    "z": lambda s: anomaly.anomaly_zscore(s, ["k"], 2.0, 9),
    "z own": lambda s: anomaly.anomaly_zscore(s, ["k"], 2.0, anomaly.OWN),
    "std": lambda s: anomaly.anomaly_std(s, ["k"], 2.0),
    "mad": lambda s: anomaly.anomaly_mad(s, ["k"], 2.0, 9),
    "mad own": lambda s: anomaly.anomaly_mad(s, ["k"], 2.0, anomaly.OWN),
    "ffill": lambda s: impute.ffill(s, ["k"], "ts", ["value"]),
    "bfill": lambda s: impute.bfill(s, ["k"], "ts", ["value"]),
    "interpolate": lambda s: impute.interpolate_time(s, ["k"], "ts", ["value"]),
    "no key": lambda s: impute.ffill(s.where("k = 'd'"), [], "ts", ["value"]),
}


@pytest.mark.parametrize("name", CASES)
def test_ranges_equal_plain_windows(some, monkeypatch, name):
    plain = rows(CASES[name](some))
    monkeypatch.setattr(halo, "LONG_ROWS", 0)
    monkeypatch.setattr(halo, "RANGE_ROWS", 50)
    assert rows(CASES[name](some)) == plain and plain


def test_an_empty_frame_has_no_rows(some, monkeypatch):
    monkeypatch.setattr(halo, "LONG_ROWS", -1)
    assert CASES["rolling"](some.limit(0)).collect() == [] and CASES["ffill"](some.limit(0)).collect() == []


def test_one_series_of_a_million_steps(spark, monkeypatch):
    n = 1_000_000
    step = F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz")
    value = F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100)
    one = spark.range(n).select(F.lit("x").alias("k"), step.alias("ts"), value.alias("value")).checkpoint()
    assert halo.is_long(one, ["k"])
    cut = halo.in_ranges(one, ["k"], "ts", 30, 30)
    sizes = [r["count"] for r in cut.groupBy("k", halo.RANGE).count().collect()]
    assert max(sizes) <= n / 8 and sum(sizes) <= 1.01 * n

    def digest(df):
        kept = df.select(F.xxhash64("k", "ts", *[F.round(c, 6) for c, t in df.dtypes if t == "double"]).alias("h"))
        return kept.agg(F.count("h"), F.bit_xor("h"), F.sum(F.shiftright("h", 20))).first()

    cases = {
        "zscore": lambda: anomaly.anomaly_zscore(one, ["k"], 3.0, 7).drop("z_score", "is_anomaly"),
        "difference": lambda: series.difference(one, ["k"], 2),
        "ffill": lambda: impute.ffill(one, ["k"], "ts", ["value"]),
        "interpolate": lambda: impute.interpolate_time(one, ["k"], "ts", ["value"]),
    }
    found = {c: digest(f()) for c, f in cases.items()}
    monkeypatch.setattr(halo, "LONG_ROWS", 1 << 40)
    assert found == {c: digest(f()) for c, f in cases.items()}


def test_lags_by_the_criterion_equal_separate_fits(some):
    import numpy as np

    got = {r["k"]: r for r in series.adf_statistic(some, ["k"], None).collect()}
    every = some.where("value IS NOT NULL").orderBy("ts").collect()
    for k in ("b", "c", "d", None):
        x = np.array([r["value"] for r in every if r["k"] == k])
        d, most = np.diff(x), max(0, min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2))

        def fit(lags, start):
            terms = np.column_stack([np.ones(len(d) - start), x[start:-1], *[d[start - i : len(d) - i] for i in range(1, lags + 1)]])
            beta, *_ = np.linalg.lstsq(terms, d[start:], rcond=None)
            return terms, beta, float(((d[start:] - terms @ beta) ** 2).sum())

        n = len(d) - most
        best = min(range(most + 1), key=lambda i: n * math.log(fit(i, most)[2] / n) + 2 * (i + 2))
        terms, beta, error = fit(best, best)
        t = beta[1] / math.sqrt(error / (len(terms) - best - 2) * np.linalg.inv(terms.T @ terms)[1, 1])
        assert got[k]["lags"] == best and got[k]["adf_statistic"] == pytest.approx(t, rel=1e-6) and got[k]["n"] == len(terms)
