"""Hypothesis tests and distribution checks. Every statistic is an aggregate over all rows; only
the finished one-row results meet the tail functions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from brightlake.functions.columns import (
    beside,
    col,
    num,
    numeric_columns,
    sample_kurtosis,
    sample_skew,
    stack_rows,
)
from brightlake.functions.tails import chi2_p, f_p, k2_statistic, kolmogorov_p, t_p
from brightlake.plans.running import SMALL_ROWS, quantile_row, quantiles, running_totals, value_cells
from brightlake.session import materialize


def _verdict(p: Column, alpha: float) -> Column:
    return F.when(p < alpha, F.lit("significant")).when(p.isNotNull(), F.lit("not_significant"))


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, var) of the non-missing values; null groups are left out."""
    return (
        df.where(col(group).isNotNull())
        .groupBy(col(group).cast("string").alias("group"))
        .agg(F.count(num(value)).alias("n"), F.avg(num(value)).alias("mean"), F.variance(num(value)).alias("var"))
    )


def welch_ttest(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Two groups, unequal variances. No row unless there are exactly two groups."""
    pair = group_moments(df, group, value).agg(
        F.count(F.lit(1)).alias("_k"),
        *[
            pick(F.struct("n", "mean", "var"), F.col("group")).alias(side)
            for side, pick in (("_a", F.min_by), ("_b", F.max_by))
        ],
        F.min("group").alias("group1"),
        F.max("group").alias("group2"),
    ).where("_k = 2")
    ea, eb = F.col("_a.var") / F.col("_a.n"), F.col("_b.var") / F.col("_b.n")
    t = F.try_divide(F.col("_a.mean") - F.col("_b.mean"), F.sqrt(ea + eb))
    dof = F.try_divide((ea + eb) * (ea + eb), ea * ea / (F.col("_a.n") - 1) + eb * eb / (F.col("_b.n") - 1))
    stats = pair.select(
        "group1",
        "group2",
        F.col("_a.mean").alias("mean1"),
        F.col("_b.mean").alias("mean2"),
        (F.col("_a.mean") - F.col("_b.mean")).alias("mean_difference"),
        t.alias("t_statistic"),
        dof.alias("dof"),
    )
    return stats.withColumn("p_value", t_p("t_statistic", "dof")).withColumn(
        "conclusion", _verdict(F.col("p_value"), alpha)
    )


def anova(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """One row per group with its mean, and the F test over all of them (three groups or more)."""
    groups = materialize(group_moments(df, group, value).where("n > 0"))  # one scan for three uses
    n, m, v = F.col("n").cast("double"), F.col("mean"), F.col("var")
    # between = sum n (mean - grand)^2, within = sum (n - 1) var
    grand = groups.agg((F.sum(n * m) / F.sum(n)).alias("g")).first()["g"]
    total = groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(n).alias("_n"),
        F.sum(n * (m - F.lit(grand)) * (m - F.lit(grand))).alias("_between"),
        F.sum(F.coalesce((n - 1) * v, F.lit(0.0))).alias("_within"),
    ).where("n_groups >= 3")
    d1, d2 = F.col("n_groups") - 1.0, F.col("_n") - F.col("n_groups")
    test = total.select(
        "n_groups",
        F.try_divide(F.try_divide(F.col("_between"), d1), F.try_divide(F.col("_within"), d2)).alias("f_statistic"),
        d1.alias("dof_between"),
        d2.alias("dof_within"),
    ).withColumn("p_value", f_p("f_statistic", "dof_between", "dof_within"))
    named = groups.select("group", "n", F.col("mean").alias("group_mean"))
    return beside(named, test).where("n_groups IS NOT NULL").withColumn("conclusion", _verdict(F.col("p_value"), alpha))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): contingency counts of rows where both are present, in tall form."""
    return (
        df.where(col(a).isNotNull() & col(b).isNotNull())
        .groupBy(col(a).cast("string").alias("a"), col(b).cast("string").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def chi2_independence(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Chi-square test of independence, with Yates' correction at one degree of freedom.

    Without the correction the statistic needs only the filled cells: N (sum n^2 / (r c) - 1), the
    marginals joined back on their keys. The correction applies to 2 x 2 tables alone, where the
    four counts are one row.
    """
    cells = crosstab(df, a, b).withColumn("n", F.col("n").cast("double"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("c"))
    total = cells.join(rows, "a").join(cols, "b").agg(
        F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("_q"), F.sum("n").alias("_n")
    )
    size = rows.agg(
        F.count(F.lit(1)).alias("_r"), F.min("r").alias("_r1"), F.max("r").alias("_r2")
    )
    wide = cols.agg(
        F.count(F.lit(1)).alias("_c"), F.min("c").alias("_c1"), F.max("c").alias("_c2")
    )
    n, dof = F.col("_n"), (F.col("_r") - 1) * (F.col("_c") - 1)
    plain = n * (F.col("_q") - 1)
    # 2 x 2: |n11 n22 - n12 n21| = sqrt(plain * r1 r2 c1 c2 / n); each cell moves by at most 1/2
    margins = F.col("_r1") * F.col("_r2") * F.col("_c1") * F.col("_c2")
    cross = F.sqrt(F.greatest(plain, F.lit(0.0)) * margins / n)
    shift = F.greatest(cross - n / 2, F.lit(0.0))
    yates = F.try_divide(n * shift * shift, margins)
    stats = beside(beside(total, size), wide).select(
        F.lit(a).alias("var1"),
        F.lit(b).alias("var2"),
        F.when(dof == 1, yates).otherwise(plain).alias("chi2"),
        dof.cast("long").alias("dof"),
    )
    return stats.withColumn(
        "p_value", F.when(F.col("dof") > 0, chi2_p("chi2", F.col("dof").cast("double"))).otherwise(1.0)
    ).withColumn("conclusion", _verdict(F.col("p_value"), alpha))


# ---- distribution ------------------------------------------------------------------------------

def normality_k2(df: DataFrame, columns: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """K^2 statistic, p and flag with moments, for all columns in one pass over all rows."""
    names = list(columns or numeric_columns(df))
    marks = quantile_row(df, names, [0.5])
    row = df.agg(
        F.lit(1),
        *[
            F.struct(
                F.count(num(c)).alias("n"),
                F.avg(num(c)).alias("mean"),
                F.stddev(num(c)).alias("std"),
                F.skewness(num(c)).alias("g1"),
                F.kurtosis(num(c)).alias("g2"),
                sample_skew(num(c)).alias("skewness"),
                sample_kurtosis(num(c)).alias("kurtosis"),
            ).alias(f"_s{i}")
            for i, c in enumerate(names)
        ],
    )
    entries = []
    for i, c in enumerate(names):
        s = lambda k, i=i: F.col(f"_s{i}.{k}")
        entries.append(
            {"column": F.lit(c), "sample_size": s("n"), "g1": s("g1"), "g2": s("g2")}
            | {k: s(k) for k in ("skewness", "kurtosis", "mean", "std")}
            | {"median": F.lit(marks[c][0]).cast("double")}
        )
    tall = stack_rows(row, entries).withColumn("statistic", k2_statistic("sample_size", "g1", "g2")).drop("g1", "g2")
    # chi-square with two degrees of freedom
    return tall.withColumn("p_value", F.exp(-F.col("statistic") / 2)).withColumn("is_normal", F.col("p_value") > alpha)


def uniformity_ks(df: DataFrame, column: str, alpha: float = 0.05, small: int = SMALL_ROWS) -> DataFrame:
    """Kolmogorov-Smirnov distance to n evenly spaced points on [min, max], as a two-sample test."""
    cells = running_totals(value_cells(df, [column]), ["column"], "value", ["n"], rows=df.count(), small=small)
    ends = df.agg(F.min(num(column)).alias("lo"), F.max(num(column)).alias("hi"), F.count(num(column)).alias("n")).first()
    lo, hi, n = ends["lo"], ends["hi"], ends["n"]
    if not n or n < 2 or lo == hi:
        return df.sparkSession.createDataFrame(
            [], "column string, sample_size long, statistic double, p_value double, is_uniform boolean"
        )
    v, total = F.col("value"), F.lit(float(n))
    # share of grid points lo + k (hi - lo) / (n - 1) at or below v, and strictly below v
    place = (v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(n - 1))
    upto = (F.floor(place) + 1) / total
    under = F.ceil(place) / total
    after = (F.col("n_before") + F.col("n")) / total
    before = F.col("n_before") / total
    distance = F.greatest(F.abs(after - upto), F.abs(before - under))
    stats = cells.groupBy("column").agg(F.lit(n).cast("long").alias("sample_size"), F.max(distance).alias("statistic"))
    return stats.withColumn(
        "p_value", kolmogorov_p(F.col("statistic") * F.sqrt(F.col("sample_size") / 2.0))
    ).withColumn("is_uniform", F.col("p_value") > alpha)


def qq_points(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """(prob, theoretical, sample) on an even grid of probabilities, with the fitted line."""
    probs = [i / (points + 1) for i in range(1, points + 1)]
    grid = quantiles(df, [column], probs)
    normal = NormalDist()
    tall = stack_rows(
        grid,
        [
            {"prob": F.lit(p), "theoretical": F.lit(normal.inv_cdf(p)), "sample": F.col(f"q{i}")}
            for i, p in enumerate(probs)
        ],
    )
    line = tall.agg(
        F.regr_slope("sample", "theoretical").alias("slope"), F.regr_intercept("sample", "theoretical").alias("intercept")
    )
    return beside(tall, line)


def significance(df: DataFrame, category: str, number: str, alpha: float = 0.05) -> DataFrame:
    """Two groups: Welch's t-test; more: ANOVA. One row (test, groups, statistic, p, conclusion)."""
    groups = group_moments(df, category, number).where("n > 0").limit(3).count()
    if groups == 2:
        found = welch_ttest(df, category, number, alpha)
        return found.select(
            F.lit("welch_t").alias("test"),
            F.lit(2).cast("long").alias("n_groups"),
            F.col("t_statistic").alias("statistic"),
            "p_value",
            "conclusion",
        )
    found = anova(df, category, number, alpha).groupBy("n_groups", "conclusion").agg(
        F.max("f_statistic").alias("statistic"), F.max("p_value").alias("p_value")
    )
    return found.select(F.lit("anova").alias("test"), "n_groups", "statistic", "p_value", "conclusion")
