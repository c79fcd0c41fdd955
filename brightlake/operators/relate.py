"""Correlation, interactions and feature relevance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from brightlake.functions import fixed
from brightlake.functions.columns import (
    categorical_columns,
    col,
    count_if,
    is_numeric,
    missing,
    num,
    numeric_columns,
    safe_corr,
    stack_rows,
)
from brightlake.plans.running import SMALL_ROWS, quantile_row, running_totals, value_cells
from brightlake.session import BROADCAST_ROWS, even_shares, materialize

PAIRS_PER_JOB = 500


def _pair_table(df: DataFrame, pairs: Sequence[tuple[str, str]], score) -> DataFrame:
    """(var1, var2, correlation): all pairs in one aggregate, in batches for very wide tables."""
    out = None
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        batch = pairs[start : start + PAIRS_PER_JOB]
        row = df.agg(*[score(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(batch)])
        part = stack_rows(
            row,
            [
                {"var1": F.lit(a), "var2": F.lit(b), "correlation": F.col(f"_r{i}")}
                for i, (a, b) in enumerate(batch)
            ],
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = df.sparkSession.createDataFrame([], "var1 string, var2 string, correlation double")
    return out


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _pair_table(df, list(combinations(columns, 2)), lambda a, b: safe_corr(num(a), num(b)))


def average_ranks(df: DataFrame, columns: Sequence[str], small: int = SMALL_ROWS) -> DataFrame:
    """(column, value, rank): average rank of every distinct value."""
    bound = df.count() * len(columns)
    cells = running_totals(value_cells(df, columns), ["column"], "value", ["n"], rows=bound, small=small)
    return cells.select("column", "value", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank"))


def spearman_pairs(df: DataFrame, columns: Sequence[str], small: int = SMALL_ROWS) -> DataFrame:
    """Pearson correlation of average ranks over the rows where both columns are present."""
    tables = []
    whole = df.select(*[num(c).alias(c) for c in columns])
    gaps = whole.agg(*[count_if(col(c).isNull()).alias(f"_c{i}") for i, c in enumerate(columns)]).first()
    groups = [tuple(columns)] if not any(gaps) else list(combinations(columns, 2))
    for names in groups:
        ranked = whole.dropna() if len(groups) == 1 else whole.select(*[col(n) for n in names]).dropna()
        # equal rows collapse first; ranks of the distinct values are joined back on the value
        ranked = ranked.groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias("_n"))
        ranks = materialize(average_ranks(whole.select(*[col(n) for n in names]).dropna(), names, small))
        for n in names:
            table = ranks.where(F.col("column") == n).select(F.col("value").alias(n), F.col("rank").alias(f"_rank_{n}"))
            ranked = ranked.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, n)
        pairs = list(combinations(names, 2))
        tables.append(
            _pair_table(ranked, pairs, lambda a, b: weighted_corr(F.col("_n"), col(f"_rank_{a}"), col(f"_rank_{b}")))
        )
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def weighted_corr(weight: Column, x: Column, y: Column) -> Column:
    """Pearson correlation where each row stands for ``weight`` equal rows."""
    w = weight.cast("double")
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) - F.try_divide(sx * sy, n)
    vx = F.sum(w * x * x) - F.try_divide(sx * sx, n)
    vy = F.sum(w * y * y) - F.try_divide(sy * sy, n)
    return F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))


def kendall_pairs(df: DataFrame, columns: Sequence[str], small: int = SMALL_ROWS) -> DataFrame:
    """Kendall's tau-b over complete pairs.

    Concordant and discordant pairs are counted without forming them. The second variable is
    replaced by its dense rank; two cells first differ at exactly one bit of that rank, so per
    (bit, higher bits) group a running total along the first variable counts the zero- and one-bit
    cells to the left. That is one row per cell and bit, and any skew is handled by the running
    totals.
    """
    pairs = list(combinations(columns, 2))
    tall = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("pair"), num(a).alias("x"), num(b).alias("y"))
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        ).alias("_e")
    ).select("_e.*")
    cells = tall.where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(cells)
    ys = cells.groupBy("pair", "y").agg(F.lit(1).alias("one"))
    ys = running_totals(ys, ["pair"], "y", ["one"], small=small)
    ranked = materialize(cells.join(ys.select("pair", "y", F.col("one_before").alias("r")), ["pair", "y"]))
    top = ranked.agg(F.max("r").alias("m")).first()["m"] or 0
    bits = max(1, int(top).bit_length())
    level = ranked.select(
        "pair", "x", "n", "r", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("b")
    ).select(
        "pair",
        "x",
        "b",
        F.expr("shiftright(r, b + 1)").alias("head"),
        F.when(F.expr("shiftright(r, b) & 1") == 1, F.col("n")).otherwise(0).alias("ones"),
        F.when(F.expr("shiftright(r, b) & 1") == 0, F.col("n")).otherwise(0).alias("zeros"),
    )
    level = level.groupBy("pair", "b", "head", "x").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    level = running_totals(level, ["pair", "b", "head"], "x", ["ones", "zeros"], small=small)
    d = lambda c: F.col(c).cast("double")
    scores = level.groupBy("pair").agg(
        F.sum(d("ones") * d("zeros_before") - d("zeros") * d("ones_before")).alias("s")
    )

    def tied(keys):
        g = cells.groupBy("pair", *keys).agg(F.sum("n").cast("double").alias("m"))
        return g.groupBy("pair").agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("t"), F.sum("m").alias("size"))

    tx, ty = tied(["x"]), tied(["y"])
    names = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, var1 string, var2 string"
    )
    n0 = F.col("size") * (F.col("size") - 1) / 2
    return (
        names.join(scores, "pair", "left")
        .join(tx.withColumnRenamed("t", "tx"), "pair", "left")
        .join(ty.select("pair", F.col("t").alias("ty")), "pair", "left")
        .select(
            "var1",
            "var2",
            F.try_divide(F.col("s"), F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))).alias("correlation"),
        )
    )


def correlation(
    df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None, small: int = SMALL_ROWS
) -> DataFrame:
    """Full matrix in tall form (var1, var2, correlation), both triangles and the diagonal."""
    names = list(columns or numeric_columns(df))
    if method == "pearson":
        upper = pearson_pairs(df, names)
    elif method == "spearman":
        upper = spearman_pairs(df, names, small)
    elif method == "kendall":
        upper = kendall_pairs(df, names, small)
    else:
        raise ValueError(f"unknown correlation method: {method}")
    both = upper.select(
        F.explode(
            F.array(
                F.struct(F.col("var1").alias("a"), F.col("var2").alias("b"), F.col("correlation").alias("r")),
                F.struct(F.col("var2").alias("a"), F.col("var1").alias("b"), F.col("correlation").alias("r")),
            )
        ).alias("_e")
    ).select(F.col("_e.a").alias("var1"), F.col("_e.b").alias("var2"), F.col("_e.r").alias("correlation"))
    row = df.agg(F.lit(1), *[(F.stddev_pop(num(c)) > 0).alias(f"_c{i}") for i, c in enumerate(names)])
    diagonal = stack_rows(
        row,
        [
            {"var1": F.lit(c), "var2": F.lit(c), "correlation": F.when(F.col(f"_c{i}"), F.lit(1.0))}
            for i, c in enumerate(names)
        ],
    )
    return both.unionByName(diagonal)


def high_corr_pairs(
    df: DataFrame, threshold: float = fixed.HIGH_CORRELATION, method: str = "pearson", columns: Sequence[str] | None = None
) -> DataFrame:
    """Pairs of the upper triangle with absolute correlation at or above the threshold."""
    names = list(columns or numeric_columns(df))
    table = {"pearson": pearson_pairs, "spearman": spearman_pairs, "kendall": kendall_pairs}[method](df, names)
    return table.where(F.abs("correlation") >= threshold).orderBy(F.desc(F.abs("correlation")), "var1", "var2")


def target_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(variable, correlation, importance): r of each numeric column to the target, largest first."""
    names = [c for c in (columns or numeric_columns(df)) if c != target]
    table = _pair_table(df, [(c, target) for c in names], lambda a, b: safe_corr(num(a), num(b)))
    return table.select(
        F.col("var1").alias("variable"), "correlation", F.abs("correlation").alias("importance")
    ).orderBy(F.desc("correlation"), "variable")


def heatmap_correlation(df: DataFrame, columns: Sequence[str] | None = None, max_missing: float = 0.5) -> DataFrame:
    """Correlation matrix without the columns that are half empty or worse."""
    names = list(columns or numeric_columns(df))
    gaps = df.agg(F.lit(1), *[F.avg(missing(df, c).cast("int")).alias(f"_c{i}") for i, c in enumerate(names)]).first()
    return correlation(df, columns=[c for i, c in enumerate(names) if (gaps[f"_c{i}"] or 0.0) < max_missing])


def interaction_numeric(df: DataFrame, a: str, b: str, target: str | None = None) -> DataFrame:
    """Correlation of two columns, and of their product with the target."""
    product = safe_corr(num(a) * num(b), num(target)) if target else F.lit(None).cast("double")
    return df.agg(
        F.lit(a).alias("feature1"),
        F.lit(b).alias("feature2"),
        safe_corr(num(a), num(b)).alias("correlation"),
        product.alias("interaction_corr_with_target"),
    )


def interaction_mixed(df: DataFrame, number: str, category: str) -> DataFrame:
    """Variance of the group means of ``number``."""
    means = df.where(col(category).isNotNull()).groupBy(col(category)).agg(F.avg(num(number)).alias("_m"))
    return means.agg(
        F.lit(number).alias("feature1"),
        F.lit(category).alias("feature2"),
        F.variance("_m").alias("group_means_variance"),
    )


def interaction_categorical(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square association of two categorical columns."""
    from brightlake.operators.inference import chi2_independence

    return chi2_independence(df, a, b).select(
        F.col("var1").alias("feature1"), F.col("var2").alias("feature2"), "chi2", "dof", "p_value"
    )


def feature_interactions(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """All pairs of features, each by the rule for its two types, in one tall table."""
    out = None
    cats = set(categorical_columns(df))
    for a, b in combinations(features, 2):
        if is_numeric(df, a) and is_numeric(df, b):
            part = interaction_numeric(df, a, b, target).withColumn("kind", F.lit("numeric-numeric"))
        elif a in cats and b in cats:
            part = interaction_categorical(df, a, b).withColumn("kind", F.lit("categorical-categorical"))
        elif is_numeric(df, a) and b in cats:
            part = interaction_mixed(df, a, b).withColumn("kind", F.lit("numeric-categorical"))
        elif is_numeric(df, b) and a in cats:
            part = interaction_mixed(df, b, a).withColumn("kind", F.lit("categorical-numeric"))
        else:
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# ---- relevance ---------------------------------------------------------------------------------

def _binned(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, Column]:
    """String code per column: quantile bin of a number, the value itself for a category."""
    numbers = [c for c in columns if is_numeric(df, c)]
    cuts = quantile_row(df, numbers, [i / bins for i in range(1, bins)])
    codes: dict[str, Column] = {}
    for c in columns:
        if c in numbers:
            edges = sorted({e for e in cuts[c] if e is not None})
            step = sum(((num(c) > F.lit(e)).cast("int") for e in edges), F.lit(0))
            codes[c] = F.when(num(c).isNotNull(), step.cast("string"))
        else:
            codes[c] = col(c).cast("string")
    return codes


def mutual_information(df: DataFrame, target: str, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """(variable, importance): mutual information in nats of each column with the target, numbers
    in quantile bins. Only contingency counts leave the first stage."""
    names = [c for c in (columns or numeric_columns(df) + categorical_columns(df)) if c != target]
    codes = _binned(df, [*names, target], bins)
    wide = df.select(codes[target].alias("_t"), *[codes[c].alias(c) for c in names]).where("_t IS NOT NULL")
    cells = (
        wide.unpivot(["_t"], [col(c) for c in names], "variable", "value")
        .where("value IS NOT NULL")
        .groupBy("variable", "value", "_t")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    cells = materialize(cells)
    # I = (sum n log n - sum row log row - sum col log col + N log N) / N, each sum over its own counts
    logs = lambda c: F.sum(F.col(c) * F.log(F.col(c)))
    both = cells.groupBy("variable").agg(logs("n").alias("_xy"), F.sum("n").alias("_all"))
    rows = cells.groupBy("variable", "value").agg(F.sum("n").alias("m")).groupBy("variable").agg(logs("m").alias("_x"))
    cols = cells.groupBy("variable", "_t").agg(F.sum("n").alias("m")).groupBy("variable").agg(logs("m").alias("_y"))
    total = F.col("_all")
    score = (F.col("_xy") - F.col("_x") - F.col("_y") + total * F.log(total)) / total
    return (
        both.join(rows, "variable")
        .join(cols, "variable")
        .select("variable", F.greatest(score, F.lit(0.0)).alias("importance"))
        .orderBy(F.desc("importance"), "variable")
    )


def forest_importance(
    df: DataFrame, target: str, columns: Sequence[str] | None = None, trees: int = 50, seed: int = 42
) -> DataFrame:
    """(variable, importance): forest importances with one-hot categories summed per column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    names = [c for c in (columns or numeric_columns(df) + categorical_columns(df)) if c != target]
    numbers = [c for c in names if is_numeric(df, c)]
    texts = [c for c in names if c not in numbers]
    regression = is_numeric(df, target)
    data = df.select(
        *[num(c).alias(c) for c in numbers],
        *[col(c).cast("string").alias(c) for c in texts],
        (num(target) if regression else col(target).cast("string")).alias(target),
    ).dropna()
    data = even_shares(data)
    stages = []
    for c in texts:
        stages.append(StringIndexer(inputCol=c, outputCol=f"_i_{c}", stringOrderType="alphabetAsc"))
    if texts:
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in texts], outputCols=[f"_h_{c}" for c in texts]))
    stages.append(VectorAssembler(inputCols=[*numbers, *[f"_h_{c}" for c in texts]], outputCol="_x"))
    label = target
    if not regression:
        stages.append(StringIndexer(inputCol=target, outputCol="_y"))
        label = "_y"
    forest = (RandomForestRegressor if regression else RandomForestClassifier)(
        featuresCol="_x", labelCol=label, numTrees=trees, seed=seed
    )
    model = Pipeline(stages=[*stages, forest]).fit(data)
    widths = [1] * len(numbers)
    for i, _ in enumerate(texts):
        widths.append(max(len(model.stages[i].labels) - 1, 0))
    scores, at = [], 0
    weights = model.stages[-1].featureImportances.toArray()
    for c, w in zip([*numbers, *texts], widths):
        scores.append((c, float(weights[at : at + w].sum())))
        at += w
    return df.sparkSession.createDataFrame(
        sorted(scores, key=lambda s: (-s[1], s[0])), "variable string, importance double"
    )
