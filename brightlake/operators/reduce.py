"""Feature matrices and principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from brightlake.functions.columns import col, num, numeric_columns
from brightlake.operators.encode import scale_parameters
from brightlake.operators.impute import medians, with_gaps

FEATURES = "features"


@dataclass
class Scaling:
    """Medians for columns with gaps, and (centre, width) of every filled column."""

    columns: list[str]
    medians: dict[str, float | None]
    params: dict[str, tuple[float, float]]


def fit_scaling(df: DataFrame, columns: Sequence[str] | None = None, scaler: str = "standard") -> Scaling:
    names = list(columns or numeric_columns(df))
    middle = medians(df, with_gaps(df, names))
    filled = df.select(*[F.coalesce(num(c), F.lit(middle.get(c)).cast("double")).alias(c) for c in names])
    return Scaling(names, middle, scale_parameters(filled, names, scaler))


def scaled_columns(
    df: DataFrame, columns: Sequence[str] | None = None, scaler: str = "standard", fit: Scaling | None = None
) -> DataFrame:
    """``df`` with its numeric columns median-filled and scaled under ``_f_<name>`` names."""
    fit = fit or fit_scaling(df, columns, scaler)
    new = {}
    for c in fit.columns:
        centre, width = fit.params.get(c, (0.0, 1.0))
        filled = F.coalesce(num(c), F.lit(fit.medians.get(c)).cast("double"))
        new[f"_f_{c}"] = (filled - F.lit(centre)) / F.lit(width)
    return df.withColumns(new)


def feature_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, scaler: str = "standard", fit: Scaling | None = None
) -> DataFrame:
    """``df`` with a ``features`` vector of its filled and scaled numeric columns."""
    fit = fit or fit_scaling(df, columns, scaler)
    names = [f"_f_{c}" for c in fit.columns]
    wide = scaled_columns(df, fit=fit)
    return VectorAssembler(inputCols=names, outputCol=FEATURES).transform(wide).drop(*names)


@dataclass
class Components:
    """Fitted components: small, feature-sized values on the driver."""

    features: list[str]
    scaling: Scaling
    loadings: list[list[float]]  # one list per component, its largest entry positive
    ratios: list[float]

    @property
    def size(self) -> int:
        return len(self.ratios)


def fit_pca(df: DataFrame, n: int = 2, columns: Sequence[str] | None = None, scaler: str = "standard") -> Components:
    """Components of the scaled features; the covariance is one distributed aggregate."""
    names = list(columns or numeric_columns(df))
    scaling = fit_scaling(df, names, scaler)
    vectors = feature_matrix(df, fit=scaling).select(FEATURES)
    model = PCA(k=min(n, len(names)), inputCol=FEATURES, outputCol="_pc").fit(vectors)
    table = model.pc.toArray()
    loadings = []
    for i in range(table.shape[1]):
        v = table[:, i]
        sign = 1.0 if v[abs(v).argmax()] >= 0 else -1.0
        loadings.append([float(x * sign) for x in v])
    return Components(names, scaling, loadings, [float(x) for x in model.explainedVariance.toArray()])


def pca(df: DataFrame, n: int = 2, columns: Sequence[str] | None = None, scaler: str = "standard", fit: Components | None = None) -> DataFrame:
    """Scores PC1..PCn with the non-numeric columns passed through."""
    fit = fit or fit_pca(df, n, columns, scaler)
    wide = scaled_columns(df, fit=fit.scaling)
    scores = [
        sum((F.col(f"_f_{c}") * F.lit(w) for c, w in zip(fit.features, loading)), F.lit(0.0)).alias(f"PC{i + 1}")
        for i, loading in enumerate(fit.loadings)
    ]
    numbers = set(numeric_columns(df))
    return wide.select(*scores, *[col(c) for c in df.columns if c not in numbers])


def loadings_table(df: DataFrame, fit: Components) -> DataFrame:
    """(component, explained_variance, feature, loading)."""
    rows = [
        (f"PC{i + 1}", fit.ratios[i], c, w) for i, loading in enumerate(fit.loadings) for c, w in zip(fit.features, loading)
    ]
    return df.sparkSession.createDataFrame(rows, "component string, explained_variance double, feature string, loading double")


def biplot_loadings(df: DataFrame, factor: float = 0.7, columns: Sequence[str] | None = None, scaler: str = "standard") -> DataFrame:
    """Loadings stretched to ``factor`` of the score range."""
    fit = fit_pca(df, 2, columns, scaler)
    reach = pca(df, fit=fit).agg(
        F.greatest(*[F.max(F.abs(f"PC{i + 1}")) for i in range(fit.size)], F.lit(0.0)).alias("m")
    ).first()["m"]
    top = max(abs(w) for loading in fit.loadings for w in loading) or 1.0
    return loadings_table(df, fit).withColumn("scaled_loading", F.col("loading") * F.lit(reach / top * factor))


def pca_importance(df: DataFrame, n: int = 2, columns: Sequence[str] | None = None, scaler: str = "standard") -> DataFrame:
    """(feature, importance): absolute loadings weighted by the variance ratio, summing to one."""
    fit = fit_pca(df, n, columns, scaler)
    scored = loadings_table(df, fit).groupBy("feature").agg(
        F.sum(F.abs("loading") * F.col("explained_variance")).alias("_i")
    )
    total = F.sum("_i").over(Window.partitionBy(F.lit(1)))
    return scored.select("feature", F.coalesce(F.try_divide(F.col("_i"), total), F.lit(0.0)).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def optimal_components(
    df: DataFrame, threshold: float = 0.95, max_components: int | None = None, columns: Sequence[str] | None = None,
    scaler: str = "standard",
) -> DataFrame:
    """(n_components, explained_variance_ratio, cumulative_variance_ratio, is_optimal): the first count
    that reaches the threshold, or the last one."""
    names = list(columns or numeric_columns(df))
    fit = fit_pca(df, min(max_components or len(names), len(names)), names, scaler)
    rows, total, chosen = [], 0.0, None
    for i, r in enumerate(fit.ratios, 1):
        total += r
        if chosen is None and total >= threshold - 1e-12:
            chosen = i
        rows.append((i, r, total))
    chosen = chosen or fit.size
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == chosen) for r in rows],
        "n_components int, explained_variance_ratio double, cumulative_variance_ratio double, is_optimal boolean",
    )


def component_interpretation(
    df: DataFrame, n: int = 2, top: int = 5, columns: Sequence[str] | None = None, scaler: str = "standard"
) -> DataFrame:
    """The strongest features of each component with their sign."""
    table = loadings_table(df, fit_pca(df, n, columns, scaler)).withColumn("loading_abs", F.abs("loading"))
    w = Window.partitionBy("component").orderBy(F.desc("loading_abs"), "feature")
    return (
        table.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= top)
        .drop("_r")
        .withColumn("direction", F.when(F.col("loading") > 0, "positive").otherwise("negative"))
    )
