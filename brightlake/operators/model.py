"""Regression and classification: preparation, training, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from brightlake.functions.columns import col, is_numeric, num, numeric_columns, ratio
from brightlake.operators.impute import medians, with_gaps
from brightlake.plans.sampling import hash_order
from brightlake.session import even_shares, materialize

X, Y, TEST = "features", "label", "is_test"


def prepare_ml(
    df: DataFrame, target: str, key: Sequence[str], test_size: float = 0.2, seed: int = 42, columns: Sequence[str] | None = None
) -> DataFrame:
    """(key..., numeric features with medians for gaps, label, is_test, problem).

    A numeric target is a regression, anything else a classification. The split follows a hash of the
    key, so it needs no shuffle and a row stays on its side when the data grows.
    """
    names = [c for c in (columns or numeric_columns(df)) if c != target and c not in key]
    middle = medians(df, with_gaps(df, names))
    regression = is_numeric(df, target)
    label = num(target) if regression else col(target).cast("string")
    share = F.pmod(hash_order(key, seed), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return df.where(col(target).isNotNull()).select(
        *[col(k) for k in key],
        *[F.coalesce(num(c), F.lit(middle.get(c)).cast("double")).alias(c) for c in names],
        label.alias(Y),
        (share < test_size).alias(TEST),
        F.lit("regression" if regression else "classification").alias("problem"),
    )


def feature_names(data: DataFrame, key: Sequence[str]) -> list[str]:
    return [c for c in data.columns if c not in (*key, Y, TEST, "problem")]


def _fit(data: DataFrame, key: Sequence[str], estimator, classify: bool):
    names = feature_names(data, key)
    stages = [VectorAssembler(inputCols=names, outputCol=X)]
    if classify:
        stages.append(StringIndexer(inputCol=Y, outputCol="_y", stringOrderType="alphabetAsc").fit(data))
    train = data.where(~F.col(TEST))
    if isinstance(estimator, (RandomForestClassifier, RandomForestRegressor)):
        train = even_shares(train)
    model = Pipeline(stages=[*stages, estimator]).fit(train)
    scored = model.transform(data.where(TEST))
    if classify:
        scored = IndexToString(inputCol="prediction", outputCol="_p", labels=stages[-1].labels).transform(scored)
        scored = scored.drop("prediction").withColumnRenamed("_p", "prediction")
    return model, scored.select(*[col(k) for k in key], F.col(Y).alias("actual"), "prediction")


def linear_regression(data: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., actual, prediction) on the test part."""
    return _fit(data, key, LinearRegression(featuresCol=X, labelCol=Y), False)[1]


def linear_coefficients(data: DataFrame, key: Sequence[str]) -> DataFrame:
    """(feature, coefficient) with the intercept, fitted on the training part."""
    model = _fit(data, key, LinearRegression(featuresCol=X, labelCol=Y), False)[0].stages[-1]
    rows = [*zip(feature_names(data, key), (float(c) for c in model.coefficients)), ("intercept", float(model.intercept))]
    return data.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def random_forest_regression(data: DataFrame, key: Sequence[str], trees: int = 100, seed: int = 42) -> DataFrame:
    return _fit(data, key, RandomForestRegressor(featuresCol=X, labelCol=Y, numTrees=trees, seed=seed), False)[1]


def logistic_regression(data: DataFrame, key: Sequence[str], max_iter: int = 1000) -> DataFrame:
    return _fit(data, key, LogisticRegression(featuresCol=X, labelCol="_y", maxIter=max_iter), True)[1]


def random_forest_classification(data: DataFrame, key: Sequence[str], trees: int = 100, seed: int = 42) -> DataFrame:
    return _fit(data, key, RandomForestClassifier(featuresCol=X, labelCol="_y", numTrees=trees, seed=seed), True)[1]


def forest_feature_importance(data: DataFrame, key: Sequence[str], trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance) of the forest for the problem of ``data``."""
    classify = data.schema[Y].dataType.typeName() == "string"
    forest = (
        RandomForestClassifier(featuresCol=X, labelCol="_y", numTrees=trees, seed=seed)
        if classify
        else RandomForestRegressor(featuresCol=X, labelCol=Y, numTrees=trees, seed=seed)
    )
    weights = _fit(data, key, forest, classify)[0].stages[-1].featureImportances.toArray()
    rows = sorted(zip(feature_names(data, key), (float(w) for w in weights)), key=lambda r: (-r[1], r[0]))
    return data.sparkSession.createDataFrame(rows, "feature string, importance double")


# ---- reports -----------------------------------------------------------------------------------

def classification_report(scored: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) per class, then macro and weighted averages and the
    accuracy. Everything follows from the confusion counts."""
    cells = scored.groupBy(col(actual).cast("string").alias("a"), col(prediction).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    cells = materialize(cells)  # the rows are scored once, for classes and averages alike
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("found"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("found"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("_e")
    ).select("_e.*")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "found", "hit")])
    per = per.withColumns(
        {"precision": zero(ratio(F.col("hit"), F.col("found"))), "recall": zero(ratio(F.col("hit"), F.col("support")))}
    ).withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    figures = ("precision", "recall", "f1")
    total = F.sum("support")
    sums = per.agg(
        total.alias("support"),
        ratio(F.sum("hit"), total).alias("accuracy"),
        *[F.avg(c).alias(f"m_{c}") for c in figures],
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(f"w_{c}") for c in figures],
    )
    extra = sums.select(
        F.explode(
            F.array(
                F.struct(F.lit("macro avg").alias("class"), *[F.col(f"m_{c}").alias(c) for c in figures], F.col("support")),
                F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"w_{c}").alias(c) for c in figures], F.col("support")),
                F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(c) for c in figures], F.col("support")),
            )
        ).alias("_e")
    ).select("_e.*")
    return per.select("class", *figures, "support").unionByName(extra)


def regression_report(scored: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """(n, rmse, r2)."""
    off = num(actual) - num(prediction)
    return scored.agg(
        F.count(off).alias("n"),
        F.sqrt(F.avg(off * off)).alias("rmse"),
        (1 - F.try_divide(F.avg(off * off), F.var_pop(num(actual)))).alias("r2"),
    )
