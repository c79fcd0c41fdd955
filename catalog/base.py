"""Registry: one entry per operator, the Spark callable next to its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None, dec: str = "", places: int = 6):
    """Register a query; the columns in ``dec`` are rounded on both sides.

    ``dec`` items are ``column`` or ``column:places``.
    """
    digits = {}
    for item in dec.split():
        column, _, p = item.partition(":")
        digits[column] = int(p or places)

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), p) + F.lit(0.0) for c, p in digits.items()}) if digits else df

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip().rstrip(";")
            if digits:
                fix = ", ".join(f"round(CAST({c} AS DOUBLE), {p}) + CAST(0 AS DOUBLE) AS {c}" for c, p in digits.items())
                text = f"SELECT * REPLACE ({fix}) FROM ({text})"
            ORACLES[name] = text
        return fn

    return add
