"""Reading files, naming tables, running SQL over them, writing results, and a log of merges."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightlake.operators.clean import load_cleanup

# Names of the Korean Windows charset that Spark and the JVM accept.
KOREAN_CHARSET = "x-windows-949"


def _is_utf8(spark: SparkSession, path: str) -> bool:
    """True if every line is valid UTF-8; the search ends at the first one that is not."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() == 0


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """CSV with a header, as UTF-8 or else in the Korean charset. Give a schema for large files:
    inferring one reads the data an extra time."""
    if encoding is None:
        encoding = "UTF-8" if _is_utf8(spark, path) else KOREAN_CHARSET
    reader = spark.read.option("header", True).option("encoding", encoding)
    if encoding != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """JSON records: an array per file, or one record per line (which splits over many tasks)."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_table(spark: SparkSession, path: str, clean: bool = True, **options) -> DataFrame:
    """File or folder by extension, through the load clean-up unless switched off."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        df = read_csv(spark, path, **options)
    elif kind in (".json", ".jsonl"):
        df = read_json(spark, path, lines=kind == ".jsonl", **options)
    elif kind == ".parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported file type: {kind or path}")
    return load_cleanup(df) if clean else df


def write_result(df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = ()) -> None:
    """CSV with header, JSON records or Parquet, written by all executors."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


class Tables:
    """Named tables as temporary views, and a log of what was merged from what."""

    LOG = "name string, kind string, inputs string, keys string, how string, row_count long, column_count int, seconds double"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.names: list[str] = []
        self.log: list[tuple] = []

    def add(self, name: str, df: DataFrame) -> str:
        """Register under a view name; a taken name gets the number of tables appended."""
        name = re.sub(r"\W+", "_", name)
        if name in self.names:
            name = f"{name}_{len(self.names)}"
        df.createOrReplaceTempView(name)
        self.names.append(name)
        return name

    def load(self, paths: Sequence[str], clean: bool = True) -> list[str]:
        """Register every file under its stem."""
        return [
            self.add(os.path.splitext(os.path.basename(p.rstrip("/")))[0], read_table(self.spark, p, clean)) for p in paths
        ]

    def get(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)
        self.names.remove(name)

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(query)

    def record(self, name: str, df: DataFrame, path: str, kind: str = "merge", inputs: Sequence[str] = (), keys: str = "", how: str = "") -> DataFrame:
        """Write a result, log it with the row count of the written files, and register these."""
        start = time.time()
        df.write.mode("overwrite").parquet(path)
        stored = self.spark.read.parquet(path)
        rows = stored.count()  # answered from the Parquet footers
        self.log.append((name, kind, ",".join(inputs), keys, how, rows, len(df.columns), time.time() - start))
        self.add(name, stored)
        return stored

    def merge_history(self) -> DataFrame:
        """One row per recorded result, oldest first."""
        return self.spark.createDataFrame(self.log, self.LOG)
