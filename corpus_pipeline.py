"""The corpus pipeline: documents go through five operators, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which
returns the ids. ``run`` writes each stage's result as Parquet in the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brightlake.llm import bpe, decontaminate, lines, neardup, toxicity
from brightlake.llm.common import table
from brightlake.llm.queries import vocabulary
from brightlake.session import stored


def _without(docs: DataFrame, reject: DataFrame) -> DataFrame:
    ids = reject.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field does not reject."""
    found = toxicity.scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1")
    return _without(docs, found)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of recurring templates."""
    kept = lines.drop_recurring(docs)
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return _without(docs, neardup.near_duplicates(docs).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), reach=None)
    return _without(docs, found.where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document left, with digests of the ids and of the text they decode to."""
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: The stages are trained models and whole-corpus comparisons; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents that pass every stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
