"""What stored tables leave behind, and what settings they leave as they were."""

import glob
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brightlake.llm import bpe, lines, toxicity
from brightlake.llm.common import whole_texts
from brightlake.llm.queries import vocabulary
from brightlake.session import BATCH_BYTES, materialize, stored

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}


def test_stored_tables_free_their_shuffles(spark):
    before, setting = shuffle_files(spark), spark.conf.get(KEY)
    for keep in (stored, materialize):
        sums = spark.range(50_000).groupBy((F.col("id") % 1000).alias("key")).agg(F.sum("id").alias("sum"))
        kept = keep(sums)
        left = shuffle_files(spark) - before
        for _ in range(50):
            if not left:
                break
            time.sleep(0.1)
            left = shuffle_files(spark) - before
        assert not left
        assert kept.agg(F.sum("sum")).first()[0] == sum(range(50_000))
        assert sums.count() == 1000  # the frame itself can still be run
        before |= shuffle_files(spark)
    assert spark.conf.get(KEY) == setting


def test_no_line_is_generalised_for_a_filter(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g 12\n \n")], "doc_id long, text string")
    plan = lines.parsed(docs).where("n_words >= 7")
    filters = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]
    assert filters and not any("regexp_replace" in x for x in filters)
    assert [r["masked"] for r in plan.collect()] == ["a b c d e f g <*>"]


def test_python_gets_texts_in_bounded_batches(spark):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    got = whole_texts(docs).mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 64
    assert max(r["bytes"] for r in got) <= BATCH_BYTES + (2 << 20)


def test_a_worker_holds_one_encoder_at_most():
    path = vocabulary()
    assert bpe.id_type(path) == bpe.held(bpe.Splitter, path).id_type
    assert bpe.held(bpe.Splitter, path) is bpe.held(bpe.Splitter, path)
    bpe.held(bpe.ForcedBoundaryEncoder, path)
    assert len(bpe._HELD) == 1
    bpe.release()
    assert not bpe._HELD


def test_scoring_gives_the_encoder_back(spark, monkeypatch):
    class Rows:
        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    monkeypatch.setattr(toxicity, "whole_texts", lambda docs: Rows)
    field = toxicity.Field(*(np.zeros(toxicity.BUCKETS) for _ in range(3)), -20.0, np.zeros((2, 2)))
    run = toxicity.tag(spark.createDataFrame([(1, "a")], "doc_id long, text string"), field)
    bpe.held(bpe.Splitter, vocabulary())
    assert list(run(iter([]))) == []
    assert not bpe._HELD
