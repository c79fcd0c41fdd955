"""Every stage of the pipeline on its own input."""

import corpus_pipeline
from brightlake.llm import queries
from brightlake.session import stored
from tests.llm.test_operators import brute_classes, brute_contamination, texts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = texts(docs)
        docs = stored(stage(spark, docs, SF), name)
        if name == "bpe_encoding":
            assert docs.count() == len(before)
            break
        assert docs.columns == columns
        after = texts(docs)
        if name == "line_dedup":
            assert len(after) == len(before)
        if name == "minhash_near_dedup":
            classes = brute_classes(before)
            assert {d for d, _ in after} == {d for d, (_, root) in classes.items() if d == root}
        if name == "benchmark_decontamination":
            bad = brute_contamination(before, items)
            assert {d for d, _ in after} == {d for d, t in before if not bad[d, t][4]}


def test_all_numbers_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
