"""Distinct lines are found by hashing, and words are counted in bytes."""

from pyspark.sql import functions as F

from brightlake.llm import lines


def test_distinct_lines_are_hashed_not_sorted(spark):
    rows = [(i, "Größe 12 über  alles\n\n a b \nGröße 7 über  alles") for i in range(3)] + [(3, None), (None, "x")]
    parsed = lines.parsed(spark.createDataFrame(rows, "doc_id long, text string"))
    kinds = lines.distinct_lines(parsed)
    plan = kinds._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert {(r["masked"], r["n"]) for r in kinds.collect()} == {("Größe <*> über  alles", 6), ("a b", 3), ("x", 1)}
    words = parsed.groupBy("masked").agg(F.collect_set("n_words").alias("n"))
    assert {r["masked"]: r["n"] for r in words.collect()} == {"Größe <*> über  alles": [5], "a b": [2], "x": [1]}
