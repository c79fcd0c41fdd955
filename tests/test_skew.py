"""Joins that split hot keys, against plain joins."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from brightlake.operators import join
from brightlake.plans import skew

KINDS = ["inner", "left", "right", "full"]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def sides(spark):
    # a third of the left rows have no key, a third of the right ones key 7; keys 1 and 2 stand on one side only
    left = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 50 == 1, 7).when(F.col("id") % 5 == 1, 1).otherwise(F.col("id") % 40 + 10).cast("int").alias("a"),
        F.col("id").alias("x"),
    )
    right = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 1, 2).when(F.col("id") % 100 == 2, None).otherwise(F.col("id") % 45 + 10).cast("long").alias("b"),
        F.col("id").alias("y"),
    )
    return left, right


def test_hot_keys_are_counted(spark, sides):
    left, right = sides
    found = skew.hot_keys(left, [["a"], ["x"], ["a", "x"]], rows=50)
    h = {r["a"]: r["h"] for r in left.select("a", skew.key_hash(left, ["a"]).alias("h")).distinct().collect()}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fair = max(50, 600 / parts)
    counts = Counter(r["a"] for r in left.collect())
    assert found[0] == {h[k]: min(parts, -int(-n // fair)) for k, n in counts.items() if n > fair}
    assert None in {k for k in counts if h[k] in found[0]} and found[1] == found[2] == {}
    assert skew.hot_keys(left.limit(0), [["a"]]) == [{}]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("which", ["both", "left", "right"])
def test_split_join_equals_plain(sides, kind, which):
    left, right = sides
    hot_left = skew.hot_keys(left, [["a"]], rows=20)[0] if which != "right" else {}
    hot_right = skew.hot_keys(right, [["b"]], rows=20)[0] if which != "left" else {}
    assert (which == "right" or hot_left) and (which == "left" or hot_right)
    got = skew.split_join(left, right, [("a", "b")], kind, hot_left, hot_right)
    want = left.join(right, F.col("a").eqNullSafe(F.col("b")), kind)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_merges_find_hot_keys_alone(sides, how, monkeypatch):
    left, right = (df.withColumnRenamed(k, "k") for df, k in zip(sides, "ab"))
    plain = rows(join.merge(left, right, "k", how))
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    hot = join.merge(left, right, "k", how)
    assert "xxhash64" in hot._jdf.queryExecution().toString()
    assert rows(hot) == plain
    assert rows(join.merge(left, right.limit(0), "k", how)) == rows(left.join(right.limit(0), "k", how))


def test_chains_and_facts_with_hot_keys(spark, sides, monkeypatch):
    left, right = sides
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    dims = right.groupBy(F.col("b").alias("a")).agg(F.max("y").alias("y"))
    more = spark.range(600).select(F.col("id").alias("x"), (F.col("id") * 2).alias("z"))
    want = Counter((r["a"], r["x"], r["y"], r["x"] * 2) for r in left.join(dims.withColumnRenamed("a", "b"), F.col("a").eqNullSafe(F.col("b")), "left").collect())
    assert rows(join.denormalize(left, [(dims, "a", ["y"]), (more, "x", ["z"])]).select("a", "x", "y", "z")) == want
    assert rows(join.merge_chain(left, [(dims, "a"), (more, "x")]).select("a", "x", "y", "z")) == want


def test_a_hot_key_is_joined_by_many_tasks(spark):
    # 30 % of the left rows hold one key: no join task may see them all
    left = spark.range(10_000).select(F.when(F.col("id") % 10 < 3, -1).otherwise(F.col("id")).alias("a"), F.col("id").alias("x"))
    right = spark.range(1000).select((F.col("id") - 1).alias("b"), F.col("id").alias("y"))
    hot = skew.hot_keys(left, [["a"]], rows=100)[0]
    assert list(hot.values()) == [3]
    got = skew.split_join(left.hint("merge"), right, [("a", "b")], "full", hot, {})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = got.where("a = -1").groupBy(F.spark_partition_id()).count().collect()
        joined = skew.split_join(left.hint("merge"), right, [("a", "b")], "left", hot, {})
        tasks = {r[0] for r in joined.where("a = -1").select(F.spark_partition_id()).distinct().collect()}
        assert sum(r["count"] for r in per_task) == 3000 and len(tasks) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_keys_of_other_types_join_plainly(spark):
    left = spark.createDataFrame([("1", 1), ("2", 2)], "a string, x int")
    right = spark.createDataFrame([(1.0, 5)], "b double, y int")
    assert not skew.comparable(left, right, [("a", "b")])
    assert rows(skew.split_join(left, right, [("a", "b")], "inner", {1: 2}, {})) == Counter({("1", 1, 1.0, 5): 1})


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("swap", [False, True])
def test_keys_with_many_pairs_are_split(spark, kind, swap, monkeypatch):
    # no key holds many rows, but key 0 and null give 200 * 20 pairs each
    big = spark.range(1000).select(F.when(F.col("id") % 5 == 1, None).otherwise(F.col("id") % 5).alias("a"), F.col("id").alias("x"))
    small = spark.range(80).select(F.when(F.col("id") % 4 == 1, None).otherwise(F.col("id") % 4 * F.lit(3)).alias("b"), F.col("id").alias("y"))
    left, right, on = (small, big, [("b", "a")]) if swap else (big, small, [("a", "b")])
    want = rows(left.join(right, F.col("a").eqNullSafe(F.col("b")), kind))
    monkeypatch.setattr(skew, "PAIRS", 500)
    hot, rest, many = skew.crowded(*(skew.hot_keys(df, [[k]])[0] for df, k in ((left, on[0][0]), (right, on[0][1]))))
    assert many and sorted((rest if swap else hot).values()) == [8, 8] and not (hot if swap else rest)
    got = skew.split_join(left, right, on, kind)
    assert rows(got) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = skew.split_join(left, right, on, "inner").where("a = 0").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == 4000 and len(tasks) > 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_salted_rows_are_joined_by_many_tasks(spark):
    # a side small enough for a broadcast must not leave the salted rows in the task that reads them
    left = spark.range(800).select(F.lit(1).alias("k"), F.col("id").alias("x")).coalesce(1)
    right = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("y"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in ("inner", "left", "right", "outer"):
            tasks = join.merge(left, right, "k", how, salt=8).groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in tasks) == 8000 and len(tasks) > 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_copies_follow_the_rows_and_not_the_pairs(spark, monkeypatch):
    # 600,000 pairs of one key, each worth a task of its own
    left, right = spark.range(2000).select(F.lit(1).alias("a"), F.col("id").alias("x")), spark.range(300).select(F.lit(1).alias("b"), F.col("id").alias("y"))
    made, copied = [], skew._copied
    monkeypatch.setattr(skew, "PAIRS", 1)
    monkeypatch.setattr(skew, "_copied", lambda *args: made.append(copied(*args)) or made[-1])
    joined = skew.split_join(left, right, [("a", "b")], "inner")
    assert sum(df.count() for df in made) <= 2000 + 300 * 512  # 309,200 with a sub-key for every pair
    assert joined.count() == 600_000


@pytest.mark.parametrize("how, salt", [("left", None), ("outer", None), ("right", None), ("outer", 8), ("inner", None), ("inner", 8)])
def test_many_pairs_come_in_blocks(spark, how, salt):
    # 2.2 million pairs: every task has all 1,000 rows of the right side, of which few may lie next to each other
    left = spark.range(2205).select(F.when(F.col("id") < 2200, None).otherwise(F.col("id")).cast("int").alias("k"), F.col("id").alias("x"))
    right = spark.range(1003).select(F.when(F.col("id") < 1000, None).otherwise(-F.col("id")).cast("long").alias("k"), F.col("id").alias("y"))
    got = join.merge(left, right, "k", how, salt=salt).withColumn("at", F.monotonically_increasing_id()).cache()
    assert got.select("k", "x", "y").distinct().count() == got.count() == 2_200_000 + 5 * (how in ("left", "outer")) + 3 * (how in ("right", "outer"))
    pairs = got.where("x < 2200 AND y < 1000 AND k IS NULL")
    near = pairs.groupBy(F.floor(F.col("at") / 4096)).agg(F.count_distinct("y").alias("n")).agg(F.avg("n")).first()[0]
    assert pairs.count() == 2_200_000 and near < 500
    got.unpersist()


def test_blocks_of_signed_zeros_and_nans(spark, monkeypatch):
    values = "(VALUES (0.0D), (-0.0D), (double('NaN')), (CAST(NULL AS DOUBLE)), (1.5D)) v(k)"
    left = spark.sql(f"SELECT k AS a, id AS x FROM {values}, range(50)")
    right = spark.sql(f"SELECT k AS b, id AS y FROM {values}, range(40) WHERE NOT k <=> 1.5D")
    monkeypatch.setattr(skew, "PAIRS", 500)
    for kind in KINDS:
        got, want = (df.groupBy(F.col("a").cast("string"), F.col("b").cast("string")).count() for df in (skew.split_join(left, right, [("a", "b")], kind), left.join(right, F.col("a").eqNullSafe(F.col("b")), kind)))
        assert rows(got) == rows(want)
