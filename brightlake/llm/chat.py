"""Chat formatting with collapse of cumulative snapshots (DataFrame functions only).

A logging system stores a conversation again after each turn, so many logged conversations are
prefixes of longer ones. Every turn gets a rolling hash of all turns up to it; a conversation whose last
hash is an inner hash of another is a prefix of it and goes by an anti-join; of equal conversations
the smallest conv_id stays. The others are rendered, turn by turn.

Turns are ordered by (turn, role, content); rows equal in conv_id, turn, role and text count once.
Null role counts as "user", null text as ""; null turns come first; rows with a null conv_id form one
conversation. Other columns are ignored. An empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_BITS = 40  # summands below 2^40: no overflow before 2^23 turns


def turns_of(conversations: DataFrame) -> DataFrame:
    """Turns without repeated rows, numbered from 1 within each conversation."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    same = F.struct("turn", "role", "tie")
    rows = rows.withColumn("again", F.coalesce(same.eqNullSafe(F.lag(same).over(order)), F.lit(False))).where("not again")
    return rows.select("conv_id", "turn", "role", "text", "tie", F.row_number().over(order).alias("n"))


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, h1, h2, h3): 120 bits of hash over the first n turns, each the last plus the turn's own."""
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)

    def part(seed: int) -> Column:
        return F.sum(F.pmod(F.xxhash64(F.lit(seed), "n", "role", "text"), F.lit(1 << _BITS))).over(upto)

    return turns.select("conv_id", "n", *[part(i).alias(f"h{i}") for i in (1, 2, 3)])


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id and length of the conversations that are no prefix of another."""
    key = ["n", "h1", "h2", "h3"]
    size = Window.partitionBy("conv_id")
    sized = hashes.withColumn("last", F.max("n").over(size))
    # one row per distinct conversation and per distinct inner prefix, however many share it
    whole = sized.where("n = last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = sized.where("n < last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, text): the turns of each conversation between role marks."""
    one = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", one.alias("body")))), lambda x: x["body"]), "").alias("text")
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, text) of every maximal conversation."""
    turns = turns_of(conversations)
    kept = maximal(rolling_hashes(turns)).withColumnRenamed("conv_id", "__conv")
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    rendered = render(turns.join(kept.select("__conv"), same, "left_semi"))
    return rendered.join(kept, same).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"), "text")


#: The same over the whole table in DuckDB: prefixes as lists of digests.
ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, list(md5(role || chr(0) || text) ORDER BY turn, role, text) AS d, count(*) AS n_turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS body
  FROM t GROUP BY conv_id
), w AS (
  SELECT array_to_string(d, ',') AS k, min(conv_id) AS conv_id, count(*) AS copies, any_value(n_turns) AS n_turns,
    any_value(body) AS text
  FROM c GROUP BY 1
), p AS (
  SELECT DISTINCT array_to_string(d[1:i], ',') AS k
  FROM (SELECT d, unnest(range(1, len(d))) AS i FROM c)
)
SELECT conv_id, n_turns, copies, text FROM w WHERE k NOT IN (SELECT k FROM p)
"""
