"""Token ids in binary shards, compressed by Re-Pair grammars.

A shard is a run of whole documents in ascending doc_id order with at least ``SHARD_IDS`` ids (the last
of a range may have fewer). Frequent neighbouring pairs are replaced by nonterminals, round after
round, until no pair is left ``LEAST`` times; a round replaces all pairs at least half as frequent as its most frequent
one, or the ``RULES_A_ROUND`` most frequent ones if these are more. Pairs across the end of a
document stay apart, so the symbols of one document can be cut out and expanded on their own.

File format: a Parquet table with a row per shard: ``part, shard`` (order of the ids), ``doc_ids,
n_tokens`` (arrays), and as little-endian unsigned 32-bit integers ``n_symbols`` (per document),
``symbols``, ``rules`` (left, right, ...; rule r is symbol FIRST + r), ``spans`` (ids that a rule
expands to) and ``rounds`` (rules after each round).

Null texts count as empty and have the end id only. Null doc_ids come last. Repeated rows are written
repeatedly. An empty table gives no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from brightlake.llm.bpe import PieceEncoder, gathered, held, id_type, release
from brightlake.llm.common import cut_points, range_of, slices, whole_texts

SHARD_IDS = 1 << 20
RULES_A_ROUND = 1024
LEAST = 16  # occurrences that make a rule worth its place
FIRST = 1 << 20  # symbols from here on are nonterminals
_BINS = 18
_PASSES = 8  # over places that overlap; what is left after them waits for the next round


def compress(ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(symbols, last, rules, rules after each round); ``last`` marks the last symbol of a document."""
    s, rules, sizes = ids.astype(np.uint32), [], []
    while len(s) > 1:
        h = (s[:-1] * np.uint32(2654435761) ^ (s[1:] + np.uint32(1)) * np.uint32(2246822519)) >> np.uint32(32 - _BINS)
        h = h.astype(np.int64)  # once, not for every look-up
        h[last[:-1]] = 1 << _BINS  # a bin of their own for the pairs across documents
        bins = np.bincount(h, minlength=(1 << _BINS) + 1)
        bins[-1] = 0
        often = min(int(np.partition(bins, -RULES_A_ROUND)[-RULES_A_ROUND]), int(bins.max()) // 2)
        for least in (max(LEAST, often), LEAST):  # a full bin may hold rare pairs only: then all that can be frequent are counted
            at = np.flatnonzero((bins >= least).take(h))
            pairs = s[at].astype(np.uint64) << np.uint64(32) | s[at + 1]
            kinds, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            top = np.argsort(-counts, kind="stable")
            top = top[: max(RULES_A_ROUND, int((2 * counts >= counts.max(initial=0)).sum()))]
            top = top[counts[top] >= LEAST]
            if len(top):
                break
        else:
            break
        number = np.full(len(kinds), -1)
        number[top] = np.arange(len(top))
        good = number[which] >= 0
        at, rank = at[good], number[which[good]]
        # of overlapping places the more frequent pair wins, of equal ones the first
        chosen, free = np.zeros(len(at), bool), np.ones(len(at), bool)
        for _ in range(_PASSES):
            left = np.flatnonzero(free)
            if not len(left):
                break
            touch, r = np.diff(at[left]) == 1, rank[left]
            keep = np.ones(len(left), bool)
            keep[1:] &= ~(touch & (r[:-1] <= r[1:]))
            keep[:-1] &= ~(touch & (r[1:] < r[:-1]))
            gone = keep.copy()
            gone[1:] |= touch & keep[:-1]
            gone[:-1] |= touch & keep[1:]
            chosen[left[keep]], free[left[gone]] = True, False
        at, rank = at[chosen], rank[chosen]
        s[at] = (FIRST + len(rules) // 2 + rank).astype(np.uint32)
        last[at] = last[at + 1]
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        left = np.flatnonzero(stay)
        s, last = s.take(left), last.take(left)
        made = kinds[top]
        rules += np.column_stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)]).ravel().tolist()
        sizes.append(len(rules) // 2)
    return s, last, np.array(rules, np.uint32), sizes


def spans_of(rules: np.ndarray) -> np.ndarray:
    """How many ids each rule expands to."""
    out: list[int] = []
    for a, b in rules.reshape(-1, 2).tolist():
        out.append((out[a - FIRST] if a >= FIRST else 1) + (out[b - FIRST] if b >= FIRST else 1))
    return np.array(out, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, rounds: list[int], spans: np.ndarray | None = None) -> np.ndarray:
    """The ids again: every rule is expanded once, a round's rules from those before, then every symbol is looked up."""
    if not len(rules):
        return symbols.astype(np.uint32)
    spans = (spans_of(rules) if spans is None else spans).astype(np.int64)
    begin = np.cumsum(spans) - spans
    flat = np.empty(int(spans.sum()), np.uint32)

    def put(into: np.ndarray, parts: np.ndarray) -> None:
        rule = parts >= FIRST
        own = parts[rule].astype(np.int64) - FIRST
        size = np.ones(len(parts), np.int64)
        size[rule] = spans[own]
        into[np.repeat(~rule, size)] = parts[~rule]
        into[np.repeat(rule, size)] = gathered(flat, begin[own], spans[own])

    for low, high in zip([0, *rounds], rounds):
        put(flat[begin[low] : begin[high - 1] + spans[high - 1]], rules[2 * low : 2 * high])
    size = np.ones(len(symbols), np.int64)
    rule = symbols >= FIRST
    size[rule] = spans[symbols[rule] - FIRST]
    out = np.empty(int(size.sum()), np.uint32)
    put(out, symbols)
    return out


def document_ids(shard: dict, place: int) -> np.ndarray:
    """Ids of one document of a shard, without expanding the others."""
    counts = np.frombuffer(shard["n_symbols"], "<u4")
    start = int(counts[:place].sum())
    own = np.frombuffer(shard["symbols"], "<u4")[start : start + int(counts[place])]
    return expand(own.copy(), np.frombuffer(shard["rules"], "<u4"), np.frombuffer(shard["rounds"], "<u4").tolist())


def write(docs: DataFrame, path: str, to: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text, append the end id and write the shards to the folder ``to``."""
    kind = docs.schema["doc_id"].dataType
    raw = "symbols rules spans rounds".split()
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_tokens", T.ArrayType(T.LongType())), T.StructField("n_symbols", T.BinaryType())]
        + [T.StructField(c, T.BinaryType()) for c in raw]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    coded_schema = T.StructType([T.StructField("doc_id", kind), T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held(PieceEncoder, path)
        for b in slices(batches, limit=2 << 20):
            ids, size = enc.ids(b.column("text").to_pylist())
            at = (ids.itemsize * np.concatenate([[0], np.cumsum(size)])).astype(np.int32)
            own = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), own], coded_schema.names)

    def close(part, shard, doc_ids, ids, width):
        lengths = np.array([len(x) // np.dtype(width).itemsize + 1 for x in ids])
        last = np.zeros(int(lengths.sum()), bool)
        last[np.cumsum(lengths) - 1] = True
        end = np.array(end_id, width).tobytes()
        s, last, rules, rounds = compress(np.frombuffer(end.join([*ids, b""]), width), last)
        per_doc = np.diff(np.flatnonzero(last), prepend=-1).astype("<u4")
        values = [part, shard, doc_ids, lengths.tolist(), per_doc.tobytes(), s.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), spans_of(rules).astype("<u4").tobytes(), np.array(rounds, "<u4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # from here on nothing is encoded
        width = id_type(path)
        size = np.dtype(width).itemsize
        part, shard, doc_ids, ids, n = None, 0, [], [], 0
        for b in slices(batches, "ids"):
            for doc, p, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "ids"))):
                if doc_ids and (p != part or n >= shard_ids):
                    yield close(part, shard, doc_ids, ids, width)
                    shard, doc_ids, ids, n = (shard + 1 if p == part else 0), [], [], 0
                part, n = p, n + len(x) // size + 1
                doc_ids.append(doc)
                ids.append(x)
        if doc_ids:
            yield close(part, shard, doc_ids, ids, width)

    # ids, in two bytes where the vocabulary allows, go through the shuffle in place of texts
    rows = whole_texts(docs)
    cuts = cut_points(rows, "doc_id")
    coded = rows.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(code, coded_schema)
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(range_of(F.col("doc_id"), cuts))
    dealt = coded.withColumn("part", part).repartition(len(cuts) + 2, "part").sortWithinPartitions("part", "doc_id", "tie")
    dealt.select("doc_id", "part", "ids").mapInArrow(pack, schema).write.parquet(to)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, place, doc_id, n_tokens, ids) of every document in the shards."""
    shards = spark.read.parquet(path)
    raw = "symbols rules rounds spans".split()
    kind = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        release()
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("part", "shard", "doc_ids", "n_tokens", *raw)}
                symbols, rules, rounds, spans = (np.frombuffer(row[c], "<u4") for c in raw)
                ids = expand(symbols, rules, rounds.tolist(), spans).astype("<u4", copy=False)
                at = 4 * np.concatenate([[0], np.cumsum(row["n_tokens"])])
                n = len(row["doc_ids"])
                own = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])
                values = [pa.array(v, f.type) for v, f in zip(([row["part"]] * n, [row["shard"]] * n, range(n), row["doc_ids"], row["n_tokens"]), arrow)]
                yield pa.RecordBatch.from_arrays([*values, own], schema=arrow)

    return shards.select("part", "shard", "doc_ids", "n_tokens", *raw).mapInArrow(run, schema)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, base): number of ids before each shard, from the shards' lengths alone."""
    sizes = spark.read.parquet(path).select("part", "shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before, base = 0, []
    for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row per range of doc_ids
        base.append((r["part"], before))
        before += r["n"]
    parts = F.broadcast(spark.createDataFrame(base, "part int, part_base long"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(parts, "part").select("part", "shard", (F.col("part_base") + F.coalesce(F.sum("n").over(own), F.lit(0))).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document read back from the shards."""
    rows = read(spark, path).select("part", "shard", "place", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    within = Window.partitionBy("part", "shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts(spark, path), ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )
