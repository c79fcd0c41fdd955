"""MinHash near-dedup: a multi-index join of b-bit signatures under a Hamming threshold.

A document's set is its distinct shingles of five words. ``VALUES`` MinHash values, cut to 16 bits, make
its signature; the distance of two signatures is the number of different values. Signatures are split
into ``CHUNKS``; two of distance up to ``2 * CHUNKS - 1`` have, by pigeonhole, a chunk with one error at
most, so each chunk is keyed once with each of its values left out. All pairs under that distance
meet in a bucket: at similarity 0.75 a pair misses every bucket with a chance of 1e-7.

Links are confirmed on full sets, and only links that can join two classes are looked for:

1. documents with equal word sequences are one representative;
2. in each bucket the representative whose buckets are largest in all (the hub of its copies) is
   compared with the others, one comparison per representative and hub; links are contracted;
3. representatives left in buckets with several classes are compared exactly: two sets of the
   required overlap share one of their rarest shingles, and the rest of both sets behind it must be
   large enough (prefix and position filters). Only pairs from different classes with such a shingle
   are formed, so the members of a group of copies are never paired with each other.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Fewer
than five words make one shingle; very long texts are hashed whole, their sets are the largest thing a task
holds. Nodes are word sequences, numbered by the operator, so ids need not be unique: every row gives one row,
rows of one id with different texts belong to the class of their own text, and repeated rows to the same one. A row without id
counts as a document named null, which sorts behind all others: its class is named by the smallest id in it and
is null only if no row of the class has one. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from brightlake.llm.common import components, slices, whole_texts
from brightlake.session import small_side, stored

SHINGLE = 5
CHUNKS = 12
WIDTH = 4  # values in a chunk
VALUES = CHUNKS * WIDTH
PERCENT = 75
ROUNDS = 2
MEMO_WORDS = 150_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = (1 << 64) - 1
_memo: dict[bytes, int] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (all bits depend on all bits)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _draws(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_XOR = (_draws(VALUES, 11) >> np.uint64(32)).astype(np.uint32)[:, None]
_MUL = (_draws(VALUES, 23) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words: runs without ASCII white space, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest as digest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    for w in set(words):
        if w not in _memo:
            _memo[w] = digest(w)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def sequence_key(words: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(words.tobytes())


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    size = min(n, len(words))
    h = words[: len(words) - size + 1].copy()
    for i in range(1, size):
        h = mix(h) + words[i : len(words) - size + 1 + i]
    return np.unique(mix(h + np.uint64(size)))


def signature(sets: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set, cut to 16 bits."""
    low = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1 << 14):
        part = (low[None, i : i + (1 << 14)] ^ _XOR) * _MUL
        best = np.minimum(best, (part ^ (part >> np.uint32(15))).min(axis=1))
    return ((best * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def keys_of(signs: np.ndarray) -> np.ndarray:
    """For each signature (a row of values) a 64-bit key per chunk and value left out."""
    chunks = signs.astype(np.uint64).reshape(-1, CHUNKS, WIDTH)
    out = []
    for skip in range(WIDTH):
        h = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(skip), chunks.shape[:2])
        for j in range(WIDTH):
            if j != skip:
                h = mix(h) + chunks[:, :, j]
        out.append(mix(h))
    return np.concatenate(out, axis=1)


def _schema(kind: T.DataType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, t) for n, t in fields]])


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, seq, sign): size of the set, key of the word sequence and signature."""
    schema = _schema(docs.schema["doc_id"].dataType, ("n_shingles", T.LongType()), ("seq", T.BinaryType()), ("sign", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, seqs, signs = [], [], []
            for t in b.column("text").to_pylist():
                words = word_hashes(t)
                own = shingles(words)
                sizes.append(len(own))
                seqs.append(sequence_key(words) if len(own) else None)
                signs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(seqs, pa.binary()), pa.array(signs, pa.binary())], schema.names)

    return whole_texts(docs).mapInArrow(run, schema)


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): the full sets, as sorted 64-bit hashes."""
    schema = _schema(docs.schema["doc_id"].dataType, ("shingles", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingles(word_hashes(t)).astype(np.int64) for t in b.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], schema.names)

    return whole_texts(docs).mapInArrow(run, schema)


def bucket_keys(reps: DataFrame) -> DataFrame:
    """(doc_id, key) of every representative."""
    schema = _schema(reps.schema["doc_id"].dataType, ("key", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_doc = CHUNKS * WIDTH
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                b = batch.slice(start, 2000)
                keys = keys_of(np.frombuffer(b"".join(b.column("sign").to_pylist()), np.uint16)).ravel()
                at = pa.array(np.repeat(np.arange(b.num_rows), per_doc))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), pa.array(keys.astype(np.int64))], schema.names)

    return reps.select("doc_id", "sign").mapInArrow(run, schema)


def candidates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text): one text for each of the wanted nodes (seq, rep, node), under its node."""
    schema = _schema(docs.schema["doc_id"].dataType, ("text", T.StringType()), ("seq", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seqs = [sequence_key(word_hashes(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(seqs, pa.binary())], schema.names)

    wanted = small_side(wanted)
    named = whole_texts(docs).join(wanted.select("rep"), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").mapInArrow(run, schema)
    nodes = wanted.withColumnRenamed("seq", "_seq")
    found = named.join(nodes, (F.col("seq") == F.col("_seq")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select(F.col("node").alias("doc_id"), "text")
    found = stored(found, "candidates")
    n = found.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("nodes")).first()
    return found if n["rows"] == n["nodes"] else stored(found.dropDuplicates(["doc_id"]), "candidates")  # rows equal in id and words


def distance(a, b):
    """Number of differing 16-bit values of two signatures given as arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that reach the similarity on their full sets."""
    used = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = stored(sets_of(docs.join(small_side(used), "doc_id", "left_semi")), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def by_hubs(keys: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of buckets with several members, and pairs (a, hub) within the signature distance d."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keys.join(sizes, "key"), "buckets")
    weight = shared.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    order = F.struct("weight", F.xxhash64("doc_id"))
    hubs = shared.join(weight, "doc_id").groupBy("key").agg(F.max_by("doc_id", order).alias("hub"))
    pairs = shared.join(hubs, "key").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    bits = reps.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(VALUES - 1)), lambda i: F.substring("sign", 2 * i + 1, F.lit(2))).alias("s"))
    near = (
        pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a")
        .join(bits.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
        .select("a", "b", distance("x", "y").alias("d"))
        .where(F.col("d") < 2 * CHUNKS)
    )
    return shared, stored(near, "near")


def rest(open_docs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs of different classes among the open representatives that share a rare shingle and pass the
    size and position bounds: a superset of their links."""
    sets = sets_of(docs.join(small_side(open_docs), "doc_id", "left_semi"))
    items = sets.select("doc_id", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    counts = items.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a set must share one of its first size - ceil(0.75 size) + 1 shingles, rarest first; those of one set
    # only come first and cannot match, so just their number counts
    ranked = items.join(counts, "shingle").groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    alone = F.col("size") - F.size("order")
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    heads = ranked.where(first > alone).select(
        "doc_id", "size", alone.alias("alone"), F.posexplode(F.slice("order", 1, (first - alone).cast("int"))).alias("at", "x")
    )
    heads = heads.select("doc_id", "size", (F.col("at") + F.col("alone")).alias("at"), F.col("x.shingle").alias("shingle"))
    heads = stored(heads.join(classes, "doc_id"), "heads")
    a = heads.select(F.col("doc_id").alias("a"), F.col("size").alias("na"), F.col("at").alias("pa"), F.col("root").alias("ra"), "shingle")
    b = heads.select(F.col("doc_id").alias("b"), F.col("size").alias("nb"), F.col("at").alias("pb"), F.col("root").alias("rb"), "shingle")
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return a.join(b, "shingle").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (left >= need)).select("a", "b").distinct()


def classes_of(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, root) of every representative."""
    roots = components(links).select(F.col("node").alias("doc_id"), "root")
    return reps.select("doc_id").join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = stored(signed(docs), "signatures")
    groups = rows.where("seq is not null").groupBy("seq").agg(F.min("doc_id").alias("rep"), F.any_value("sign").alias("sign"))
    # a node is the number of its word sequence, fixed once it is written; up to the end doc_id is the node
    groups = stored(groups.withColumn("node", F.monotonically_increasing_id()), "representatives")
    reps = groups.select(F.col("node").alias("doc_id"), "sign")
    shared, near = by_hubs(bucket_keys(reps), reps)
    # only representatives that share a bucket are looked at again
    seen = shared.select(F.col("doc_id").alias("node")).distinct()
    texts = candidates(docs, groups.select("seq", "rep", "node").join(seen, "node"))
    # the nearest hub first: most copies are settled by one comparison
    links = None
    tested = near.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    for turn in range(ROUNDS):
        tested = stored(tested.select("a", "b"), "pairs")
        good = stored(confirmed(tested, texts, percent), "links")
        links = good if links is None else links.unionByName(good)
        classes = stored(classes_of(reps, links), "classes")
        near = near.join(tested, ["a", "b"], "left_anti")
        of = lambda c: classes.select(F.col("doc_id").alias(c), F.col("root").alias(f"r{c}"))
        tested = near.join(of("a"), "a").join(of("b"), "b").where("ra <> rb")
    spread = shared.join(classes, "doc_id").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    open_docs = shared.join(spread.select("key"), "key", "left_semi").select("doc_id").distinct()
    more = stored(rest(open_docs, classes, texts, percent), "pairs")
    links = links.unionByName(confirmed(more, texts, percent))
    placed = groups.join(classes_of(reps, links), F.col("node") == F.col("doc_id")).select("seq", "rep", "root")
    # the class is named by its smallest doc_id
    names = placed.groupBy("root").agg(F.min("rep").alias("name"))
    named = placed.join(names, "root").select("seq", "name")
    component = F.coalesce("name", "doc_id")
    return rows.join(named, "seq", "left").select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
