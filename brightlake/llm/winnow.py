"""Document fingerprints by winnowing.

Every k-gram of characters gets a rolling hash; of every window of w neighbouring k-grams the smallest
hash is kept, of equal ones the rightmost. Two texts sharing a run of at least k + w - 1 characters
therefore share a kept hash, whose position is kept as well.

A fingerprint is a hex string of 8-byte records: one byte distance to the previous kept position
(windows are at most 255 wide, so it fits), seven bytes hash. Equal texts have equal fingerprints.
Null and empty texts have the fingerprint ""; a text shorter than k has one record for its whole;
one with fewer k-grams than a window has the minimum of all. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from brightlake.llm.common import cut_points, range_of, slices, whole_texts

GRAM = 12
WINDOW = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64((1 << 56) - 1)


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """56-bit hash of every k-gram; a run of 2m hashes from two runs of m, so log2(k) passes."""
    n = len(codes)
    total, done, at = None, 0, 0
    run, power = codes.astype(np.uint64) + np.uint64(1), np.array([_BASE])  # arrays wrap around silently
    width = 1
    while width <= k:
        if k & width:
            total = run.copy() if total is None else total[: n - done - width + 1] * power + run[done : n - width + 1][: n - done - width + 1]
            done += width
        if width * 2 <= k:
            run = run[: len(run) - width] * power + run[width:]
        power = power * power
        width *= 2
    h = total[: n - k + 1]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h ^ (h >> np.uint64(29))) & _LOW


def keep_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost minimum of every window of w hashes, each once, ascending."""
    if len(hashes) <= w:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    value, place, width = hashes, np.arange(len(hashes)), 1
    while width < w:  # minima of windows twice as wide from two overlapping ones
        step = min(width, w - width)
        right = value[step:] <= value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    return place[np.flatnonzero(np.diff(place, prepend=-1))]


def fingerprint(text: str, k: int = GRAM, w: int = WINDOW) -> np.ndarray:
    """Records of a text: distance in the high byte, hash below."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.empty(0, np.uint64)
    hashes = rolling_hashes(codes, min(k, len(codes)))
    at = keep_minima(hashes, w)
    return np.diff(at, prepend=0).astype(np.uint64) << np.uint64(56) | hashes[at]


def positions(records: np.ndarray) -> np.ndarray:
    """Character positions of the kept k-grams."""
    return np.cumsum((records >> np.uint64(56)).astype(np.int64))


def as_string(records: np.ndarray) -> str:
    return records.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of kept hashes (Jaccard); 1 for two empty ones."""
    a, b = np.unique(a & _LOW), np.unique(b & _LOW)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row."""
    assert 1 <= w <= 255, "a distance must fit in a byte"
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            prints = [as_string(fingerprint(t, k, w)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(prints, pa.string())], schema.names)

    return whole_texts(docs).mapInArrow(run, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text, borrowed) of which each but the borrowed is followed by its next one.

    Order: descending doc_id, equal ids by their text's hash, null ids last; the last row is followed
    by the first. Rows are dealt into ranges of doc_id; every range but the first lends its first row
    to the one before, so one shuffle of the texts suffices and no window spans more than a range.
    Returned sorted within its partitions by (part, place).
    """
    spark = docs.sparkSession
    rows = whole_texts(docs).select("doc_id", "text", F.xxhash64("text").alias("tie"))
    cuts = cut_points(rows, "doc_id")  # at most one cut point per partition comes to the driver
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - range_of(F.col("doc_id"), cuts))
    rows = rows.withColumn("part", part)
    order = [F.col("doc_id").desc_nulls_last(), "tie"]
    # one row per range: its first, by a struct that sorts like the order (max id, min tie)
    first = rows.groupBy("part").agg(F.max(F.struct("doc_id", -F.col("tie").cast("decimal(20,0)"))).alias("m")).orderBy("part").collect()
    if not first:
        return rows.withColumn("borrowed", F.lit(False))
    heads = spark.createDataFrame(
        [(r["part"], r["m"]["doc_id"], int(-r["m"][1]), first[i - 1]["part"]) for i, r in enumerate(first)],
        T.StructType([T.StructField("part", T.IntegerType()), T.StructField("head", docs.schema["doc_id"].dataType), T.StructField("tie", T.LongType()), T.StructField("to", T.IntegerType())]),
    )
    lent = (
        rows.join(F.broadcast(heads), ["part", "tie"])  # one row per range
        .where(F.col("doc_id").eqNullSafe(F.col("head")))
        .dropDuplicates(["part"])
        .select("doc_id", "text", "tie", F.col("to").alias("part"), F.lit(True).alias("borrowed"))
    )
    every = rows.withColumn("borrowed", F.lit(False)).unionByName(lent)
    return every.repartition(max(1, len(first)), "part").sortWithinPartitions("part", "borrowed", *order)


def edited_text(text: str, following: str) -> str:
    """The last third replaced by as many leading characters of the next document, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_with_edits(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses to the edited and the next."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        held = None  # the row before, waiting for its next
        for b in slices(batches):
            out: list[list] = [[] for _ in schema.names]
            for doc, text, part, borrowed in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part", "borrowed"))):
                own = fingerprint(text, k, w)
                if held is not None and held[2] == part:
                    edit = edited_text(held[1], text)
                    edit_print = fingerprint(edit, k, w) if edit != held[1] else held[3]
                    row = (held[0], len(held[1]), sha256(edit.encode("utf-8", "surrogatepass")).hexdigest(), as_string(held[3]), as_string(edit_print), likeness(held[3], edit_print), likeness(held[3], own))
                    for column, value in zip(out, row):
                        column.append(value)
                held = None if borrowed else (doc, text, part, own)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow)], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in schema.fields]
    return with_next(docs).select("doc_id", "text", "part", "borrowed").mapInArrow(run, schema)
