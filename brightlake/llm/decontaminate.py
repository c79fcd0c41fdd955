"""Benchmark decontamination with a positional inverted index.

``build_index`` stores the postings of all training words, sharded by document: a row holds the sorted
word hashes of a bounded run of documents, each with its ascending word positions. ``search`` looks up
the windows of the test items (whole items of fewer words) in every shard: windows with an absent word
drop out at once, for the others the lists, shifted by the word's offset, are intersected from the
rarest word on. Only matches leave a shard. Test items go to the tasks in blocks of bounded size, so
their number is not limited.

Words are compared by 64-bit hashes. Null and empty texts have no words. Repeated rows give repeated
results; items with equal ids count as one. Null item ids count as the id "". An empty test table
leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from brightlake.llm.common import slices, whole_texts
from brightlake.session import scratch_path

WINDOW = 10
REACH = 20
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
MEMO_WORDS = 150_000
#: Bytes outside words become spaces; A-Z become a-z; digits, a-z and all of non-ASCII stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_memo: dict[bytes, int] = {}


def words_of(text: str) -> list[bytes]:
    """Words of lower-cased text: runs of digits, letters a-z and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as digest

    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    for w in set(words):
        if w not in _memo:
            _memo[w] = digest(w)
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def build_index(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the postings of all words of all documents as Parquet to ``path``."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("shard", T.StringType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_words", T.ArrayType(T.LongType()))]
        + [T.StructField(c, T.BinaryType()) for c in ("words", "ends", "positions")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, task = to_arrow_schema(schema), TaskContext.get().partitionId()
        for n, b in enumerate(slices(batches, limit=shard_bytes)):
            texts = [words_of(t) for t in b.column("text").to_pylist()]
            counts = np.array([len(t) for t in texts], np.int64)
            all_hashes = hashes([w for t in texts for w in t])
            # one free place after each document keeps phrases within it
            places = np.arange(len(all_hashes)) + np.repeat(np.arange(len(texts)), counts)
            order = np.argsort(all_hashes, kind="stable")
            own, first = np.unique(all_hashes[order], return_index=True)
            ends = np.append(first[1:], len(order)) if len(order) else first
            values = [f"{task}-{n}", b.column("doc_id").to_pylist(), counts.tolist(), own.astype("<u8").tobytes(), ends.astype("<u4").tobytes(), places[order].astype("<u4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    whole_texts(docs).mapInArrow(run, schema).write.parquet(path)


class Shard:
    """Postings of one shard."""

    def __init__(self, n_words, words: bytes, ends: bytes, positions: bytes):
        self.counts = np.array(n_words, np.int64)
        self.starts = np.cumsum(self.counts + 1) - self.counts - 1
        self.words = np.frombuffer(words, "<u8")
        self.ends = np.frombuffer(ends, "<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, -1 if the shard lacks it."""
        if not len(self.words):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def posting(self, row: int) -> np.ndarray:
        return self.positions[self.ends[row - 1] if row else 0 : self.ends[row]]

    def frequency(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[rows] - np.where(rows > 0, self.ends[rows - 1], 0)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def phrase(self, rows: np.ndarray) -> np.ndarray:
        """Places where the words stand in a row: shifted lists intersected from the rarest on."""
        order = np.argsort(self.frequency(rows), kind="stable")
        found = self.posting(rows[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            listed = self.posting(rows[k])
            want = found + k
            at = np.minimum(np.searchsorted(listed, want), len(listed) - 1)
            found = found[listed[at] == want]
        return found

    def near(self, rows: np.ndarray, reach: int) -> np.ndarray:
        """Places of the rarest word with every other word at most ``reach`` words away, in its document."""
        rows = np.unique(rows)
        order = np.argsort(self.frequency(rows), kind="stable")
        found = self.posting(rows[order[0]])
        doc = self.document(found)
        low = np.maximum(found - reach, self.starts[doc])
        high = np.minimum(found + reach, self.starts[doc] + self.counts[doc] - 1)
        for k in order[1:]:
            if not len(found):
                break
            listed = self.posting(rows[k])
            at = np.searchsorted(listed, low)
            ok = (at < len(listed)) & (listed[np.minimum(at, len(listed) - 1)] <= high)
            found, low, high = found[ok], low[ok], high[ok]
        return found


def windows_of(text: str, n: int) -> np.ndarray:
    """Hashes of all windows of n words, one row each; fewer words make one shorter window."""
    h = hashes(words_of(text))
    if not len(h):
        return np.empty((0, 0), np.uint64)
    return np.lib.stride_tricks.sliding_window_view(h, min(n, len(h)))


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, reach: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(shard, place, item_id, starts, lengths, near): matches of each item in each document.

    ``starts``/``lengths`` are word runs hit by exact windows (merged per item). With ``reach``,
    documents with a proximity match of a window have ``near`` true, and rows may have no exact run.
    """
    spark = index.sparkSession
    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    schema = "shard string, place int, item_id string, starts array<long>, lengths array<long>, near boolean"
    out = None
    for block in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else texts
        queries = [(r["item_id"], windows_of(r["text"], window)) for r in own.toLocalIterator()]  # about block_bytes of text
        sent = spark.sparkContext.broadcast([q for q in queries if len(q[1])])
        part = index.mapInArrow(_searcher(sent, reach), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _searcher(sent, reach):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from _matches(b.column("shard")[i].as_py(), Shard(*(b.column(c)[i].as_py() for c in ("n_words", "words", "ends", "positions"))), sent.value, reach)

    return run


def _matches(name: str, shard: Shard, queries, reach) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    by_width: dict[int, list] = {}
    for q, (_, w) in enumerate(queries):
        by_width.setdefault(w.shape[1], []).append(q)
    for width, members in by_width.items():
        rows = shard.rows(np.concatenate([queries[q][1] for q in members]))
        owner = np.repeat(members, [len(queries[q][1]) for q in members])
        alive = np.flatnonzero((rows >= 0).all(axis=1))
        hits: dict[int, list] = {}
        for a in alive.tolist():
            q = int(owner[a])
            exact = shard.phrase(rows[a])
            close = shard.near(rows[a], reach) if reach is not None else exact[:0]
            if len(exact) or len(close):
                kept = hits.setdefault(q, [[], []])
                kept[0].append(exact)
                kept[1].append(close)
        for q, (exact, close) in hits.items():
            places = np.unique(np.concatenate(exact))
            docs, near = shard.document(places), set(shard.document(np.concatenate(close)).tolist())
            for d in sorted({*docs.tolist(), *near}):
                own = places[docs == d] - shard.starts[d]
                cut = np.flatnonzero(np.diff(own, prepend=-width - 1) > width) if len(own) else own
                ends = np.append(own[cut[1:] - 1], own[-1:]) + width if len(own) else own
                out.append((name, d, queries[q][0], own[cut].tolist(), (ends - own[cut]).tolist(), d in near))
    if out:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["shard", "place", "item_id", "starts", "lengths", "near"])


def documents_of(index: DataFrame) -> DataFrame:
    """(shard, place, doc_id, n_words) of every indexed row."""
    return index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d")).select("shard", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, reach: int | None = REACH) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    spark: SparkSession = docs.sparkSession
    path = scratch_path(spark, "postings")
    build_index(docs, path)
    index = spark.read.parquet(path)
    found = search(index, items, window, reach)
    run = F.transform(F.arrays_zip("starts", "lengths"), lambda x: F.struct(x["starts"].alias("a"), (x["starts"] + x["lengths"]).alias("z")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("z"))
    union = F.aggregate(
        F.sort_array(F.flatten(F.collect_list("runs"))),
        zero,
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["z"] - F.greatest(s["z"], r["a"]))).alias("n"), F.greatest(s["z"], r["z"]).alias("z")),
        lambda s: s["n"],
    )
    per_doc = (
        found.withColumn("runs", run)
        .groupBy("shard", "place")
        .agg(
            union.alias("n_hit"),
            F.sort_array(F.collect_set(F.when(F.size("starts") > 0, F.col("item_id")))).alias("items"),
            F.count_distinct(F.when(F.col("near"), F.col("item_id"))).alias("n_near"),
        )
    )
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return documents_of(index).join(per_doc, ["shard", "place"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )
