"""Alignment of two tokenizers by white-space anchors.

Every text is tokenised whole by a byte-level BPE (A, of space + text) and by a sentence-piece BPE (B, which
adds that space itself). Byte offsets at which tokens of both end, verified on the lengths of both, and where the
next token of both is marked by a space, are anchors: they cut the document into windows, a run of A ids
and a run of B ids over the same bytes. The alignment of a window depends on its ids alone and is memoised by
them. Inside a window the shared ends cut groups; tokens of a group whose byte ranges overlap are links.

``links`` stores one row per document with its counts and its distinct (A id, B id) pairs; ``pair_counts`` sums
the pairs over the corpus. ``report`` gives every document the counts of its links: the ``FREQUENT`` most frequent
pairs at most go to all tasks, the others are joined by key, so no key that many documents share is shuffled.

The ids of A are taken from its JSON file, whose merges are in the order of the ids, by the ``tiktoken`` library,
which gives the same ids several times faster; special tokens' strings are plain text for both.

Null and empty texts, and texts whose joined token bytes differ from space + text for either tokenizer (B turns
U+2581 into a space), have no tokens: zeros and the digest ''. Long texts stay whole; one without anchors is one
window. Repeated rows count repeatedly. Null doc_ids stay. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from brightlake.llm.bpe import _byte_letters, gathered
from brightlake.llm.common import slices, whole_texts
from brightlake.session import stored

SLICE_BYTES = 1 << 20
MEMO_BYTES = 96 << 20
FREQUENT = 1 << 20
PAIRS_HELD = 1 << 21  # pairs that a task counts before it passes them on
#: Splitting rule of the byte-level vocabulary: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_HELD: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Both tokenizers and the memo of windows of one worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        letters = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for w, i in ranks.items():
            self.a_bytes[i] = w
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.vocab_size())]
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        self.spelled = [pa.array(t, pa.binary()) for t in (self.a_bytes, self.b_bytes)]
        numbers = [list(map(str, range(len(t)))) for t in (self.a_bytes, self.b_bytes)]
        self.names = pa.array([f"{x}{mark}" for own, marks in zip(numbers, (",|", ",;")) for mark in marks for x in own], pa.string())
        self.marked = [np.array([x[:1] == b" " for x in t]) for t in (self.a_bytes, self.b_bytes)]
        self.n_b = len(self.b_bytes)
        self.width = 2 if max(len(self.a_bytes), self.n_b) < 0xFFFF else 4  # bytes of an id in a window
        assert len(self.a_bytes) * self.n_b <= 1 << 32, "a pair of ids must fit in 32 bits"
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.held, self.texts = 0, []
        self.n_groups, self.n_links, self.start = (np.empty(0, np.int64) for _ in range(3))
        self.keys = np.empty(0, np.int64)

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both tokenizers; none unless both give the bytes of space + text."""
        if not text:
            return [], []
        want = f" {text}".encode("utf-8", "surrogatepass")
        a, b = self.a.encode_ordinary(f" {text}"), self.b.encode(text, num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return [], []
        return a, b

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids of all texts, numbers of ids of each) of A and of B; as ``tokens`` gives them, with one look at all bytes."""
        full = [t for t in texts if t]
        found = [self.a.encode_ordinary(f" {t}") for t in full], [self.b.encode(t, num_threads=1) for t in full]
        want = [f" {t}".encode("utf-8", "surrogatepass") for t in full]
        ends = np.cumsum(list(map(len, want)), dtype=np.int64)
        ids, counts, right = [], [], True
        for own, sizes, spelled in zip(found, self.sizes, self.spelled):
            n = np.fromiter(map(len, own), np.int64, len(own))
            x = np.fromiter(chain.from_iterable(own), np.int64, int(n.sum()))
            upto = np.concatenate([[0], np.cumsum(sizes[x])])[np.cumsum(n)]
            right = right and (upto == ends).all() and b"".join(want) == _bytes(spelled.take(pa.array(x)))[0]
            ids.append(x)
            counts.append(n)
        if not right:  # the texts at fault are told one by one
            pairs = [self.tokens(t) for t in full]
            counts = [np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1)]
            ids = [np.fromiter(chain.from_iterable(p[k] for p in pairs), np.int64, int(counts[k].sum())) for k in (0, 1)]
        out = np.zeros((2, len(texts)), np.int64)
        out[:, [i for i, t in enumerate(texts) if t]] = counts
        return ids, list(out)

    def learn(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        """Align windows that the memo lacks, given one behind the other, with the numbers of their ids."""
        if not len(n_a):
            return
        a_end, b_end = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.searchsorted(b_end, a_end)
        a_shut = b_end[at] == a_end  # the last byte of both is shared
        b_shut = np.zeros(len(b), bool)
        b_shut[at[a_shut]] = True
        # every run of bytes between two neighbouring ends is a link of the tokens that hold it
        ends = np.sort(np.concatenate([a_end, b_end[~b_shut]]), kind="stable")
        pairs = a[np.searchsorted(a_end, ends)] * self.n_b + b[np.searchsorted(b_end, ends)]
        groups = np.diff(np.cumsum(a_shut)[np.cumsum(n_a) - 1], prepend=0)
        n_links = n_a + n_b - groups
        # in the text, the tokens of B follow those of A group by group
        a_done, b_done = np.flatnonzero(a_shut) + 1, np.concatenate([[0], np.flatnonzero(b_shut) + 1])
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + b_done[np.cumsum(a_shut) - a_shut]] = a + len(self.a_bytes) * a_shut
        names[np.arange(len(b)) + a_done[np.cumsum(b_shut) - b_shut]] = 2 * len(self.a_bytes) + b + self.n_b * b_shut
        raw, offsets = _bytes(self.names.take(pa.array(names)))
        cut = offsets[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        self.texts += [raw[i:j] for i, j in zip(cut, cut[1:])]
        self.held += len(raw) + (8 + 2 * self.width) * int(n_links.sum()) + 250 * len(n_a)
        self.start = np.concatenate([self.start, len(self.keys) + np.cumsum(n_links) - n_links])
        self.n_groups, self.n_links = np.concatenate([self.n_groups, groups]), np.concatenate([self.n_links, n_links])
        self.keys = np.concatenate([self.keys, pairs])

    def cuts(self, a: np.ndarray, b: np.ndarray, lasts: np.ndarray) -> tuple[list[int], list[int]]:
        """Ends of the windows of a run of documents, as numbers of A and of B tokens; ``lasts``: A tokens up to the end of each document."""
        a_end, b_end = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.searchsorted(b_end, a_end)
        shared = b_end[np.minimum(at, len(b) - 1)] == a_end
        cut = np.flatnonzero(shared) + 1
        other = at[cut - 1] + 1
        inner = cut < len(a)
        anchor = np.ones(len(cut), bool)  # before space-marked tokens of both, and at the end of all
        anchor[inner] = self.marked[0][a[cut[inner]]] & self.marked[1][b[other[inner]]]
        anchor |= np.isin(cut, lasts)
        return cut[anchor].tolist(), other[anchor].tolist()

    def run(self, texts: list[str | None]) -> dict[str, list]:
        """Counts, digest and distinct pairs of every text."""
        if self.held > MEMO_BYTES:
            self.forget()
        (a, b), (n_a, n_b) = self.encode(texts)
        out = {"n_a": n_a, "n_b": n_b, "n_groups": [0] * len(texts), "n_links": [0] * len(texts), "groups_sha256": [""] * len(texts), "pairs": [b""] * len(texts), "counts": [b""] * len(texts)}
        if not len(a):
            return out
        full = np.flatnonzero(n_a).tolist()
        lasts = np.cumsum(n_a[full])
        x, y = self.cuts(a, b, lasts)
        (a_raw, b_raw), w, end = (v.astype(f"<u{self.width}").tobytes() for v in (a, b)), self.width, b"\xff" * self.width
        memo, known = self.memo, len(self.memo)
        number = memo.setdefault
        num = np.array([number(a_raw[w * i : w * j] + end + b_raw[w * k : w * m], len(memo)) for i, j, k, m in zip([0, *x], x, [0, *y], y)], np.int64)
        first = np.unique(num, return_index=True)[1]
        new = first[num[first] >= known]
        ends = [np.array([0, *v], np.int64) for v in (x, y)]
        begin, size = [v[new] for v in ends], [np.diff(v)[new] for v in ends]
        self.learn(gathered(a, begin[0], size[0]), size[0], gathered(b, begin[1], size[1]), size[1])
        last = np.searchsorted(np.array(x), lasts) + 1  # windows up to the end of each document
        links, groups = np.cumsum(self.n_links[num]), np.cumsum(self.n_groups[num])
        flat = np.arange(links[-1]) + np.repeat(self.start[num] - links + self.n_links[num], self.n_links[num])
        linked = self.keys[flat]
        before = (0, 0, 0)
        text = self.texts.__getitem__
        numbers = num.tolist()
        for i, w in zip(full, last.tolist()):  # every text ends with the mark between groups
            upto = (w, int(links[w - 1]), int(groups[w - 1]))
            pairs, counts = np.unique(linked[before[1] : upto[1]], return_counts=True)
            out["n_links"][i], out["n_groups"][i] = upto[1] - before[1], upto[2] - before[2]
            out["groups_sha256"][i] = sha256(b"".join(map(text, numbers[before[0] : w]))[:-1]).hexdigest()
            out["pairs"][i], out["counts"][i] = pairs.astype("<u4").tobytes(), counts.astype("<u4").tobytes()
            before = upto
        return out


def _bytes(strings: pa.Array) -> tuple[bytes, np.ndarray]:
    """All strings of a fresh array in one, and where each begins and ends."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1)
    return strings.buffers()[2].to_pybytes()[: int(offsets[-1])], offsets


def held(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process."""
    if (a_path, b_path) not in _HELD:
        _HELD[a_path, b_path] = Aligner(a_path, b_path)
    return _HELD[a_path, b_path]


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts) of every row; a pair is A id x size of B + B id."""
    fields = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType()), ("pairs", T.BinaryType()), ("counts", T.BinaryType())]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(*f) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, aligner = to_arrow_schema(schema), held(a_path, b_path)
        for b in slices(batches, limit=SLICE_BYTES):
            gc.disable()  # the lists of a slice hold no cycles, and there are very many of them
            try:
                out = aligner.run(b.column("text").to_pylist())
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *[pa.array(out[n], arrow.field(n).type) for n, _ in fields]], schema=arrow)

    rows = whole_texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, schema)


def pair_counts(linked: DataFrame, held_pairs: int = PAIRS_HELD) -> DataFrame:
    """(pair, n): links of every pair over all documents, summed in each task before the shuffle."""

    def add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
        return kinds, np.bincount(which, np.concatenate(counts), len(kinds)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [], [], 0
        row = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], ["pair", "n"])
        for b in batches:
            for p, c in zip(b.column("pairs").to_pylist(), b.column("counts").to_pylist()):
                keys.append(np.frombuffer(p, "<u4"))
                counts.append(np.frombuffer(c, "<u4"))
                waiting += len(keys[-1])
                if waiting > held_pairs:
                    k, n = add(keys, counts)
                    if len(k) > held_pairs // 2:
                        yield row(k, n)
                        k, n = k[:0], n[:0]
                    keys, counts, waiting = [k], [n], len(k)
        if waiting:
            yield row(*add(keys, counts))

    return linked.select("pairs", "counts").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def report(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    import sentencepiece

    spark = docs.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    linked = stored(links(docs, a_path, b_path), "links")
    counts = pair_counts(linked).withColumn("b", (F.col("pair") % size_b).cast("int"))
    counts = stored(counts, "pairs")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row per id of B: bounded by its vocabulary
    counts = counts.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    # the least count that leaves no more than ``frequent`` pairs at or above it, from a histogram of the counts' logarithms
    level = F.floor(F.log2("n") * 16).cast("int")
    kinds = sorted(((r["level"], r["kinds"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("kinds")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for at, n in kinds:
        if total + n > frequent:
            break
        least, total = at, total + n
    often = counts.where(level >= least).toArrow()
    order = np.argsort(often["pair"].to_numpy())
    known = spark.sparkContext.broadcast((often["pair"].to_numpy()[order].astype(np.uint32), often["n"].to_numpy()[order], often["best"].to_numpy()[order]))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = T.StructType([linked.schema["row"], *[linked.schema[c] for c in plain], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("rare_n", T.ArrayType(T.LongType()))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        pair, n, top = known.value
        for b in batches:
            out: list[list] = [[], [], [], []]
            for p, c in zip(b.column("pairs").to_pylist(), b.column("counts").to_pylist()):
                keys, times = np.frombuffer(p, "<u4"), np.frombuffer(c, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
                hit = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                out[0].append(int(times[hit][top[at[hit]]].sum()))
                out[1].append(int(times[hit] @ n[at[hit]]))
                out[2].append(keys[~hit].astype(np.int64))
                out[3].append(times[~hit])
            values = [pa.array(v, arrow.field(f).type) for v, f in zip(out, ("n_best", "count_sum", "rare", "rare_n"))]
            yield pa.RecordBatch.from_arrays([b.column("row"), *map(b.column, plain), *values], schema=arrow)

    rows = linked.mapInArrow(look_up, schema)
    names = [*plain[:-1], "n_best", "count_sum", "groups_sha256"]
    if total == sum(n for _, n in kinds):  # no pair is left
        return rows.select(*names)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_n").alias("times"))
    sums = rare.join(counts.where(level < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    more = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return rows.drop("rare", "rare_n").join(sums, "row", "left").select(*plain[:-1], more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
