"""Toxicity by a linear-chain conditional random field over words.

Fitting uses a bounded sample of labelled documents: the ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` other ones
whose doc_id hashes lowest, never a held-out row (crc32 of doc_id as text, modulo 3, is 1). Words and
word beginnings that occur in toxic documents almost only mark their tokens as toxic; windows of words
around marked tokens, and as many from clean documents, train the field. Forward-backward gives every
word of every text its marginal; their sum and maximum, through a logistic curve fitted on the sample,
are the document's score, words over one half the offending offsets.

A word is a run of ``\\w`` characters, lower-cased, of any number. Null and empty texts score like a text
without words. Rows with a null label are not used; without any toxic label all scores are the same
low value. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from brightlake.llm.bpe import release
from brightlake.llm.common import slices, whole_texts

FIT_TOXIC = 4000
FIT_CLEAN = 12000
MARKS = 5000  # words and beginnings that mark tokens, the most frequent
LEAST = 5
PURE = 0.9
HALF = 8  # words on either side of a window's centre
BUCKETS = 1 << 16
STARTS = (4, 5, 6, 7, 8)
EPOCHS = 60
SLICE_BYTES = 8 << 20
MEMO_WORDS = 300_000
LIMIT = 0.7
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(word: str) -> list[int]:
    """Buckets of the word itself, its beginnings and its end."""
    names = [f"w{word}", *(f"b{word[:n]}" for n in STARTS if len(word) >= n), f"e{word[-3:]}"]
    return [crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names]


@dataclass
class Field:
    """Weights: of a word's own features, of the neighbours' features, bias and transitions (from, to)."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    move: np.ndarray
    curve: tuple[float, float, float] = (-4.0, 1.0, 4.0)

    def __post_init__(self):
        self.memo: dict[str, int] = {}
        self.table = np.empty((0, 3))

    def learn(self, words: set[str]) -> None:
        """Sums of the weights of new words, one row of the table each."""
        if len(self.memo) > MEMO_WORDS:
            self.__post_init__()
            new = list(words)
        else:
            new = [w for w in words if w not in self.memo]
        if new:
            found = [features(w) for w in new]
            flat = np.fromiter((i for f in found for i in f), np.int64)
            start = np.cumsum([0] + [len(f) for f in found[:-1]])
            rows = np.column_stack([np.add.reduceat(w[flat], start) for w in (self.own, self.before, self.after)])
            self.memo.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, rows])

    def of_texts(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Log-odds of each word of each text in its context, without the chain."""
        self.learn(set().union(*texts))
        get, out = self.memo.__getitem__, []
        for words in texts:
            rows = self.table[np.fromiter(map(get, words), np.int64, len(words))]
            x = rows[:, 0] + self.bias
            x[1:] += rows[:-1, 1]
            x[:-1] += rows[1:, 2]
            out.append(x)
        return out


def chain(x: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of padded rows (rows, steps) of a two-state chain."""
    forward, backward = np.empty_like(x), np.zeros_like(x)
    forward[:, 0] = x[:, 0]
    for t in range(1, x.shape[1]):
        r = forward[:, t - 1]
        forward[:, t] = x[:, t] + np.logaddexp(r + move[1, 1], move[0, 1]) - np.logaddexp(r + move[1, 0], move[0, 0])
    for t in range(x.shape[1] - 2, -1, -1):
        r = backward[:, t + 1] + x[:, t + 1]
        backward[:, t] = np.logaddexp(r + move[1, 1], move[1, 0]) - np.logaddexp(r + move[0, 1], move[0, 0])
    return forward, backward


def marginals(texts: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Chance of the toxic state for each word of each text; texts of all lengths step together."""
    order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
    out: list[np.ndarray] = [np.empty(0)] * len(texts)
    if not order:
        return out
    sizes = np.array([len(texts[i]) for i in order])
    starts = np.cumsum(sizes) - sizes
    x = np.concatenate([texts[i] for i in order])
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1))  # texts still running at each step
    forward, backward = x.copy(), np.zeros_like(x)
    a11, a01, a10, a00 = (float(np.exp(move[i, j])) for i, j in ((1, 1), (0, 1), (1, 0), (0, 0)))
    for t in range(1, int(sizes[0])):
        at = starts[: active[t]] + t
        r = np.exp(np.clip(forward[at - 1], -50, 50))
        forward[at] += np.log((r * a11 + a01) / (r * a10 + a00))
    ends = starts + sizes - 1
    for t in range(1, int(sizes[0])):
        at = ends[: active[t]] - t
        r = np.exp(np.clip(backward[at + 1] + x[at + 1], -50, 50))
        backward[at] = np.log((r * a11 + a10) / (r * a01 + a00))
    p = 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))
    for k, i in enumerate(order):
        out[i] = p[starts[k] : starts[k] + sizes[k]]
    return out


def sample(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN) -> DataFrame:
    """(text, toxic) of the bounded, deterministic sample; held-out rows never enter."""
    own = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = own.where("toxic").orderBy(*order).limit(toxic).unionByName(own.where("not toxic").orderBy(*order).limit(clean))
    return whole_texts(docs).join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id").select("text", "toxic")


def _word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def marks(rows: DataFrame) -> set[str]:
    """Words (w...) and beginnings (b...) found in toxic documents almost only."""
    words = F.array_distinct(_word_array(F.col("text")))

    def beginnings(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.lit("b"), F.substring(w, 1, n)))

    names = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w"), w)), *map(beginnings, STARTS[1:])))
    counts = (
        rows.select("toxic", F.explode(names).alias("name"))
        .groupBy("name")
        .agg(F.count_if("toxic").alias("yes"), F.count_if(~F.col("toxic")).alias("no"))
        .where((F.col("yes") >= LEAST) & (F.col("yes") >= PURE * (F.col("yes") + F.col("no") + 0.3)))
    )
    return {r["name"] for r in counts.orderBy(F.desc("yes"), "name").limit(MARKS).collect()}


def windows(rows: DataFrame, marked: set[str]) -> list[tuple[list[str], list[int]]]:
    """Two windows of words with token labels from each sampled document: around the first and last
    marked words of toxic ones, from two places of the others."""
    schema = "words array<string>, labels array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            words_out, labels_out = [], []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = _WORD.findall(text.lower())
                if not words:
                    continue
                hit = [int(toxic and ("w" + w in marked or any("b" + w[:n] in marked for n in STARTS[1:] if len(w) >= n))) for w in words]
                at = [i for i, h in enumerate(hit) if h]
                if toxic and not at:
                    continue  # nothing shows where it is toxic
                seed = crc32(text.encode("utf-8", "surrogatepass"))
                for c in {at[0], at[-1]} if at else {seed % len(words), seed // 7 % len(words)}:
                    low = max(0, c - HALF)
                    words_out.append([w[:40] for w in words[low : c + HALF + 1]])
                    labels_out.append(hit[low : c + HALF + 1])
            yield pa.RecordBatch.from_arrays([pa.array(words_out, pa.list_(pa.string())), pa.array(labels_out, pa.list_(pa.int32()))], ["words", "labels"])

    return [(r["words"], r["labels"]) for r in rows.mapInArrow(run, schema).collect()]  # two short windows per sampled row


def fit_field(data: list[tuple[list[str], list[int]]]) -> Field:
    """Maximum likelihood with a small penalty, by Adam on whole batches."""
    width = 2 * HALF + 1
    n_feat = len(STARTS) + 2
    ids = np.full((len(data), width, n_feat), BUCKETS)  # BUCKETS: no feature
    y, mask = np.zeros((len(data), width)), np.zeros((len(data), width), bool)
    known: dict[str, list[int]] = {}
    for i, (words, labels) in enumerate(sorted(data)):
        for t, (w, label) in enumerate(zip(words, labels)):
            f = known.get(w) or known.setdefault(w, features(w))
            ids[i, t, : len(f)] = f
            y[i, t], mask[i, t] = label, True
    theta = [np.zeros(BUCKETS + 1) for _ in range(3)] + [np.array([-2.0]), np.array([[0.5, -0.5], [0.0, 0.0]])]
    first, second = [np.zeros_like(a) for a in theta], [np.zeros_like(a) for a in theta]
    flat = ids.reshape(-1, n_feat)
    before, after = np.roll(ids, 1, axis=1), np.roll(ids, -1, axis=1)
    before[:, 0], after[:, -1] = BUCKETS, BUCKETS
    after[:, :-1][~mask[:, 1:]] = BUCKETS
    shifted = [flat, before.reshape(-1, n_feat), after.reshape(-1, n_feat)]
    pair_mask = mask[:, 1:] & mask[:, :-1]
    for step in range(1, EPOCHS + 1):
        for w in theta[:3]:
            w[BUCKETS] = 0
        x = sum(w[f].sum(axis=1) for w, f in zip(theta, shifted)).reshape(y.shape) + theta[3]
        move = theta[4]
        # padded steps get no evidence and a uniform chain cannot be undone: run rows of a length together
        p, pair = np.zeros_like(y), np.zeros((2, 2))
        lengths = mask.sum(axis=1)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            f, b = chain(x[own, :n], move)
            p[own, :n] = 1 / (1 + np.exp(-(f + b)))
            if n > 1:  # expected transitions
                end = (b + x[own, :n])[:, 1:]
                cell = np.stack([[np.exp(np.clip(i * f[:, :-1] + move[i, j] + j * end, -60, 60)) for j in (0, 1)] for i in (0, 1)])
                pair += (cell / cell.sum(axis=(0, 1))).sum(axis=(2, 3))
        gap = np.where(mask, p - y, 0).ravel()
        seen = np.array([[np.sum((y[:, :-1] == i) & (y[:, 1:] == j) & pair_mask) for j in (0, 1)] for i in (0, 1)])
        scale = 1 / max(1, len(data))
        grads = [np.bincount(f.ravel(), np.repeat(gap, n_feat), BUCKETS + 1) for f in shifted] + [np.array([gap.sum()]), pair - seen]
        for k, g in enumerate(grads):
            g = g * scale + 1e-4 * theta[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            theta[k] = theta[k] - 0.2 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(theta[0][:BUCKETS], theta[1][:BUCKETS], theta[2][:BUCKETS], float(theta[3][0]), theta[4])


def score_texts(texts: list[str], field: Field) -> list[tuple[float, float, np.ndarray]]:
    """Sum and maximum of the marginals and the marginals of each text."""
    evidence: list[np.ndarray] = []
    for i in range(0, len(texts), 500):
        evidence += field.of_texts([_WORD.findall(t.lower()) for t in texts[i : i + 500]])
    found = marginals(evidence, field.move)
    return [(float(p.sum()), float(p.max()) if len(p) else 0.0, p) for p in found]


def fit_curve(rows: DataFrame, field: Field) -> tuple[float, float, float]:
    """Logistic curve of label on log(1 + sum) and maximum over the sample, by Newton steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches, limit=SLICE_BYTES):
            got = score_texts(b.column("text").to_pylist(), field)
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), b.column("toxic")], ["total", "most", "toxic"])

    got = rows.mapInArrow(run, "total double, most double, toxic boolean").orderBy("total", "most", "toxic").collect()  # three numbers per sampled row
    x = np.array([[1.0, np.log1p(r["total"]), r["most"]] for r in got])
    y = np.array([float(r["toxic"]) for r in got])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.5 * w)
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    rows = sample(docs, labels).cache()
    data = windows(rows, marks(rows))
    if not any(sum(labels) for _, labels in data):
        return Field(*(np.zeros(BUCKETS) for _ in range(3)), -20.0, np.zeros((2, 2)), (-6.0, 0.0, 0.0))
    field = fit_field(data)
    field.curve = fit_curve(rows, field)
    rows.unpersist()
    return field


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score, spans): score from 0 to 1 and the (start, end) offsets of toxic words."""
    kind = docs.schema["doc_id"].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType()), T.StructField("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        a, s, m = field.curve
        release()
        for b in slices(batches, limit=SLICE_BYTES):
            texts = b.column("text").to_pylist()
            scores, spans = [], []
            for text, (total, most, p) in zip(texts, score_texts(texts, field)):
                scores.append(float(1 / (1 + np.exp(-np.clip(a + s * np.log1p(total) + m * most, -50, 50)))))
                bad = set(np.flatnonzero(p > 0.5).tolist())
                low = text.lower() if bad else ""
                spans.append([{"start": w.start(), "end": w.end()} for i, w in enumerate(_WORD.finditer(low)) if i in bad])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array(spans, to_arrow_type(span))], schema.names)

    return whole_texts(docs).mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row."""
    found = tag(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"), "spans")
