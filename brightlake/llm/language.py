"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; runs of non-letters become one blank, one stands at either end. Runs of 1 to ``LONGEST``
characters are hashed to ``BUCKETS`` features of weight (1 + log count) x idf, scaled to length one. The document
frequencies cover all rows that may be learned from: those with a text, a lang and an id whose crc32 as text,
modulo 3, is not 1. The weights are fitted on a bounded sample of these, ``FIT_ROWS`` at most and equally many
of each language, a window of ``FIT_CHARS`` characters from a place that depends on the text of each: follow-the-
regularised-leader with both penalties, a learning rate per weight, ``EPOCHS`` times over the rows. A fifth of the sample is
kept out of the fit; on its whole texts one temperature is chosen that makes the scores likeliest.

Null texts and texts without a letter are ``und`` with score 0; without rows to learn from all are. Of equal
scores the language first in order wins. Long texts are read whole, in pieces. Repeated rows give repeated
results; null ids may be learned from. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from brightlake.llm.common import slices, summed
from brightlake.session import stored

BUCKETS = 1 << 16
LONGEST = 4
FIT_ROWS = 8000
FIT_CHARS = 600
KEPT_OUT = 5  # one in so many sampled rows sets the temperature
EPOCHS = 2
ALPHA, BETA = 0.5, 1.0  # learning rate
LASSO, RIDGE = 5e-5, 2e-5  # penalties, for rows of length one
PIECE = 1 << 20  # characters hashed at a time
SHORT = 1 << 14  # characters up to which n-grams are sorted, not counted in an array of all buckets
SLOTS = 64
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters as one 0, one at either end; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[codes], codes, 0)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    return codes if len(codes) > 1 else codes[:0]


def counts_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets in ascending order, and how often their n-grams occur."""
    total = np.zeros(BUCKETS if len(codes) > SHORT else 0, np.int64)
    grams = np.empty(0, np.uint16)
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + LONGEST - 1]
        own = min(len(part), PIECE)  # n-grams that begin in this piece
        h, found = part * np.uint32(0x9E3779B1), []
        for n in range(1, LONGEST + 1):
            if n > 1:
                h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * np.uint32(0x9E3779B1)
            h = h ^ (h >> np.uint32(15))
            found.append(((h[:own] + np.uint32(n)) * np.uint32(0x85EBCA77) >> np.uint32(16)).astype(np.uint16))
            if n == len(part):
                break
        grams = np.concatenate(found)
        if len(total):
            total += np.bincount(grams, minlength=BUCKETS)
    if len(total):
        at = np.flatnonzero(total)
        return at, total[at]
    grams = np.sort(grams, kind="stable")  # a radix sort of 16 bits
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
    return grams[first].astype(np.int64), np.diff(np.append(first, len(grams)))


def weights_of(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a row, of length one."""
    w = (1 + np.log(counts)) * idf[at]
    return at, w / max(float(np.sqrt(w @ w)), 1e-300)


@dataclass
class Model:
    """Languages in order, idf, weights of the buckets in use, biases and the temperature."""

    langs: list[str]
    idf: np.ndarray
    place: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        codes = characters(text or "")
        if not len(codes) or not self.langs:
            return None
        at, x = weights_of(*counts_of(codes), self.idf)
        row = self.place[at]
        return x[row >= 0] @ self.weights[row[row >= 0]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text)
        if z is None:
            return UNKNOWN, 0.0
        p = softmax(z / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int = EPOCHS, lasso: float = LASSO, ridge: float = RIDGE, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, language) and biases by follow-the-regularised-leader over the rows (buckets, weights, language).

    The penalties are per row seen, so z must exceed ``lasso`` times the rows before a weight leaves zero.
    """
    last = buckets  # the bias is a feature of its own, without penalties
    z, n = np.zeros((buckets + 1, n_langs)), np.zeros((buckets + 1, n_langs))
    total = max(1, len(rows) * epochs)

    def current(at: np.ndarray) -> np.ndarray:
        own = z[at]
        free = (at == last)[:, None]
        one, two = np.where(free, 0, lasso * total), np.where(free, 0, ridge * total)
        return np.where(np.abs(own) <= one, 0, (np.sign(own) * one - own) / ((BETA + np.sqrt(n[at])) / ALPHA + two))

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, last), np.append(x, 1.0)
            w = current(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = current(np.arange(buckets + 1))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of highest likelihood between 1/100 and 100, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean())

    low, high, g = -np.log(100), np.log(100), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Rows with a letter, and rows with an n-gram of each bucket, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + SLOTS, np.int64)  # one more in each slot: the rows, in the first
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                codes = characters(text)
                if len(codes):
                    total[counts_of(codes)[0]] += 1
                    total[BUCKETS] += 1
        parts = np.concatenate([total[:BUCKETS].reshape(SLOTS, -1), total[BUCKETS:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slot", "values"])

    found = {r["slot"]: np.frombuffer(r["values"], np.int64) for r in summed(rows.select("text").mapInArrow(run, "slot int, values binary"), "<i8").collect()}
    if not found:
        return 0, np.zeros(BUCKETS, np.int64)
    return int(found[0][-1]), np.concatenate([found[s][:-1] for s in range(SLOTS)])


def sample(rows: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], DataFrame]:
    """The languages, and (text, lang, kept_out) of equally many rows of each, ``fit_rows`` at most expected in all.

    A row is taken if the hash of its id and text is below its language's share, so no class is ranked or gathered.
    """
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return [], rows.select("text", "lang", F.lit(False).alias("kept_out")).limit(0)
    quota = max(1.0, fit_rows / len(langs))
    shares = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, quota / n))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id", "text"), F.lit(KEPT_OUT)) == 0
    return langs, rows.where(place < F.try_element_at(shares, F.col("lang"))).select("text", "lang", fold.alias("kept_out"))


def window(codes: np.ndarray, seed: int) -> np.ndarray:
    """``FIT_CHARS`` characters from a place that the seed gives."""
    if len(codes) <= FIT_CHARS:
        return codes
    at = seed % (len(codes) - FIT_CHARS + 1)
    return codes[at : at + FIT_CHARS]


def fit(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    rows = docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    n, df = frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    langs, picked = sample(rows)
    picked = stored(picked, "languages")
    number = {x: i for i, x in enumerate(langs)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                codes = window(characters(text), crc32(text.encode("utf-8", "surrogatepass")))
                if len(codes):
                    at, x = weights_of(*counts_of(codes), idf)
                    out.append((at.astype("<u4").tobytes(), x.astype("<f4").tobytes(), number[lang]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int32())], ["at", "x", "y"])

    got = picked.where("not kept_out").select("text", "lang").mapInArrow(features, "at binary, x binary, y int").collect()  # short windows of the sample
    got.sort(key=lambda r: (crc32(r["at"] + r["x"]), r["at"], r["y"]))  # mixed, and the same in every run
    data = [(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float), r["y"]) for r in got]
    if not data:
        return Model([], idf, np.full(BUCKETS, -1), np.zeros((0, 0)), np.zeros(0))
    weights, bias = follow_leader(data, len(langs))
    used = np.flatnonzero(weights.any(axis=1))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    model = Model(langs, idf, place, weights[used], bias)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            z = [(model.logits(t), number[x]) for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())]
            z = [(a, y) for a, y in z if a is not None]
            yield pa.RecordBatch.from_arrays([pa.array([a.tolist() for a, _ in z], pa.list_(pa.float64())), pa.array([y for _, y in z], pa.int32())], ["z", "y"])

    kept = picked.where("kept_out").select("text", "lang").mapInArrow(evidence, "z array<double>, y int").collect()  # a number per language and sampled row
    model.temperature = best_temperature(np.array([r["z"] for r in kept]), np.array([r["y"] for r in kept], np.int64))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    known = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS rows of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [known.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema.names)

    found = docs.select("doc_id", "text").mapInArrow(run, schema)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
