"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that no vocabulary token holds side by side can never be merged, so a cut
between them is certain. Words are cut at all such places, the fragments are encoded on their own
(memoised: fragments recur far more often than words) and their ids concatenated.

The normaliser and the word splitter are those of the tokenizer file; the merges are done here. The
result equals the library's for every text, added tokens such as ``<|endoftext|>`` included.

Null texts count as empty: no ids, decoded text "". Repeated rows give repeated results.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from brightlake.llm.common import slices, whole_texts

MEMO_WORDS = 200_000
PIECES_HELD = 400_000  # some 35 bytes each
LONGEST_HELD = 64  # characters; longer runs and chunks hardly recur
_WIDE = re.compile("[^\x00-ɏ]")
_ODD = re.compile("[\x1c-\x1f]")  # white space for Python, not for the tokenizer


def _narrowest(spec: dict) -> str:
    return "<u2" if max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]) < 1 << 16 else "<u4"


@cache
def id_type(path: str) -> str:
    """Narrowest type of the file's ids, without an encoder."""
    with open(path, encoding="utf-8") as f:
        return _narrowest(json.load(f))


class Splitter:
    """Cuts a text into added tokens and white-space chunks that may be encoded on their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units: a worker starts no threads
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.decoder = spec.get("decoder")
        self.id_type = _narrowest(spec)
        self.prepare(spec["model"])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.memo: dict[str, bytes] = {c: np.uint32(i).tobytes() for c, i in self.added.items()}

    def prepare(self, model: dict) -> None:
        """Take what the encoder needs of the file's model."""

    def chunks(self, text: str) -> list[str]:
        if "<|" in text and self.cut:
            out: list[str] = []
            for part in self.cut.split(text):
                out += [part] if part in self.added else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [text] if text else []
        if text.isascii() or not _WIDE.search(text):
            text = text.lower()
        return text.split()

    def make_room(self, words: set[str]) -> None:
        """Cut the memo back to the words at hand: the frequent ones are among them."""
        if len(self.memo) > MEMO_WORDS:
            recent = words.union(w[:-1] for w in words if _tail(w))
            held_on = {w: ids for w, ids in self.memo.items() if w in recent}
            self.memo = held_on | {c: np.uint32(i).tobytes() for c, i in self.added.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.chunks(t) for t in texts]
        words = set().union(*cut)
        self.make_room(words)
        todo = words.difference(self.memo)
        tails = [w for w in todo if _tail(w)]  # a final point or comma after a letter is a piece of its own
        new = todo.difference(tails).union((w[:-1] for w in tails), ".," if tails else "")
        self.learn(list(new.difference(self.memo)))
        memo = self.memo
        for w in tails:
            memo[w] = memo[w[:-1]] + memo[w[-1]]
        get = memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def learn(self, words: list[str]) -> None:
        """Memoise the ids of words."""
        raise NotImplementedError


def one_piece(word: str) -> bool:
    """Lower-case letters below U+0250 only: nothing to normalise and nothing to split."""
    return word.isalpha() and not _WIDE.search(word) and word == word.lower()


def _tail(word: str) -> bool:
    return len(word) > 1 and word[-1] in ".," and word[-2].isalpha() and word[-2] < "ɐ"


_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ʯⱥⱦ"  # letters below U+0250 and what lower case makes of them
_NUMBER = "0-9²³¹¼½¾"
_WHITE = "\t\n\x0b\x0c\r\x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^ {_LETTER}{_NUMBER}]+")
_RUN = re.compile(f"([^ {_LETTER}][^ {_LETTER}]*(?:(?<=')(?:s|t|re|ve|m|ll|d))?)")  # what stands between words, with the letters that an apostrophe may take


class _Apart(dict):
    """Runs between words with spaces around their pieces."""

    def __missing__(self, run: str) -> str:
        pieces = _PIECE.findall(run)
        # letters that no apostrophe took belong to the word behind
        out = f" {' '.join(pieces)}" if re.match(f"[{_LETTER}]", pieces[-1]) else f" {' '.join(pieces)} "
        if len(run) <= LONGEST_HELD:
            self[run] = out
        return out


class PieceEncoder(Splitter):
    """The library's merges of every distinct piece, put together in numpy.

    Pieces are what the file's splitter gives: words, numerals and what stands between them. Texts below U+0250 are split here,
    chunks with other letters by the library.
    """

    def prepare(self, model: dict) -> None:
        self.apart, self.wide = _Apart(), {}
        self.known = pa.array(["", *self.added], pa.string())  # "" stands between two spaces
        self.flat = np.array(list(self.added.values()), self.id_type)
        self.size = np.array([0] + [1] * len(self.added), np.int64)
        self.start = np.cumsum(self.size) - self.size

    def learn(self, words: list[str]) -> None:
        """Memoise the ids that the library's merges give for pieces."""
        tokenize = self.tok.model.tokenize
        ids = [[t.id for t in tokenize(w if w.isascii() and w.isprintable() else _lettered(w))] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known = pa.concat_arrays([self.known, pa.array(words, pa.string())])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), self.id_type, int(size.sum()))])

    def keep(self, which: np.ndarray) -> None:
        """Cut the memo back to the pieces at hand: the frequent ones are among them."""
        recent = np.zeros(len(self.size), bool)
        recent[: 1 + len(self.added)], recent[which] = True, True
        own = np.flatnonzero(recent)
        self.known, self.flat, self.size = self.known.take(pa.array(own)), gathered(self.flat, self.start[own], self.size[own]), self.size[own]
        self.start = np.cumsum(self.size) - self.size

    def spaced(self, text: str) -> str:
        """The text's pieces, in order, with spaces between them."""
        if "<|" in text and self.cut:
            return " ".join(part if part in self.added else self._spaced(part) for part in self.cut.split(text))
        return self._spaced(text)

    def _spaced(self, text: str) -> str:
        if text.isascii() or not _WIDE.search(text):
            return self._narrow(text)
        if _ODD.search(text):
            return self._wide(text)
        return " ".join(" ".join(map(self._wide, chunks)) if wide else self._narrow(" ".join(chunks)) for wide, chunks in groupby(text.split(), lambda c: bool(_WIDE.search(c))))

    def _narrow(self, text: str) -> str:
        text = text.lower()
        for c in _WHITE:
            text = text.replace(c, " ")
        if len(self.apart) > MEMO_WORDS:
            self.apart.clear()
        parts = _RUN.split(text)
        parts[1::2] = map(self.apart.__getitem__, parts[1::2])
        return "".join(parts)

    def _wide(self, chunk: str) -> str:
        out = self.wide.get(chunk)
        if out is None:
            normal = self.tok.normalizer.normalize_str(chunk)
            out = " ".join(normal[i:j] for _, (i, j) in self.tok.pre_tokenizer.pre_tokenize_str(normal))
            if len(self.wide) > MEMO_WORDS:
                self.wide.clear()
            if len(chunk) <= LONGEST_HELD:
                self.wide[chunk] = out
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        rows = pc.split_pattern(pa.array([self.spaced(t) for t in texts], pa.string()), " ")
        found = pc.index_in(rows.values, value_set=self.known)
        which = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            new = rows.values.filter(found.is_null()).dictionary_encode()
            which[which < 0] = len(self.size) + new.indices.to_numpy()
            self.learn(new.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = self.size[which]
        upto = np.concatenate([[0], np.cumsum(size)])[rows.offsets.to_numpy()]
        ids = gathered(self.flat, self.start[which], size)
        if len(self.size) > PIECES_HELD:
            self.keep(which)
        return ids, np.diff(upto)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, size = self.ids(texts)
        raw, at = ids.astype("<u4").tobytes(), 4 * np.concatenate([[0], np.cumsum(size)])
        return [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start``, one behind the other."""
    upto = np.cumsum(size)
    n = int(upto[-1]) if len(upto) else 0
    at = np.repeat((start - upto + size).astype(np.int32 if max(n, len(flat)) < 1 << 31 else np.int64), size)
    at += np.arange(n, dtype=at.dtype)
    return flat[at]


class ForcedBoundaryEncoder(Splitter):
    """The same ids from forced cuts and merges of fragments."""

    def prepare(self, model: dict) -> None:
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.inside = self.pairs_inside()
        self.fragments: dict[str, bytes] = {}

    def pairs_inside(self) -> set[str]:
        """Pairs of byte letters that stand side by side in a token."""
        found = set()
        for token in self.vocab:
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            found.update(body[i : i + 2] for i in range(len(body) - 1))
        return found

    def fragments_of(self, piece: str) -> list[str]:
        """Fragments between the forced cuts; the last carries the word end."""
        out, start, inside = [], 0, self.inside
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in inside:
                out.append(piece[start:i])
                start = i
        return [*out, piece[start:] + self.end]

    def merge(self, fragment: str) -> bytes:
        """Merge the lowest-ranked pair until none is left."""
        last = fragment.endswith(self.end) if self.end else False
        body = fragment[: -len(self.end)] if last else fragment
        parts = list(body)
        if last:
            parts[-1] += self.end
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return np.array([self.vocab[p] for p in parts], "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        if len(self.fragments) > MEMO_WORDS:
            self.fragments = {}
        frags = self.fragments
        for w in words:
            if one_piece(w):
                pieces = [w if w.isascii() else w.translate(_LETTERS)]
            else:
                normal = self.tok.normalizer.normalize_str(w)
                pieces = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)]
            ids = []
            for piece in pieces:
                for f in self.fragments_of(piece):
                    got = frags.get(f)
                    if got is None:
                        got = frags[f] = self.merge(f) if len(f) < 200 else self.merge_long(f)
                    ids.append(got)
            self.memo[w] = b"".join(ids)

    def merge_long(self, fragment: str) -> bytes:
        """As ``merge`` with a heap: n log n for a fragment of any length."""
        import heapq

        last = bool(self.end) and fragment.endswith(self.end)
        parts = list(fragment[: -len(self.end)] if last else fragment)
        if last:
            parts[-1] += self.end
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([self.vocab[p] for p in parts if p], "<u4").tobytes()


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {}, 256
    for b in range(256):
        letters[b] = chr(b) if b in plain else chr(n)
        n += b not in plain
    return [letters[b] for b in range(256)]


_BYTE_LETTER = _byte_letters()
_LETTERS = {c: "".join(_BYTE_LETTER[b] for b in chr(c).encode()) for c in range(0x250)}
_HELD: dict[tuple[str, str], Splitter] = {}


def _lettered(word: str) -> str:
    return "".join(_BYTE_LETTER[b] for b in word.encode())


def held(kind: type[Splitter], path: str) -> Splitter:
    """One encoder per worker process, the last one asked for; its memo of words is bounded."""
    key = (kind.__name__, path)
    if key not in _HELD:
        release()
        _HELD[key] = kind(path)
    return _HELD[key]


def release() -> None:
    """Give the encoder's memory back: Spark gives its workers to other operators' tasks later, where it would stay."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


class Decoder:
    """Ids back to text; the file names no decoder, so tokens are joined by one space."""

    def __init__(self, path: str):
        enc = held(ForcedBoundaryEncoder, path)
        assert enc.decoder is None, "only files without a decoder are supported"
        tokens = {i: t for t, i in enc.vocab.items()} | {i: t for t, i in enc.added.items()}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]

    def decode(self, ids: bytes) -> str:
        get = self.tokens.__getitem__
        return " ".join(map(get, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids of every whole text as little-endian unsigned 32-bit integers."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = held(ForcedBoundaryEncoder, path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(enc.encode(b.column("text").to_pylist()), pa.binary())], ["doc_id", "ids"])

    return whole_texts(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for."""
    schema = T.StructType([*encoded.select("doc_id", "ids").schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(path)
        for b in slices(batches, "ids"):
            texts = [dec.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded again.

    Both directions run in one pass, so ids and decoded texts never leave the worker.
    """
    kinds = [T.LongType(), T.StringType(), T.StringType()]
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *map(T.StructField, names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        enc, dec = held(ForcedBoundaryEncoder, path), Decoder(path)
        for b in slices(batches, limit=1 << 20):
            coded = enc.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([sha256(x).hexdigest() for x in coded], pa.string()),
                    pa.array([sha256(dec.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in coded], pa.string()),
                ],
                schema.names,
            )

    return whole_texts(docs).mapInArrow(run, schema)
