"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level tags. Each block becomes a
vector of hashed tag-path names (with words of class and id), hashed words and a few shape numbers; a
bidirectional LSTM in numpy reads the whole sequence and labels every block as main text or not, so
the decision for a block depends on the whole page.

No labels come with pages. The labeller learns from the blocks of ``FIT_PAGES`` pages (those whose
page_id hashes lowest), labelled by where they stand: inside an article or main element, and inside
no element that menus, headers outside the article, footers, sidebars, notices, adverts, forms or
comments are marked up with. Those marks and the path are inputs too, so what the marks say about the
sampled pages carries over to pages whose markup differs.

Scripts, styles, templates and markup comments hold no blocks. Character references are decoded, white
space inside a block becomes one space, blocks are joined in page order by one space; nothing else is
dropped or cut. Null and empty pages, and pages without main blocks, have an empty text. Repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from brightlake.llm.common import slices

FIT_PAGES = 400
FIT_BLOCKS = 120  # blocks of a fitting page from its start; extraction reads all
BUCKETS = 512
HIDDEN = 12
EPOCHS = 40
#: Elements that do not end a block, hold no text, have no end tag, or mark main text and side matter.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN_TEXT = ("script", "style", "template", "noscript", "svg", "textarea", "title", "select", "iframe")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
MAIN = {"article", "main"}
SIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "figcaption-ad"}
SIDE_WORDS = re.compile(r"\b(ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumb\w*|sidebar|footer|comment\w*|reply|replies|discussion|cookie\w*|consent|notice|alert|newsletter|subscribe|share|social|related|popup|modal)\b")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARK = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str]]:
    """(path, text) of every leaf block; a path has an element's name and the words of its marks per step."""
    stack: list[tuple[str, str]] = []
    out: list[tuple[tuple[str, ...], str]] = []
    text: list[str] = []

    def close_block():
        body = " ".join(html.unescape("".join(text)).split())
        if body:
            out.append((tuple(f"{n} {m}".strip() for n, m in stack), body))
        text.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in HIDDEN_TEXT and not m[1]:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if not m[3].endswith("/"):
                at = end.end() if end else n
            if name not in INLINE:
                close_block()
            continue
        if name in ("br", "hr"):
            text.append(" ")
        if name in INLINE or name in VOID:
            continue
        close_block()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            while stack and stack[-1][0] in CLOSED_BY.get(name, ()):
                stack.pop()
            if not m[3].endswith("/"):
                stack.append((name, " ".join(a or b or c for _, a, b, c in _MARK.findall(m[3])).lower()))
    close_block()
    return out


def weak_label(path: tuple[str, ...]) -> int:
    """1 for a block inside the article and inside nothing marked as side matter."""
    names = [p.split(" ")[0] for p in path]
    inside = [i for i, x in enumerate(names) if x in MAIN]
    if not inside or SIDE & set(names):
        return 0
    return int(not any(SIDE_WORDS.search(re.sub(r"[_-]", " ", p)) for p in path if " " in p))


def _bucket(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def vector_ids(path: tuple[str, ...], body: str) -> tuple[list[int], list[float]]:
    """Hashed names of the block's path and words, and its shape."""
    ids = {_bucket("/" + w) for step in path for w in re.split(r"[\s_-]+", step) if w}
    ids |= {_bucket("^" + "/".join(p.split(" ")[0] for p in path[-2:]))}
    words = body.split(" ")
    ids |= {_bucket("w" + w.lower()) for w in words[:3]}
    shape = [min(1.0, np.log1p(len(words)) / 6), min(1.0, sum(body.count(c) for c in ".!?") / (1 + len(words)) * 4), min(1.0, len(path) / 10)]
    return sorted(ids), shape


def page_matrix(blocks) -> np.ndarray:
    """One row per block."""
    x = np.zeros((len(blocks), BUCKETS + 3))
    for i, (path, body) in enumerate(blocks):
        ids, shape = vector_ids(path, body)
        x[i, ids] = 1
        x[i, BUCKETS:] = shape
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Labeller:
    """Bidirectional LSTM with one output per block; rows of a batch are padded at the end."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        size, h = BUCKETS + 3, HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = r.normal(0, 0.1, (size, 4 * h))
            self.p["h" + d] = r.normal(0, 0.1, (h, 4 * h))
            self.p["c" + d] = np.concatenate([np.ones(h), np.zeros(3 * h)])
        self.p["o"] = r.normal(0, 0.1, (2 * h, 1))
        self.p["q"] = np.zeros(1)

    def _run(self, x, mask, d):
        """States of one direction over (pages, blocks, inputs); padded blocks keep the state."""
        n, t, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        z_in = x @ self.p["x" + d] + self.p["c" + d]
        states, tape = np.zeros((n, t, HIDDEN)), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = z_in[:, s] + h @ self.p["h" + d]
            f, i, o, g = (_sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :]))
            new = f * c + i * g
            on = mask[:, s : s + 1]
            tape.append((s, h, c, f, i, o, g, new, on))
            c = np.where(on, new, c)
            h = np.where(on, o * np.tanh(new), h)
            states[:, s] = h
        return states, tape

    def _back(self, x, tape, grad, d, out):
        dh, dc = np.zeros_like(tape[0][1]), np.zeros_like(tape[0][2])
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
        for s, h, c, f, i, o, g, new, on in reversed(tape):
            dh = dh + grad[:, s]
            tn = np.tanh(new)
            dn = np.where(on, dc + dh * o * (1 - tn * tn), 0)
            do = np.where(on, dh * tn * o * (1 - o), 0)
            dz = np.concatenate([dn * c * f * (1 - f), dn * g * i * (1 - i), do, dn * i * (1 - g * g)], axis=1)
            dz_all[:, s] = dz
            out["h" + d] += h.T @ dz
            dc = np.where(on, dn * f, dc)
            dh = np.where(on, 0, dh) + dz @ self.p["h" + d].T
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        out["x" + d] += x.reshape(-1, x.shape[2]).T @ flat
        out["c" + d] += flat.sum(axis=0)

    def chances(self, x, mask):
        states = np.concatenate([self._run(x, mask, d)[0] for d in "fb"], axis=2)
        return _sigmoid((states @ self.p["o"])[..., 0] + self.p["q"])

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 32) -> Labeller:
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        pages = sorted(pages, key=lambda p: len(p[1]))
        step = 0
        for _ in range(epochs):
            for start in range(0, len(pages), batch):
                x, mask = padded([p[0] for p in pages[start : start + batch]])
                y = np.zeros(mask.shape)
                for k, p in enumerate(pages[start : start + batch]):
                    y[k, : len(p[1])] = p[1]
                runs = {d: self._run(x, mask, d) for d in "fb"}
                states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
                gap = np.where(mask, _sigmoid((states @ self.p["o"])[..., 0] + self.p["q"]) - y, 0) / max(1, mask.sum())
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["o"] = states.reshape(-1, 2 * HIDDEN).T @ gap.reshape(-1, 1)
                grads["q"] = np.array([gap.sum()])
                down = gap[..., None] @ self.p["o"].T
                self._back(x, runs["f"][1], down[..., :HIDDEN], "f", grads)
                self._back(x, runs["b"][1], down[..., HIDDEN:], "b", grads)
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), longest, BUCKETS + 3)), np.zeros((len(pages), longest), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


def fit(pages: DataFrame, n: int = FIT_PAGES) -> Labeller:
    """Train on the blocks of a bounded, deterministic sample of pages."""
    picked = pages.where("html is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(n).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page in b.column("html").to_pylist():
                found = blocks_of(page)[:FIT_BLOCKS]
                rows = [vector_ids(*x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([[r[0] for r in rows]], pa.list_(pa.list_(pa.int32()))), pa.array([[r[1] for r in rows]], pa.list_(pa.list_(pa.float64()))), pa.array([[weak_label(p) for p, _ in found]], pa.list_(pa.int32()))],
                    ["ids", "shape", "labels"],
                )

    rows = picked.mapInArrow(run, "ids array<array<int>>, shape array<array<double>>, labels array<int>").collect()  # FIT_PAGES x FIT_BLOCKS
    data = []
    for r in sorted(rows, key=lambda r: str(r)):
        if r["labels"]:
            x = np.zeros((len(r["labels"]), BUCKETS + 3))
            for i, (ids, shape) in enumerate(zip(r["ids"], r["shape"])):
                x[i, ids] = 1
                x[i, BUCKETS:] = shape
            data.append((x, np.array(r["labels"], float)))
    return Labeller().fit(data)


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 1 << 20):
            found = [blocks_of(p or "") for p in b.column("html").to_pylist()]
            texts = [""] * len(found)
            order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
            while order:  # pages of similar length together, a bounded number of blocks at a time
                longest, take = len(found[order[-1]]), 1
                while take < len(order) and (take + 1) * longest <= 4000:
                    take += 1
                own, order = order[-take:], order[:-take]
                x, mask = padded([page_matrix(found[i]) for i in own])
                p = labeller.chances(x, mask)
                for k, i in enumerate(own):
                    texts[i] = " ".join(body for (_, body), q in zip(found[i], p[k]) if q > 0.5)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, schema)
