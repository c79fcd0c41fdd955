"""Centres and Gaussian mixtures of several sizes, fitted in the same passes over all points.

The points are packed once into blocks of doubles, which stay cached. A pass is one Spark job: every task adds up its
blocks for all fits still moving, and the driver gets one short row of sums per task. So ten numbers of clusters
cost as many passes as the slowest of them, and a pass moves no rows. Random choices are hashes of the coordinates
and of a row's place in its block, so copies of a point are drawn as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brightlake.plans.nearest import matrix

BLOCK_ROWS = 4096
STEPS = 50
TOLERANCE = 1e-4  # a fit of centres ends when none moves farther
ROUNDS = 2  # of drawing candidates; more while there are fewer than clusters
MOST_ROUNDS = 20
EM_STEPS = 100
EM_TOLERANCE = 0.01  # of the log likelihood
RIDGE = 1e-6  # added to the variances of a mixture

Centres = np.ndarray
Mixture = tuple[np.ndarray, np.ndarray, np.ndarray]  # weights, means, covariances


def pack(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(points): blocks of rows as bytes, dealt evenly over the cores and cached. The caller unpersists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, axes)
            if np.isnan(x).any():
                raise ValueError("a feature without values")
            raw = [x[i : i + BLOCK_ROWS].tobytes() for i in range(0, len(x), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["points"])

    axes = list(axes)
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.select(*[f"`{a}`" for a in axes]).mapInArrow(run, "points binary").repartition(tasks).persist()


def _tasks(blocks: DataFrame, d: int, work: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> list[np.ndarray]:
    """What ``work`` makes of the blocks of each task: one array of doubles, for points as (axis, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (np.ascontiguousarray(np.frombuffer(raw.as_buffer()).reshape(-1, d).T) for b in batches for raw in b.column("points"))
        found = work(rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(found, float).tobytes()], pa.binary())], ["sums"])

    return [np.frombuffer(r["sums"]) for r in blocks.mapInArrow(run, "sums binary").collect()]


def _summed(blocks: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part`` over all blocks."""

    def work(rows):
        total = None
        for x in rows:
            total = part(x) if total is None else total + part(x)
        return total

    found = _tasks(blocks, d, work)
    if not found:
        raise ValueError("no rows to fit")
    return np.sum(found, axis=0)


def _squares(x: np.ndarray, c: Centres) -> np.ndarray:
    """(centre, row): squared distances, exact near zero."""
    return sum(np.square(x[i][None, :] - c[:, i, None]) for i in range(len(x)))


def _least(far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and value of the least entry of every column, the first of equal ones."""
    best, at = far[0].copy(), np.zeros(far.shape[1], np.intp)
    for j in range(1, len(far)):
        np.putmask(at, far[j] < best, j)
        np.minimum(best, far[j], out=best)
    return at, best


def _grouped(at: np.ndarray, k: int, values: Sequence[np.ndarray]) -> np.ndarray:
    """(1 + values, group): number of rows and sums per group."""
    return np.stack([np.bincount(at, minlength=k).astype(float), *[np.bincount(at, v, k) for v in values]])


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for every point, from its coordinates and its place."""
    h = np.arange(x.shape[1], dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for v in x:
        h = (h ^ (v + 0.0).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)) / float(1 << 53)


def starts(blocks: DataFrame, d: int, ks: Sequence[int], seed: int) -> dict[int, Centres]:
    """First centres for every number of clusters, by k-means||: all points are weighed against the candidates so far
    and drawn in proportion to their squared distance; the candidates, with the points nearest to them, are then
    clustered on the driver. Fewer distinct points than ``k`` give a centre each."""

    def first(rows):
        best = None
        for x in rows:
            u = _uniform(x, seed)
            i = int(u.argmin())
            best = min(best or (2.0,), (float(u[i]), *x[:, i].tolist()))
        return best

    found = _tasks(blocks, d, first)
    if not found:
        raise ValueError("no rows to fit")
    candidates = np.array([min(map(tuple, found))[1:]])
    for turn in range(MOST_ROUNDS):
        if turn >= ROUNDS and len(candidates) >= max(ks):
            break
        cost = float(_summed(blocks, d, lambda x, c=candidates: np.array([_least(_squares(x, c))[1].sum()]))[0])
        if cost <= 0:
            break

        def draw(rows, c=candidates, share=2.0 * max(ks) / cost, salt=seed + 1 + turn):
            drawn = [x[:, _uniform(x, salt) < share * _least(_squares(x, c))[1]].T for x in rows]
            return np.unique(np.concatenate(drawn), axis=0).ravel() if drawn else None

        more = [x.reshape(-1, d) for x in _tasks(blocks, d, draw)]
        candidates = np.unique(np.concatenate([candidates, *more]), axis=0)
    weights = _summed(blocks, d, lambda x: np.bincount(_least(_squares(x, candidates))[0], minlength=len(candidates)).astype(float))
    return {k: _plus_plus(candidates, weights, k, np.random.default_rng(seed)) for k in ks}


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> Centres:
    """Weighted k-means++ and a few moves, on the candidates alone."""
    centres = points[[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centres) < min(k, len(points)):
        mass = weights * _least(_squares(points.T, centres))[1]
        if mass.sum() <= 0:
            break
        centres = np.vstack([centres, points[rng.choice(len(points), p=mass / mass.sum())]])
    for _ in range(30):
        at = _least(_squares(points.T, centres))[0]
        n, *sums = _grouped(at, len(centres), [weights, *(weights * points.T)])[1:]
        centres = np.where(n[:, None] > 0, np.stack(sums, 1) / np.maximum(n, 1e-300)[:, None], centres)
    return centres


def _split(flat: np.ndarray, shapes: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    ends = np.cumsum([math.prod(s) for s in shapes])[:-1]
    return [part.reshape(s) for part, s in zip(np.split(flat, ends), shapes)]


def _cuts(parts: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    """Rows of each part once they are stacked."""
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return list(zip([0, *ends], ends))


def fit_centres(blocks: DataFrame, d: int, ks: Sequence[int], seed: int) -> dict[int, Centres]:
    """Lloyd's moves for all ``ks`` in the same passes; a fit that has come to rest leaves them."""
    fits = starts(blocks, d, ks, seed)
    moving = list(ks)
    for _ in range(STEPS):
        now = [fits[k] for k in moving]
        every, cuts = np.concatenate(now), _cuts(now)
        # squared distance without the point's own square: one product for the centres of all fits
        product = np.column_stack([np.square(every).sum(axis=1), -2 * every])

        def work(rows, product=product, cuts=cuts):
            total, far = None, np.empty((0, 0))
            for x in rows:
                if far.shape[1] != x.shape[1]:
                    far, near = np.empty((2, len(product), x.shape[1]))
                z = np.concatenate([np.ones((1, x.shape[1])), x])
                np.matmul(product, z, out=far)
                for a, b in cuts:
                    np.less_equal(far[a:b], far[a:b].min(axis=0), out=near[a:b], casting="unsafe")
                if near.sum() > len(cuts) * x.shape[1]:  # of equally near centres the first
                    for a, b in cuts:
                        near[a:b] *= np.cumsum(near[a:b], axis=0) == 1
                total = near @ z.T if total is None else total + near @ z.T
            return total

        found = np.sum(_tasks(blocks, d, work), axis=0).reshape(len(every), 1 + d)
        rest = []
        for k, c, (a, b) in zip(moving, now, cuts):
            sums = found[a:b].T
            n = sums[0]
            fits[k] = np.where(n[:, None] > 0, (sums[1:] / np.maximum(n, 1.0)).T, c)
            if np.square(fits[k] - c).sum(axis=1).max() > TOLERANCE**2:
                rest.append(k)
        moving = rest
        if not moving:
            break
    return fits


def _terms(x: np.ndarray) -> np.ndarray:
    """(1 + d + d * d, row): one, the coordinates and their products."""
    return np.concatenate([np.ones((1, x.shape[1])), x, (x[:, None, :] * x[None, :, :]).reshape(-1, x.shape[1])])


def _log_weights(model: Mixture) -> np.ndarray:
    """(component, term): log of weight times density is a sum over the terms of a point."""
    out = []
    for w, m, c in zip(*model):
        inverse = np.linalg.inv(c)
        inverse = (inverse + inverse.T) / 2
        one = math.log(max(w, 1e-300)) - 0.5 * (np.linalg.slogdet(c)[1] + len(m) * math.log(2 * math.pi) + m @ inverse @ m)
        out.append(np.concatenate([[one], inverse @ m, -0.5 * inverse.ravel()]))
    return np.array(out)


def _mixture(sums: np.ndarray, d: int) -> Mixture:
    """Weights, means and covariances from sums of shares, of coordinates and of their products."""
    n = np.maximum(sums[:, 0], 1e-300)
    means = sums[:, 1 : 1 + d] / n[:, None]
    second = sums[:, 1 + d :].reshape(-1, d, d) / n[:, None, None]
    return sums[:, 0] / sums[:, 0].sum(), means, second - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)


def fit_mixtures(blocks: DataFrame, d: int, ks: Sequence[int], seed: int) -> dict[int, tuple[Mixture, float]]:
    """Full-covariance mixtures by expectation and maximisation from the clusters of ``fit_centres``, all ``ks`` in the same
    passes; with the log likelihood of each fit."""
    centres = fit_centres(blocks, d, ks, seed)
    wide = 1 + d + d * d

    def first(x):
        return np.concatenate([(np.eye(len(c))[_least(_squares(x, c))[0]].T @ _terms(x).T).ravel() for c in centres.values()])

    sums = _split(_summed(blocks, d, first), [(len(c), wide) for c in centres.values()])
    fits = {k: _mixture(s[s[:, 0] > 0], d) for k, s in zip(centres, sums)}
    likelihood, moving = dict.fromkeys(ks, -math.inf), list(ks)
    for step in range(EM_STEPS + 1):
        weights = [_log_weights(fits[k]) for k in moving]
        product, cuts = np.concatenate(weights), _cuts(weights)

        def work(rows, product=product, cuts=cuts):
            total, logs = None, np.zeros(len(cuts))
            shares = np.empty((0, 0))
            for x in rows:
                z = _terms(x)
                if shares.shape[1] != x.shape[1]:
                    shares = np.empty((len(product), x.shape[1]))
                np.matmul(product, z, out=shares)
                for i, (a, b) in enumerate(cuts):
                    part = shares[a:b]
                    top = part.max(axis=0)
                    part -= top
                    np.exp(part, out=part)
                    whole = part.sum(axis=0)
                    part /= whole
                    logs[i] += top.sum() + np.log(whole).sum()
                total = shares @ z.T if total is None else total + shares @ z.T
            return None if total is None else np.concatenate([logs, total.ravel()])

        found = np.sum(_tasks(blocks, d, work), axis=0)
        found, parts = found[: len(cuts)], found[len(cuts) :].reshape(len(product), wide)
        rest = []
        for k, logs, (a, b) in zip(moving, found, cuts):
            sums = parts[a:b]
            before, likelihood[k] = likelihood[k], float(logs)
            if step < EM_STEPS and abs(logs - before) > EM_TOLERANCE:
                fits[k] = _mixture(sums, d)
                rest.append(k)
        moving = rest
        if not moving:
            break
    return {k: (fits[k], likelihood[k]) for k in ks}


def labels(x: np.ndarray, model: Centres | Mixture) -> np.ndarray:
    """Cluster of every point (axis, row): the nearest centre, or the likeliest component."""
    return _least(_squares(x, model) if isinstance(model, np.ndarray) else -(_log_weights(model) @ _terms(x)))[0]


def quality(blocks: DataFrame, d: int, models: Sequence[Centres | Mixture]) -> list[dict]:
    """Per model and cluster ``n``, ``centre`` (mean of its points), ``within`` (sum of squares about it) and ``spread`` (mean
    distance); ``inertia`` about the model's own centres, and the silhouette on squared distances. Two passes for all models;
    empty clusters are left out, but for ``sizes``."""
    sizes = [len(m) if isinstance(m, np.ndarray) else len(m[0]) for m in models]

    def first(x):
        square = np.square(x).sum(axis=0)
        out = []
        for m, k in zip(models, sizes):
            at = labels(x, m)
            c = m if isinstance(m, np.ndarray) else m[1]
            out.append(_grouped(at, k, [*x, square, np.square(x - c[at].T).sum(axis=0)]).ravel())
        return np.concatenate(out)

    sums = _split(_summed(blocks, d, first), [(3 + d, k) for k in sizes])
    there = [s[0] > 0 for s in sums]
    n = [s[0][t] for s, t in zip(sums, there)]
    centres = [(s[1 : 1 + d][:, t] / s[0][t]).T for s, t in zip(sums, there)]
    squares = [s[1 + d][t] / s[0][t] for s, t in zip(sums, there)]
    rank = [np.cumsum(t) - 1 for t in there]

    def second(x):
        out = []
        own_square = np.square(x).sum(axis=0)
        for m, c, size, square, place in zip(models, centres, n, squares, rank):
            at = place[labels(x, m)]
            far = np.square(x - c[at].T).sum(axis=0)
            score = np.zeros(x.shape[1])
            if len(c) > 1:
                mean = np.maximum(own_square - 2 * np.einsum("kd,dn->kn", c, x) + square[:, None], 0.0)
                rows = np.arange(x.shape[1])
                alone, own = size[at] == 1, mean[at, rows] * (size / np.maximum(size - 1, 1))[at]
                mean[at, rows] = np.inf
                other = mean.min(axis=0)
                score = np.where(alone, 0.0, (other - own) / np.maximum(np.maximum(own, other), 1e-300))
            out.append(_grouped(at, len(c), [far, np.sqrt(far), score])[1:].ravel())
        return np.concatenate(out)

    parts = _split(_summed(blocks, d, second), [(3, len(c)) for c in centres])
    return [
        {"n": size, "centre": c, "within": p[0], "spread": p[1] / size, "silhouette": float(p[2].sum() / size.sum()), "inertia": float(s[2 + d].sum()), "sizes": s[0]}
        for size, c, p, s in zip(n, centres, parts, sums)
    ]
