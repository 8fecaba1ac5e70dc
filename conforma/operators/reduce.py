"""Projection of frames to two dimensions: principal components, metric scaling, and stochastic neighbour embedding.

All three run distributed on all frames (see components and embedding). For very many frames the latter two also take landmarks: the
plain method on so many frames, chosen by hash, and every other frame placed by its nearest landmarks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import normalise_techniques
from .components import OUT, pca
from .embedding import PERPLEXITY, embed_all, scale_places

SEED = 42
NEIGHBOURS = 5
#: Query frames of distances_from() that the driver holds at most.
MOST_QUERIES = 10_000


def distance_matrix(wide: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(frame_a, frame_b, d): Euclidean distances of all frames, frame_a < frame_b, or of queries to all other frames. The result itself is quadratic; for landmarks only."""
    a = (wide if queries is None else queries).select(F.col("frame").alias("frame_a"), F.col("vals").alias("va"))
    b = wide.select(F.col("frame").alias("frame_b"), F.col("vals").alias("vb"))
    square = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    on = F.col("frame_a") < F.col("frame_b") if queries is None else F.col("frame_a") != F.col("frame_b")
    return a.join(b, on).select("frame_a", "frame_b", F.sqrt(square).alias("d"))


def distances_from(queries: DataFrame, wide: DataFrame, block: int = 256) -> DataFrame:
    """(frame_a, frame_b, d): Euclidean distances of every frame of queries, a stated set, to every other frame of wide.

    Queries go to all frames in blocks of so many rows at a time; each block meets all frames once, in a map over them.
    """
    rows = queries.select("frame", "vals").orderBy("frame")
    numbered = [(r["frame"], r["vals"]) for r in rows.limit(MOST_QUERIES + 1).collect()]
    if len(numbered) > MOST_QUERIES:
        # too many for the driver: the same pairs by a join, whose blocks are Spark's
        return distance_matrix(wide, queries)
    out = None
    for k in range(0, max(1, len(numbered)), block):
        part = numbered[k : k + block]
        ids = np.array([x[0] for x in part], np.int64)
        shared = wide.sparkSession.sparkContext.broadcast((ids, np.array([x[1] for x in part], float)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a, va = shared.value
            for batch in batches:
                for i in range(0, batch.num_rows if len(a) else 0, 512):
                    some = batch.slice(i, 512)
                    b, vb = some.column("frame").to_numpy(), some.column("vals").flatten().to_numpy().reshape(some.num_rows, -1)
                    # differences, not the expanded square, so that near frames lose no digits
                    d = np.sqrt(np.stack([((v - vb) ** 2).sum(axis=1) for v in va]))
                    x, y = np.nonzero(a[:, None] != b[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(a[x]), pa.array(b[y]), pa.array(d[x, y])], ["frame_a", "frame_b", "d"])

        got = wide.select(F.col("frame").cast("long").alias("frame"), "vals").mapInArrow(run, "frame_a long, frame_b long, d double")
        out = got if out is None else out.unionByName(got)
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def stress(d: np.ndarray, y: np.ndarray) -> float:
    """Sum over pairs of squared differences between wanted and embedded distances."""
    return float(((d - _distances(y, y)) ** 2).sum() / 2)


def scale_metric(d: np.ndarray, seed: int = SEED, rounds: int = 300, tolerance: float = 1e-6) -> np.ndarray:
    """Two-dimensional metric scaling of a distance matrix by majorisation: each round applies the Guttman transform."""
    n = len(d)
    y = np.random.default_rng(seed).normal(size=(n, 2)) * (d.max() or 1.0)
    last = None
    for _ in range(rounds):
        e = _distances(y, y)
        ratio = np.divide(d, e, out=np.zeros_like(d), where=e > 1e-12)
        b = -ratio
        b[np.arange(n), np.arange(n)] = ratio.sum(axis=1)
        y = b @ y / n
        now = stress(d, y)
        if last is not None and last - now < tolerance * max(last, 1e-12):
            break
        last = now
    return y


def neighbour_embedding(x: np.ndarray, perplexity: float = PERPLEXITY, rounds: int = 500, seed: int = SEED) -> np.ndarray:
    """Two-dimensional exact t-distributed stochastic neighbour embedding, started from principal components."""
    n = len(x)
    if n <= perplexity:
        raise ValueError(f"perplexity {perplexity:g} needs more than {perplexity:g} frames; there are {n}")
    square = _distances(x, x) ** 2
    np.fill_diagonal(square, np.inf)
    beta, lo, hi = np.ones(n) / max(np.median(square[np.isfinite(square)]), 1e-12), np.zeros(n), np.full(n, np.inf)
    shifted = square - square.min(axis=1, keepdims=True)
    for _ in range(60):
        p = np.exp(-shifted * beta[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + beta * (np.where(p > 0, shifted, 0) * p).sum(axis=1) / total
        wide = entropy > np.log(perplexity)
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    p = np.exp(-shifted * beta[:, None])
    p /= p.sum(axis=1, keepdims=True)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    y = u[:, :2] * s[:2]
    if y.shape[1] < 2:
        y = np.column_stack([y, np.zeros(n)])
    y = y / (y[:, 0].std() or 1.0) * 1e-4 + np.random.default_rng(seed).normal(size=(n, 2)) * 1e-6
    speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50.0)
    for k in range(rounds):
        q = 1 / (1 + _distances(y, y) ** 2)
        np.fill_diagonal(q, 0)
        force = ((12.0 if k < rounds // 4 else 1.0) * p - np.maximum(q / q.sum(), 1e-12)) * q
        slope = 4 * (force.sum(axis=1)[:, None] * y - force @ y)
        gain = np.maximum(np.where(slope * speed < 0, gain + 0.2, gain * 0.8), 0.01)
        speed = (0.5 if k < rounds // 4 else 0.8) * speed - rate * gain * slope
        y = y + speed
        y -= y.mean(axis=0)
    return y


def _by_landmarks(wide: DataFrame, embed: Callable[[np.ndarray], np.ndarray], landmarks: int) -> DataFrame:
    """Embed at most landmarks frames (the first by hash of ensemble and frame), then place the others by their nearest ones."""
    chosen = wide.orderBy(F.xxhash64("ensemble", "frame"), "ensemble", "frame").limit(landmarks).toPandas()
    chosen = chosen.sort_values(["ensemble", "frame"])
    if not len(chosen):
        return wide.sparkSession.createDataFrame([], OUT)
    x = np.stack(chosen["vals"].to_numpy())
    shared = wide.sparkSession.sparkContext.broadcast((x, embed(x)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("vals").flatten().to_numpy().reshape(batch.num_rows, -1)
            d = _distances(v, x)
            k = min(NEIGHBOURS, len(x))
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            w = 1 / np.maximum(np.take_along_axis(d, near, 1), 1e-6) ** 2
            # a frame that is a landmark keeps its own place
            out = (w[:, :, None] * y[near]).sum(axis=1) / w.sum(axis=1)[:, None]
            own = d.min(axis=1) < 1e-7
            out[own] = y[d[own].argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("ensemble"), batch.column("frame"), pa.array(out[:, 0]), pa.array(out[:, 1])], ["ensemble", "frame", "c1", "c2"])

    rows = wide.select(F.col("ensemble").cast("int").alias("ensemble"), F.col("frame").cast("long").alias("frame"), "vals")
    return rows.mapInArrow(place, OUT)


def mds(wide: DataFrame, landmarks: int | None = None) -> DataFrame:
    """Metric scaling to two dimensions (seeded) of all frames; with landmarks, of so many, with the others by their nearest ones."""
    return scale_places(wide) if landmarks is None else _by_landmarks(wide, lambda x: scale_metric(_distances(x, x)), landmarks)


def tsne(wide: DataFrame, landmarks: int | None = None, perplexity: float = PERPLEXITY) -> DataFrame:
    """Stochastic neighbour embedding to two dimensions (seeded) of all frames; with landmarks, of so many, with the others by their nearest ones."""
    return embed_all(wide, perplexity) if landmarks is None else _by_landmarks(wide, lambda x: neighbour_embedding(x, perplexity), landmarks)


def reduce(wide: DataFrame, technique: str) -> DataFrame:
    """(ensemble, frame, c1, c2) by a technique; ValueError if there is no such technique."""
    names = normalise_techniques([technique])
    return {"pca": pca, "mds": mds, "tsne": tsne}[names[0]](wide)


def points_of(reduced: DataFrame, ensemble: int) -> DataFrame:
    """The projected frames of one ensemble."""
    return reduced.where(F.col("ensemble") == ensemble)


__all__ = ["distance_matrix", "distances_from", "mds", "neighbour_embedding", "pca", "points_of", "reduce", "scale_metric", "stress", "tsne"]
