"""Principal components by block Krylov iteration: no matrix of features by features anywhere, so any number of features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import stored
from .blocks import block_rows, packed, summed, width_of

SEED = 42
#: Vectors multiplied at once, and vectors of the basis before it is restarted from the best.
BLOCK, BASIS = 6, 96
TOLERANCE = 1e-10
ROUNDS = 200
#: Features whose sums make one row.
CHUNK = 8192
ROWS = 2048
OUT = "ensemble int, frame long, c1 double, c2 double"


def _each(blocks: DataFrame, features: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of of(x), an array of one row per feature; tasks add up their own blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("x"):
                got = of(np.frombuffer(x.as_buffer()).reshape(-1, features))
                total = got if total is None else total + got
        if total is not None:
            keys = range(0, features, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([np.ascontiguousarray(total[k : k + CHUNK]).tobytes() for k in keys], pa.binary())], ["key", "x"])

    got = summed(blocks.select("x").mapInArrow(run, "key long, x binary"), blocks.rdd.getNumPartitions(), features * BLOCK)
    return np.concatenate([got[k] for k in sorted(got)])


def leading(multiply: Callable[[np.ndarray], np.ndarray], features: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k largest eigenvalues of a symmetric operator that multiplies a block of vectors.

    The basis of a block Krylov space grows by orthogonalised products until the residuals of the k best Ritz vectors are below
    TOLERANCE of the largest value, or the space is exhausted. It restarts from the best vectors at BASIS vectors.
    """
    k = min(k, features)
    new, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, min(BLOCK, features))))
    basis, images = np.zeros((features, 0)), np.zeros((features, 0))
    for _ in range(ROUNDS):
        basis, images = np.hstack([basis, new]), np.hstack([images, multiply(new)])
        small = basis.T @ images
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        best, best_images = basis @ mix[:, :k], images @ mix[:, :k]
        left = np.linalg.norm(best_images - best * values[:k], axis=0)
        if len(values) >= k and (left <= TOLERANCE * max(abs(values[0]), 1e-300)).all():
            break
        if basis.shape[1] > BASIS:
            keep = mix[:, :BLOCK]
            basis, images = basis @ keep, images @ keep
        new = images[:, -new.shape[1] :]
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
        new, r = np.linalg.qr(new)
        new = new[:, np.abs(np.diag(r)) > 1e-12 * max(abs(values[0]), 1e-300)]
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
        new = np.linalg.qr(new)[0] if new.shape[1] else new
        if not new.shape[1] or basis.shape[1] >= features:
            break
    return values[:k], best


def fit_components(wide: DataFrame, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, loadings (features, k), variances) of the centred, unscaled features; the largest loading of each is positive.

    Each step multiplies a few vectors by the covariance in a map over blocks of frames; features times BLOCK numbers come back.
    """
    features = width_of(wide)
    blocks = stored(packed(wide, block_rows(features, ROWS)), "packed")
    n = sum(r["n"] for r in blocks.select("n").collect())
    mean = _each(blocks, features, lambda x: x.sum(axis=0)) / n

    def multiply(v: np.ndarray) -> np.ndarray:
        shared = wide.sparkSession.sparkContext.broadcast((mean, v))

        def of(x: np.ndarray) -> np.ndarray:
            mu, v = shared.value
            # (x - mu)' (x - mu) v without a centred copy of x
            y = x @ v - mu @ v
            return x.T @ y - np.outer(mu, y.sum(axis=0))

        got = _each(blocks, features, of).reshape(features, -1) / max(1, n - 1)
        shared.destroy()
        return got

    values, loads = leading(multiply, features, k)
    signs = np.sign(loads[np.abs(loads).argmax(axis=0), np.arange(loads.shape[1])])
    return mean, loads * np.where(signs == 0, 1, signs), values


def pca(wide: DataFrame) -> DataFrame:
    """First two principal components of the centred, unscaled features; with one feature, c2 is 0. An empty table gives an empty result."""
    features = width_of(wide)
    if not features:
        return wide.sparkSession.createDataFrame([], OUT)
    mean, loads, _ = fit_components(wide)
    shared = wide.sparkSession.sparkContext.broadcast((mean, np.hstack([loads, np.zeros((features, 2 - loads.shape[1]))])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, loads = shared.value
        for batch in batches:
            if batch.num_rows:
                y = (batch.column("vals").flatten().to_numpy().reshape(batch.num_rows, -1) - mean) @ loads
                yield pa.RecordBatch.from_arrays([batch.column("ensemble"), batch.column("frame"), pa.array(np.ascontiguousarray(y[:, 0])), pa.array(np.ascontiguousarray(y[:, 1]))], ["ensemble", "frame", "c1", "c2"])

    return wide.selectExpr("CAST(ensemble AS INT) AS ensemble", "CAST(frame AS BIGINT) AS frame", "CAST(vals AS ARRAY<DOUBLE>) AS vals").mapInArrow(place, OUT)
