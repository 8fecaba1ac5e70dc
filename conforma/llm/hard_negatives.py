"""Hard negatives: for each anchor and each of its nearest rows of the same label, near rows of other labels in a score window.

Scores are integer inner products of scaled, floored vectors. Anchors, a stated query set, meet all rows in tiles: blocks of
anchors, as many as a bounded number of values allows, go to the tasks, and each task multiplies them with its rows by
Strassen's recursion on int64 (odd sizes padded by zeros). A task keeps a bounded heap per anchor (its best rows of the
same label), then per anchor and positive (best rows of other labels inside the window); heaps of tasks are merged by a
shuffle of a few rows an anchor and task. Rows themselves are never shuffled, and no table of scores is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score is this share, in percent, of the positive's.
LOW_PERCENT, HIGH_PERCENT = 50, 95
#: Numbers of one round's anchors that go to every task (32 MB); more anchors take more rounds over the rows.
ROUND_VALUES = 1 << 22
#: Anchors and rows of one tile.
TILE = (1024, 4096)
#: Strassen's recursion ends where a side is this small.
LEAF = 32
NONE = np.iinfo(np.int64).min
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices by seven products of halves. Sums wrap at 64 bits, so the result is exact if it fits them."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return _leaf(a, b)
    h, i, j = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (m, k, n) != (2 * h, 2 * i, 2 * j):
        a = np.pad(a, ((0, 2 * h - m), (0, 2 * i - k)))
        b = np.pad(b, ((0, 2 * i - k), (0, 2 * j - n)))
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b; in doubles where no sum of products can pass 2^53, so that these are exact and much faster, else in int64."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    most = a.shape[1]
    for x in (a, b):
        most *= max(int(x.max()), -int(x.min()), 1)
    return (a.astype(float) @ b.astype(float)).astype(np.int64) if most < 1 << 53 else a @ b


def scaled(batch: pa.RecordBatch, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vec_id, label, matrix) of the rows of a batch that take part: floor(scale x) of vectors without null or non-finite components.

    Shorter vectors are padded by zeros. ValueError if squares of a row add up to 2^62, as products might not fit 64 bits.
    """
    vectors = batch.column("embedding")
    sizes = pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    flat = vectors.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if flat.null_count:
        values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, values)
    row = np.repeat(np.arange(len(sizes)), sizes)
    takes = vectors.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
    takes &= np.bincount(row, weights=~np.isfinite(values), minlength=len(sizes)) == 0
    with np.errstate(invalid="ignore", over="ignore"):
        floored = np.floor(scale * values)
        square = np.bincount(row, weights=np.where(takes[row], floored * floored, 0), minlength=len(sizes))
    if (square >= 2.0**62).any():
        raise ValueError("vectors are so long that their inner products may not fit 64 bits")
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    mine = takes[row]
    out[row[mine], (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[mine]] = floored[mine]
    ids, labels = (pa.compute.fill_null(batch.column(c), 0).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
    return ids[takes], labels[takes], out[takes]


class Heaps:
    """The best k of the rows met so far for each of n owners: by score, descending, then by id. Heaps of other tasks merge likewise."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def push(self, at: slice, scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        """Offer the wanted entries of scores (owners at x rows) with these ids, ascending."""
        held = self.score[at]
        wanted = wanted & (scores >= held[:, -1:])
        if wanted.sum() > 8 * self.k * len(held) and scores.shape[1] > self.k:
            # only a tile's own best k of an owner can enter
            bar = np.partition(np.where(wanted, scores, NONE), -self.k, axis=1)[:, -self.k :].min(axis=1)
            wanted &= scores >= bar[:, None]
        owner, col = np.nonzero(wanted)
        if not len(owner):
            return
        full = held > NONE
        owner = np.concatenate([np.nonzero(full)[0], owner])
        score = np.concatenate([held[full], scores[wanted]])
        new = np.concatenate([self.id[at][full], ids[col]])
        order = np.lexsort((new, -score, owner))
        owner, score, new = owner[order], score[order], new[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = place < self.k
        self.score[at][owner[best], place[best]] = score[best]
        self.id[at][owner[best], place[best]] = new[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, score, id) of what is held."""
        owner, _ = full = np.nonzero(self.score > NONE)
        return owner, self.score[full], self.id[full]


def _tiles(batches: Iterator[pa.RecordBatch], anchors: tuple[np.ndarray, np.ndarray, np.ndarray], scale: int) -> Iterator[tuple]:
    """(anchors' slice, scores, rows' ids and labels) of each tile; its rows ascend by id."""
    _, _, a = anchors
    for batch in batches:
        for first in range(0, batch.num_rows, TILE[1]):
            ids, labels, v = scaled(batch.slice(first, TILE[1]), scale)
            order = np.argsort(ids, kind="stable")
            ids, labels, v = ids[order], labels[order], v[order]
            width = min(a.shape[1], v.shape[1])  # the padding of the shorter adds nothing
            right = np.ascontiguousarray(v[:, :width].T)
            for k in range(0, len(a) if len(ids) else 0, TILE[0]):
                at = slice(k, min(len(a), k + TILE[0]))
                yield at, strassen(a[at, :width], right), ids, labels


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key, by score, descending, then by id, with their rank. Tasks drop what can't be among them before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _round(rows: DataFrame, anchors: pa.Table, scale: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for one round's anchors, a bounded table."""
    spark = rows.sparkSession
    batch = anchors.combine_chunks().to_batches()[0]
    shared = spark.sparkContext.broadcast(scaled(batch, scale))

    def best_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, _ = anchors = shared.value
        heaps = Heaps(len(a_ids), positives)
        for at, scores, ids, labels in _tiles(batches, anchors, scale):
            heaps.push(at, scores, (labels == a_labels[at, None]) & (ids != a_ids[at, None]), ids)
        owner, score, found = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(score), pa.array(found)], ["anchor", "score", "id"])

    chosen = materialise(_best(rows.mapInArrow(best_positives, "anchor long, score long, id long"), ["anchor"], positives), "positives")
    # at most POSITIVES rows of each of this round's anchors
    held = chosen.toArrow()
    n = len(shared.value[0])
    low_at, high_at = np.ones((positives, n), np.int64), np.zeros((positives, n), np.int64)
    ids, own = np.zeros((positives, n), np.int64), np.zeros((positives, n), np.int64)
    for anchor, score, found, rank in zip(*(held[c].to_pylist() for c in ("anchor", "score", "id", "rank"))):
        # low p <= 100 s <= high p as bounds of s
        low_at[rank - 1, anchor], high_at[rank - 1, anchor] = -(-low * score // 100), high * score // 100
        ids[rank - 1, anchor], own[rank - 1, anchor] = found, score
    windows = spark.sparkContext.broadcast((low_at, high_at, ids, own))

    def best_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_ids, a_labels, _ = anchors = shared.value
        low_at, high_at, ids_of, own = windows.value
        heaps = [Heaps(len(a_ids), negatives) for _ in range(positives)]
        for at, scores, ids, labels in _tiles(batches, anchors, scale):
            other = (labels != a_labels[at, None]) & (ids != a_ids[at, None])
            for k in range(positives):
                heaps[k].push(at, scores, other & (scores >= low_at[k][at, None]) & (scores <= high_at[k][at, None]), ids)
        for k, heap in enumerate(heaps):
            owner, score, found = heap.rows()
            cols = [owner, np.full(len(owner), k), a_ids[owner], ids_of[k][owner], own[k][owner], score, found]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["anchor", "place", "anchor_id", "positive_id", "positive_score", "score", "id"])

    found = rows.mapInArrow(best_negatives, "anchor long, place long, anchor_id long, positive_id long, positive_score long, score long, id long")
    best = _best(found, ["anchor", "place"], negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(vectors: DataFrame, anchors: DataFrame, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each of anchors, rows like those of vectors.

    vectors: vec_id, label, embedding. An anchor's positives are its best rows of its label (fewer, if there are fewer); each has
    its best rows of another label with low p <= 100 s <= high p, p the positive's score. Higher scores come first, ties by
    smaller vec_id. Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Rows with the
    anchor's own vec_id are no other rows. Repeated rows each count; a repeated anchor is mined once, anchors that share only their vec_id
    each. Vectors of different lengths are padded by zeros. Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    some = anchors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    some = materialise(some.where(F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).distinct(), "anchors")
    seen = some.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    rounds = -(-seen["n"] * max(1, seen["width"] or 1) // ROUND_VALUES)
    path = fresh_path(vectors.sparkSession, "negatives")
    for k in range(rounds):
        mine_now = some.where(F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(rounds)) == k).toArrow()
        if mine_now.num_rows:
            _round(rows, mine_now, scale, positives, negatives, low, high).write.mode("append").parquet(path)
    if not rounds:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return vectors.sparkSession.read.schema(SCHEMA).parquet(path)
