"""Metric scaling and stochastic neighbour embedding of all frames to two dimensions, in blocks of frames.

Both methods move all frames at once, round by round. A round is one map over stored blocks: the frames' places, two numbers
each and counted, go to the tasks, and the sums that move them come back. Pairs of frames are neither shuffled nor stored: a task holds one
run of blocks and reads the others, one after another, from where they are stored.

Metric scaling: the Guttman transform over blocks of the distance matrix, which are computed anew each round (majorisation, so
the stress never rises); of very many frames places near the end come from rounds by some frames first.
Neighbour embedding: exact nearest neighbours by blocks, a bounded list per frame; attraction along that graph; repulsion
from a grid over the places, whose nodes meet by one convolution, or, for places that are spread too far, by a quadtree (Barnes-Hut):
cells that look small from a frame act as one point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .blocks import ROWS, VALUES, Place, block_groups, by_group, ordered_blocks, read_blocks, read_rows, summed
from .components import OUT, pca

SEED = 42
PERPLEXITY = 30.0
#: Neighbours of a frame in the graph, as multiples of the perplexity.
REACH = 3
#: Frames whose places go to every task; both methods need far more than a day beyond that.
MOST_FRAMES = 5_000_000
SCALING_ROUNDS, SCALING_TOLERANCE = 300, 5e-5
EMBEDDING_ROUNDS = 250
#: Frames by which all others move at first in metric scaling, if they are a sixteenth of all or less.
FEW = 8192
#: A quadtree's cell acts as one point if its width is under this share of its distance.
ANGLE = 0.5
#: Levels of the quadtree.
DEPTH = 16
#: Steps of the grid of places (the kernel's own width is 1), and about its nodes a side at most.
STEP, MOST_SIDE = 0.25, 2048
#: Columns of the grid's transform at a time.
BAND = 64
#: Edges of a stored row, edges that a task deals at a time, and frames of the other ends that come together.
EDGES, PACKETS, SPAN = 1 << 16, 1 << 20, 1 << 16
#: Frames of a block of the graph at most.
MOST_ROWS = 1 << 14
#: Frames of a task's own that meet a block at a time.
CHUNK = 256
#: Pairs whose values are gathered at a time.
GATHERED = 1 << 10


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows, from differences about a common centre so that near rows lose few digits."""
    centre = x.mean(axis=0)
    x, y = x - centre, y - centre
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def _matrix(value: pa.Scalar, rows: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer()).reshape(rows, -1)


def _places(wide: DataFrame, frames: int) -> np.ndarray:
    """Places to start from: principal components, in the order of (ensemble, frame)."""
    if frames > MOST_FRAMES:
        raise ValueError(f"{frames} frames are too many to embed by all their distances; give landmarks")
    got = pca(wide).orderBy("ensemble", "frame").select("c1", "c2").toArrow()
    return np.stack([got["c1"].to_numpy(), got["c2"].to_numpy()], axis=1)


def _placed(blocks: DataFrame, y: np.ndarray) -> DataFrame:
    """OUT for the frames of blocks with places y."""
    shared = blocks.sparkSession.sparkContext.broadcast(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, ensembles, frames in zip(*(batch.column(c).to_pylist() for c in ("first", "n", "ensembles", "frames"))):
                own = shared.value[first : first + n]
                yield pa.RecordBatch.from_arrays([pa.array(ensembles, pa.int32()), pa.array(frames, pa.int64()), pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy())], ["ensemble", "frame", "c1", "c2"])

    return blocks.select("first", "n", "ensembles", "frames").mapInArrow(run, OUT)


class _Products:
    """Squared distances of rows x about centre to other rows, one product of matrices of the given type."""

    def __init__(self, x: np.ndarray, kind: type):
        self.centre, self.kind = x.mean(axis=0), kind
        x = x - self.centre
        # a power of two, so that the smaller type neither overflows nor loses a digit by it
        top = float(np.abs(x).max(initial=0))
        self.scale = 2.0 ** -np.frexp(top)[1] if np.isfinite(top) and top else 1.0
        x = x * self.scale
        self.square = (x * x).sum(axis=1)
        self.left = np.column_stack([-2 * x, self.square, np.ones(len(x))]).astype(kind)

    def right(self, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The other factor for rows other, and their squares."""
        with np.errstate(over="ignore", invalid="ignore"):
            z = (other - self.centre) * self.scale
            square = (z * z).sum(axis=1)
            return np.ascontiguousarray(np.column_stack([z, np.ones(len(z)), square]).astype(self.kind).T), square


# -- metric scaling ----------------------------------------------------------------------------------------------------


class Distances(NamedTuple):
    """The matrix of distances of frames, by the places of their blocks; it is quadratic, so it is computed where it is used."""

    blocks: DataFrame
    groups: list[list[Place]]


def distance_blocks(blocks: DataFrame, count: int) -> Distances:
    return Distances(blocks, block_groups(blocks, count))


def _met_groups(group: int, groups: int, half: bool) -> list[int]:
    """Groups that a group meets: all, or those that make each unordered pair once, equally many for each."""
    if not half:
        return list(range(groups))
    return [(group + k) % groups for k in range(groups // 2 + 1) if 2 * k < groups or group < groups // 2]


def _partners(places: list[Place], some: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, values) of the frames of blocks, block by block; of those that some marks, as many as a block at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for place, _, other in read_blocks(places):
        numbers = np.arange(place.first, place.first + place.n)
        if some is None:
            yield numbers, other
            continue
        held.append((numbers[some[numbers]], other[some[numbers]]))
        if sum(len(h[0]) for h in held) >= ROWS:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held = []
    if sum(len(h[0]) for h in held):
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def guttman(distances: Distances, y: np.ndarray, kind: type = np.float64, half: bool | None = None, some: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(next places, stress of y): place i moves to the mean over j of d_ij / e_ij (y_i - y_j). Distances are computed in type kind.

    With half, each unordered pair is met once, and a task has sums of half of all places; otherwise each ordered pair, and a task
    has its own places' sums alone. By default half if all tasks' sums are few. With some, every frame moves by the marked frames
    alone, and the stress is that of their pairs, as of so many more.
    """
    groups = distances.groups
    half = some is None and (2 * len(groups) * len(y) <= VALUES if half is None else half)
    shared = distances.blocks.sparkSession.sparkContext.broadcast((y, some))

    def moves(group: int) -> dict[int, np.ndarray]:
        y, some = shared.value
        x = np.concatenate([x for _, _, x in read_blocks(groups[group])])
        own, first = _Products(x, kind), groups[group][0].first
        del x
        met = [(g, groups[g]) for g in _met_groups(group, len(groups), True)] if half else [(group, [p for g in groups for p in g])]
        sums = {g: np.zeros(2 * sum(p.n for p in groups[g]) + 1) for g in ([g for g, _ in met])}
        # distances of places are products too, in the units of the others
        at_own = y[first : first + len(own.left)].mean(axis=0)
        scaled = (y - at_own) * own.scale
        square = (scaled * scaled).sum(axis=1)
        flat = np.column_stack([-2 * scaled, square, np.ones(len(y))])[first : first + len(own.left)].astype(kind)
        # tasks write to the same memory again and again
        lost, room, near = 0.0, [np.zeros(0, kind)] * 3, np.zeros(0, bool)
        for g, places in met:
            both = half and g != group
            for numbers, other in _partners(places, some):
                right, _ = own.right(other)
                yb = y[numbers]
                flat_right = np.ascontiguousarray(np.column_stack([scaled[numbers], np.ones(len(yb)), square[numbers]]).astype(kind).T)
                to, back = np.column_stack([yb, np.ones(len(yb))]).astype(kind), np.zeros((len(yb), 2))
                for at in range(0, len(own.left), CHUNK):
                    left = own.left[at : at + CHUNK]
                    start, shape = first + at, (len(left), len(yb))
                    ya = y[start : start + len(left)]
                    if room[0].size < len(left) * len(yb):
                        room, near = [np.empty(len(left) * len(yb), kind) for _ in range(3)], np.empty(len(left) * len(yb), bool)
                    d, e, f, one = (r[: len(left) * len(yb)].reshape(shape) for r in (*room, near))
                    # what falls below zero does so by rounding
                    np.sqrt(np.abs(np.matmul(left, right, out=d), out=d), out=d)
                    np.sqrt(np.abs(np.matmul(flat[at : at + CHUNK], flat_right, out=e), out=e), out=e)
                    if numbers[0] < start + len(left) and numbers[-1] >= start:
                        # a frame and itself
                        i = np.flatnonzero((numbers >= start) & (numbers < start + len(left)))
                        d[numbers[i] - start, i] = e[numbers[i] - start, i] = 0
                    np.subtract(d, e, out=f)
                    lost += float(np.einsum("ij,ij->i", f, f).sum(dtype=float)) / own.scale**2 / (1 if both else 2)
                    if np.less_equal(e, kind(1e-12 * own.scale), out=one).any():
                        e[one] = np.inf
                    ratio = np.divide(d, e, out=d)
                    got = (ratio @ to).astype(float)
                    sums[group][2 * at : 2 * (at + len(left))] += (got[:, 2:] * ya - got[:, :2]).ravel()
                    if both:
                        got = (ratio.T @ np.column_stack([ya, np.ones(len(ya))]).astype(kind)).astype(float)
                        back += got[:, 2:] * yb - got[:, :2]
                if both:
                    start = 2 * (int(numbers[0]) - groups[g][0].first)
                    sums[g][start : start + 2 * len(yb)] += back.ravel()
        # the stress rides at the end
        sums[group][-1] += lost
        return sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("id").to_pylist():
                sums = moves(group)
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["key", "x"])

    numbers = -(-2 * len(y) // (1 if half else len(groups))) + len(groups)
    got = summed(by_group(distances.blocks, groups).mapInArrow(run, "key long, x binary"), len(groups), numbers)
    shared.destroy()
    rows = [got[k] for k in sorted(got)]
    moved, lost = np.concatenate([r[:-1].reshape(-1, 2) for r in rows]), float(sum(r[-1] for r in rows))
    if some is None:
        return moved / len(y), lost
    # the mean of all places is 0 after a round, that of some is not
    return moved / some.sum() + y[some].mean(axis=0), lost * len(y) / int(some.sum())


def _descend(distances: Distances, y: np.ndarray, rounds: int, tolerance: float, some: np.ndarray | None = None) -> np.ndarray:
    """The best places of rounds from y on, until the stress falls by less than tolerance times itself."""
    best, least, step = y, np.inf, 1.0
    for _ in range(rounds):
        # digits that single precision lacks change the stress by far less than the tolerance
        moved, now = guttman(distances, y, np.float32, some=some)
        gained = least - now
        if gained < 0 and step > 1:
            # an overlong step raised the stress: go on from the best with plain steps, which never do
            y, step = kept, 1.0
            continue
        if now < least:
            best, least, kept = y, now, moved
        if gained < tolerance * max(now, 1e-12):
            break
        # steps twice as long halve the rounds (relaxed majorisation); by some frames they would double what the choice adds
        step = 2.0 if some is None and (step > 1 or np.isfinite(gained)) else 1.0
        y = y + step * (moved - y)
    return best


def _scaled(wide: DataFrame, rows: int, rounds: int, tolerance: float) -> tuple[Distances, np.ndarray] | None:
    """(distances, places) of metric scaling; None without frames.

    Rounds over all pairs end it. Where frames are very many, they start from rounds in which every frame moves by some frames, chosen by
    a seed, first by some FEW, then by eight times as many, and so on: these bring places near their end at a small part of the cost.
    """
    blocks, frames, count = ordered_blocks(wide, rows)
    if not frames:
        return None
    y = _places(wide, frames)
    rng = np.random.default_rng(SEED)
    # frames at one place would never part
    y = y + rng.normal(size=y.shape) * (1e-3 * (np.abs(y).max() or 1.0))
    distances = distance_blocks(blocks, count)
    # fewer rounds over all pairs are saved than rounds by some frames cost unless these are a small part
    part = FEW / frames if FEW <= frames / 16 else 1.0
    while part <= 0.25:
        some = rng.random(frames) < part
        y = _descend(distances, y, rounds, tolerance, some)
        part *= 8
    return distances, _descend(distances, y, rounds, tolerance)


def scale_all(wide: DataFrame, rows: int = ROWS, rounds: int = SCALING_ROUNDS, tolerance: float = SCALING_TOLERANCE) -> tuple[DataFrame, float]:
    """(OUT, stress) of metric scaling of all frames, started from principal components. The stress takes a round of its own, in double precision."""
    found = _scaled(wide, rows, rounds, tolerance)
    if not found:
        return wide.sparkSession.createDataFrame([], OUT), 0.0
    return _placed(found[0].blocks, found[1]), guttman(*found)[1]


def scale_places(wide: DataFrame, rows: int = ROWS, rounds: int = SCALING_ROUNDS, tolerance: float = SCALING_TOLERANCE) -> DataFrame:
    """OUT of metric scaling, as scale_all, without the stress."""
    found = _scaled(wide, rows, rounds, tolerance)
    return _placed(found[0].blocks, found[1]) if found else wide.sparkSession.createDataFrame([], OUT)


# -- neighbour embedding -----------------------------------------------------------------------------------------------


def _few(mask: np.ndarray) -> np.ndarray:
    """As flatnonzero, for masks of few hits: eight cells are looked at as one first."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    hit = np.flatnonzero(flat[:whole].view(np.int64))
    row, place = np.nonzero(flat[:whole].reshape(-1, 8)[hit])
    return np.concatenate([8 * hit[row] + place, whole + np.flatnonzero(flat[whole:])])


class _Nearest:
    """The k nearest others of rows x, the first of which has number first: exact, ties to the smaller number; blocks are met in any order.

    Products in single precision drop what lies beyond the k-th nearest so far by more than their largest error; what is left is
    measured by differences, so that equal rows are equally far. Of each row k are kept, and at most half as many wait, or a block's.
    """

    def __init__(self, x: np.ndarray, first: int, k: int, named: bool = True):
        self.x, self.first, self.k, self.named = x, first, k, named
        self.own = _Products(x, np.float32)
        self.length = np.sqrt(self.own.square)
        self.d2, self.ids = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        self.names = np.zeros((len(x), k if named else 0), np.int64)
        self.waiting: dict[int, list[tuple[np.ndarray, ...]]] = {at: [] for at in range(0, len(x), CHUNK)}
        # of each row the squared distance of the k-th one, beyond which nothing counts
        self.bar = np.full(len(x), np.inf)
        # tasks write to the same memory again and again
        self.room, self.mask, self.pairs = np.zeros(0, np.float32), np.zeros(0, bool), np.empty((2, max(1, GATHERED * 64 // max(64, x.shape[1])), x.shape[1]))

    def meet(self, first: int, names: np.ndarray, other: np.ndarray) -> None:
        own, k = self.own, self.k
        right, square = own.right(other)
        # rounding of a product of so many terms, and of the factors
        unit, far = (self.x.shape[1] + 8) * 2.0**-23, np.sqrt(square.max())
        for at in self.waiting:
            rows = slice(at, at + CHUNK)
            with np.errstate(over="ignore", invalid="ignore"):
                left = own.left[rows]
                if self.room.size < len(left) * len(other):
                    self.room, self.mask = (np.empty(len(left) * len(other), t) for t in (np.float32, bool))
                near = np.matmul(left, right, out=self.room[: len(left) * len(other)].reshape(len(left), len(other)))
                error = unit * (self.length[rows] + far) ** 2
                bar = self.bar[rows] * own.scale**2
                if np.isinf(bar).any() and len(other) > k + 1:
                    # one more, as a frame may meet itself
                    bar = np.minimum(bar, np.partition(near, k, axis=1)[:, k] + error)
                limit = np.nextafter((bar + error).astype(np.float32), np.float32(np.inf))
            # no nearer place is left, and no smaller number
            if (bar == 0).any():
                limit[(bar == 0) & (self.ids[rows].max(axis=1) < first)] = -np.inf
            mask = self.mask[: near.size].reshape(near.shape)
            np.logical_not(np.greater(near, limit[:, None], out=mask), out=mask)
            i, j = np.divmod(_few(mask), len(other))
            away = self.first + at + i != first + j
            i, j = i[away], j[away]
            if not len(i):
                continue
            d2 = np.empty(len(i))
            step = self.pairs.shape[1]
            for s in range(0, len(i), step):
                apart, far_off = self.pairs[:, : len(i[s : s + step])]
                np.take(self.x, at + i[s : s + step], axis=0, out=apart, mode="clip")
                np.take(other, j[s : s + step], axis=0, out=far_off, mode="clip")
                apart -= far_off
                np.einsum("ij,ij->i", apart, apart, out=d2[s : s + step])
            d2[np.isnan(d2)] = np.inf
            # as far as the k-th one counts too: numbers decide
            some = d2 <= self.bar[at + i]
            self.waiting[at].append(tuple(c[some] for c in ((i, d2, first + j, names[j]) if self.named else (i, d2, first + j))))
            if 2 * sum(len(w[0]) for w in self.waiting[at]) >= k * len(near):
                self._settle(at)

    def _settle(self, at: int) -> None:
        some = self.waiting[at]
        if not some:
            return
        i, *new = (np.concatenate(c) for c in zip(*some))
        self.waiting[at] = []
        rows, k = slice(at, at + CHUNK), self.k
        held = [c[rows] for c in ((self.d2, self.ids, self.names) if self.named else (self.d2, self.ids))]
        n = len(held[0])
        counts = np.bincount(i, minlength=n)
        # what waits is laid beside what is kept, row by row
        order = np.argsort(i, kind="stable")
        place = k + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        both = []
        for old, c, void in zip(held, new, (np.inf, np.iinfo(np.int64).max, 0)):
            wide = np.full((n, k + int(counts.max(initial=0))), void, c.dtype)
            wide[:, :k] = old
            wide[i[order], place] = c[order]
            both.append(wide)
        d2, ids = both[:2]
        last = np.partition(d2, k - 1, axis=1)[:, k - 1]
        inside = d2 <= last[:, None]
        # of equally far ones at the end the smallest numbers stay
        for r in np.flatnonzero(inside.sum(axis=1) > k):
            found = np.flatnonzero(inside[r])
            inside[r, found[np.lexsort((ids[r, found], d2[r, found]))[k:]]] = False
        for old, wide in zip(held, both):
            old[:] = wide[inside].reshape(n, k)
        self.bar[rows] = last

    def result(self) -> tuple[np.ndarray, ...]:
        """(numbers, squared distances) and, if named, names, in order of distance."""
        for at in self.waiting:
            self._settle(at)
            rows = slice(at, at + CHUNK)
            for by in (self.ids, self.d2):
                order = np.argsort(by[rows], axis=1, kind="stable")
                for c in (self.ids, self.d2, self.names) if self.named else (self.ids, self.d2):
                    c[rows] = np.take_along_axis(c[rows], order, 1)
        return (self.ids, self.d2, self.names) if self.named else (self.ids, self.d2)


def nearest(blocks: DataFrame, count: int, k: int, named: bool = False) -> DataFrame:
    """(first, n, near, d2): for each block of frames the numbers of their k nearest other frames (n by k) and the squared distances, nearest first, stored.

    Exact; ties go to the smaller number. With named also frames and names, the frames' own names and those of near. A task's
    blocks meet all others one after another and keep k of each frame, nothing more.
    """
    # a frame has its values, and k numbers of each kind
    groups = block_groups(blocks, count, 2 * k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("id").to_pylist():
                own = [(place, frames) for place, frames, _ in read_blocks(groups[group])]
                start = own[0][0].first
                search = _Nearest(np.concatenate([x for _, _, x in read_blocks(groups[group])]), start, k, named)
                # its own and the next ones first: frames of one ensemble follow one another
                for some in groups[group:] + groups[:group]:
                    for place, frames, other in read_blocks(some):
                        search.meet(place.first, frames, other)
                results = search.result()
                for place, frames in own:
                    rows = slice(place.first - start, place.first - start + place.n)
                    near, d2, *names = (pa.array([a[rows].tobytes()], pa.binary()) for a in results)
                    cols = {"first": pa.array([place.first], pa.int64()), "n": pa.array([place.n], pa.int32()), "near": near, "d2": d2}
                    if named:
                        cols |= {"frames": pa.array([frames.astype(np.int64).tobytes()], pa.binary()), "names": names[0]}
                    yield pa.RecordBatch.from_pydict(cols)

    schema = "first long, n int, near binary, d2 binary" + ", frames binary, names binary" * named
    return stored(by_group(blocks, groups).mapInArrow(run, schema), "nearest")


def nearest_frames(wide: DataFrame, k: int, rows: int = ROWS) -> DataFrame:
    """(frame_a, rank, frame_b, d): the k nearest other frames of every frame (fewer, if there are fewer), rank from 1; ties by (ensemble, frame)."""
    blocks, frames, count = ordered_blocks(wide, rows)
    k = min(k, frames - 1)
    if k < 1:
        return wide.sparkSession.createDataFrame([], "frame_a long, rank int, frame_b long, d double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, d2, own, names in zip(batch.column("n").to_pylist(), *(batch.column(c) for c in ("d2", "frames", "names"))):
                own, names = (np.frombuffer(c.as_buffer(), np.int64) for c in (own, names))
                cols = [np.repeat(own, k), np.tile(np.arange(1, k + 1, dtype=np.int32), n), names, np.sqrt(np.frombuffer(d2.as_buffer()))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["frame_a", "rank", "frame_b", "d"])

    return nearest(blocks, count, k, named=True).mapInArrow(run, "frame_a long, rank int, frame_b long, d double")


def affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Conditional affinities of the rows' neighbours at squared distances d2, each row's entropy that of the perplexity."""
    shifted = d2 - d2.min(axis=1, keepdims=True)
    beta, lo, hi = 1 / np.maximum(np.median(d2, axis=1), 1e-12), np.zeros(len(d2)), np.full(len(d2), np.inf)
    for _ in range(60):
        p = np.exp(-shifted * beta[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + beta * (shifted * p).sum(axis=1) / total
        flat = entropy > np.log(perplexity)
        lo, hi = np.where(flat, beta, lo), np.where(flat, hi, beta)
        beta = np.where(np.isinf(hi), np.minimum(beta * 2, 1e300), (lo + hi) / 2)
    p = np.exp(-shifted * beta[:, None])
    return p / p.sum(axis=1, keepdims=True)


def affinity_graph(near: DataFrame, frames: int, perplexity: float, rows: int) -> DataFrame:
    """(block, head, own, count, other, weight, i, j, p): symmetric affinities, some EDGES edges a row of the frames of one block (of rows frames), stored.

    i, j, p are the edges one by one. They are made from what is stored when they are asked for: own are frames of the block, counted
    from its first, which have count edges each, to the frames other with affinity weight. head: whether the row is its block's
    first. Edges come in packets to the block of i, those with near j together, so that a frame that very many others have as a
    neighbour fills no task's memory.
    """
    spans = max(1, -(-frames // SPAN))
    packets = "block long, span int, head boolean, i binary, j binary, p binary"

    def directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def dealt() -> pa.RecordBatch:
            i, j, p = (np.concatenate(c) for c in zip(*held))
            key = i // rows * spans + j // SPAN
            order = np.argsort(key, kind="stable")
            key, *edges = (c[order] for c in (key, i.astype(np.int32), j.astype(np.int32), p))
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(cuts[1:], len(key))
            named = [pa.array(key[cuts] // spans), pa.array((key[cuts] % spans).astype(np.int32)), pa.array([False] * len(cuts))]
            return pa.RecordBatch.from_arrays([*named, *(pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for c in edges)], ["block", "span", "head", "i", "j", "p"])

        for batch in batches:
            for first, size, ids, d2 in zip(batch.column("first").to_pylist(), batch.column("n").to_pylist(), batch.column("near"), batch.column("d2")):
                j = np.frombuffer(ids.as_buffer(), np.int64).reshape(size, -1)
                p = (affinities(_matrix(d2, size), perplexity) / (2 * frames)).ravel().astype(np.float32)
                i, j = np.repeat(first + np.arange(size), j.shape[1]), j.ravel()
                held += [(i, j, p), (j, i, p)]
                n += 2 * len(i)
                heads = list(range(-(-first // rows), -(-(first + size) // rows)))
                if heads:
                    none = [pa.array([b""] * len(heads), pa.binary())] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array([0] * len(heads), pa.int32()), pa.array([True] * len(heads)), *none], ["block", "span", "head", "i", "j", "p"])
                if n >= PACKETS:
                    yield dealt()
                    held, n = [], 0
        if held:
            yield dealt()

    # dealt by block once: sums, order and packing all lie within a block
    tasks = max(1, -(-frames // rows))
    both = near.mapInArrow(directed, packets).repartitionById(tasks, F.col("block").cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(block: int, span: int, head: bool, some: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            i, j, p = (np.concatenate(c) for c in zip(*some))
            key = (i - block * rows).astype(np.int64) * SPAN + (j - span * SPAN)
            order = np.argsort(key, kind="stable")
            key, p = key[order], p[order]
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            # an edge that both of its frames have comes twice
            key, p = key[cuts], np.add.reduceat(p, cuts) if len(cuts) else p
            for a in range(0, max(1, len(key)), EDGES):
                own, count = np.unique(key[a : a + EDGES] // SPAN, return_counts=True)
                other = key[a : a + EDGES] % SPAN + span * SPAN
                cols = [pa.array([c.tobytes()], pa.binary()) for c in (own.astype(np.int32), count.astype(np.int32), other.astype(np.int32), p[a : a + EDGES])]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([head and a == 0]), *cols], ["block", "head", "own", "count", "other", "weight"])

        seen, head, some = None, False, []
        for batch in batches:
            for block, span, first, *edges in zip(*(batch.column(c).to_pylist() for c in ("block", "span", "head")), *(batch.column(c) for c in "ijp")):
                if seen != (block, span):
                    if some:
                        yield from full(*seen, head, some)
                    seen, head, some = (block, span), False, []
                head = head or first
                some.append(tuple(np.frombuffer(e.as_buffer(), t) for e, t in zip(edges, (np.int32, np.int32, np.float32))))
        if some:
            yield from full(*seen, head, some)

    packed = both.sortWithinPartitions("block", "span").mapInArrow(pack, "block long, head boolean, own binary, count binary, other binary, weight binary")
    graph = stored(packed, "affinities")
    i = F.udf(lambda block, own, count: (np.repeat(np.frombuffer(own, np.int32), np.frombuffer(count, np.int32)) + np.int64(block * rows)).tobytes(), "binary")
    j = F.udf(lambda other: np.frombuffer(other, np.int32).astype(np.int64).tobytes(), "binary")
    p = F.udf(lambda weight: np.frombuffer(weight, np.float32).astype(float).tobytes(), "binary")
    return graph.withColumns({"i": i("block", "own", "count"), "j": j("other"), "p": p("weight")})


class QuadTree:
    """Cells of a quadtree over places, level by level: number of places, their mean, and the range of cells below."""

    def __init__(self, y: np.ndarray, depth: int = DEPTH):
        low = y.min(axis=0)
        self.span = float((y.max(axis=0) - low).max()) or 1.0
        at = np.minimum(((y - low) / self.span * (1 << depth)).astype(np.int64), (1 << depth) - 1)
        code = np.zeros(len(y), np.int64)
        for k in range(depth):
            code |= ((at[:, 0] >> k & 1) << (2 * k)) | ((at[:, 1] >> k & 1) << (2 * k + 1))
        order = np.argsort(code, kind="stable")
        code, total = code[order], np.vstack([np.zeros(2), np.cumsum(y[order], axis=0)])
        self.levels, before = [], None
        # no part of the sum of all q is known beforehand
        self.total = 0.0
        for level in range(depth + 1):
            own = code >> 2 * (depth - level)
            cut = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
            n = np.diff(cut)
            mean = (total[cut[1:]] - total[cut[:-1]]) / n[:, None]
            single = n == 1
            mean[single] = y[order[cut[:-1][single]]]
            if before is not None:
                self.levels[-1][2] = np.searchsorted(cut[:-1], before)
            self.levels.append([n, mean, None])
            before = cut
            if n.max() == 1:
                break

    def repulsion(self, y: np.ndarray, angle: float = ANGLE) -> tuple[np.ndarray, float]:
        """For places y of the tree: the sums of q^2 (y - z) over all others z, q = 1 / (1 + |y - z|^2), and the sum of all q."""
        force, total = np.zeros_like(y), 0.0
        i, cell = np.arange(len(y)), np.zeros(len(y), np.int64)
        for level, (n, mean, below) in enumerate(self.levels):
            apart = y[i] - mean[cell]
            square = (apart * apart).sum(axis=1)
            last = level == len(self.levels) - 1
            taken = (n[cell] == 1) | ((self.span / (1 << level)) ** 2 < angle * angle * square)
            if last:
                taken[:] = True
            q = 1 / (1 + square[taken])
            many = n[cell[taken]]
            total += float((many * q).sum())
            push = (many * q * q)[:, None] * apart[taken]
            for c in (0, 1):
                force[:, c] += np.bincount(i[taken], weights=push[:, c], minlength=len(y))
            if last or taken.all():
                break
            i, cell = i[~taken], cell[~taken]
            count = below[cell + 1] - below[cell]
            k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            i, cell = np.repeat(i, count), np.repeat(below[cell], count) + k
        # a place met itself once, with q = 1
        return force, total - len(y)


@lru_cache(maxsize=1)
def _kernels(step: float, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transforms of 1 / (1 + r^2), which are real, and of x and y / (1 + r^2)^2, which are imaginary, on a grid of side nodes, a step apart, without wrapping around; by columns."""
    at = np.fft.fftfreq(2 * side, 1 / (2 * side)).astype(np.float32) * np.float32(step)
    square, odd = at * at, at.copy()
    # no two nodes are so far apart
    odd[side] = 0
    out = np.empty((3, side + 1, 2 * side), np.float32)
    wave = np.empty((side + 1, 2 * side), np.complex64)
    for k in range(3):
        for a in range(0, 2 * side, BAND):
            band = slice(a, a + BAND)
            q = 1 / (1 + square[band, None] + square)
            if k:
                q *= q
                q *= odd[band, None] if k == 1 else odd
            wave[:, band] = np.fft.rfft(q).T
        for a in range(0, side + 1, BAND):
            some = np.fft.fft(wave[a : a + BAND])
            out[k, a : a + BAND] = some.imag if k else some.real
    return out[0], out[1], out[2]


class Field:
    """Repulsion of places from a grid: places are spread to its nodes by cubic interpolation, the nodes' sums over all nodes are
    one convolution by Fourier transforms, and a place's sum is interpolated from its nodes. Work grows with places and nodes, not pairs.
    """

    def __init__(self, y: np.ndarray):
        self.low, span = y.min(axis=0), self.width(y)
        self.step = min(STEP, span / 192) if span else 1.0
        # few different sides, of which transforms are fast
        side = int(span / self.step) + 4
        some = 1 << max(4, side.bit_length() - 3)
        self.side = -(-side // some) * some
        charge = np.zeros(self.side**2)
        for node, weight in self._nodes(y):
            charge += np.bincount(node, weight, self.side**2)
        whole, east, north = _kernels(self.step, self.side)
        # single precision has more digits than the interpolation. Half of the grid is there against wrapping around and stays out
        wave = np.ascontiguousarray(np.fft.rfft(charge.astype(np.float32).reshape(self.side, -1), 2 * self.side).T)
        pull = np.empty((2, *wave.shape), np.complex64)
        power = np.zeros(len(wave))
        for a in range(0, len(wave), BAND):
            band = slice(a, a + BAND)
            some = np.fft.fft(wave[band], 2 * self.side)
            power[band] = ((some.real**2 + some.imag**2) * whole[band]).sum(axis=1, dtype=float)
            some *= np.complex64(1j)
            for k, kernel in enumerate((east, north)):
                pull[k, band] = np.fft.ifft(some * kernel[band])[:, : self.side]
        # Parseval; all but the first and the last stand for two. A place met itself once, with q = 1
        self.total = float(2 * power.sum() - power[0] - power[-1]) / (2 * self.side) ** 2 - len(y)
        self.force = np.zeros((self.side, self.side), np.complex64)
        self.force.real = np.fft.irfft(np.ascontiguousarray(pull[0].T))[:, : self.side]
        self.force.imag = np.fft.irfft(np.ascontiguousarray(pull[1].T))[:, : self.side]
        self.force = self.force.ravel()

    @staticmethod
    def width(y: np.ndarray) -> float:
        return float(np.ptp(y, axis=0).max())

    def _nodes(self, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sixteen nodes around places, and their weights."""
        at = (y - self.low) / self.step
        cell = np.floor(at).astype(np.int64)
        f = at - cell
        weights = (-f * (f - 1) * (f - 2) / 6, (f + 1) * (f - 1) * (f - 2) / 2, -(f + 1) * f * (f - 2) / 2, (f + 1) * f * (f - 1) / 6)
        for a in range(4):
            for b in range(4):
                yield (cell[:, 0] + a) * self.side + cell[:, 1] + b, weights[a][:, 0] * weights[b][:, 1]

    def repulsion(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        """As of QuadTree, without the sum of q, which is known for all places: total."""
        force = np.zeros(len(y), complex)
        for node, weight in self._nodes(y):
            force += self.force[node] * weight
        return force.view(float).reshape(-1, 2), 0.0


def repelling(y: np.ndarray) -> Field | QuadTree:
    """What gives the repulsion of places y: a grid; a quadtree if the grid would have too many nodes."""
    return Field(y) if Field.width(y) <= STEP * MOST_SIDE else QuadTree(y)


def _slope(graph: DataFrame, y: np.ndarray, rows: int, more: float) -> np.ndarray:
    """Gradient of the divergence at places y, its attraction times more: one map over the graph."""
    y = np.ascontiguousarray(y)
    field = repelling(y)
    shared = graph.sparkSession.sparkContext.broadcast((y, field))

    # a task reads a file by itself: of what Spark would hand over, most time goes into handing over
    files = sorted(graph.inputFiles())
    columns = ["block", "head", "own", "count", "other", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, field = shared.value
        # pairs of numbers as complex ones
        at = y.view(complex).ravel()
        for file in (files[k] for batch in batches for k in batch.column("id").to_pylist()):
            sums, z = {}, 0.0
            for block, head, *edges in read_rows(file, columns):
                own, count, other, p = (np.frombuffer(e.as_buffer(), t) for e, t in zip(edges, (np.int32, np.int32, np.int32, np.float32)))
                mine = at[block.as_py() * rows : (block.as_py() + 1) * rows]
                both = sums.setdefault(block.as_py(), np.zeros((2, len(mine)), complex))
                if len(own):
                    apart = np.repeat(mine[own], count)
                    apart -= at[other]
                    apart *= p / (1 + apart.real**2 + apart.imag**2)
                    both[0, own] += np.add.reduceat(apart, np.cumsum(count) - count)
                if head.as_py():
                    force, some = field.repulsion(y[block.as_py() * rows : (block.as_py() + 1) * rows])
                    both[1] += np.ascontiguousarray(force).view(complex).ravel()
                    z += some
            for block, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([z])], ["block", "x", "z"])
                z = 0.0

    both, z = np.zeros((2, *y.shape)), field.total
    for r in by_group(graph, files).mapInArrow(run, "block long, x binary, z double").collect():
        some = np.frombuffer(r["x"]).reshape(2, -1, 2)
        both[:, r["block"] * rows : r["block"] * rows + some.shape[1]] += some
        z += r["z"]
    shared.destroy()
    return 4 * (more * both[0] - both[1] / max(z, 1e-300))


def embed_all(wide: DataFrame, perplexity: float = PERPLEXITY, rounds: int = EMBEDDING_ROUNDS, rows: int = ROWS) -> DataFrame:
    """OUT of stochastic neighbour embedding of all frames, started from principal components."""
    blocks, frames, count = ordered_blocks(wide, rows)
    if not frames:
        return wide.sparkSession.createDataFrame([], OUT)
    if frames <= perplexity:
        raise ValueError(f"perplexity {perplexity:g} needs more than {perplexity:g} frames; there are {frames}")
    y = _places(wide, frames)
    near = nearest(blocks, count, min(frames - 1, max(1, int(REACH * perplexity))))
    # the graph's blocks are as many for each core, and at most so long
    cores = wide.sparkSession.sparkContext.defaultParallelism
    rows = max(rows, -(-frames // (cores * max(2, -(-frames // (cores * MOST_ROWS))))))
    graph = affinity_graph(near, frames, perplexity, rows)
    y = y / (y[:, 0].std() or 1.0) * 1e-4 + np.random.default_rng(SEED).normal(size=y.shape) * 1e-6
    speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(frames / 48, 50.0)
    for k in range(rounds):
        early = k < rounds // 4
        slope = _slope(graph, y, rows, 12.0 if early else 1.0)
        gain = np.maximum(np.where(slope * speed < 0, gain + 0.2, gain * 0.8), 0.01)
        speed = (0.5 if early else 0.8) * speed - rate * gain * slope
        y = y + speed
        y -= y.mean(axis=0)
    return _placed(blocks, y)
