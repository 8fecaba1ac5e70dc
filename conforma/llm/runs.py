"""Periodic runs of words inside documents, by longest common extensions (LCE) over a difference cover.

A run is a stretch of words with smallest period q and at least max(LEAST, TIMES q) words that can't be extended on either side.

1. Grid. Places i and i + q lie in a run of period q for TIMES q - q places i in a row at least, so grid places so far apart
   meet every run; over all q these are n log n pairs of places.
2. A pair that differs within COVER words on both sides is settled by these words.
3. For the rest an index is built: of the suffixes only those at places whose residue modulo COVER lies in a difference
   cover are sorted (by prefix doubling over blocks of COVER words), with the common blocks of neighbours and a sparse table
   of their minima. A pair (i, j) needs less than COVER words to reach two sampled places; one range minimum gives their
   common blocks, and less than COVER words follow. The same index over the reversed words extends to the left.
4. Extents of one stretch found for several multiples of its period keep the smallest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, string_buffers, text_slices
from .words import mix, scan, span_hashes

COVER = 31
# A perfect difference set modulo 31; each other residue is the difference of exactly one pair.
RESIDUES = np.array([0, 1, 3, 8, 12, 18])
TIMES = 4
LEAST = 6
#: Grid places held at once, however long a text is.
GRID_BLOCK = 1 << 19
#: Words of a collapsed text joined at once.
JOIN_BLOCK = 1 << 17
FIELDS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _shifts() -> np.ndarray:
    """For each difference j - i modulo COVER, the residue of i from which both places are sampled."""
    out = np.zeros(COVER, np.int64)
    for d in range(COVER):
        out[d] = next(r for r in RESIDUES if (r + d) % COVER in RESIDUES)
    return out


SHIFTS = _shifts()


def agreeing(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal words from the places i and j on, at most most of each pair. Places past the end of x are not to be asked for."""
    out = np.zeros(len(i), np.int64)
    live, t = np.flatnonzero(most > 0), 0
    while len(live):
        live = live[x[i[live] + t] == x[j[live] + t]]
        t += 1
        out[live] = t
        live = live[most[live] > t]
    return out


class CoverIndex:
    """Longest common extensions to the right of any two places of x (64-bit word hashes)."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        padded = np.append(x, np.zeros(COVER, x.dtype))
        chains = [np.arange(r, self.n, COVER) for r in RESIDUES]
        # a chain's samples stand one after another, each block followed by the next; a mark ends the chain
        size = [len(c) + 1 for c in chains]
        self.base = np.append(0, np.cumsum(size))[:-1]
        m = int(sum(size))
        marks = np.zeros(m, dtype=bool)
        marks[np.cumsum(size) - 1] = True
        block = np.zeros(m, np.uint64)
        at = np.concatenate([c for c in chains])
        value = np.zeros(len(at), np.uint64)
        for k in range(COVER):
            value = value * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]
        block[~marks] = mix(value)
        rank, levels = self._ranks(block, marks)
        suffixes = np.empty(m, np.int64)
        suffixes[rank] = np.arange(m)
        self.rank = rank
        self.table = [self._common(suffixes, levels, m).astype(np.int32)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))
        self.chain = np.zeros(COVER, np.int64)
        self.chain[RESIDUES] = self.base

    @staticmethod
    def _ranks(block: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rank of each sampled suffix, as a sequence of blocks, and the ranks by the first 1, 2, 4, ... blocks."""
        m = len(block)
        order = np.lexsort((block, marks))
        new = np.ones(m, dtype=bool)
        new[1:] = (block[order][1:] != block[order][:-1]) | marks[order][1:]
        rank = np.empty(m, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        levels, span = [rank], 1
        while True:
            tied = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
            if not len(tied):
                return rank, levels
            # a tied suffix has span blocks before its chain's mark, so tied + span is in its chain
            second = rank[tied + span]
            by = np.lexsort((second, rank[tied]))
            tied, second = tied[by], second[by]
            head = rank[tied]
            group = np.append(True, head[1:] != head[:-1])
            fresh = group | np.append(True, second[1:] != second[:-1])
            place = np.arange(len(tied))
            rank = rank.copy()
            rank[tied] = head + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
            levels.append(rank)
            span *= 2

    @staticmethod
    def _common(suffixes: np.ndarray, levels: list[np.ndarray], m: int) -> np.ndarray:
        """Common blocks of each sampled suffix with the next in order."""
        a, b = suffixes[:-1], suffixes[1:]
        out = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + out, b + out
            same = (x < m) & (y < m)
            same[same] = levels[k][x[same]] == levels[k][y[same]]
            out[same] += 1 << k
        return out

    def extend(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from the places i < j on, at most most of each pair (which must end within x)."""
        shift = (SHIFTS[(j - i) % COVER] - i) % COVER
        out = agreeing(self.x, i, j, np.minimum(shift, most))
        live = np.flatnonzero((out == shift) & (out < most))
        if not len(live):
            return out
        a, b = i[live] + shift[live], j[live] + shift[live]
        lo, hi = (self.rank[self.chain[p % COVER] + p // COVER] for p in (a, b))
        lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        blocks = np.empty(len(live), np.int64)
        for k in np.unique(level).tolist():
            of = np.flatnonzero(level == k)
            blocks[of] = np.minimum(self.table[k][lo[of]], self.table[k][hi[of] - (1 << k)])
        got = np.minimum(shift[live] + COVER * blocks, most[live])
        out[live] = got + agreeing(self.x, i[live] + got, j[live] + got, np.minimum(most[live] - got, COVER))
        return out


def grid_pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (row, place, period): grid places of rows of these sizes, for every period that a run in a row may have."""
    periods = np.where(sizes >= LEAST, sizes // TIMES, 0)
    row = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(row)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(TIMES * q, LEAST) - q
    count = -(-(sizes[row] - q) // step)
    ends = np.cumsum(count)
    first = 0
    while first < len(row):
        before = int(ends[first] - count[first])
        last = max(first + 1, int(np.searchsorted(ends, before + GRID_BLOCK, side="right")))
        some = slice(first, last)
        n = count[some]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(row[some], n), k * np.repeat(step[some], n), np.repeat(q[some], n)
        first = last


def find_runs(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of every run in the rows x[edges[r]:edges[r + 1]], by row, start, period; start from 0 in its row."""
    sizes = np.diff(edges)
    found, open_pairs, held = [], [], {}
    for row, k, q in grid_pairs(sizes):
        i = edges[row] + k
        same = x[i] == x[i + q]
        row, i, q = row[same], i[same], q[same]
        right, left = edges[row + 1] - i - q, i - edges[row]
        f = agreeing(x, i, i + q, np.minimum(right, COVER))
        # to the left: the words before both places
        b = _agreeing_left(x, i, i + q, np.minimum(left, COVER))
        far = ((f == COVER) & (right > COVER)) | ((b == COVER) & (left > COVER))
        done = ~far & (f + b + q >= np.maximum(LEAST, TIMES * q))
        found.append((row[done], (i - b)[done], (f + b + q)[done], q[done]))
        if far.any():
            open_pairs.append((row[far], i[far], q[far]))
            if sum(len(p[0]) for p in open_pairs) > GRID_BLOCK:
                found.append(_indexed(x, edges, open_pairs, held))
                open_pairs = []
    if open_pairs:
        found.append(_indexed(x, edges, open_pairs, held))
    row, start, length, q = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(4))
    # one stretch found at several grid places, or for multiples of its period, stays once with the smallest
    order = np.lexsort((q, length, start))
    row, start, length, q = (c[order] for c in (row, start, length, q))
    new = np.ones(len(row), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    row, start, length, q = (c[new] for c in (row, start, length, q))
    order = np.lexsort((q, start))
    return row[order], (start - edges[row])[order], length[order], q[order]


def _agreeing_left(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    back = x[::-1]
    return agreeing(back, len(x) - j, len(x) - i, most)


def _indexed(x: np.ndarray, edges: np.ndarray, pairs: list, held: dict) -> tuple[np.ndarray, ...]:
    """Runs around pairs (row, place, period) by an index over the rows that have any. held: the last index, for a next call with the same rows."""
    row, i, q = (np.concatenate([p[k] for p in pairs]) for k in range(3))
    rows, at = np.unique(row, return_inverse=True)
    cuts = np.append(0, np.cumsum(edges[rows + 1] - edges[rows]))
    if (key := rows.tobytes()) not in held:
        held.clear()
        own = np.concatenate([x[edges[r] : edges[r + 1]] for r in rows.tolist()])
        held[key] = CoverIndex(own), CoverIndex(own[::-1].copy())
    ahead, back = held[key]
    moved, n = i - edges[row] + cuts[at], ahead.n
    f = ahead.extend(moved, moved + q, cuts[at + 1] - moved - q)
    b = back.extend(n - moved - q, n - moved, moved - cuts[at])
    keep = f + b + q >= np.maximum(LEAST, TIMES * q)
    return row[keep], (i - b)[keep], (f + b + q)[keep], q[keep]


def repeat_words(doc_ids: list, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of each row after the planted edit, and which rows have it.

    Of doc_ids whose crc32 (of the decimal text) 10 divides, words from one place on repeat with one period. A null doc_id has no edit.
    """
    out = np.arange(int(counts.sum()))
    edges = np.append(0, np.cumsum(counts))
    edited = np.zeros(len(counts), dtype=bool)
    for r, d in enumerate(doc_ids):
        n = int(counts[r])
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = out[edges[r] + a : edges[r + 1]]
        own[:] = edges[r] + a + np.arange(n - a) % p
        edited[r] = True
    return out, edited


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Hex SHA-256 of the words at these bytes of data, joined by single spaces."""
    sha = hashlib.sha256()
    for k in range(0, len(starts), JOIN_BLOCK):
        s, e = starts[k : k + JOIN_BLOCK], ends[k : k + JOIN_BLOCK]
        size = e - s + 1
        out_at = np.cumsum(size) - size
        total = int(size.sum())
        take = np.repeat(s - out_at, size) + np.arange(total)
        joined = data[np.minimum(take, len(data) - 1)]
        joined[out_at + size - 1] = 32
        sha.update(joined.data if k + JOIN_BLOCK < len(starts) else joined[:-1].data)
    return sha.hexdigest()


def periodic_runs(docs: DataFrame, edit: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_runs, the longest run and hashes of all runs and of the collapsed text.

    start, length, period, exponent_milli: of the run of most words (ties: smallest start, then period); null without a run.
    runs_sha256: of "start,length,period" lines by start, then period. collapsed_sha256: of the words outside runs and those in
    the first period of every run that holds them, joined by a space. edit: plant repeats first (see repeat_words).
    Nulls: a null text has no words; a null doc_id is kept. Repeated rows are rows of their own, texts are taken whole, other columns
    are ignored, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                data, offsets = string_buffers(part.column("text"))
                w = scan(data, offsets)
                counts = np.diff(w.first)
                ids = part.column("doc_id").to_pylist()
                words = np.arange(len(w.starts))
                if edit:
                    words, _ = repeat_words(ids, counts)
                x = span_hashes(data, w.starts, w.ends)[words]
                edges = np.append(0, np.cumsum(counts))
                row, start, length, q = find_runs(x, edges)
                # words after the first period of a run go
                at = edges[row] + start
                gone = np.cumsum(np.bincount(at + q, minlength=len(x) + 1) - np.bincount(at + length, minlength=len(x) + 1))[: len(x)] > 0
                starts, ends = w.starts[words], w.ends[words]
                longest = np.lexsort((q, start, -length, row))
                head = longest[np.append(True, row[longest][1:] != row[longest][:-1])] if len(row) else longest
                best = np.full(len(ids), -1)
                best[row[head]] = head
                cut = np.searchsorted(row, np.arange(len(ids) + 1))
                listed, collapsed = [], []
                for r in range(len(ids)):
                    own = slice(cut[r], cut[r + 1])
                    lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start[own].tolist(), length[own].tolist(), q[own].tolist()))
                    listed.append(hashlib.sha256(lines.encode()).hexdigest())
                    s, e = starts[edges[r] : edges[r + 1]], ends[edges[r] : edges[r + 1]]
                    if cut[r] < cut[r + 1]:
                        kept = ~gone[edges[r] : edges[r + 1]]
                        s, e = s[kept], e[kept]
                    collapsed.append(_collapsed(data, s, e))
                none = best < 0
                some = [c[best] if len(c) else np.zeros(len(best), np.int64) for c in (start, length, q)]
                milli = 1000 * some[1] // np.maximum(some[2], 1)
                cols = [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(np.diff(cut).astype(np.int64))]
                cols += [pa.array(c.astype(np.int64), mask=none) for c in (*some, milli)]
                names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(listed, pa.string()), pa.array(collapsed, pa.string())], names)

    return documents(docs).mapInArrow(run, FIELDS)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """docs with text collapsed: words after the first period of any run go, the others are joined by single spaces.

    A text without a run, or null, stays as it is, white space included. Other columns are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                column = part.column("text")
                data, offsets = string_buffers(column)
                w = scan(data, offsets)
                row, start, length, q = find_runs(span_hashes(data, w.starts, w.ends), w.first)
                at = w.first[row] + start
                gone = np.cumsum(np.bincount(at + q, minlength=len(w.starts) + 1) - np.bincount(at + length, minlength=len(w.starts) + 1)) > 0
                texts = column.to_pylist()
                for r in np.unique(row).tolist():
                    kept = [k for k in range(int(w.first[r]), int(w.first[r + 1])) if not gone[k]]
                    texts[r] = " ".join(data[w.starts[k] : w.ends[k]].tobytes().decode() for k in kept)
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, column.type))

    return docs.mapInArrow(run, docs.schema)
