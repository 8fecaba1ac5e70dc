"""Exact Jaccard join of documents on five-word shingles, with signature trees.

1. Documents with equal shingle sets form a class; its smallest doc_id stands for it.
2. Shingles are in a total order, frequent ones last (counted over all documents). Sets with Jaccard >= t share one of
   their first n - ceil(t n) + 1 shingles, so documents meet by these.
3. Pairs with the smallest document of each shingle are verified first. They join large groups of near copies into
   components without making all their pairs.
4. Where one shingle still holds different components, its documents go into signature trees: nodes hold OR-combined
   bitmaps of first shingles and ranges of sizes, and a dual traversal drops node pairs whose largest possible overlap is
   too small. What is left is verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, documents, materialise, string_buffers, text_slices
from .components import components
from .words import LOWER, mix, scan, span_hashes

PERCENT = 75
SHINGLE = 5
#: Shingles ranked by their number of occurrences; all others, each rarer, are ordered by hash. Its size is fixed.
RANKED = 100_000
LEAST_LOCAL = 4
BITMAP = 1024
FANOUT = 8
#: Documents of one shingle in one tree; more are dealt into chunks, and trees compare each chunk with each other.
CHUNK = 1024


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): distinct shingle hashes of row i, ascending, are hashes[edges[i]:edges[i + 1]].

    A-Z are lower-cased; a text of fewer than width words has its whole sequence as one shingle; without words it has none.
    """
    n = len(offsets) - 1
    data = LOWER[data]
    w = scan(data, offsets)
    h = span_hashes(data, w.starts, w.ends)
    counts = np.diff(w.first)
    five = np.uint64(0x9E3779B97F4A7C15)
    total = len(h)
    parts, rows = [], []
    if total >= width:
        s = h[: total - width + 1].copy()
        for k in range(1, width):
            s = s * five + h[k : total - width + 1 + k]
        inside = w.rows[width - 1 :] == w.rows[: total - width + 1]
        parts.append(mix(s[inside]))
        rows.append(w.rows[width - 1 :][inside])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        s = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            s[has] = s[has] * five + h[w.first[short][has] + k]
        parts.append(mix(s + counts[short].astype(np.uint64)))
        rows.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    s, r = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[new], r[new]
    return s, np.searchsorted(r, np.arange(n + 1))


def frequent_shingles(docs: DataFrame, ranked: int = RANKED) -> np.ndarray:
    """The shingles in most documents, ascending by that number: at most ranked of those that a task meets LEAST_LOCAL times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        fresh: list[np.ndarray] = []

        def fold() -> None:
            s, c = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            fresh.clear()
            kept.append((s[c > 1], c[c > 1]))

        for batch in batches:
            for part in text_slices(batch):
                fresh.append(shingle_hashes(*string_buffers(part.column("text")))[0])
                if sum(map(len, fresh)) > 3_000_000:
                    fold()
        fold()
        s = np.concatenate([x for x, _ in kept])
        values, place = np.unique(s, return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate([c for _, c in kept]), minlength=len(values)).astype(np.int64)
        often = sums >= LEAST_LOCAL
        yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(sums[often])], ["s", "c"])

    counted = docs.mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    # a bounded table: ranked rows of two numbers
    top = counted.orderBy(F.col("c").desc(), "s").limit(ranked).toArrow()
    s, c = top["s"].to_numpy().view(np.uint64), top["c"].to_numpy()
    return s[np.lexsort((s, c))]


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-n * PERCENT // 100) + 1


def first_shingles(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, k1, k2 (hashes of the set) and prefix: its first shingles in the total order, ascending as unsigned numbers."""
    by_hash = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash.astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            for part in text_slices(batch):
                s, edges = shingle_hashes(*string_buffers(part.column("text")))
                n = np.diff(edges)
                key = s >> np.uint64(1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    key[hit] = (np.uint64(1) << np.uint64(63)) | rank[at[hit]]
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((key, row))
                place = np.arange(len(s)) - edges[:-1][row]
                length = np.where(n > 0, prefix_length(n), 0)
                first = place < length[row]
                low, high = s, mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                k1, k2 = (np.append(np.uint64(0), np.cumsum(x)) for x in (low, high))
                taken, cuts = key[order][first], np.append(0, np.cumsum(length))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(taken.view(np.int64)))
                maps = pa.array([m.tobytes() for m in bitmaps(taken, cuts)], pa.binary())
                cols = [part.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array((k[edges[1:]] - k[edges[:-1]]).view(np.int64)) for k in (k1, k2)), lists, maps]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "k1", "k2", "prefix", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix array<long>, bits binary")


def bitmaps(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A bitmap of BITMAP bits for each of the rows values[edges[i]:edges[i + 1]]."""
    flags = np.zeros((len(edges) - 1, BITMAP), dtype=bool)
    flags[np.repeat(np.arange(len(edges) - 1), np.diff(edges)), (mix(values) & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


class SignatureTree:
    """A tree over sets given by bitmaps of their first shingles and by sizes; leaves are ordered by size, then by bitmap.

    levels[0] holds the sets; each node above holds FANOUT of the level below: OR of bitmaps, least size, most size, most
    shingles lost to shared bits, and most shingles beyond the first ones.
    """

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        ones = np.bitwise_count(maps)
        self.order = np.lexsort((*maps.T[::-1], sizes))
        maps, n = maps[self.order], sizes[self.order]
        first = prefix_length(n)
        lost = first - ones[self.order].sum(axis=1)
        rest = n - first
        self.levels = [(maps, n, n, lost, rest)]
        while len(maps) > 1:
            cut = np.arange(0, len(maps), FANOUT)
            below = self.levels[-1]
            maps = np.bitwise_or.reduceat(below[0], cut)
            self.levels.append((maps, np.minimum.reduceat(below[1], cut), *(np.maximum.reduceat(x, cut) for x in below[2:])))

    def possible(self, other: "SignatureTree", level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a linked pair, by sizes and by the largest overlap that bitmaps and rests allow."""
        a, b = (t.levels[min(level, len(t.levels) - 1)] for t in (self, other))
        fits = (100 * b[2][j] >= PERCENT * a[1][i]) & (100 * a[2][i] >= PERCENT * b[1][j])
        i, j, at = i[fits], j[fits], np.flatnonzero(fits)
        common = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1).astype(np.int64)
        most = common + np.minimum(a[3][i], b[3][j]) + np.maximum(a[4][i], b[4][j])
        need = -(-PERCENT * (a[1][i] + b[1][j]) // (100 + PERCENT))
        out = np.zeros(len(fits), dtype=bool)
        out[at[most >= need]] = True
        return out

    def join(self, other: "SignatureTree") -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (into the given sets) that dual traversal leaves. With itself, each pair comes once."""
        level = max(len(self.levels), len(other.levels)) - 1
        i = j = np.zeros(1, np.int64)
        while True:
            keep = self.possible(other, level, i, j)
            i, j = i[keep], j[keep]
            if self is other:
                i, j = i[i <= j], j[i <= j]
            if level == 0 or not len(i):
                break
            level -= 1
            i, j = (self._below(level, i), other._below(level, j))
            pairs = [np.meshgrid(x, y, indexing="ij") for x, y in zip(i, j)]
            i, j = (np.concatenate([p[k].ravel() for p in pairs]) for k in (0, 1))
        if self is other:
            i, j = i[i != j], j[i != j]
        return self.order[i], other.order[j]

    def _below(self, level: int, nodes: np.ndarray) -> list[np.ndarray]:
        if level >= len(self.levels) - 1:
            return [np.array([x]) for x in nodes.tolist()]
        n = len(self.levels[level][1])
        return [np.arange(x * FANOUT, min(n, (x + 1) * FANOUT)) for x in nodes.tolist()]


def leaf_pairs(maps: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of sets the bounds of a tree's leaves leave."""
    first = prefix_length(sizes)
    lost = first - np.bitwise_count(maps).sum(axis=1)
    n, m = sizes[i], sizes[j]
    most = np.bitwise_count(maps[i] & maps[j]).sum(axis=1) + np.minimum(lost[i], lost[j]) + np.maximum((sizes - first)[i], (sizes - first)[j])
    need = -(-PERCENT * (n + m) // (100 + PERCENT))
    return (100 * n >= PERCENT * m) & (100 * m >= PERCENT * n) & (most >= need)


def _tree_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of rows sorted by (h, lo, hi): doc_id, n, component, side and bits of each group's documents."""

    def join(table: pa.Table) -> pa.RecordBatch:
        c = {k: table[k].to_numpy() for k in ("h", "lo", "hi", "side", "doc_id", "n", "component")}
        maps = np.frombuffer(b"".join(x.as_buffer() for chunk in table["bits"].chunks for x in chunk), np.uint64).reshape(table.num_rows, -1)
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = (c["h"][1:] != c["h"][:-1]) | (c["lo"][1:] != c["lo"][:-1]) | (c["hi"][1:] != c["hi"][:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, table.num_rows))
        one = c["lo"][start] == c["hi"][start]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # groups of one leaf node, by far the most, are compared by size of group at once
        for g in range(2, FANOUT + 1):
            at = start[one & (size == g)]
            x, y = np.triu_indices(g, 1)
            i, j = (at[:, None] + x).ravel(), (at[:, None] + y).ravel()
            apart = c["component"][i] != c["component"][j]
            i, j = i[apart], j[apart]
            keep = leaf_pairs(maps, c["n"], i, j)
            left.append(i[keep])
            right.append(j[keep])
        for k in np.flatnonzero(~one | (size > FANOUT)).tolist():
            at = np.arange(start[k], start[k] + size[k])
            sides = [at] if one[k] else [at[c["side"][at] == 0], at[c["side"][at] == 1]]
            if any(not len(x) for x in sides):
                continue
            trees = [SignatureTree(maps[x], c["n"][x]) for x in sides]
            i, j = trees[0].join(trees[-1])
            i, j = sides[0][i], sides[-1][j]
            apart = c["component"][i] != c["component"][j]
            left.append(i[apart])
            right.append(j[apart])
        i, j = (c["doc_id"][np.concatenate(x)] for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        # all groups but the last, which may go on in the next batch
        keys = [batch.column(k).to_numpy() for k in ("h", "lo", "hi")]
        other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        if len(other):
            cut = int(other[-1]) + 1
            yield join(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held = [batch.slice(cut)]
    if held:
        yield join(pa.Table.from_batches(held))


def _enough(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of pairs (a, b, c) those that c common first shingles, and all shingles beyond the first ones, could link.

    Sets of n and m shingles must share (n + m) t / (1 + t). Beyond the first ones, the set whose last first shingle is
    the smaller one can share ceil(t n) - 1 at most. sizes: doc_id, n, low (largest and smallest set of a doc_id).
    """
    a, b = (sizes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("low").alias(f"l{x}")) for x in "ab")
    both = counted.join(a, "a").join(b, "b")
    need = F.ceil((F.col("la") + F.col("lb")) * PERCENT / (100 + PERCENT) - 1e-9)
    rest = F.ceil(F.greatest("na", "nb") * PERCENT / 100 - 1e-9) - 1
    alike = (100 * F.col("na") >= PERCENT * F.col("lb")) & (100 * F.col("nb") >= PERCENT * F.col("la"))
    return both.where(alike & (F.col("c") + rest >= need)).select("a", "b")


def linked(pairs: DataFrame, docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) of doc_ids, a stored table, those whose whole shingle sets are similar enough."""
    ids = materialise(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id"), "pair-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    some = docs.join(ids, "doc_id", "left_semi")
    both = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text")), "a").join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1 << 20):
                x, xe = shingle_hashes(*string_buffers(part.column("text")), width)
                y, ye = shingle_hashes(*string_buffers(part.column("other")), width)
                keep = []
                for k in range(part.num_rows):
                    p, q = x[xe[k] : xe[k + 1]], y[ye[k] : ye[k + 1]]
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text", "other").mapInArrow(verify, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Nulls: a null text has no shingles and is linked with nothing; a null doc_id has a null component and takes no part.
    Rows that share a doc_id count as one document for links. Other columns are ignored; an empty table gives an empty result.
    """
    rows = documents(docs)
    known = rows.where(F.col("doc_id").isNotNull())
    sets = materialise(first_shingles(rows, frequent_shingles(known)), "first-shingles")
    full = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialise(full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "set-classes")
    others = materialise(full.select("doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"]).where("doc_id != rep").select("doc_id", "k1", "k2").distinct(), "class-copies")
    reps = full.join(F.broadcast(others) if others.count() <= BROADCAST_ROWS else others, ["doc_id", "k1", "k2"], "left_anti")
    # documents that meet in a shingle, each with the smallest of them; a shingle of very many documents is pre-aggregated, and
    # its side of the join is one that Spark can split
    posts = reps.select("doc_id", F.explode_outer("prefix").alias("h"))
    meets = posts.groupBy("h").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot != last")
    posts = materialise(posts.join(meets.select("h", "pivot"), "h"), "shingle-posts")
    sizes = reps.groupBy("doc_id").agg(F.max("n").alias("n"), F.min("n").alias("low"))
    near = posts.where("doc_id != pivot").groupBy(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("c"))
    pairs = materialise(_enough(near, sizes), "pivot-pairs")
    links = materialise(linked(pairs, known), "pivot-links")
    found = materialise(components(links), "pivot-components")
    # shingles that still hold more than one component
    posts = posts.join(found, posts["doc_id"] == found["id"], "left").select("h", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    posts = materialise(posts, "posts-components")
    mixed = posts.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).where("x != y")
    mixed = mixed.select("h", F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks"))
    # a mixed shingle's documents with what a tree needs of each: size and bitmap
    met = posts.join(mixed, "h").join(reps.select("doc_id", "n", "bits"), "doc_id")
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    met = met.withColumn("chunk", chunk).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("h", F.least("chunk", "x").alias("lo"), F.greatest("chunk", "x").alias("hi"), (F.col("chunk") > F.col("x")).cast("int").alias("side"), "doc_id", "n", "component", "bits")
    met = met.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi", "doc_id")
    # a pair comes once for each first shingle that both hold, as that shingle has two components
    more = met.mapInArrow(_tree_pairs, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("c"))
    more = materialise(_enough(more, sizes).join(pairs, ["a", "b"], "left_anti"), "tree-pairs")
    links = links.union(linked(more, known))
    final = materialise(components(links), "components")
    named = classes.join(final, classes["rep"] == final["id"], "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(named.withColumnRenamed("n", "m").withColumnRenamed("k1", "l1").withColumnRenamed("k2", "l2"), (F.col("n") == F.col("m")) & (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs less every row whose doc_id isn't the smallest of its component. Rows with a null doc_id stay."""
    out = materialise(jaccard_components(docs).where("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    gone = F.broadcast(out) if out.count() <= BROADCAST_ROWS else out
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
