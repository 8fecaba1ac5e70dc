"""Near duplicates by MinHash: many universal hash minima, banding, signatures, exact verification, star components.

1. Documents with equal sets of shingles form a class; its smallest doc_id stands for it.
2. A set's signature is its minima under HASHES hash functions of a universal family (multiply, add, shift, with seeded odd
   factors). Each ROWS minima form a band. A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: at
   the threshold of 0.8 a pair is missed once in 10^9, and ever more rarely above.
3. Each document of a band's key is compared with the smallest one there. A pair whose signatures agree in fewer than
   LEAST_EQUAL minima is dropped (at 0.8 once in 10^9), and so is one whose parity maps differ in more bits than the sets of a
   linked pair may differ in shingles (never wrongly); the others are verified on their whole sets. The links give components
   by alternating large-star and small-star, so a large group of near copies needs about one pair a document.
4. Keys that still hold several components compare all their documents of different components, by signatures and parity maps, in
   chunks; what is left is verified too. No key, bucket or number of candidates is capped.
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
from .ngram_join import linked, shingle_hashes
from .words import mix

SHINGLE = 4
PERCENT = 80
ROWS = 4
BANDS = 40
HASHES = ROWS * BANDS
SEED = 7
#: Of wrongly dropped pairs at the threshold, the share that the signature's bounds may have.
LOSS = 1e-9
#: Documents of one key compared as one chunk; larger keys are dealt into chunks that meet each other.
CHUNK = 4096
#: Minima compared first where whole chunks meet.
FIRST = 32
#: Bits of a parity map for each shingle, at least (the next power of two), and of any map.
MAP_BITS, LEAST_MAP = 4, 256
#: Keys of so many documents are compared size by size, all keys of a size at once.
FEW = 64


def least_equal(hashes: int, share: float = PERCENT / 100, loss: float = LOSS) -> int:
    """The most m for which a pair of similarity share agrees in fewer than m of so many minima with a probability under loss."""
    total = 0.0
    for m in range(hashes + 1):
        total += math.comb(hashes, m) * share**m * (1 - share) ** (hashes - m)
        if total >= loss:
            return m
    return hashes


LEAST_EQUAL = least_equal(HASHES)
LEAST_FIRST = least_equal(FIRST)


def hash_family(n: int = HASHES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and addends of n functions x -> (a x + b mod 2^64) >> 32 of 32-bit numbers."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b * np.uint64(2)


def minima(sets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(rows, HASHES) minima of the sets sets[edges[i]:edges[i + 1]] of 64-bit hashes; a row of an empty set is 0."""
    out = np.zeros((len(edges) - 1, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(edges))
    if not len(full):
        return out
    x = sets >> np.uint64(32)
    held = np.empty_like(x)
    start = edges[:-1][full]
    for k, (a, b) in enumerate(zip(*hash_family())):
        np.multiply(x, a, out=held)
        np.add(held, b, out=held)
        # the least of the products has the least high half
        out[full, k] = np.minimum.reduceat(held, start) >> np.uint64(32)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit keys of the bands of signatures."""
    low = low.astype(np.uint64).reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(low), BANDS))
    for k in range(ROWS):
        key = mix(key ^ low[:, :, k])
    return key


def parity_maps(sets: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """For each set a map whose bits tell whether an odd number of its hashes falls there; its size, a power of two, grows with the set.

    The maps of two sets, the larger folded onto the smaller, differ in at most as many bits as the sets in elements.
    """
    n = np.diff(edges)
    size = np.maximum(LEAST_MAP, 1 << np.ceil(np.log2(np.maximum(MAP_BITS * n, 1))).astype(np.int64))
    ends = np.cumsum(size)
    at = (mix(sets ^ np.uint64(0x3C6EF372FE94F82B)) & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(ends - size, n)
    odd = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    np.bitwise_xor.at(odd, at, 1)
    data = np.packbits(odd, bitorder="little").tobytes()
    return [data[(e - m) // 8 : e // 8] for e, m in zip(ends.tolist(), size.tolist())]


class Sketches:
    """Signatures, set sizes and parity maps of documents, to be compared pairwise."""

    def __init__(self, sig: pa.ChunkedArray | pa.Array, n: np.ndarray, odd: pa.ChunkedArray | pa.Array):
        self.sig, self.n = sig_matrix(sig), n
        maps = [x.as_buffer() for x in odd]
        self.bytes = np.array([m.size for m in maps], np.int64)
        self.place, self.maps = np.zeros(len(maps), np.int64), {}
        for b in np.unique(self.bytes).tolist():
            of = np.flatnonzero(self.bytes == b)
            self.place[of] = np.arange(len(of))
            self.maps[b] = np.frombuffer(b"".join(maps[k] for k in of.tolist()), np.uint64).reshape(len(of), -1)

    def near(self, i: np.ndarray, other: "Sketches", j: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """Which pairs (i, j) the signatures and the maps leave."""
        out = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), block):
            a, b = i[k : k + block], j[k : k + block]
            keep = np.flatnonzero((self.sig[a] == other.sig[b]).sum(axis=1) >= LEAST_EQUAL)
            out[k + keep[self._few(a[keep], other, b[keep])]] = True
        return out

    def _few(self, i: np.ndarray, other: "Sketches", j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=bool)
        most = (100 - PERCENT) * (self.n[i] + other.n[j]) // (100 + PERCENT)
        x, y = self.bytes[i], other.bytes[j]
        for b, c in {*zip(x.tolist(), y.tolist())}:
            at = np.flatnonzero((x == b) & (y == c))
            p, q = self.maps[b][self.place[i[at]]], other.maps[c][other.place[j[at]]]
            while p.shape[1] > q.shape[1]:
                p = p[:, : p.shape[1] // 2] ^ p[:, p.shape[1] // 2 :]
            while q.shape[1] > p.shape[1]:
                q = q[:, : q.shape[1] // 2] ^ q[:, q.shape[1] // 2 :]
            out[at] = np.bitwise_count(p ^ q).sum(axis=1) <= most[at]
        return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), k1, k2 (hashes of the set), keys (of bands), sig (low 16 bits of the minima), odd (parity map) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                s, edges = shingle_hashes(*string_buffers(part.column("text")), SHINGLE)
                n = np.diff(edges)
                sums = (np.append(np.uint64(0), np.cumsum(x)) for x in (s, mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
                low = minima(s, edges)
                keys = band_keys(low)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                short = pa.array([x.tobytes() for x in low.astype(np.uint16)], pa.binary())
                cols = [part.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array((k[edges[1:]] - k[edges[:-1]]).view(np.int64)) for k in sums), lists, short, pa.array(parity_maps(s, edges), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "k1", "k2", "keys", "sig", "odd"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, keys array<long>, sig binary, odd binary")


def sig_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint16).reshape(-1, HASHES)


def _alike(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that signatures and parity maps leave."""
    a, b = (sigs.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "sig", "odd")]) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (Sketches(batch.column(f"sig_{c}"), batch.column(f"n_{c}").to_numpy(), batch.column(f"odd_{c}")) for c in "ab")
                at = np.arange(batch.num_rows)
                yield batch.select(["a", "b"]).filter(pa.array(x.near(at, y, at)))

    return both.mapInArrow(check, "a long, b long").distinct()


def chunk_pairs(s: Sketches, a: np.ndarray, b: np.ndarray, apart: np.ndarray, block: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members a and b of s, of different values of apart, that signatures and maps leave; FIRST minima are compared before the others."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    other = np.ascontiguousarray(s.sig[b, :FIRST].T)
    for k in range(0, len(a), block):
        some = a[k : k + block]
        equal = np.zeros((len(some), len(b)), np.uint8)
        for c in range(FIRST):
            equal += s.sig[some, c, None] == other[c]
        i, j = np.nonzero((equal >= LEAST_FIRST) & (apart[some, None] != apart[b]))
        i, j = some[i], b[j]
        keep = s.near(i, s, j)
        left.append(i[keep])
        right.append(j[keep])
    return np.concatenate(left), np.concatenate(right)


def _key_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with similar signatures, of rows sorted by (h, lo, hi): the documents of a key's chunk, or of two chunks that meet."""

    def join(table: pa.Table) -> pa.RecordBatch:
        c = {k: table[k].to_numpy() for k in ("h", "lo", "hi", "side", "doc_id", "component")}
        s = Sketches(table["sig"], table["n"].to_numpy(), table["odd"])
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = (c["h"][1:] != c["h"][:-1]) | (c["lo"][1:] != c["lo"][:-1]) | (c["hi"][1:] != c["hi"][:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, table.num_rows))
        one = c["lo"][start] == c["hi"][start]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        few = one & (size <= FEW)
        for g in np.unique(size[few]).tolist():
            at = start[few & (size == g)]
            x, y = np.triu_indices(g, 1)
            step = 1 + (1 << 16) // max(1, len(x))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                i, j = (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
                apart = c["component"][i] != c["component"][j]
                i, j = i[apart], j[apart]
                keep = s.near(i, s, j)
                left.append(i[keep])
                right.append(j[keep])
        for k in np.flatnonzero(~few).tolist():
            at = np.arange(start[k], start[k] + size[k])
            sides = [at, at] if one[k] else [at[c["side"][at] == 0], at[c["side"][at] == 1]]
            i, j = chunk_pairs(s, *sides, c["component"])
            left.append(i)
            right.append(j)
        i, j = (c["doc_id"][np.concatenate(x)] for x in (left, right))
        pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

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


def minhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included), kept.

    kept: the row's doc_id is its component's. Nulls: a null text has no shingles and is linked with nothing; a null doc_id has a
    null component, takes no part and is kept. Rows that share a doc_id count as one document for links. Texts are taken whole,
    other columns are ignored, and an empty table gives an empty result.
    """
    rows = documents(docs)
    known = rows.where(F.col("doc_id").isNotNull())
    sets = materialise(signatures(rows), "signatures")
    full = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialise(full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "set-classes")
    others = materialise(full.select("doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"]).where("doc_id != rep").select("doc_id", "k1", "k2").distinct(), "class-copies")
    reps = full.join(F.broadcast(others) if others.count() <= BROADCAST_ROWS else others, ["doc_id", "k1", "k2"], "left_anti")
    sigs = reps.select("doc_id", "n", "sig", "odd")
    # a key of very many documents is pre-aggregated, and its side of the join is one that Spark can split
    posts = reps.select("doc_id", F.explode("keys").alias("h"))
    meets = posts.groupBy("h").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot != last")
    posts = materialise(posts.join(meets.select("h", "pivot"), "h"), "band-posts")
    near = posts.where("doc_id != pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = materialise(_alike(near, sigs), "pivot-pairs")
    links = materialise(linked(pairs, known, SHINGLE, PERCENT), "pivot-links")
    found = materialise(components(links), "pivot-components")
    # keys that still hold more than one component
    posts = posts.join(found, posts["doc_id"] == found["id"], "left").select("h", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    posts = materialise(posts, "posts-components")
    mixed = posts.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).where("x != y")
    mixed = mixed.select("h", F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks"))
    met = posts.join(mixed, "h").join(sigs, "doc_id")
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    met = met.withColumn("chunk", chunk).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("h", F.least("chunk", "x").alias("lo"), F.greatest("chunk", "x").alias("hi"), (F.col("chunk") > F.col("x")).cast("int").alias("side"), "doc_id", "component", "n", "sig", "odd")
    met = met.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi", "doc_id")
    more = met.mapInArrow(_key_pairs, "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialise(more, "key-pairs")
    final = materialise(components(links.union(linked(more, known, SHINGLE, PERCENT))), "components")
    named = classes.join(final, classes["rep"] == final["id"], "left").select(F.col("n").alias("m"), F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(named, (F.col("n") == F.col("m")) & (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
