"""Bootstrap draws of frames and the schedule of compared draws.

Draws are a hash of (seed, comparison, draw, place), so they are the same in any engine and on any partitioning.

v2: of each comparison, s draws of the reference, a fresh draw of the other ensemble for each of the s * s pairs, and two
fresh draws for each pair of s within each of the two ensembles. v1: s draws of each ensemble, used in all pairs, and
every feature is drawn on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .density import GRID, jensen_shannon

SAMPLE_SIZE = 1000
S_NUM = 5
#: Features whose drawn values meet in one group, and numbers of one draw in it.
FEATURE_BLOCK = 8
GROUP_VALUES = 1 << 20
#: Frames named by two numbers that may be broadcast.
BROADCAST_FRAMES = 2_000_000


def draw_table(s: int, variant: str = "v2") -> list[tuple[int, int]]:
    """(draw, side) of one comparison; side 0 is the reference."""
    _check(s, variant)
    if variant == "v1":
        return [(d, 0) for d in range(s)] + [(s + d, 1) for d in range(s)]
    inner = s * (s - 1)
    return [(d, 0) for d in range(s)] + [(s + d, 1) for d in range(s * s)] + [(s + s * s + side * inner + d, side) for side in (0, 1) for d in range(inner)]


def pair_schedule(s: int, variant: str = "v2") -> list[tuple[str, int, int, int]]:
    """(kind, pair, draw_a, draw_b): s * s pairs between the ensembles (inter), s * (s - 1) within them (intra)."""
    _check(s, variant)
    within = [(a, b) for a in range(s) for b in range(a + 1, s)]
    if variant == "v1":
        inter = [("inter", i * s + j, i, s + j) for i in range(s) for j in range(s)]
        return inter + [("intra", side * len(within) + k, side * s + a, side * s + b) for side in (0, 1) for k, (a, b) in enumerate(within)]
    inter = [("inter", i * s + j, i, s + i * s + j) for i in range(s) for j in range(s)]
    base = s + s * s
    return inter + [("intra", side * len(within) + k, base + side * s * (s - 1) + 2 * k, base + side * s * (s - 1) + 2 * k + 1) for side in (0, 1) for k in range(len(within))]


def _check(s: int, variant: str) -> None:
    if s < 2:
        raise ValueError("s_num must be at least 2")
    if variant not in ("v1", "v2"):
        raise ValueError("variant is 'v1' or 'v2'")


def schedule_frame(spark: SparkSession, s: int, variant: str = "v2") -> DataFrame:
    return spark.createDataFrame(pair_schedule(s, variant), "kind string, pair int, draw_a int, draw_b int")


def hashed(*parts: Column) -> Column:
    """Number of 32 bits from the first 8 hex digits of md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def frame_index(wide: DataFrame) -> DataFrame:
    """(ensemble, frame, idx, n): dense index of each ensemble's frames in frame order, without gathering an ensemble.

    Frames are counted in blocks by the frame number's order: ranks within a range block, plus the blocks before it.
    """
    ids = wide.select("ensemble", "frame")
    blocked = ids.withColumn("block", F.floor(F.col("frame") / 4096))
    sizes = blocked.groupBy("ensemble", "block").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy("ensemble").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("ensemble", "block", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("ensemble")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("ensemble", "block").orderBy("frame")) - 1
    return blocked.withColumn("r", rank).join(before, ["ensemble", "block"]).select("ensemble", "frame", (F.col("r") + F.col("before")).cast("long").alias("idx"), "n")


def draws(spark: SparkSession, sizes: dict[int, int], ref: int, s: int = S_NUM, sample_size: int = SAMPLE_SIZE, seed: int = 0, variant: str = "v2", features: int = 1) -> DataFrame:
    """(ensemble, draw, source, idx, weight): how often frame idx of ensemble source is in a draw of the comparison with ensemble.

    sizes: frames of each ensemble. Equal frames of a draw are one row with their number as weight. v1 adds feature.
    The table has (comparisons * draws * sample_size) rows at most, whatever the number of frames.
    """
    rows = [(e, d, ref if side == 0 else e, sizes[ref if side == 0 else e]) for e in sorted(sizes) if e != ref for d, side in draw_table(s, variant)]
    plan = spark.createDataFrame(rows, "ensemble int, draw int, source int, n long")
    if variant == "v1":
        plan = plan.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(features - 1))))
    keys = ["ensemble", "draw", *["feature"] * (variant == "v1")]
    each = plan.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sample_size - 1))))
    each = each.withColumn("idx", hashed(F.lit(seed), *keys_as_columns(keys), F.col("k")) % F.col("n"))
    return each.groupBy(*keys, "source", "idx").agg(F.count("*").cast("double").alias("weight"))


def keys_as_columns(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def drawn_frames(wide: DataFrame, drawn: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of drawn, with vals of their frames in place of idx.

    Draws meet the index of frames first, both without values. The frames they need then filter the wide table where it is
    read, before any of its values is shuffled. most: a bound on the number of drawn frames; if it is small enough, they are
    broadcast to the scan.
    """
    index = frame_index(wide).select(F.col("ensemble").alias("source"), "frame", "idx")
    picked = drawn.join(index, ["source", "idx"]).drop("idx")
    needed = picked.select("source", "frame").distinct()
    needed = F.broadcast(needed) if most is not None and most <= BROADCAST_FRAMES else needed
    rows = wide.select(F.col("ensemble").alias("source"), "frame", "vals").join(needed, ["source", "frame"], "left_semi")
    return picked.join(rows, ["source", "frame"])


def drawn_values(wide: DataFrame, drawn: DataFrame, most: int | None = None) -> DataFrame:
    """(ensemble, draw, feature, value, weight) of the drawn frames (see drawn_frames)."""
    met = drawn_frames(wide, drawn, most)
    if "feature" in drawn.columns:
        return met.select("ensemble", "draw", "feature", F.element_at("vals", F.col("feature") + 1).alias("value"), "weight")
    return met.select("ensemble", "draw", "weight", F.posexplode("vals").alias("feature", "value")).select("ensemble", "draw", "feature", "value", "weight")


def sampled_distances(met: DataFrame, schedule: list[tuple[str, int, int, int]], lo: float, hi: float, features: int, sample_size: int, grid: int = GRID, on_degenerate: str = "error") -> DataFrame:
    """(ensemble, kind, pair, feature, value): distances between the densities of drawn samples, for rows of drawn_frames.

    One shuffle brings together the drawn values of a comparison and a block of features, a group whose size the draws bound,
    whatever the number of frames. A task then estimates each draw's densities once, bandwidths included, and compares them.
    """
    if on_degenerate not in ("error", "zero"):
        raise ValueError("on_degenerate is 'error' or 'zero'")
    one = "feature" in met.columns
    width = 1 if one else max(1, min(FEATURE_BLOCK, GROUP_VALUES // max(1, sample_size)))
    if one:
        rows = met.select("ensemble", F.col("feature").alias("block"), "draw", "frame", "weight", F.array(F.element_at("vals", F.col("feature") + 1)).alias("part"))
    else:
        parts = F.transform(F.sequence(F.lit(0), F.lit(-(-features // width) - 1)), lambda b: F.slice("vals", b * width + 1, F.lit(width)))
        rows = met.select("ensemble", "draw", "frame", "weight", F.posexplode(parts).alias("block", "part"))
    # a fixed number of tasks, as the kernels' work has no relation to the bytes of the values
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("ensemble", "block", "draw", "frame", "weight", "part").repartition(n, "ensemble", "block").sortWithinPartitions("ensemble", "block", "draw", "frame")
    at = lo + np.arange(grid) * ((hi - lo) / (grid - 1))
    kinds, pairs, left, right = zip(*schedule)
    left, right = np.array(left), np.array(right)

    def distances(ensemble: int, block: int, draw: np.ndarray, weight: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, draw[1:] != draw[:-1]))
        sums = np.zeros((int(draw.max()) + 1, part.shape[1], grid))
        for first, last in zip(starts, np.append(starts[1:], len(draw))):
            w, x = weight[first:last], part[first:last]
            total = w.sum()
            mean = w @ x / total
            with np.errstate(invalid="ignore", divide="ignore"):
                sd = np.sqrt(np.maximum((w @ (x * x) - total * mean * mean) / (total - 1), 0))
            if on_degenerate == "error" and not (sd >= 1e-300).all():
                raise ValueError("a feature has one value only, or equal values: no density can be estimated")
            h = sd * (total * 0.75) ** -0.2
            for f in np.flatnonzero(h > 0).tolist():
                for k in range(0, len(w), 4096):
                    u = (at[:, None] - x[None, k : k + 4096, f]) / h[f]
                    sums[draw[first], f] += np.exp(-0.5 * u * u) @ w[k : k + 4096]
        found = np.stack([jensen_shannon(sums[a], sums[b]) for a, b in zip(left, right)])
        count = found.shape[1]
        feature = np.tile(block * width + np.arange(count, dtype=np.int32), len(left))
        cols = [pa.array(np.full(found.size, ensemble, np.int32)), pa.array(np.repeat(np.array(kinds), count)), pa.array(np.repeat(np.array(pairs, np.int32), count)), pa.array(feature.astype(np.int32)), pa.array(found.ravel())]
        return pa.RecordBatch.from_arrays(cols, ["ensemble", "kind", "pair", "feature", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
            e, b, d, w = (table[c].to_numpy() for c in ("ensemble", "block", "draw", "weight"))
            x = table["part"].combine_chunks().flatten().to_numpy()
            size = np.append(0, np.cumsum(table["part"].combine_chunks().value_lengths().to_numpy()))
            cut = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (b[1:] != b[:-1])))
            for first, last in zip(cut.tolist(), np.append(cut[1:], len(e)).tolist()):
                yield distances(int(e[first]), int(b[first]), d[first:last], w[first:last], x[size[first] : size[last]].reshape(last - first, -1))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # all groups but the last, which may go on in the next batch
            e, b = (batch.column(c).to_numpy() for c in ("ensemble", "block"))
            other = np.flatnonzero((e != e[-1]) | (b != b[-1]))
            if len(other):
                cut = int(other[-1]) + 1
                yield from groups(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held = [batch.slice(cut)]
        if held:
            yield from groups(pa.Table.from_batches(held))

    got = rows.mapInArrow(run, "ensemble int, kind string, pair int, feature int, value double")
    return got.select("ensemble", "kind", "pair", "feature", F.round("value", 9).alias("value"))
