"""Value ranges, bandwidths, kernel density estimates and Jensen-Shannon distances of features.

Densities are summed map-side: each task adds up its values' kernels on the grid for each group it meets, and only those
sums are shuffled, so no group is gathered anywhere, and values are read where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BROADCAST_ROWS

GRID = 100
#: Points of the linear bins of binned_densities.
FINE = 4096


def value_range(wide: DataFrame, column: str = "vals") -> DataFrame:
    """One row (lo, hi): smallest and largest value of all frames and features; NaN if any value is NaN, as in numpy."""
    lo, hi = F.array_min(column), F.array_max(column)
    has_nan = F.max(F.exists(column, lambda x: F.isnan(x)))
    got = wide.agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), has_nan.alias("bad"))
    nan = F.lit(float("nan"))
    return got.select(F.when(F.col("bad"), nan).otherwise(F.col("lo")).alias("lo"), F.when(F.col("bad"), nan).otherwise(F.col("hi")).alias("hi"))


def long_range(rep: DataFrame) -> DataFrame:
    """value_range of a long representation."""
    got = rep.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.max(F.isnan("value")).alias("bad"))
    nan = F.lit(float("nan"))
    return got.select(F.when(F.col("bad"), nan).otherwise(F.col("lo")).alias("lo"), F.when(F.col("bad"), nan).otherwise(F.col("hi")).alias("hi"))


def bandwidth(values: DataFrame, keys: list[str], on_degenerate: str = "error") -> DataFrame:
    """(keys, n, sd, h): h = sd (3 n / 4)^(-1/5). values has the keys, value and, if rows stand for several, weight.

    on_degenerate: what h is for a group of one value or of equal values: "error" stops the query, "zero" gives 0.
    """
    if on_degenerate not in ("error", "zero"):
        raise ValueError("on_degenerate is 'error' or 'zero'")
    if "weight" in values.columns:
        w, x = F.col("weight"), F.col("value")
        n, mean = F.sum(w).cast("double"), F.sum(w * x) / F.sum(w)
        var = (F.sum(w * x * x) - n * mean * mean) / F.nullif(n - 1, F.lit(0.0))
        got = values.groupBy(*keys).agg(n.alias("n"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))
    else:
        got = values.groupBy(*keys).agg(F.count("value").cast("double").alias("n"), F.stddev_samp("value").alias("sd"))
    h = F.col("sd") * F.pow(F.col("n") * 0.75, F.lit(-0.2))
    bad = F.col("sd").isNull() | (F.col("sd") < 1e-300)
    stop = F.raise_error(F.lit("a feature has one value only, or equal values: no density can be estimated")).cast("double")
    return got.withColumn("h", F.when(bad, stop if on_degenerate == "error" else F.lit(0.0)).otherwise(h))


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def _add_up(part: DataFrame, keys: list[str], grid: int) -> DataFrame:
    """Sum of the partial sums of each group: as many short rows meet as tasks that met the group."""
    types = [_ARROW[t] for _, t in part.select(*keys).dtypes]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[tuple, int] = {}
        places, rows = [], []
        for batch in batches:
            own = zip(*(batch.column(k).to_pylist() for k in keys))
            places += [index.setdefault(key, len(index)) for key in own]
            rows.append(batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, grid))
        if index:
            total = np.zeros((len(index), grid))
            np.add.at(total, np.array(places), np.concatenate(rows))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * grid, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in index], t) for k, t in enumerate(types)), lists], [*keys, "sums"])

    return part.repartition(*keys).mapInArrow(add, part.schema)


def kernel_sums(values: DataFrame, keys: list[str], lo: float, hi: float, grid: int = GRID, widths: dict[tuple, float] | None = None) -> DataFrame:
    """(keys, sums): sums[k] = sum of weight exp(-((g_k - value) / h)^2 / 2) over the rows of a group; g is the grid lo..hi.

    values has integer keys, value, perhaps weight, and h (of its group) unless widths has h by keys.
    """
    at = lo + np.arange(grid) * ((hi - lo) / (grid - 1))
    schema = ", ".join(f"{k} {t}" for k, t in values.select(*keys).dtypes) + ", sums array<double>"
    types = [_ARROW[t] for _, t in values.select(*keys).dtypes]
    weighted = "weight" in values.columns
    shared = values.sparkSession.sparkContext.broadcast(widths) if widths is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[tuple, int] = {}
        sums = np.zeros((64, grid))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            order = np.lexsort(own[::-1])
            own = [k[order] for k in own]
            new = np.ones(len(order), dtype=bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in own])
            starts = np.flatnonzero(new)
            x = batch.column("value").to_numpy(zero_copy_only=False)[order]
            widths_here = None if shared is not None else batch.column("h").to_numpy(zero_copy_only=False)[order]
            w = batch.column("weight").to_numpy(zero_copy_only=False)[order] if weighted else None
            found = list(zip(*(k[starts].tolist() for k in own)))
            place = np.array([index.setdefault(key, len(index)) for key in found])
            h = np.array([shared.value[key] for key in found]) if shared is not None else widths_here[starts]
            while place.max() >= len(sums):
                sums = np.concatenate([sums, np.zeros_like(sums)])
            group = np.cumsum(new) - 1
            for i in range(0, len(order), 4096):
                g = group[i : i + 4096]
                width = np.where(h[g] > 0, h[g], np.inf)
                u = (at[None, :] - x[i : i + 4096, None]) / width[:, None]
                k = np.exp(-0.5 * u * u) * (h[g] > 0)[:, None]
                if w is not None:
                    k *= w[i : i + 4096, None]
                first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                np.add.at(sums, place[g[first]], np.add.reduceat(k, first))
        if index:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(index) + 1) * grid, pa.int32()), pa.array(sums[: len(index)].ravel()))
            yield pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in index], t) for k, t in enumerate(types)), lists], [*keys, "sums"])

    columns = [*keys, "value", *["h"] * (widths is None), *["weight"] * weighted]
    return _add_up(values.select(*columns).mapInArrow(run, schema), keys, grid)


def densities(values: DataFrame, keys: list[str], lo: float, hi: float, grid: int = GRID, on_degenerate: str = "error") -> DataFrame:
    """(keys, n, h, sums) of each group. Up to BROADCAST_ROWS groups the bandwidths go to the tasks; beyond, they join by a shuffle."""
    widths = bandwidth(values, keys, on_degenerate).select(*keys, "n", "h")
    found = widths.limit(BROADCAST_ROWS + 1).toArrow()
    if len(found) > BROADCAST_ROWS:
        return kernel_sums(values.join(widths, keys), keys, lo, hi, grid).join(widths, keys)
    known = dict(zip(zip(*(found[k].to_pylist() for k in keys)), found["h"].to_pylist()))
    few = values.sparkSession.createDataFrame(found, widths.schema)
    return kernel_sums(values, keys, lo, hi, grid, known).join(F.broadcast(few), keys)


def linear_bins(x: np.ndarray, w: np.ndarray, lo: float, hi: float, fine: int) -> np.ndarray:
    """Weights w of values x shared out to the two nearest of fine points from lo to hi, by nearness; values beyond count at the ends."""
    at = np.clip((x - lo) * ((fine - 1) / (hi - lo)), 0, fine - 1)
    left = np.minimum(at.astype(np.int64), fine - 2)
    right = at - left
    return np.bincount(left, weights=w * (1 - right), minlength=fine) + np.bincount(left + 1, weights=w * right, minlength=fine)


def sums_of_bins(bins: np.ndarray, h: np.ndarray, lo: float, hi: float, grid: int = GRID) -> np.ndarray:
    """Kernel sums on the grid of rows of linear bins, each with its bandwidth; zeros where h is 0.

    A kernel between two points of distance d is off by at most d^2 / (8 h^2), so a sum over n values is by n times that.
    """
    at, points = np.linspace(lo, hi, grid), np.linspace(lo, hi, bins.shape[1])
    out = np.zeros((len(bins), grid))
    for k in np.flatnonzero(h > 0).tolist():
        u = (at[:, None] - points) / h[k]
        out[k] = np.exp(-0.5 * u * u) @ bins[k]
    return out


def binned_densities(values: DataFrame, keys: list[str], lo: float, hi: float, grid: int = GRID, fine: int = FINE, on_degenerate: str = "error") -> DataFrame:
    """densities(), in one pass over the values: moments and linear bins are summed, and kernels are laid over the bins.

    Work grows with values plus groups times fine, not with values times grid. See sums_of_bins for the error; at 4096 points over
    20 bandwidths it is under 0.000003 of n. Values beyond lo and hi count at the ends. values has keys and value, and weight perhaps.
    """
    if on_degenerate not in ("error", "zero"):
        raise ValueError("on_degenerate is 'error' or 'zero'")
    schema = ", ".join(f"{k} {t}" for k, t in values.select(*keys).dtypes)
    types = [_ARROW[t] for _, t in values.select(*keys).dtypes]
    weighted = "weight" in values.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            order = np.lexsort(own[::-1])
            own = [k[order] for k in own]
            x = batch.column("value").to_numpy(zero_copy_only=False)[order]
            w = batch.column("weight").to_numpy(zero_copy_only=False)[order].astype(float) if weighted else np.ones(len(x))
            cuts = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in own])))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)]):
                key = tuple(k[a].item() if hasattr(k[a], "item") else k[a] for k in own)
                # moments about lo lose fewer digits
                d, v = x[a:b] - lo, w[a:b]
                part = np.concatenate([[v.sum(), v @ d, v @ (d * d)], linear_bins(x[a:b], v, lo, hi, fine)])
                held[key] = held[key] + part if key in held else part
        if held:
            rows = np.stack(list(held.values()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in held], t) for k, t in enumerate(types)), lists], [*keys, "sums"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, -1)
                n, h = moments_width(*rows[:, :3].T, on_degenerate)
                sums = sums_of_bins(rows[:, 3:], h, lo, hi, grid)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * grid, pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(n), pa.array(h), lists], [*keys, "n", "h", "sums"])

    columns = [*keys, "value", *["weight"] * weighted]
    added = _add_up(values.select(*columns).mapInArrow(run, f"{schema}, sums array<double>"), keys, 3 + fine)
    return added.mapInArrow(finish, f"{schema}, n double, h double, sums array<double>")


def moments_width(n: np.ndarray, total: np.ndarray, square: np.ndarray, on_degenerate: str = "error") -> tuple[np.ndarray, np.ndarray]:
    """(n, h) of groups with these sums of weights, values and squares (see bandwidth)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        sd = np.sqrt(np.maximum((square - total * total / n) / (n - 1), 0))
    bad = ~(sd >= 1e-300)
    if bad.any() and on_degenerate == "error":
        raise ValueError("a feature has one value only, or equal values: no density can be estimated")
    return n.copy(), np.where(bad, 0.0, sd * (n * 0.75) ** -0.2)


def pdf_points(dens: DataFrame, keys: list[str], lo: float, hi: float, grid: int = GRID) -> DataFrame:
    """(keys, k, x, p): the density estimates at the grid points."""
    norm = F.col("n") * F.col("h") * F.lit(float(np.sqrt(2 * np.pi)))
    points = dens.select(*keys, norm.alias("norm"), F.posexplode("sums").alias("k", "s"))
    x = F.lit(lo) + F.col("k") * F.lit((hi - lo) / (grid - 1))
    return points.select(*keys, "k", x.alias("x"), (F.col("s") / F.col("norm")).alias("p"))


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances in base 2 of the rows of two arrays of non-negative weights; NaN and infinite results are 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
        m = (p + q) / 2
        left = np.where(p > 0, p * np.log(p / m), 0.0).sum(axis=1)
        total = left + np.where(q > 0, q * np.log(q / m), 0.0).sum(axis=1)
        out = np.sqrt(np.maximum(total / np.log(2), 0) / 2)
    return np.where(np.isfinite(out), out, 0.0)


def jsd_rows(pairs: DataFrame, p: str, q: str) -> DataFrame:
    """The other columns of pairs, and jsd: the distance of the arrays in columns p and q."""
    others = [c for c in pairs.columns if c not in (p, q)]
    schema = ", ".join(f"{c} {t}" for c, t in pairs.select(*others).dtypes) + ", jsd double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in (p, q))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(jensen_shannon(a, b))], [*others, "jsd"])

    return pairs.select(*others, p, q).mapInArrow(run, schema)


def jsd_between(dens: DataFrame, ref: int, on: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(ensemble, *on, jsd): distance of each other ensemble's density to that of ensemble ref."""
    left = dens.where(F.col("ensemble") == ref).select(*on, F.col("sums").alias("ref_sums"))
    right = dens.where(F.col("ensemble") != ref)
    return jsd_rows(right.join(left, list(on)).select("ensemble", *on, "ref_sums", "sums"), "ref_sums", "sums")
