"""Local order parameters of frames.

A frame is one row, so every measure is a narrow map: Arrow batches of frames, numpy inside, no shuffle. Formulas:
contact number  sum over j of 1 / (1 + exp(50 (d_ij - 1))), d in nm, over atoms j more than two residues away
bond angle      angle at the middle of three consecutive CA atoms
torsion         signed dihedral of four consecutive CA atoms
surface         4 pi (r + 0.14)^2 times the share of points on the sphere outside all other spheres, summed by residue
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import normalise_measure
from .atoms import MIN_SEPARATION
from .cells import as_cells, nearest_image

STEEPNESS = 50.0
MIDPOINT = 1.0
LIMIT = 700.0
PROBE = 0.14
POINTS = 960
# Van der Waals radii in nm after Bondi (1964); other elements count as carbon.
RADII = {"H": 0.120, "C": 0.170, "N": 0.155, "O": 0.152, "F": 0.147, "P": 0.180, "S": 0.180, "CL": 0.175, "SE": 0.190}
WIDE = "ensemble int, frame long, vals array<double>"


def contact_numbers(xyz: np.ndarray, atoms: np.ndarray, residues: np.ndarray, cell: np.ndarray | None = None) -> np.ndarray:
    far = np.abs(residues[:, None] - residues[None, :]) > MIN_SEPARATION
    out = np.zeros((len(xyz), len(atoms)))
    p = xyz[:, atoms]
    for i in range(len(atoms)):
        j = np.flatnonzero(far[i])
        d = nearest_image(p[:, j] - p[:, i : i + 1], cell)
        power = np.clip(STEEPNESS * (np.sqrt((d * d).sum(axis=2)) - MIDPOINT), -LIMIT, LIMIT)
        out[:, i] = (1 / (1 + np.exp(power))).sum(axis=1)
    return out


def bond_angles(xyz: np.ndarray, atoms: np.ndarray, cell: np.ndarray | None = None) -> np.ndarray:
    p = xyz[:, atoms]
    if len(atoms) < 3:
        return np.zeros((len(xyz), 0))
    u, v = nearest_image(p[:, :-2] - p[:, 1:-1], cell), nearest_image(p[:, 2:] - p[:, 1:-1], cell)
    dot = (u * v).sum(axis=2) / (np.sqrt((u * u).sum(axis=2)) * np.sqrt((v * v).sum(axis=2)))
    return np.arccos(np.clip(dot, -1, 1))


def torsions(xyz: np.ndarray, atoms: np.ndarray, cell: np.ndarray | None = None) -> np.ndarray:
    if len(atoms) < 4:
        return np.zeros((len(xyz), 0))
    step = nearest_image(np.diff(xyz[:, atoms], axis=1), cell)
    a, b, c = step[:, :-2], step[:, 1:-1], step[:, 2:]
    bc, ab = np.cross(b, c), np.cross(a, b)
    return np.arctan2(np.sqrt((b * b).sum(axis=2)) * (a * bc).sum(axis=2), (ab * bc).sum(axis=2))


def sphere_points(n: int = POINTS) -> np.ndarray:
    """n points on the unit sphere along a golden spiral."""
    k = np.arange(n)
    y = 2 * k / n - 1 + 1 / n
    around, angle = np.sqrt(1 - y * y), k * np.pi * (3 - np.sqrt(5))
    return np.stack([np.cos(angle) * around, y, np.sin(angle) * around], axis=1)


def near_atoms(xyz: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, i, j) of the atoms i != j of each frame with |p_i - p_j| < reach_i + reach_j, by frame, then i, then j.

    Atoms are hashed into cubic cells as wide as the largest reach of two atoms, so partners lie in the 27 cells around; work
    grows with atoms times their partners. Cells that share a hash only add candidates, which the distance test drops.
    """
    frames, atoms = xyz.shape[:2]
    if frames * atoms == 0:
        return (np.zeros(0, np.int64),) * 3
    flat = xyz.reshape(-1, 3)
    width = max(2 * float(reach.max()), 1e-9)
    with np.errstate(invalid="ignore"):
        cell = np.nan_to_num(np.floor(flat / width), nan=0.0, posinf=0.0, neginf=0.0).clip(-(1 << 40), 1 << 40).astype(np.int64)
    frame = np.repeat(np.arange(frames), atoms)

    def hashed(c: np.ndarray) -> np.ndarray:
        x = (frame * 0x1F1F1F1F + c[:, 0]) * 0x5851F42D4C957F2D + c[:, 1]
        return (x ^ (x >> 29)) * 0x14057B7EF767814F + c[:, 2]

    with np.errstate(over="ignore"):
        key = hashed(cell)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        left, right = [], []
        for shift in np.ndindex(3, 3, 3):
            near = hashed(cell + (np.array(shift) - 1))
            lo, hi = np.searchsorted(ranked, near, "left"), np.searchsorted(ranked, near, "right")
            n = hi - lo
            i = np.repeat(np.arange(len(flat)), n)
            j = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(i))]
            d = flat[i] - flat[j]
            keep = (i != j) & (frame[i] == frame[j]) & ((d * d).sum(axis=1) < (reach[i % atoms] + reach[j % atoms]) ** 2)
            left.append(i[keep])
            right.append(j[keep])
    # a pair found twice by two cells of one hash stays once
    pairs = np.unique(np.concatenate(left) * len(flat) + np.concatenate(right))
    i, j = np.divmod(pairs, len(flat))
    return frame[i], i % atoms, j % atoms


def surface_areas(xyz: np.ndarray, radii: np.ndarray, residues: np.ndarray, points: int = POINTS, block: int = 256) -> np.ndarray:
    """Accessible area of each residue in each frame: shares of sphere points outside the spheres of the atoms near by."""
    sphere, reach = sphere_points(points), radii + PROBE
    n_res = int(residues.max()) + 1 if len(residues) else 0
    out = np.zeros((len(xyz), n_res))
    atoms = len(reach)
    full = 4 * np.pi * reach**2
    # frames at once: as many as make some 30,000 atoms, so that large systems take one at a time
    step = max(1, min(block, 30_000 // max(1, atoms)))
    for first in range(0, len(xyz) if atoms else 0, step):
        p = xyz[first : first + step]
        f, i, j = near_atoms(p, reach)
        owner = f * atoms + i
        share = np.ones(len(p) * atoms)
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(owner))
        k = 0
        while k < len(cuts):
            # whole atoms, some 2048 pairs at a time
            last = max(k + 1, int(np.searchsorted(ends, cuts[k] + 2048, side="right")))
            some = slice(cuts[k], ends[last - 1])
            c, own = p[f[some], i[some]] - p[f[some], j[some]], reach[i[some]]
            # |c + r u|^2 < R^2 along the centres' difference c: the sphere's points are the same for all atoms
            shut = (c * c).sum(axis=1)[:, None] + 2 * own[:, None] * (c @ sphere.T) + own[:, None] ** 2 < (reach[j[some]] ** 2)[:, None]
            buried = np.logical_or.reduceat(shut, cuts[k:last] - cuts[k], axis=0)
            share[owner[cuts[k:last]]] = 1 - buried.mean(axis=1)
            k = last
        areas = share.reshape(len(p), atoms) * full
        for a in range(atoms):
            out[first : first + len(p), residues[a]] += areas[:, a]
    return out


def neighbours(frames: DataFrame, reach: float) -> DataFrame:
    """(ensemble, frame, atom, n, nearest): number of atoms of the frame nearer than reach to each atom, and the least such distance (null without one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                xyz = part.column("xyz").flatten().to_numpy().reshape(part.num_rows, -1, 3)
                atoms = xyz.shape[1]
                f, i, j = near_atoms(xyz, np.full(atoms, reach / 2))
                owner, d = f * atoms + i, np.sqrt(((xyz[f, i] - xyz[f, j]) ** 2).sum(axis=1))
                nearest = np.full(part.num_rows * atoms, np.inf)
                np.minimum.at(nearest, owner, d)
                row = pa.array(np.repeat(np.arange(part.num_rows), atoms))
                cols = [part.column("ensemble").take(row), part.column("frame").take(row), pa.array(np.tile(np.arange(atoms, dtype=np.int32), part.num_rows))]
                cols += [pa.array(np.bincount(owner, minlength=len(nearest)).astype(np.int64)), pa.array(nearest, mask=np.isinf(nearest))]
                yield pa.RecordBatch.from_arrays(cols, ["ensemble", "frame", "atom", "n", "nearest"])

    rows = frames.select(F.col("ensemble").cast("int").alias("ensemble"), F.col("frame").cast("long").alias("frame"), "xyz")
    return rows.mapInArrow(run, "ensemble int, frame long, atom int, n long, nearest double")


def _kernel(measure: str, atoms: list, drop_last_angle: bool) -> Callable[[np.ndarray, np.ndarray | None], np.ndarray]:
    name = "CB" if measure == "cbcn" else "CA"
    chosen = [a for a in atoms if a["name"] == name]
    index = np.array([a["atom"] for a in chosen], np.int64)
    residues = np.array([a["res_index"] for a in chosen], np.int64)
    if measure in ("cbcn", "cacn"):
        return lambda xyz, cell: contact_numbers(xyz, index, residues, cell)
    if measure == "caba":
        return lambda xyz, cell: bond_angles(xyz, index, cell)[:, : max(0, len(index) - 2 - drop_last_angle)]
    if measure == "cata":
        return lambda xyz, cell: torsions(xyz, index, cell)
    radii = np.array([RADII.get(str(a["element"]).strip().upper(), RADII["C"]) for a in atoms])
    own = np.array([a["res_index"] for a in atoms], np.int64)
    return lambda xyz, cell: surface_areas(xyz, radii, own)


def represent(frames: DataFrame, atoms: DataFrame, measure: str, variant: str = "v2") -> DataFrame:
    """Wide representation of frames by a measure. variant "v1" leaves out the last bond angle.

    The topology is collected: it is one row per atom, however many frames there are. Too few atoms give empty vals.
    """
    measure = normalise_measure(measure)
    kernel = _kernel(measure, atoms.orderBy("atom").collect(), variant == "v1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("xyz").flatten().to_numpy()
            xyz = flat.reshape(batch.num_rows, -1, 3)
            vals = np.asarray(kernel(xyz, as_cells(batch.column("cell").to_pylist())), float)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vals) + 1) * vals.shape[1], pa.int32()), pa.array(vals.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("ensemble"), batch.column("frame"), lists], ["ensemble", "frame", "vals"])

    rows = frames.select(F.col("ensemble").cast("int").alias("ensemble"), F.col("frame").cast("long").alias("frame"), "xyz", "cell")
    return rows.mapInArrow(run, WIDE)
