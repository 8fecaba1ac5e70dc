"""Periodic cells: lattice vectors, their reduction, and nearest images.

A cell is three lengths, or three lengths and the angles alpha, beta, gamma in degrees. Missing, zero or non-finite lengths mean
no periodicity along that vector (in a skewed cell: none at all).
"""

from __future__ import annotations

import itertools

import numpy as np

SWEEPS = 50


def as_cells(rows: list) -> np.ndarray | None:
    """(frames, 3) or (frames, 6) of a column of cells; None if all are null. ValueError for other numbers than 3 and 6."""
    sizes = {len(r) for r in rows if r is not None}
    if not sizes:
        return None
    if sizes - {3, 6}:
        raise ValueError("a cell has three lengths, or three lengths and three angles")
    if sizes == {3}:
        return np.array([[np.nan] * 3 if r is None else r for r in rows], float)
    return np.array([[np.nan] * 3 + [90.0] * 3 if r is None else list(r) + [90.0] * (6 - len(r)) for r in rows], float)


def lattice(cells: np.ndarray) -> np.ndarray:
    """(frames, 3, 3): vectors of cells of six numbers, the first along x, the second in the plane of x and y."""
    a, b, c = cells[:, :3].T
    alpha, beta, gamma = np.deg2rad(cells[:, 3:]).T
    out = np.zeros((len(cells), 3, 3))
    out[:, 0, 0] = a
    out[:, 1, 0], out[:, 1, 1] = b * np.cos(gamma), b * np.sin(gamma)
    x, y = np.cos(beta), (np.cos(alpha) - np.cos(beta) * np.cos(gamma)) / np.sin(gamma)
    out[:, 2, 0], out[:, 2, 1], out[:, 2, 2] = c * x, c * y, c * np.sqrt(np.maximum(1 - x * x - y * y, 0))
    return out


def reduced(h: np.ndarray) -> np.ndarray:
    """Short vectors of the same lattices: of each vector the nearest combination of the others is taken away until none gets shorter."""
    h = h.copy()
    for _ in range(SWEEPS):
        order = np.argsort((h * h).sum(axis=2), axis=1, kind="stable")
        h = np.take_along_axis(h, order[:, :, None], axis=1)
        short, mid, long = h[:, 0], h[:, 1], h[:, 2]
        before = (h * h).sum()
        mid = mid - np.rint((mid * short).sum(axis=1) / (short * short).sum(axis=1))[:, None] * short
        # the lattice point of the plane of the first two nearest to the third
        tries = [long - n * short - m * mid for n, m in _near_plane(short, mid, long)]
        size = np.stack([(t * t).sum(axis=1) for t in tries])
        long = np.take_along_axis(np.stack(tries), size.argmin(axis=0)[None, :, None], axis=0)[0]
        h = np.stack([short, mid, long], axis=1)
        if not (h * h).sum() < before * (1 - 1e-12):
            break
    return h


def _near_plane(u: np.ndarray, v: np.ndarray, w: np.ndarray):
    uu, vv, uv, uw, vw = ((a * b).sum(axis=1) for a, b in ((u, u), (v, v), (u, v), (u, w), (v, w)))
    det = uu * vv - uv * uv
    x, y = np.rint((uw * vv - vw * uv) / det), np.rint((vw * uu - uw * uv) / det)
    return [((x + i)[:, None], (y + j)[:, None]) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def nearest_image(d: np.ndarray, cells: np.ndarray | None) -> np.ndarray:
    """Differences (frames, ..., 3) in the nearest image: rounding along the axes of orthorhombic cells; in skewed ones rounding in the reduced cell, then its 26 neighbours."""
    if cells is None:
        return d
    shape = (len(cells), *[1] * (d.ndim - 2))
    if cells.shape[1] == 3:
        box = cells.reshape(*shape, 3)
        with np.errstate(invalid="ignore", divide="ignore"):
            moved = d - box * np.rint(d / box)
        return np.where(np.isfinite(box) & (box > 0), moved, d)
    out = d.copy()
    square = (cells[:, 3:] == 90).all(axis=1)
    if square.any():
        out[square] = nearest_image(d[square], cells[square, :3])
    skew = np.flatnonzero(~square & (np.isfinite(cells) & (cells > 0)).all(axis=1))
    if len(skew):
        h = reduced(lattice(cells[skew]))
        part = d[skew].reshape(len(skew), -1, 3)
        base = part - np.rint(part @ np.linalg.inv(h)) @ h
        best, least = base, (base * base).sum(axis=2)
        for n in itertools.product((-1, 0, 1), repeat=3):
            moved = base + (np.array(n, float) @ h)[:, None, :]
            size = (moved * moved).sum(axis=2)
            less = size < least
            best, least = np.where(less[:, :, None], moved, best), np.where(less, size, least)
        out[skew] = best.reshape(len(skew), *d.shape[1:])
    return out
