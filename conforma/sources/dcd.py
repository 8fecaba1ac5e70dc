"""DCD trajectories (CHARMM/NAMD binary): a Spark data source with a partition per block of frames, and a writer.

Layout: Fortran records, each between two 4-byte lengths. A header record ("CORD" and 20 integers), a title record and the
number of atoms; then for each frame an optional cell record (6 doubles) and one record of floats per axis, in Angstrom.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .topology import ANGSTROM

#: Atoms between wanted ones that are read over, as a seek costs more.
GAP = 64
SCHEMA = "ensemble int, frame long, xyz array<double>, cell array<double>"


@dataclass
class Header:
    frames: int
    atoms: int
    has_cell: bool
    order: str
    data: int

    @property
    def frame_bytes(self) -> int:
        return 3 * (4 * self.atoms + 8) + 56 * self.has_cell


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        raw = f.read(4)
        order = next((o for o in "<>" if len(raw) == 4 and struct.unpack(o + "i", raw)[0] == 84), None)
        head = f.read(84)
        if order is None or head[:4] != b"CORD":
            raise ValueError(f"{path} is not a DCD file")
        numbers = struct.unpack(order + "20i", head[4:])
        f.read(4)
        (title,) = struct.unpack(order + "i", f.read(4))
        f.seek(title + 4, 1)
        _, atoms, _ = struct.unpack(order + "3i", f.read(12))
        if numbers[8]:
            raise ValueError("DCD files with fixed atoms are not supported")
        head = Header(0, atoms, bool(numbers[10]), order, f.tell())
        # the header's count is wrong in files that were cut or appended to
        head.frames = (os.path.getsize(path) - head.data) // head.frame_bytes
        return head


def _read(f, at: int, size: int) -> bytes:
    f.seek(at)
    return f.read(size)


def runs_of(atoms: list[int]) -> list[tuple[int, int]]:
    """(first, last + 1) of stretches of ascending atoms to read at once; gaps of at most GAP atoms are read over."""
    out: list[tuple[int, int]] = []
    for a in sorted(set(atoms)):
        if out and a - out[-1][1] <= GAP:
            out[-1] = (out[-1][0], a + 1)
        else:
            out.append((a, a + 1))
    return out


def read_cells(raw: np.ndarray, order: str) -> np.ndarray:
    """Cells (frames, 3 lengths in nm, or 6 numbers with alpha, beta, gamma in degrees) of raw cell records (frames, 56 bytes)."""
    box = np.ascontiguousarray(raw[:, 4:52]).view(order + "f8").astype(float)
    lengths, angles = box[:, [0, 2, 5]] * ANGSTROM, box[:, [4, 3, 1]]
    # angles are written in degrees or as cosines
    cosines = (np.abs(angles) <= 1).all(axis=1)
    angles[cosines] = np.rad2deg(np.arccos(angles[cosines]))
    right = np.abs(angles - 90) < 1e-3
    return lengths if right.all() else np.hstack([lengths, np.where(right, 90.0, angles)])


def read_frames(path: str, head: Header, first: int, last: int, atoms: list[int] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Coordinates (frames, atoms, 3) in nm, and cells (see read_cells) if the file has them. atoms: those to read, in this order, by byte offsets."""
    n = last - first
    skip = 56 * head.has_cell
    with open(path, "rb") as f:
        if atoms is None:
            raw = np.frombuffer(_read(f, head.data + first * head.frame_bytes, n * head.frame_bytes), np.uint8).reshape(n, head.frame_bytes)
            boxes, axes = raw[:, :skip], []
            for k in range(3):
                at = skip + k * (4 * head.atoms + 8) + 4
                axes.append(np.ascontiguousarray(raw[:, at : at + 4 * head.atoms]).view(head.order + "f4"))
            xyz = np.stack(axes, axis=2)
        else:
            if atoms and not 0 <= min(atoms) <= max(atoms) < head.atoms:
                raise ValueError(f"{path} has {head.atoms} atoms")
            runs = runs_of(atoms)
            held = np.concatenate([np.arange(a, b) for a, b in runs]) if runs else np.zeros(0, np.int64)
            take = np.searchsorted(held, atoms)
            xyz, boxes = np.zeros((n, len(atoms), 3), np.float32), np.zeros((n, skip), np.uint8)
            for k in range(n):
                start = head.data + (first + k) * head.frame_bytes
                if skip:
                    boxes[k] = np.frombuffer(_read(f, start, skip), np.uint8)
                for axis in range(3):
                    at = start + skip + axis * (4 * head.atoms + 8) + 4
                    got = b"".join(_read(f, at + 4 * a, 4 * (b - a)) for a, b in runs)
                    xyz[k, :, axis] = np.frombuffer(got, head.order + "f4")[take]
    return xyz.astype(float) * ANGSTROM, read_cells(boxes, head.order) if head.has_cell else None


def write_dcd(path: str, xyz: np.ndarray, cell: np.ndarray | None = None) -> None:
    """Write (frames, atoms, 3) in nm, and cells (three lengths in nm, or with three angles) if given."""
    n, atoms, _ = xyz.shape
    numbers = [n, 1, 1, 0, 0, 0, 0, 0, 0, 0, int(cell is not None), *[0] * 8, 24]

    def record(raw: bytes) -> bytes:
        return struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(raw))

    with open(path, "wb") as f:
        f.write(record(b"CORD" + struct.pack("<20i", *numbers)))
        f.write(record(struct.pack("<i", 1) + b"written by a test or tool".ljust(80)))
        f.write(record(struct.pack("<i", atoms)))
        for k in range(n):
            if cell is not None:
                a, b, c = cell[k][:3] / ANGSTROM
                alpha, beta, gamma = cell[k][3:] if len(cell[k]) == 6 else (90.0, 90.0, 90.0)
                f.write(record(struct.pack("<6d", a, gamma, b, beta, alpha, c)))
            for axis in range(3):
                f.write(record((xyz[k, :, axis] / ANGSTROM).astype("<f4").tobytes()))


@dataclass
class Block(InputPartition):
    path: str
    ensemble: int
    first: int
    last: int


class DcdReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ensemble = options["path"], int(options.get("ensemble", 0))
        self.block = int(options.get("framesperpartition", 1024))
        chosen = options.get("atoms")
        self.atoms = None if chosen is None else [int(a) for a in chosen.split(",") if a.strip()]
        self.low, self.high, self.only = 0, None, None

    def partitions(self) -> list[Block]:
        n = read_header(self.path).frames
        high = n if self.high is None else min(n, self.high)
        blocks = [Block(self.path, self.ensemble, i, min(high, i + self.block)) for i in range(self.low, high, self.block)]
        if self.only is not None:
            # stretches of wanted frames
            frames = sorted(k for k in self.only if k is not None and self.low <= k < high)
            cuts = [i for i, k in enumerate(frames) if not i or k != frames[i - 1] + 1] + [len(frames)]
            blocks = [Block(self.path, self.ensemble, k, min(frames[b - 1] + 1, k + self.block)) for a, b in zip(cuts, cuts[1:]) for k in range(frames[a], frames[b - 1] + 1, self.block)]
        return blocks or [Block(self.path, self.ensemble, 0, 0)]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        head = read_header(part.path)
        for i in range(part.first, part.last, 256):
            j = min(part.last, i + 256)
            xyz, cell = read_frames(part.path, head, i, j, self.atoms)
            width = 3 * xyz.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * width, pa.int32()), pa.array(xyz.ravel()))
            boxes = pa.array([None] * (j - i) if cell is None else cell.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part.ensemble), pa.int32()), pa.array(np.arange(i, j)), lists, boxes], ["ensemble", "frame", "xyz", "cell"])


class FilteringDcdReader(DcdReader):
    """A reader that takes filters; Spark refuses one unless spark.sql.python.filterPushdown.enabled is true."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds and lists of frames choose partitions; a filter on another ensemble leaves none. All others go back to Spark."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("frame",) and isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif name == ("frame",) and isinstance(f, GreaterThan):
                self.low = max(self.low, value + 1)
            elif name == ("frame",) and isinstance(f, (LessThan, LessThanOrEqual)):
                end = value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            elif name in (("frame",), ("ensemble",)) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                if name == ("frame",):
                    self.only = wanted if self.only is None else self.only & wanted
                elif self.ensemble not in wanted:
                    self.high = 0
            elif not (isinstance(f, IsNotNull) and name in (("frame",), ("ensemble",))):
                yield f


class DcdSource(DataSource):
    """spark.read.format("dcd").option("ensemble", 0).load(path); option framesPerPartition sets the block size.

    Option atoms ("0,4,8") reads these atoms alone, by byte offsets; they are numbered from 0 in the given order. Filters on
    frame and ensemble choose what is read with option pushFilters ("true"; needs spark.sql.python.filterPushdown.enabled).

    The path must be readable as a file on every machine (a shared mount): the format is read at byte offsets.
    """

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DcdReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringDcdReader if options.get("pushfilters", "false").lower() == "true" else DcdReader)(options)
