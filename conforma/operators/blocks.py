"""Frames packed into blocks of rows, blocks that tasks read by themselves, and sums of arrays over tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Frames of a block at most, and numbers in it.
ROWS = 512
VALUES = 1 << 22
#: Blocks of a stored file at most.
FILE_BLOCKS = 16
PACKED = "part int, chunk int, n int, ensembles array<int>, frames array<long>, x binary"


def packed(wide: DataFrame, rows: int) -> DataFrame:
    """PACKED blocks of at most rows frames in the order of wide's partitions; x holds their values, row by row. Nothing is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(table: pa.Table, chunk: int) -> pa.RecordBatch:
            vals = table["vals"].combine_chunks()
            if vals.null_count or vals.flatten().null_count or len(set(vals.value_lengths().to_pylist())) > 1:
                raise ValueError("frames have missing values or different numbers of features")
            lists = [pa.array([table[c].to_pylist()], pa.list_(t)) for c, t in (("ensemble", pa.int32()), ("frame", pa.int64()))]
            cols = [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([table.num_rows], pa.int32()), *lists, pa.array([vals.flatten().to_numpy().tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "chunk", "n", "ensembles", "frames", "x"])

        for batch in batches:
            first = 0
            while first < batch.num_rows:
                some = batch.slice(first, rows - n)
                held.append(some)
                n += some.num_rows
                first += some.num_rows
                if n == rows:
                    yield block(pa.Table.from_batches(held), chunk)
                    chunk, held, n = chunk + 1, [], 0
        if n:
            yield block(pa.Table.from_batches(held), chunk)

    named = wide.select(F.col("ensemble").cast("int").alias("ensemble"), F.col("frame").cast("long").alias("frame"), F.col("vals").cast("array<double>").alias("vals"))
    return named.mapInArrow(pack, PACKED)


def width_of(wide: DataFrame) -> int:
    """Features of a frame; 0 without frames."""
    first = wide.select(F.size("vals").alias("n")).first()
    return first["n"] if first else 0


def block_rows(features: int, rows: int) -> int:
    return max(1, min(rows, VALUES // max(1, features)))


def ordered_blocks(wide: DataFrame, rows: int = ROWS) -> tuple[DataFrame, int, int]:
    """(block, first, n, ensembles, frames, x, file, chunk) in the order of (ensemble, frame), stored; the numbers of frames and of blocks.

    first is the number of frames before the block; the block is the row of its file with that chunk. One shuffle sorts the
    frames; a few numbers a block come to the driver.
    """
    features = width_of(wide)
    rows = block_rows(features, rows)
    frames = wide.count()
    together = max(1, min(FILE_BLOCKS, VALUES // (rows * max(1, features))))
    parts = max(1, -(-frames // (rows * together)))
    ranged = wide.select("ensemble", "frame", "vals").repartitionByRange(parts, "ensemble", "frame").sortWithinPartitions("ensemble", "frame")
    blocks = stored(packed(ranged, rows), "blocks")
    known = sorted((r["part"], r["chunk"], r["n"], r["file"]) for r in blocks.select("part", "chunk", "n", F.input_file_name().alias("file")).collect())
    first, numbered = 0, []
    for k, (part, chunk, n, file) in enumerate(known):
        numbered.append((part, chunk, k, first, file))
        first += n
    numbers = blocks.sparkSession.createDataFrame(numbered, "part int, chunk int, block int, first long, file string")
    # two numbers and a name a block of frames
    named = blocks.join(F.broadcast(numbers), ["part", "chunk"]).select("block", "first", "n", "ensembles", "frames", "x", "file", "chunk")
    return named, frames, len(known)


class Place(NamedTuple):
    """Where a block lies: frames before it, its frames, its file in the shared folder, and its chunk there."""

    first: int
    n: int
    file: str
    chunk: int


def block_groups(blocks: DataFrame, count: int, more: int = 0) -> list[list[Place]]:
    """Places of ordered_blocks in order, in runs of blocks: a task has one run as its own. A run has at most some VALUES numbers, or is one block.

    more: numbers that a task holds for each frame besides its values.
    """
    found = blocks.select("first", "n", "file", "chunk", F.octet_length("x").alias("size")).collect()
    numbers = sum(r["size"] // 8 + more * r["n"] for r in found)
    places = [Place(*x) for x in sorted((r["first"], r["n"], r["file"], r["chunk"]) for r in found)]
    groups = min(count, max(2 * blocks.sparkSession.sparkContext.defaultParallelism, -(-numbers // VALUES)))
    cuts = [k * count // groups for k in range(groups + 1)]
    return [places[a:b] for a, b in zip(cuts, cuts[1:])]


def _table(file: str, columns: list[str]) -> pa.Table:
    """Columns of a stored file, read by a task from the shared folder."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    system, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", file))
    with system.open_input_file(path) as f:
        return pq.read_table(f, columns=columns)


def read_rows(file: str, columns: list[str]) -> Iterator[tuple[pa.Scalar, ...]]:
    """Rows of a stored file, read by a task from the shared folder."""
    yield from zip(*_table(file, columns).columns)


def read_blocks(places: list[Place]) -> Iterator[tuple[Place, np.ndarray, np.ndarray]]:
    """(place, frames, values) of blocks, file after file, read by a task from the shared folder: no block is shuffled or broadcast."""
    for file, some in groupby(places, key=lambda p: p.file):
        table = _table(file, ["chunk", "frames", "x"])
        row = {chunk: k for k, chunk in enumerate(table["chunk"].to_pylist())}
        for place in some:
            k = row[place.chunk]
            yield place, table["frames"][k].values.to_numpy(), np.frombuffer(table["x"][k].as_buffer()).reshape(place.n, -1)


def by_group(blocks: DataFrame, groups: list) -> DataFrame:
    """One task for each of groups, with its number in column id."""
    return blocks.sparkSession.range(0, len(groups), 1, len(groups))


def summed(parts: DataFrame, tasks: int, numbers: int) -> dict[int, np.ndarray]:
    """Sums of the arrays of float64 in column x by the number in column key, on the driver: as many numbers as the keys' arrays have.

    Each of the tasks has at most numbers numbers in all. If all of them together are few, the driver adds them; if not, tasks do, in
    two levels, so that none reads more than the square root of a key's arrays.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, x in zip(batch.column("key").to_pylist(), batch.column("x")):
                value = np.frombuffer(x.as_buffer())
                total[key] = total[key] + value if key in total else value.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["key", "x"])

    parts = parts.select("key", "x")
    if tasks * numbers <= VALUES:
        total: dict[int, np.ndarray] = {}
        for r in parts.collect():
            value = np.frombuffer(r["x"])
            total[r["key"]] = total[r["key"]] + value if r["key"] in total else value
        return total
    if tasks > 16:
        parts = parts.withColumn("of", F.pmod(F.spark_partition_id(), F.lit(int(np.sqrt(tasks))))).repartition("key", "of").select("key", "x").mapInArrow(add, "key long, x binary")
    parts = parts.repartition("key").mapInArrow(add, "key long, x binary")
    return {r["key"]: np.frombuffer(r["x"]) for r in parts.collect()}
