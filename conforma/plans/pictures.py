"""Pictures of matrices of any size: cells are averaged to a grid of pixels in Spark, and tasks compress the picture's rows.

A PNG file is a header, compressed data in chunks, and an end. The data is one zlib stream, which may be made of blocks that are
compressed one by one if each but the last ends at a byte; so tasks make the blocks of bands of rows, and only each band's length and
checksum come to the driver, which adds the checksum of the whole.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of the longer side, unless the matrix is smaller.
SIDE = 1024
#: Rows of pixels that a task compresses together.
BAND = 64
#: Colours of the least value, the middle and the greatest; between them they are mixed.
RAMP = ((38, 64, 140), (235, 235, 225), (170, 30, 40))
#: Colour of a pixel without a value.
BLANK = (255, 255, 255)


def pixels(wide: DataFrame, height: int = SIDE, width: int = SIDE) -> DataFrame:
    """(ensemble, py, px, n, value): mean of the n values of each pixel. wide: ensemble, frame, vals.

    Frame number y of an ensemble whose numbers run from 0 to r - 1 falls into pixel row floor(y * h / r), where h is the smaller of
    height and r; features likewise. Null and NaN values don't count; a pixel of none of the others has no row.
    Sums are made before the shuffle, which carries one row a pixel and task.
    """
    shape = wide.groupBy("ensemble").agg((F.max("frame") + 1).alias("_rows"), F.max(F.size("vals")).cast("long").alias("_cols"))
    # one row an ensemble
    cells = wide.join(shape, "ensemble").select("ensemble", "frame", "_rows", "_cols", F.posexplode("vals").alias("_x", "_v"))
    cells = cells.where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    def at(index: str, count: str, limit: int) -> Column:
        return F.expr(f"cast({index} * least({count}, {limit}L) div {count} as int)")

    spots = cells.select("ensemble", at("frame", "_rows", height).alias("py"), at("_x", "_cols", width).alias("px"), "_v")
    return spots.groupBy("ensemble", "py", "px").agg(F.count("*").alias("n"), F.avg("_v").alias("value"))


def spans(wide: DataFrame) -> DataFrame:
    """(ensemble, rows, cols, low, high): frames, features, and the least and greatest value, NaN and null aside."""
    real = F.filter("vals", lambda v: v.isNotNull() & ~F.isnan(v))
    return wide.groupBy("ensemble").agg((F.max("frame") + 1).alias("rows"), F.max(F.size("vals")).alias("cols"), F.min(F.array_min(real)).alias("low"), F.max(F.array_max(real)).alias("high"))


def chunk(kind: bytes, data: bytes) -> bytes:
    """A chunk of a PNG file: length, kind, data, checksum."""
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def colours(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bytes (..., 3) of values between low and high by RAMP; BLANK for NaN. A span of nothing gives the middle."""
    share = np.full(values.shape, 0.5) if high <= low else (values - low) / (high - low)
    share = np.clip(np.nan_to_num(share, nan=0.5), 0.0, 1.0) * (len(RAMP) - 1)
    ramp = np.asarray(RAMP, float)
    base = np.minimum(share.astype(int), len(RAMP) - 2)
    mixed = ramp[base] + (share - base)[..., None] * (ramp[base + 1] - ramp[base])
    return np.where(np.isnan(values)[..., None], np.asarray(BLANK, float), np.rint(mixed)).astype(np.uint8)


def adler_of_both(a: int, b: int, size_b: int) -> int:
    """Adler-32 of two texts one after the other, from that of each and the second one's size."""
    m = 65521
    one, two = a & 0xFFFF, b & 0xFFFF
    low = (one + two - 1) % m
    high = ((a >> 16) + (b >> 16) + size_b * (one - 1)) % m
    return high << 16 | low


def bands(spots: DataFrame, height: int, width: int, low: float, high: float) -> DataFrame:
    """(band, data, adler, size): compressed rows of pixels of one picture, a row per BAND rows, those without pixels included."""
    n = -(-height // BAND)
    spark = spots.sparkSession
    all_bands = spark.range(n).select(F.col("id").cast("int").alias("band"), F.lit(None).cast("int").alias("py"), F.lit(None).cast("int").alias("px"), F.lit(None).cast("double").alias("value"))
    rows = spots.select(F.floor(F.col("py") / BAND).cast("int").alias("band"), "py", "px", F.col("value").cast("double").alias("value")).unionByName(all_bands)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band = key[0].as_py()
        grid = np.full((min(BAND, height - band * BAND), width), np.nan)
        # a pixel has one row, so a table has BAND * width rows at most
        got = table.filter(pa.compute.is_valid(table["py"]))
        grid[got["py"].to_numpy() - band * BAND, got["px"].to_numpy()] = got["value"].to_numpy()
        lines = colours(grid, low, high).reshape(len(grid), width * 3)
        # a byte before each row: no filter
        raw = np.concatenate([np.zeros((len(grid), 1), np.uint8), lines], axis=1).tobytes()
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = squeeze.compress(raw) + squeeze.flush(zlib.Z_FINISH if band == n - 1 else zlib.Z_FULL_FLUSH)
        return pa.table({"band": pa.array([band], pa.int32()), "data": pa.array([chunk(b"IDAT", data)], pa.binary()), "adler": pa.array([zlib.adler32(raw)], pa.int64()), "size": pa.array([len(raw)], pa.int64())})

    return rows.groupBy("band").applyInArrow(run, "band int, data binary, adler long, size long")


def png_rows(spots: DataFrame, height: int, width: int, low: float, high: float, store) -> DataFrame:
    """The bytes of a PNG file of one picture, as rows of one column value in the file's order, one partition a band or so.

    spots: py, px, value. store: a function that stores a DataFrame and reads it back, as bands are read twice.
    """
    made = store(bands(spots, height, width, low, high))
    total = 1
    for r in made.select("band", "adler", "size").orderBy("band").toLocalIterator():
        total = adler_of_both(total, r["adler"], r["size"])
    spark = spots.sparkSession
    head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"\x78\x9c")
    tail = chunk(b"IDAT", struct.pack(">I", total)) + chunk(b"IEND", b"")
    ends = spark.createDataFrame([(-1, bytearray(head)), (-(-height // BAND), bytearray(tail))], "band int, data binary")
    return made.select("band", "data").unionByName(ends).orderBy("band").select(F.col("data").alias("value"))
