import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conforma.plans import pictures
from conforma.sources import onefile, sinks


def frames(spark, rows, parts=5):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(rows)], "ensemble int, frame long, vals array<double>").repartition(parts)


def read_png(path):
    """Pixels of an 8-bit RGB picture without filters; every chunk's checksum and the whole stream's are checked."""
    raw, at, data = open(path, "rb").read(), 8, b""
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    kinds = []
    while at < len(raw):
        (n,) = struct.unpack(">I", raw[at : at + 4])
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
        data += body if kind == b"IDAT" else b""
        kinds.append(kind)
        at += 12 + n
    assert form == [8, 2, 0, 0, 0] and kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + 3 * width)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(height, width, 3)


def test_one_file_equals_the_parts_in_order_and_replaces_a_folder(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("line é "), F.col("id").cast("string")).alias("value")).repartition(7)
    path = str(tmp_path / "x.txt")
    for _ in range(2):
        assert onefile.write_one_file(rows.orderBy("id").select("value"), path) == path
        assert open(path, encoding="utf-8").read() == "".join(f"line é {i}\n" for i in range(1000))
    os.mkdir(tmp_path / "y.txt")
    onefile.write_one_file(spark.createDataFrame([(None,), ("a",)], "value string").coalesce(1), str(tmp_path / "y.txt"))
    assert (tmp_path / "y.txt").read_text() == "\na\n"
    onefile.write_one_file(spark.createDataFrame([], "value string"), str(tmp_path / "empty"))
    assert (tmp_path / "empty").read_bytes() == b""
    onefile.write_one_file(spark.createDataFrame([(bytearray(b"\x00\xff"),), (None,)], "value binary"), str(tmp_path / "b"))
    assert (tmp_path / "b").read_bytes() == b"\x00\xff"
    assert sorted(os.listdir(tmp_path)) == ["b", "empty", "x.txt", "y.txt"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "old").write_text("kept")
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="no"):
        onefile.write_one_file(bad, str(tmp_path / "old"))
    assert os.listdir(tmp_path) == ["old"] and (tmp_path / "old").read_text() == "kept"
    with pytest.raises(Exception, match="one column"):
        onefile.write_one_file(spark.range(3).select("id", "id"), str(tmp_path / "two"))


def test_parts_are_placed_by_the_lengths_before_them(tmp_path):
    folder = tmp_path / "parts"
    writer = onefile.PartsWriter(str(folder))
    writer.commit([onefile.Part(2, "c", 5), None, onefile.Part(0, "a", 3), onefile.Part(1, "b", 0)])
    assert (folder / onefile.PLAN).read_text() == '{"size": 8, "parts": [["a", 0, 3], ["b", 3, 0], ["c", 3, 5]]}'
    writer.abort([])
    assert not folder.exists()


def test_pixels_are_means_of_their_cells(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(53, 17))
    m[4, 5] = np.nan
    m[:20, 16] = np.nan
    got = pictures.pixels(frames(spark, m.tolist()), 10, 6).collect()
    want = {}
    for y in range(53):
        for x in range(17):
            if not np.isnan(m[y, x]):
                want.setdefault((y * 10 // 53, x * 6 // 17), []).append(m[y, x])
    assert {(r["py"], r["px"]): r["n"] for r in got} == {k: len(v) for k, v in want.items()}
    assert all(r["value"] == pytest.approx(np.mean(want[r["py"], r["px"]])) for r in got)


def test_picture_of_a_matrix_is_a_valid_file_of_its_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 9))
    m[150, 3] = np.nan
    path = sinks.write_matrix_png(frames(spark, m.tolist()), 0, str(tmp_path))
    assert os.path.basename(path) == "ensemble_0_matrix.png"
    low, high = np.floor(np.nanmin(m)), np.ceil(np.nanmax(m))
    assert np.array_equal(read_png(path), pictures.colours(m, low, high))
    # averaged to fewer pixels; no values at all; no frames
    small = read_png(sinks.write_matrix_png(frames(spark, m.tolist()), 0, str(tmp_path), side=7))
    assert small.shape == (7, 7, 3)
    nothing = read_png(sinks.write_matrix_png(frames(spark, [[float("nan"), None]]), 0, str(tmp_path)))
    assert (nothing == 255).all() and nothing.shape == (1, 2, 3)
    assert sinks.write_matrix_png(frames(spark, m.tolist()), 3, str(tmp_path)) is None


def test_colours_and_joined_checksums():
    low, middle, high = pictures.colours(np.array([0.0, 5.0, 10.0]), 0, 10).tolist()
    assert [tuple(low), tuple(middle), tuple(high)] == list(pictures.RAMP)
    assert tuple(pictures.colours(np.array([2.0]), 2, 2)[0]) == pictures.RAMP[1]
    a, b = os.urandom(70_001), os.urandom(123_456)
    assert pictures.adler_of_both(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    assert pictures.adler_of_both(1, zlib.adler32(b), len(b)) == zlib.adler32(b)
