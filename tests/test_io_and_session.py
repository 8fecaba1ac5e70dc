import json
import os

import numpy as np
import pytest

from conforma import cli
from conforma.operators import reduce as X
from conforma.plans import figures as P
from conforma.session import EnsembleSession
from conforma.sources import dcd, sinks, topology, trajectory

ATOM = "{:<6}{:>5} {:<4}{:1}{:>3} {:1}{:>4}{:1}   {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}          {:>2}\n"


def write_pdb(path, residues=8, models=1, seed=0):
    rng = np.random.default_rng(seed)
    with open(path, "w") as f:
        f.write("HEADER    TEST\n")
        for m in range(models):
            if models > 1:
                f.write(f"MODEL {m + 1:>8}\n")
            k = 1
            for r in range(residues):
                for name in (" CA", " CB"):
                    f.write(ATOM.format("ATOM", k, name, "", "ALA", "A", r + 1, "", *rng.normal(0, 5, 3), 1, 0, "C"))
                    k += 1
            if models > 1:
                f.write("ENDMDL\n")
        f.write("END\n")


@pytest.fixture()
def folder(tmp_path):
    write_pdb(tmp_path / "top.pdb")
    for k in range(3):
        xyz = np.cumsum(np.random.default_rng(k).normal(0, 0.12 + 0.02 * k, (35, 16, 3)), axis=1)
        dcd.write_dcd(str(tmp_path / f"e{k}.dcd"), xyz)
    return tmp_path


def test_topology(spark, folder):
    rows = topology.read_topology(spark, str(folder / "top.pdb")).orderBy("atom").collect()
    assert len(rows) == 16 and [r["res_index"] for r in rows] == [i // 2 for i in range(16)]
    assert rows[1]["name"] == "CB" and rows[0]["element"] == "C" and rows[0]["chain"] == "A"


def test_pdb_models_are_frames(spark, tmp_path):
    write_pdb(tmp_path / "m.pdb", models=3)
    rows = topology.read_pdb_frames(spark, str(tmp_path / "m.pdb")).orderBy("frame").collect()
    assert [r["frame"] for r in rows] == [0, 1, 2] and len(rows[0]["xyz"]) == 48
    assert topology.read_topology(spark, str(tmp_path / "m.pdb")).count() == 16


def test_dcd_round_trip_with_and_without_box(spark, tmp_path):
    xyz = np.random.default_rng(1).normal(size=(23, 5, 3))
    for cell in (None, np.tile([3.0, 4.0, 5.0], (23, 1))):
        path = str(tmp_path / f"x{cell is None}.dcd")
        dcd.write_dcd(path, xyz, cell)
        spark.dataSource.register(dcd.DcdSource)
        df = spark.read.format("dcd").option("ensemble", 4).option("framesPerPartition", 7).load(path)
        assert df.rdd.getNumPartitions() == 4
        rows = df.orderBy("frame").collect()
        assert [r["frame"] for r in rows] == list(range(23)) and {r["ensemble"] for r in rows} == {4}
        assert np.allclose([r["xyz"] for r in rows], xyz.reshape(23, 15), atol=1e-6)
        assert (rows[0]["cell"] is None) if cell is None else rows[0]["cell"] == pytest.approx([3, 4, 5])
    (tmp_path / "bad.dcd").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        dcd.read_header(str(tmp_path / "bad.dcd"))


def test_dcd_reads_chosen_frames_and_atoms_alone(spark, tmp_path, monkeypatch):
    from conforma.sources.trajectory import load_ensembles, load_trajectory

    xyz = np.random.default_rng(2).normal(size=(50, 400, 3))
    path, other = str(tmp_path / "a.dcd"), str(tmp_path / "b.dcd")
    dcd.write_dcd(path, xyz, np.tile([3.0, 4.0, 5.0, 70.0, 80.0, 100.0], (50, 1)))
    dcd.write_dcd(other, xyz[:9])
    df = load_trajectory(spark, path, 3)
    some = df.where("frame >= 10 AND frame < 13 AND ensemble = 3")
    # the reader took the filter: Spark's plan has none of its own
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString() and [r["frame"] for r in some.orderBy("frame").collect()] == [10, 11, 12]
    assert sorted(r["frame"] for r in df.where("frame IN (4, 5, 48, 99)").collect()) == [4, 5, 48]
    assert df.where("ensemble = 4").count() == 0 and df.where("frame % 10 = 0 AND frame > 30").count() == 1
    assert {r["ensemble"] for r in load_ensembles(spark, [path, other]).where("ensemble = 1").collect()} == {1}
    assert df.first()["cell"] == pytest.approx([3, 4, 5, 70, 80, 100])
    got = load_trajectory(spark, path, 0, [250, 3, 4]).orderBy("frame").collect()
    assert np.allclose([r["xyz"] for r in got], xyz[:, [250, 3, 4]].reshape(50, 9), atol=1e-6)
    # what the reader fetches: three frames of two atoms
    read, plain = [], dcd._read
    monkeypatch.setattr(dcd, "_read", lambda f, at, size: read.append(size) or plain(f, at, size))
    reader = dcd.FilteringDcdReader({"path": path, "atoms": "3,250"})
    left = list(reader.pushFilters([dcd.GreaterThan(("frame",), 6), dcd.LessThanOrEqual(("frame",), 9), dcd.EqualTo(("ensemble",), 0), dcd.EqualTo(("xyz",), 1)]))
    assert [f.attribute for f in left] == [("xyz",)]
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in rows) == 3 and sum(read) == 3 * (56 + 3 * 2 * 4)
    with pytest.raises(ValueError, match="atoms"):
        dcd.read_frames(path, dcd.read_header(path), 0, 1, [400])


def test_pdb_cells(spark, tmp_path):
    from conforma.sources.topology import read_pdb_frames

    atom = "ATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00  0.00           C"
    for head, cell in (("CRYST1   30.000   40.000   50.000  90.00  90.00  90.00 P 1", [3, 4, 5]), ("CRYST1   30.000   40.000   50.000  70.00  80.00 100.00 P 1", [3, 4, 5, 70, 80, 100]), ("CRYST1    1.000    1.000    1.000  90.00  90.00  90.00 P 1", None), ("REMARK", None)):
        path = tmp_path / "x.pdb"
        path.write_text(f"{head}\n{atom}\nEND\n")
        got = read_pdb_frames(spark, str(path)).first()["cell"]
        assert got is None if cell is None else got == pytest.approx(cell)


def test_paths_and_joined_trajectories(spark, folder):
    assert trajectory.resolve_paths(" a.dcd, b.dcd ") == ["a.dcd", "b.dcd"]
    assert trajectory.resolve_paths(str(folder / "e*.dcd")) == [str(folder / f"e{k}.dcd") for k in range(3)]
    assert trajectory.resolve_paths("none*.dcd") == ["none*.dcd"]
    for bad in (3, None):
        with pytest.raises(ValueError):
            trajectory.resolve_paths(bad)
    with pytest.raises(ValueError):
        trajectory.load_trajectory(spark, "x.xtc")
    joined = trajectory.load_trajectories(spark, str(folder / "e*.dcd"))
    assert sorted(r["frame"] for r in joined.select("frame").collect()) == list(range(105))


def test_session_from_files_to_results(spark, folder):
    s = EnsembleSession(spark, [str(folder / f"e{k}.dcd") for k in range(3)], str(folder / "top.pdb"), str(folder / "out"))
    got = s.compare("CBCN, caba", ref=0, s_num=2, sample_size=30, dimred="pca", x_num=50)
    assert set(got) == {"cbcn", "caba"} and s.comparison("Caba").count() == 2
    lines = sorted(os.listdir(folder / "out" / "caba_output" / "ensemble_1_matrix.csv"))
    text = "".join((folder / "out" / "caba_output" / "ensemble_1_matrix.csv" / p).read_text() for p in lines if p.startswith("part-"))
    want = [r["vals"] for r in s.representation("caba").where("ensemble = 1").orderBy("frame").collect()]
    assert text == "".join(",".join(f"{v:.18e}" for v in row) + "\n" for row in want)
    figures = s.figures("cbcn")
    assert set(figures) == {"heatmap", "heatmap_ticks", "global_bar", "global_line", "local", "scatter_pca"}
    assert {r["colour"] for r in s.replot_local("caba", 1, color="red").collect()} == {"red"}
    assert {r["title"] for r in s.replot_global("caba", title="T").collect()} == {"T"}
    with pytest.raises(ValueError):
        s.replot_local("caba", 0)
    with pytest.raises(ValueError):
        s.replot_global("sasa")
    out = json.loads(sinks.results_json(got))
    assert [r["ensemble_index"] for r in out["cbcn"]] == [1, 2] and len(out["caba"][0]["local_dissimilarity"]) == 6
    s.close()


def test_command_line(folder, capsys, spark, monkeypatch):
    monkeypatch.chdir(folder)
    assert cli.main(["-traj", ",".join(str(folder / f"e{k}.dcd") for k in (0, 1)), "-top", str(folder / "top.pdb"), "-m", "cata", "-d", "none", "--s-num", "2", "--sample-size", "20"]) == 0
    assert [r["ensemble_index"] for r in json.loads(capsys.readouterr().out)["cata"]] == [1]
    # without an output folder results are written here, each matrix as one file
    lines = (folder / "cata_output" / "ensemble_1_matrix.csv").read_text().splitlines()
    assert len(lines) == 35 and all(len(x.split(",")) == 5 for x in lines)
    assert (folder / "cata_output" / "ensemble_0_matrix.png").read_bytes()[:4] == b"\x89PNG"


def test_heatmap_cells(spark):
    df = wide(spark, [[1.5, 2.5], [-0.5, 3.0]], [0, 0])
    got = [tuple(r) for r in P.heatmap_cells(df).orderBy("y", "x").collect()]
    assert got == [(0, 0, 0, 1.5, -1, 3), (0, 0, 1, 2.5, -1, 3), (0, 1, 0, -0.5, -1, 3), (0, 1, 1, 3.0, -1, 3)]


def test_distances_of_query_frames(spark):
    x = np.random.default_rng(2).normal(size=(23, 4))
    df = wide(spark, x, [0] * 23)
    want = {(a, b): float(np.sqrt(((x[a] - x[b]) ** 2).sum())) for a in (0, 5, 10) for b in range(23) if a != b}
    for most in (X.MOST_QUERIES, 2):
        X.MOST_QUERIES, before = most, X.MOST_QUERIES
        got = {(r["frame_a"], r["frame_b"]): r["d"] for r in X.distances_from(df.where("frame in (0, 5, 10)"), df, block=2).collect()}
        X.MOST_QUERIES = before
        assert got == pytest.approx(want)
    assert X.distances_from(df.limit(0), df).count() == 0


def wide(spark, x, labels):
    return spark.createDataFrame([(int(e), i, [float(v) for v in row]) for i, (e, row) in enumerate(zip(labels, x))], "ensemble int, frame long, vals array<double>")


def test_projections(spark):
    rng = np.random.default_rng(5)
    labels = np.repeat([0, 1, 2], 30)
    x = rng.normal(size=(90, 6)) * 0.3 + np.eye(6)[labels] * 5
    df = wide(spark, x, labels)
    y = np.array([(r["c1"], r["c2"]) for r in X.pca(df).orderBy("frame").collect()])
    c = x - x.mean(axis=0)
    s = np.linalg.svd(c, compute_uv=False)
    assert (y**2).sum() == pytest.approx((s[:2] ** 2).sum())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for technique in ("mds", "tsne"):
        z = np.array([(r["c1"], r["c2"]) for r in X.reduce(df, technique).orderBy("frame").collect()])
        if technique == "mds":
            assert X.stress(d, z) < 0.2 * (d**2).sum() / 2
        e = ((z[:, None] - z[None]) ** 2).sum(axis=2)
        np.fill_diagonal(e, np.inf)
        assert (labels[e.argmin(axis=1)] == labels).mean() > 0.9
    few = X.mds(df, landmarks=40)
    assert few.count() == 90
    with pytest.raises(ValueError):
        X.neighbour_embedding(x[:20])
    with pytest.raises(ValueError):
        X.reduce(df, "umap")
    assert X.points_of(few, 1).count() == 30


def test_ticks_steps_and_colours(spark):
    for top, step, last in ((7.0, 1, 7), (23.0, 5, 25), (120.0, 10, 120)):
        ticks = [r["tick"] for r in P.heatmap_ticks(wide(spark, [[0.0, top]], [0])).orderBy("tick").collect()]
        assert ticks[1] - ticks[0] == step and ticks[-1] == last
    records = spark.createDataFrame([(i, 0.1, [0.1] * 21, 0.0) for i in (1, 13)], "ensemble_index int, global_dissimilarity double, local_dissimilarity array<double>, p_value double")
    bars = {r["ensemble_index"]: r["colour"] for r in P.global_bars(records).collect()}
    assert bars[1] == "orange" and bars[13].startswith("#") and len(bars[13]) == 7
    assert {r["step"] for r in P.local_lines(records).collect()} == {5}
    assert P.local_lines(records.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.replot_global(records, "pie")


def test_stream_and_batch_moments_agree(spark, tmp_path):
    from datetime import datetime

    from conforma.streaming.moments import windowed_moments

    rows = [(datetime(2024, 1, 1, h, m), "a" if m % 2 else "b", float(h * m)) for h in range(5) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts timestamp, ensemble string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_moments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["window_start"], r["ensemble"]): (r["n"], r["mean"]) for r in windowed_moments(df).collect()}
    assert {(r["window_start"], r["ensemble"]): (r["n"], r["mean"]) for r in spark.sql("select * from moments").collect()} == want
