"""Distributed projections against plain versions."""

from pathlib import Path

import numpy as np
import pytest

from conforma.operators import atoms as A
from conforma.operators import blocks as B
from conforma.operators import components as C
from conforma.operators import embedding as E
from conforma.operators import reduce as X

WIDE = "ensemble int, frame long, vals array<double>"


def frames(spark, x, labels=None):
    labels = np.zeros(len(x), int) if labels is None else labels
    return spark.createDataFrame([(int(e), i, [float(v) for v in row]) for i, (e, row) in enumerate(zip(labels, x))], WIDE).repartition(3)


def places(df):
    return np.array([(r["c1"], r["c2"]) for r in df.orderBy("ensemble", "frame").collect()])


def test_blocks_hold_all_frames_in_order(spark):
    rng = np.random.default_rng(1)
    x, labels = rng.normal(size=(53, 4)), np.sort(rng.integers(0, 3, 53))
    blocks, n, count = B.ordered_blocks(frames(spark, x, labels), rows=10)
    rows = sorted(blocks.collect(), key=lambda r: r["block"])
    assert n == 53 and count == len(rows) and max(r["n"] for r in rows) <= 10
    assert [f for r in rows for f in r["frames"]] == list(range(53)) and [r["first"] for r in rows] == np.cumsum([0, *[r["n"] for r in rows[:-1]]]).tolist()
    assert np.concatenate([np.frombuffer(r["x"]).reshape(-1, 4) for r in rows]) == pytest.approx(x)


def test_sums_by_driver_and_by_tasks_agree(spark):
    rows = [(k % 3, np.full(4, float(k)).tobytes()) for k in range(60)]
    df = spark.createDataFrame(rows, "key long, x binary").repartition(20)
    for numbers in (1, 1 << 40):
        got = B.summed(df, 20, numbers)
        assert {k: v.tolist() for k, v in got.items()} == {k: [float(sum(range(k, 60, 3)))] * 4 for k in range(3)}


@pytest.mark.parametrize("features", [1, 2, 9, 300])
def test_eigenvectors_equal_the_dense_ones(features):
    rng = np.random.default_rng(features)
    x = rng.normal(size=(120, features)) * np.linspace(2, 1, features)
    values, loads = C.leading(lambda v: x.T @ (x @ v), features, 2)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    k = min(2, features)
    assert values == pytest.approx(s[:k] ** 2) and np.abs(np.diag(v[:k] @ loads)) == pytest.approx(1)


def test_components_of_many_features(spark):
    # more features than any dense covariance could have here
    rng = np.random.default_rng(2)
    x = np.outer(rng.normal(size=12), np.linspace(0, 1, 100_000)) + np.outer(rng.normal(size=12), rng.normal(size=100_000)) * 0.1 + 5
    y = places(C.pca(frames(spark, x)))
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert (y**2).sum(axis=0) == pytest.approx(s[:2] ** 2)


def test_components_of_flat_and_empty_tables(spark):
    assert places(C.pca(frames(spark, np.full((4, 3), 7.0)))) == pytest.approx(0)
    one = places(C.pca(frames(spark, np.arange(5.0)[:, None])))
    assert one[:, 0] == pytest.approx(np.arange(5) - 2.0) and (one[:, 1] == 0).all()
    assert C.pca(frames(spark, np.ones((1, 2))).limit(0)).count() == 0
    with pytest.raises(Exception, match="different numbers"):
        C.pca(spark.createDataFrame([(0, 0, [1.0]), (0, 1, [1.0, 2.0])], WIDE).coalesce(1)).count()


def test_scaling_of_all_frames_is_no_worse_than_on_the_driver(spark):
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(90, 8)), np.sort(rng.integers(0, 3, 90))
    got, stress = E.scale_all(frames(spark, x, labels), rows=20)
    d = np.sqrt(E.squared(x, x))
    y = places(got)
    assert X.stress(d, y) == pytest.approx(stress) and stress < 1.02 * X.stress(d, X.scale_metric(d))


def test_one_round_of_scaling_equals_the_plain_transform(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(35, 5)), rng.normal(size=(35, 2))
    blocks, _, count = B.ordered_blocks(frames(spark, x), rows=9)
    moved, stress = E.guttman(E.distance_blocks(blocks, count), y)
    d, e = np.sqrt(E.squared(x, x)), np.sqrt(E.squared(y, y))
    np.fill_diagonal(d, 0)
    np.fill_diagonal(e, 1)
    b = -d / e
    np.fill_diagonal(b, 0)
    np.fill_diagonal(b, -b.sum(axis=1))
    assert moved == pytest.approx(b @ y / 35) and stress == pytest.approx(X.stress(d, y))


def test_nearest_frames_are_exact_with_ties(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(60, 3)), np.zeros((12, 3))])
    rows = E.nearest_frames(frames(spark, x), 7, rows=11).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    got = {(r["frame_a"], r["rank"]): r["frame_b"] for r in rows}
    assert len(got) == 72 * 7
    for a in range(72):
        want = np.lexsort((np.arange(72), np.round(d[a], 12)))[:7]
        assert [got[a, k + 1] for k in range(7)] == want.tolist()
    assert E.nearest_frames(frames(spark, x[:1]), 3).count() == 0


def test_quadtree_repulsion_is_near_the_exact_sum():
    rng = np.random.default_rng(6)
    y = np.vstack([rng.normal(size=(300, 2)), np.zeros((5, 2)), [[1e3, 1e3]]])
    d = y[:, None] - y[None]
    q = 1 / (1 + (d**2).sum(axis=2))
    np.fill_diagonal(q, 0)
    exact = (q[:, :, None] ** 2 * d).sum(axis=1)
    for angle, off in ((0.0, 1e-8), (0.5, 0.02)):
        force, total = E.QuadTree(y).repulsion(y, angle)
        assert np.abs(force - exact).max() < off * np.abs(exact).max() + 1e-8 and total == pytest.approx(q.sum(), rel=max(off, 1e-6))


def test_slope_equals_the_exact_gradient(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(48, 4)), rng.normal(size=(48, 2))
    blocks, n, count = B.ordered_blocks(frames(spark, x), rows=10)
    graph = E.affinity_graph(E.nearest(blocks, count, n - 1), n, 8.0, rows=7)
    p = np.zeros((n, n))
    for r in graph.collect():
        p[np.frombuffer(r["i"], np.int64), np.frombuffer(r["j"], np.int64)] = np.frombuffer(r["p"])
    assert p.sum() == pytest.approx(1) and p == pytest.approx(p.T)
    d = y[:, None] - y[None]
    q = 1 / (1 + (d**2).sum(axis=2))
    np.fill_diagonal(q, 0)
    exact = 4 * (((p - q / q.sum()) * q)[:, :, None] * d).sum(axis=1)
    assert E._slope(graph, y, 7, 1.0) == pytest.approx(exact, abs=0.02 * np.abs(exact).max())


def test_embedding_of_all_frames_keeps_groups(spark):
    rng = np.random.default_rng(8)
    labels = np.repeat([0, 1, 2], 30)
    x = rng.normal(size=(90, 6)) * 0.3 + np.eye(6)[labels] * 5
    z = places(E.embed_all(frames(spark, x, labels), perplexity=10, rounds=200, rows=32))
    e = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    np.fill_diagonal(e, np.inf)
    assert len(z) == 90 and (labels[e.argmin(axis=1)] == labels).mean() > 0.9
    with pytest.raises(ValueError, match="perplexity"):
        E.embed_all(frames(spark, x[:9]), perplexity=10)


def test_numbered_and_joined_ensembles_take_one_scan(spark):
    rows = [(7, 5, [1.0]), (7, 9, [2.0]), (3, 4, [3.0]), (9, 0, [4.0])]
    df = spark.createDataFrame(rows, WIDE)
    assert sorted((r["ensemble"], r["frame"]) for r in A.number_ensembles(df).collect()) == [(0, 4), (1, 5), (1, 9), (2, 0)]
    assert sorted(map(tuple, A.joined_trajectory(df).collect())) == [(0, 3, 4), (1, 7, 5), (2, 7, 9), (3, 9, 0)]


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm = spark.sparkContext._jvm
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def kept(spark):
    """Bytes of intermediate tables."""
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return sum(p.stat().st_size for p in top.rglob("*.parquet"))


def test_nearest_frames_shuffle_and_store_no_pairs(spark):
    # quadratic shuffles failed on larger tables: here each block went to each other, 30 times the frames' own size
    x = np.random.default_rng(9).normal(size=(400, 16))
    wide = frames(spark, x)
    before = shuffled(spark) + kept(spark)
    assert E.nearest_frames(wide, 3, rows=25).count() == 1200
    assert shuffled(spark) + kept(spark) - before < 6 * x.nbytes


def test_nearest_frames_among_copies_are_ordered_by_number(spark):
    # far from the common centre a product of matrices tells no copies from near rows, and copies not from one another
    rng = np.random.default_rng(10)
    x = np.repeat(rng.normal(size=(9, 5)) + 1e4 * (np.arange(9) % 2)[:, None], 8, axis=0)[rng.permutation(72)]
    got = {(r["frame_a"], r["rank"]): (r["frame_b"], r["d"]) for r in E.nearest_frames(frames(spark, x), 11, rows=7).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for a in range(72):
        want = np.lexsort((np.arange(72), d[a]))[:11]
        assert [got[a, k + 1][0] for k in range(11)] == want.tolist() and [got[a, k + 1][1] for k in range(11)] == pytest.approx(np.sqrt(d[a, want]))


def test_scaling_stores_no_distances(spark):
    x = np.random.default_rng(11).normal(size=(400, 4))
    wide = frames(spark, x)
    before = shuffled(spark) + kept(spark)
    E.scale_all(wide, rows=25, rounds=3)
    # the matrix of distances is 50 times the frames' own size
    assert shuffled(spark) + kept(spark) - before < 25 * x.nbytes


def test_rounds_of_scaling_by_half_of_the_pairs_and_in_single_precision_agree(spark):
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(83, 5)), rng.normal(size=(83, 2))
    blocks, _, count = B.ordered_blocks(frames(spark, x), rows=9)
    met = E.distance_blocks(blocks, count)
    assert len(met.groups) > 2
    moved, stress = E.guttman(met, y, half=False)
    for kind, off in ((np.float64, 1e-9), (np.float32, 1e-4)):
        for half in (True, False):
            other, lost = E.guttman(met, y, kind, half)
            assert other == pytest.approx(moved, abs=off) and lost == pytest.approx(stress, rel=off)
    for groups in range(1, 8):
        pairs = [frozenset((g, h)) for g in range(groups) for h in E._met_groups(g, groups, True)]
        assert len(pairs) == len(set(pairs)) == groups * (groups + 1) // 2


def test_affinities_are_dealt_once(spark):
    x = np.random.default_rng(13).normal(size=(400, 4))
    blocks, n, count = B.ordered_blocks(frames(spark, x), rows=25)
    near = E.nearest(blocks, count, 60)
    before = shuffled(spark)
    E.affinity_graph(near, n, 20.0, rows=25)
    # 48,000 edges of three numbers and a block's, each dealt to its block; they were dealt for their sums before that
    assert shuffled(spark) - before < 48_000 * 20


@pytest.mark.parametrize("n, width", [(48, 1.0), (1500, 1e-4), (1500, 10.0), (1500, 50.0)])
def test_repulsion_from_the_grid_is_near_the_exact_sum(n, width):
    rng = np.random.default_rng(14)
    y = np.vstack([rng.normal(size=(n, 2)) * width, np.zeros((5, 2))])
    d = y[:, None] - y[None]
    q = 1 / (1 + (d**2).sum(axis=2))
    np.fill_diagonal(q, 0)
    exact = (q[:, :, None] ** 2 * d).sum(axis=1)
    field = E.Field(y)
    force, _ = field.repulsion(y)
    assert np.abs(force - exact).max() < 0.02 * np.abs(exact).max() and field.total == pytest.approx(q.sum(), rel=5e-3)
    # far apart, where a grid would have too many nodes, the quadtree does it
    assert isinstance(E.repelling(y), E.Field) and isinstance(E.repelling(np.vstack([y, [[1e4, 0]]])), E.QuadTree)


def test_rounds_of_embedding_take_no_walk_of_the_tree(spark, monkeypatch):
    # each round walked the quadtree from each place, which took most of the time of larger tables
    monkeypatch.setattr(E.QuadTree, "__init__", lambda self, y: pytest.fail("a quadtree"))
    x = np.random.default_rng(15).normal(size=(60, 4))
    assert E.embed_all(frames(spark, x), perplexity=8, rounds=12, rows=16).count() == 60


def test_edges_come_in_packets_and_are_stored_without_their_frames(spark, monkeypatch):
    x = np.random.default_rng(16).normal(size=(400, 4))
    blocks, n, count = B.ordered_blocks(frames(spark, x), rows=25)
    near = E.nearest(blocks, count, 60)
    want = {(i, j): p for r in E.affinity_graph(near, n, 20.0, rows=25).collect() for i, j, p in zip(*(np.frombuffer(r[c], t) for c, t in (("i", np.int64), ("j", np.int64), ("p", float))))}
    for name, value in (("SPAN", 64), ("PACKETS", 5000), ("EDGES", 300)):
        monkeypatch.setattr(E, name, value)
    graph = E.affinity_graph(near, n, 20.0, rows=100)
    rows = graph.collect()
    got = {(i, j): p for r in rows for i, j, p in zip(*(np.frombuffer(r[c], t) for c, t in (("i", np.int64), ("j", np.int64), ("p", float))))}
    assert got.keys() == want.keys() and list(got.values()) == pytest.approx([want[k] for k in got])
    assert sorted(r["block"] for r in rows if r["head"]) == [0, 1, 2, 3] and max(len(r["p"]) for r in rows) <= 8 * 300
    y = np.random.default_rng(17).normal(size=(n, 2))
    assert E._slope(graph, y, 100, 2.0) == pytest.approx(E._slope(E.affinity_graph(near, n, 20.0, rows=25), y, 25, 2.0), abs=1e-8)


def test_nearest_frames_do_not_depend_on_chunks(spark, monkeypatch):
    # small whole numbers: most distances tie, some with the last kept one
    x = np.random.default_rng(18).integers(0, 3, size=(150, 4)).astype(float)
    monkeypatch.setattr(E, "CHUNK", 8)
    search = E._Nearest(x[60:90], 60, 9)
    for a in (60, 80, 120, 0, 10):
        b = {60: 80, 80: 120, 120: 150, 0: 10, 10: 60}[a]
        search.meet(a, np.arange(a, b) * 10, x[a:b])
    ids, d2, names = search.result()
    d = ((x[60:90, None] - x[None]) ** 2).sum(axis=2)
    d[np.arange(30), 60 + np.arange(30)] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :9]
    assert (ids == want).all() and (names == 10 * want).all() and (d2 == np.take_along_axis(d, want, 1)).all()


def test_a_round_by_some_frames_equals_the_plain_one_by_them(spark):
    rng = np.random.default_rng(19)
    x, y, some = rng.normal(size=(83, 5)), rng.normal(size=(83, 2)), rng.random(83) < 0.4
    blocks, n, count = B.ordered_blocks(frames(spark, x), rows=9)
    met = E.distance_blocks(blocks, count)
    moved, stress = E.guttman(met, y, some=some)
    d, e = (np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))[:, some] for a in (x, y))
    ratio = np.divide(d, e, out=np.ones_like(d), where=e > 0)
    assert moved == pytest.approx((y[some] + ratio[:, :, None] * (y[:, None] - y[some])).mean(axis=1))
    assert stress == pytest.approx(((d - e) ** 2).sum() / 2 * 83 / some.sum())
    # all frames as some make a plain round
    moved, stress = E.guttman(met, y - y.mean(axis=0), some=np.ones(83, bool))
    want, lost = E.guttman(met, y - y.mean(axis=0))
    assert moved == pytest.approx(want) and stress == pytest.approx(lost)


def test_scaling_ends_by_all_pairs_and_spends_no_round_on_an_unread_stress(spark, monkeypatch):
    # a last round in double precision, twice as long as others, gave a stress that mds dropped
    rng = np.random.default_rng(20)
    x = rng.normal(size=(800, 6)) * [5, 4, 1, 1, 1, 1]
    wide, met, plain = frames(spark, x), [], E.guttman

    def counted(distances, y, kind=np.float64, half=None, some=None):
        met.append((kind, 1.0 if some is None else some.mean()))
        return plain(distances, y, kind, half, some)

    monkeypatch.setattr(E, "guttman", counted)
    d = np.sqrt(E.squared(x, x))
    whole = X.stress(d, places(X.mds(wide)))
    assert all(kind is np.float32 and part == 1 for kind, part in met)
    met.clear()
    # rounds by some frames only give places to start from
    monkeypatch.setattr(E, "FEW", 50)
    part = X.stress(d, places(X.mds(wide)))
    assert met[0][1] < 0.1 and [p for _, p in met[-2:]] == [1, 1] and part < 1.002 * whole
