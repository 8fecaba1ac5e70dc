import math

import numpy as np
import pytest

from conforma import model
from conforma.operators import atoms as A
from conforma.operators import measures as M


def topology(spark, names, residues=None):
    rows = [(i, n, "C", (residues or list(range(len(names))))[i], "ALA", "A") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "atom int, name string, element string, res_index int, res_name string, chain string")


def frames(spark, xyz, cell=None):
    rows = [(0, k, [float(c) for p in f for c in p], cell) for k, f in enumerate(xyz)]
    return spark.createDataFrame(rows, "ensemble int, frame long, xyz array<double>, cell array<double>")


def values(spark, xyz, names, measure, residues=None, cell=None, variant="v2"):
    return [r["vals"] for r in M.represent(frames(spark, xyz, cell), topology(spark, names, residues), measure, variant).orderBy("frame").collect()]


def test_contact_at_the_midpoint_and_too_close_in_sequence(spark):
    two = [[(0, 0, 0), (1, 0, 0)]]
    assert values(spark, two, ["CB", "CB"], "cbcn", [0, 3]) == [[0.5, 0.5]]
    assert values(spark, two, ["CB", "CB"], "cbcn", [0, 2]) == [[0.0, 0.0]]
    assert values(spark, [[(0, 0, 0), (1000, 0, 0)]], ["CA", "CA"], "cacn", [0, 3])[0][0] < 1e-300


def test_contacts_count_only_named_atoms(spark):
    assert values(spark, [[(0, 0, 0), (0.1, 0, 0), (0.2, 0, 0)]], ["CA", "CB", "CB"], "cbcn", [0, 4, 8]) == [[pytest.approx(1.0), pytest.approx(1.0)]]


def test_angles_and_torsions(spark):
    assert values(spark, [[(1, 0, 0), (0, 0, 0), (0, 1, 0)]], ["CA"] * 3, "caba") == [[pytest.approx(math.pi / 2)]]
    cis = [(0, 1, 0), (0, 0, 0), (1, 0, 0), (1, 1, 0)]
    trans = [(0, 1, 0), (0, 0, 0), (1, 0, 0), (1, -1, 0)]
    got = values(spark, [cis, trans], ["CA"] * 4, "cata")
    assert got[0] == [pytest.approx(0)] and abs(got[1][0]) == pytest.approx(math.pi)
    skew = [(0, 1, 0), (0, 0, 0), (1, 0, 0), (1, 0.5, 0.7)]
    mirror = [(x, y, -z) for x, y, z in skew]
    a, b = values(spark, [skew, mirror], ["CA"] * 4, "cata")
    assert a[0] == pytest.approx(-b[0]) and a[0] != 0


def test_short_chains_give_no_features_and_v1_drops_an_angle(spark):
    assert values(spark, [[(0, 0, 0), (1, 0, 0)]], ["CA"] * 2, "caba") == [[]]
    assert values(spark, [[(0, 0, 0)] * 3], ["CA"] * 3, "cata") == [[]]
    line = [[(i, i % 2, 0) for i in range(6)]]
    assert len(values(spark, line, ["CA"] * 6, "caba")[0]) == 4
    assert len(values(spark, line, ["CA"] * 6, "caba", variant="v1")[0]) == 3


def test_surface_of_a_lone_atom_and_of_a_buried_one(spark):
    area = 4 * math.pi * (0.17 + 0.14) ** 2
    assert values(spark, [[(0, 0, 0)]], ["CA"], "sasa") == [[pytest.approx(area)]]
    assert values(spark, [[(0, 0, 0), (9, 0, 0)]], ["CA", "CB"], "sasa", [0, 0]) == [[pytest.approx(2 * area)]]
    near = values(spark, [[(0, 0, 0), (0.1, 0, 0)]], ["CA", "CB"], "sasa", [0, 1])[0]
    assert 0 < near[0] < area


def test_nearest_image_in_a_box(spark):
    two = [[(0.1, 0, 0), (2.9, 0, 0)]]
    plain = values(spark, two, ["CA"] * 2, "cacn", [0, 5])[0][0]
    boxed = values(spark, two, ["CA"] * 2, "cacn", [0, 5], cell=[3.0, 3.0, 3.0])[0][0]
    assert plain < 1e-20 and boxed > 0.999


def test_rotation_and_translation_leave_measures_unchanged(spark):
    rng = np.random.default_rng(0)
    xyz = rng.normal(size=(1, 8, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    for measure in ("cacn", "caba", "cata"):
        a = values(spark, xyz, ["CA"] * 8, measure)[0]
        b = values(spark, xyz @ q + 5, ["CA"] * 8, measure)[0]
        assert a == pytest.approx(b, abs=1e-9)


def test_selection_and_pairs(spark):
    chosen = A.select_atoms(topology(spark, ["CA", "CB", "CA", "CA", "CA"]), "CA")
    assert [(r["pos"], r["atom"]) for r in chosen.orderBy("pos").collect()] == [(0, 0), (1, 2), (2, 3), (3, 4)]
    pairs = A.pair_table(chosen)
    assert sorted((r["i"], r["j"]) for r in pairs.collect()) == [(0, 2), (0, 3)]
    assert sorted((r["pos"], r["partner"]) for r in A.incident_pairs(pairs).collect()) == [(0, 2), (0, 3), (2, 0), (3, 0)]


def test_concat_and_stack(spark):
    one, two = frames(spark, [[(0, 0, 0)]] * 2), frames(spark, [[(1, 0, 0)]] * 3)
    got = A.concat_trajectories([one, two]).orderBy("frame").collect()
    assert [r["frame"] for r in got] == [0, 1, 2, 3, 4] and got[2]["xyz"] == [1.0, 0.0, 0.0]
    assert sorted(r["ensemble"] for r in A.stack_ensembles([one, two]).collect()) == [0, 0, 1, 1, 1]
    with pytest.raises(ValueError):
        A.concat_trajectories([])


def test_names(spark):
    assert model.normalise_measures(" CBCN, sasa") == ["cbcn", "sasa"]
    assert model.normalise_techniques("none") == [] and model.normalise_techniques(["PCA ", "tsne"]) == ["pca", "tsne"]
    for bad in ("caca", ""):
        with pytest.raises(ValueError):
            model.normalise_measure(bad)
    with pytest.raises(ValueError):
        model.normalise_techniques("umap")


def test_wide_and_long_are_inverse(spark):
    wide = spark.createDataFrame([(0, 1, [1.0, 2.0]), (0, 2, [3.0, 4.0])], "ensemble int, frame long, vals array<double>")
    assert sorted(map(tuple, model.to_wide(model.to_long(wide)).collect()), key=str) == sorted(map(tuple, wide.collect()), key=str)


def plain_areas(xyz, radii, residues):
    """Areas from the definition: every sphere point against every other atom."""
    sphere, reach = M.sphere_points(), radii + M.PROBE
    out = np.zeros((len(xyz), residues.max() + 1))
    for f, p in enumerate(xyz):
        for i in range(len(p)):
            on = p[i] + reach[i] * sphere
            shut = np.zeros(len(sphere), dtype=bool)
            for j in range(len(p)):
                if j != i:
                    shut |= ((on - p[j]) ** 2).sum(axis=1) < reach[j] ** 2
            out[f, residues[i]] += 4 * np.pi * reach[i] ** 2 * (1 - shut.mean())
    return out


@pytest.mark.parametrize(("atoms", "box"), [(1, 1.0), (40, 0.4), (60, 1.5), (60, 500.0)])
def test_surfaces_by_cells_equal_all_pairs(atoms, box):
    rng = np.random.default_rng(atoms)
    xyz, radii = rng.normal(size=(3, atoms, 3)) * box, rng.choice([0.12, 0.155, 0.18], atoms)
    residues = np.sort(rng.integers(0, 5, atoms))
    assert M.surface_areas(xyz, radii, residues) == pytest.approx(plain_areas(xyz, radii, residues), abs=0.002)


def test_near_atoms_equal_all_pairs_and_grow_with_atoms():
    rng = np.random.default_rng(3)
    xyz, reach = rng.random((2, 500, 3)) * 3 - 1, rng.random(500) * 0.2
    f, i, j = M.near_atoms(xyz, reach)
    d = np.sqrt(((xyz[:, :, None] - xyz[:, None]) ** 2).sum(axis=3))
    want = np.argwhere((d < reach[:, None] + reach[None, :]) & ~np.eye(500, dtype=bool))
    assert np.stack([f, i, j], axis=1).tolist() == want.tolist() and len(want) > 500
    # a frame of 5000 atoms at the same density has ten times the pairs, found without 25 million distances
    big = rng.random((1, 5000, 3)) * 3 * 10 ** (1 / 3)
    assert len(M.near_atoms(big, np.full(5000, 0.1))[0]) < 100 * 5000
    nowhere = np.full((1, 4, 3), np.nan)
    assert len(M.near_atoms(nowhere, np.full(4, 0.1))[0]) == 0 and len(M.near_atoms(xyz[:0], reach)[0]) == 0


def test_neighbour_counts(spark):
    df = spark.createDataFrame([(0, 1, [0.0] * 3 + [0.5, 0.0, 0.0] + [9.0] * 3), (0, 2, [0.0] * 9)], "ensemble int, frame long, xyz array<double>")
    got = sorted(map(tuple, M.neighbours(df, 0.8).collect()))
    assert got == [(0, 1, 0, 1, 0.5), (0, 1, 1, 1, 0.5), (0, 1, 2, 0, None)] + [(0, 2, a, 2, 0.0) for a in range(3)]


@pytest.mark.parametrize("angles", [(60, 60, 90), (70, 100, 120), (33, 44, 55), (90, 90, 35), (109.471, 109.471, 109.471)])
def test_nearest_images_in_skewed_cells_equal_a_wide_search(angles):
    from conforma.operators import cells

    rng = np.random.default_rng(int(sum(angles)))
    box = np.array([[2.0, 3.1, 2.6, *angles], [5.0, 1.0, 1.2, *angles]])
    d = rng.normal(size=(2, 40, 3)) * 6
    got = cells.nearest_image(d, box)
    h = cells.lattice(box)
    n = np.array(list(np.ndindex(31, 31, 31))) - 15
    for f in range(2):
        red = cells.reduced(h[f : f + 1])[0]
        assert abs(abs(np.linalg.det(red)) - abs(np.linalg.det(h[f]))) < 1e-9
        near = d[f] - np.rint(d[f] @ np.linalg.inv(h[f])) @ h[f]
        images = near[:, None] + (n @ h[f])[None]
        assert np.sqrt((got[f] ** 2).sum(axis=1)) == pytest.approx(np.sqrt((images**2).sum(axis=2)).min(axis=1))
        k = (got[f] - d[f]) @ np.linalg.inv(h[f])
        assert k == pytest.approx(np.rint(k), abs=1e-6)


def test_measures_in_skewed_cells(spark):
    from conforma.operators import cells

    box = [3.0, 3.0, 3.0, 60.0, 60.0, 90.0]
    h = cells.lattice(np.array([box]))[0]
    two = [[(0.1, 0, 0), tuple(np.array([0.3, 0, 0]) + h[2] - h[0])]]
    assert values(spark, two, ["CA"] * 2, "cacn", [0, 5], cell=box)[0][0] > 0.999
    assert values(spark, two, ["CA"] * 2, "cacn", [0, 5])[0][0] < 0.01
    # torsions and angles of a chain that crosses the cell's faces
    chain = np.cumsum(np.random.default_rng(2).normal(size=(6, 3)) * 0.3, axis=0)
    moved = chain + np.array([[0, 0, 0], [1, 0, 0], [1, -1, 0], [0, 0, 2], [0, 1, 1], [0, 0, 0]]) @ h
    for measure in ("caba", "cata"):
        a, b = (values(spark, [x.tolist()], ["CA"] * 6, measure, cell=box)[0] for x in (chain, moved))
        assert a == pytest.approx(b)
    with pytest.raises(Exception, match="three lengths"):
        values(spark, two, ["CA"] * 2, "cacn", [0, 5], cell=[1.0, 2.0])
    with pytest.raises(Exception, match="orthorhombic"):
        A.pair_distances(frames(spark, two, box), A.pair_table(A.select_atoms(topology(spark, ["CA"] * 2, [0, 5]), "CA"))).collect()
