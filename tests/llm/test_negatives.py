"""Hard negatives: Strassen's products, heaps, and rows against brute force."""

import math

import numpy as np
import pytest
from conforma.llm import hard_negatives as hn
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<float>, score int, rank string"


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 65, 70), (128, 64, 128), (0, 3, 5), (5, 0, 7), (97, 131, 66)])
def test_strassen_is_exact_with_odd_sizes(shape):
    m, k, n = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-900, 900, (m, k)), rng.integers(-900, 900, (k, n))
    assert (hn.strassen(a, b) == a @ b).all()


def test_strassen_beyond_the_doubles():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(1 << 28), 1 << 28, (70, 80)), rng.integers(-(1 << 28), 1 << 28, (80, 90))
    assert (hn.strassen(a, b).astype(object) == a.astype(object) @ b.astype(object)).all()


def test_heaps_of_tiles_equal_one_sort(monkeypatch):
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 6, (7, 300)), np.sort(rng.choice(10_000, 300, replace=False))
    wanted = rng.random((7, 300)) < 0.7
    wanted[3] = False
    heaps = hn.Heaps(7, 4)
    for k in range(0, 300, 37):
        heaps.push(slice(0, 7), scores[:, k : k + 37], wanted[:, k : k + 37], ids[k : k + 37])
    owner, score, found = heaps.rows()
    want = [(r, -s, i) for r in range(7) for s, i in sorted((-s, i) for s, i, w in zip(scores[r], ids, wanted[r]) if w)[:4]]
    assert sorted(zip(owner.tolist(), score.tolist(), found.tolist()), key=lambda x: (x[0], -x[1], x[2])) == [tuple(map(int, x)) for x in want]


def plain(rows, anchors):
    def usable(r):
        return None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[2])

    def vector(r):
        return [math.floor(256 * float(x)) for x in r[2]]

    rows = [(r[0], r[1], vector(r)) for r in rows if usable(r)]
    out = []
    for a in {(r[0], r[1], tuple(vector(r))) for r in anchors if usable(r)}:
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        others = sorted(((-score(r), r[0], r[1]) for r in rows if r[0] != a[0]), key=lambda x: x[:2])
        for p, pid, _ in [o for o in others if o[2] == a[1]][:5]:
            near = [o for o in others if o[2] != a[1] and 50 * -p <= 100 * -o[0] <= 95 * -p][:3]
            out += [(a[0], pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(near)]
    return sorted(out)


def vectors(n, seed, labels=4, width=6):
    rng = np.random.default_rng(seed)
    f32 = lambda x: [float(v) for v in x.astype(np.float32)]
    rows = [(k, int(rng.integers(labels)), f32(rng.normal(0.3, 0.5, width)), 1, "x") for k in range(n)]
    # ties: many equal vectors, other lengths, rows that take no part
    rows += [(1000 + k, k % 3, [0.5] * width, 1, "x") for k in range(60)]
    rows += [(2000, 1, [0.25, 0.5], 1, "x"), (2050, 1, [], 1, "x"), (2100, 2, None, 1, "x"), (2150, None, [1.0] * width, 1, "x"), (None, 1, [1.0] * width, 1, "x")]
    return rows + [(2200, 0, [float("nan")] * width, 1, "x"), (2250, 0, [float("inf")] + [0.0] * (width - 1), 1, "x"), (2300, 0, [None] + [0.0] * (width - 1), 1, "x"), (2350, 3, [-1.0] * width, 1, "x")]


@pytest.mark.parametrize(("values", "tile"), [(1 << 22, (1024, 4096)), (40, (3, 50))])
def test_rows_equal_brute_force_in_rounds_and_tiles(spark, values, tile, monkeypatch):
    monkeypatch.setattr(hn, "ROUND_VALUES", values)
    monkeypatch.setattr(hn, "TILE", tile)
    rows = vectors(160, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    anchors = df.where(F.col("vec_id") % 50 == 0)
    got = sorted(map(tuple, hn.mine(df, anchors.unionByName(anchors)).collect()))
    assert got == plain(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0]) and len(got) > 20


def test_no_anchors_empty_tables_and_overlong_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.mine(empty, empty).count() == 0
    rows = spark.createDataFrame([(1, 1, [1e30], 0, ""), (2, 1, [1.0], 0, "")], SCHEMA)
    assert hn.mine(rows, rows.where("vec_id = 7")).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        hn.mine(rows, rows).count()
