"""MinHash near-dedup against brute force on whole shingle sets."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conforma.llm import minhash


def near_copies(seed, groups=12, most=14):
    """Groups of near copies around the threshold, a shared passage in many texts, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = " ".join(word() for _ in range(50))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 40, 160]))]
        for _ in range(rng.randrange(1, most)):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4]) * len(w) // 80 + rng.randrange(2)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += [f"{passage} " + " ".join(word() for _ in range(rng.choice([3, 12, 30]))) for _ in range(40)]
    rng.shuffle(out)
    return [(3 * k + 1, t) for k, t in enumerate(out)]


def test_bounds_lose_one_pair_in_a_billion():
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-9
    assert minhash.least_equal(10, 1.0) == 10 and minhash.least_equal(minhash.HASHES) > 80


def test_minima_estimate_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = np.sort(pool[:2000]), np.sort(pool[1000:])
    low = minhash.minima(np.concatenate([a, b]), np.array([0, 2000, 2000, 4000]))
    assert abs((low[0] == low[2]).mean() - 1 / 3) < 0.12 and not low[1].any()


@pytest.mark.parametrize(("chunk", "few"), [(4096, 64), (4, 3)])
def test_components_equal_brute_force(spark, chunk, few, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "FEW", few)
    docs = near_copies(2) + [(2, None), (3, ""), (5, " \n "), (6, "one"), (9, "ONE"), (12, "long " * 3000 + " ".join(map(str, range(20000))))]
    df = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id int, text string, component_id string, n int").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.minhash_components(df).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute.components(docs, 4, 80).items()}


def test_keys_of_several_components_are_compared_in_full(spark):
    # all share two thirds of their words, so bands put texts together that don't link; one pair among them does
    rng = random.Random(4)
    head = " ".join(f"h{k}" for k in range(90))
    docs = [(k, head + " " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(30))) for k in range(150)]
    docs += [(900, docs[77][1] + " end"), (901, docs[149][1] + " end")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.minhash_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: {900: 77, 901: 149}.get(k, k) for k, _ in docs}


def test_null_and_repeated_ids_and_empty_tables(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (7, text), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash.minhash_components(df).collect()), key=str)
    assert got == sorted([(None, 5, None, True), (None, 0, None, True), (4, 5, 4, True), (4, 5, 4, True), (7, 5, 4, False)], key=str)
    assert minhash.minhash_components(df.limit(0)).count() == 0


def test_parity_maps_never_drop_a_linked_pair():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 63, 65, 700, 9000):
        pool = rng.integers(0, 1 << 63, size + size // 5 + 2, dtype=np.uint64)
        for shared in range(size - size // 8 - 1, size + 1):
            if shared < 0 or shared % 7 and size > 700:
                continue
            a, b = pool[:size], pool[size - shared : size + (size - shared) // 2]
            maps = minhash.parity_maps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            s = minhash.Sketches(pa.array([bytes(2 * minhash.HASHES)] * 2, pa.binary()), np.array([len(a), len(b)]), pa.array(maps, pa.binary()))
            if 100 * shared >= 80 * (len(a) + len(b) - shared):
                assert s.near(np.array([0]), s, np.array([1])).all()
    far = minhash.parity_maps(rng.integers(0, 1 << 63, 400, dtype=np.uint64), np.array([0, 200, 400]))
    s = minhash.Sketches(pa.array([bytes(2 * minhash.HASHES)] * 2, pa.binary()), np.array([200, 200]), pa.array(far, pa.binary()))
    assert not s.near(np.array([0]), s, np.array([1])).any()
