"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from conforma.llm import runs
from conforma.llm.words import mix


def plain_runs(w):
    """(start, length, period) of every run, by trying every period at every place."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_row(doc_id, text, edit):
    w = brute.words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if edit and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if found else None
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, len(found), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


def periodic(rng, words):
    out = []
    while len(out) < words:
        unit = [rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 7, 40, 60]))]
        out += unit * rng.choice([1, 1, 3, 5, 8]) + [rng.choice("abcde") for _ in range(rng.randrange(4))]
    return out


def test_run_finder_equals_brute_force():
    rng = random.Random(3)
    rows = [periodic(rng, rng.choice([0, 3, 6, 20, 100, 400])) for _ in range(150)]
    rows += [[], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], ["a"] * 500]
    x = mix(np.array([ord(c) for w in rows for c in w], np.uint64))
    edges = np.append(0, np.cumsum([len(w) for w in rows]))
    row, start, length, period = runs.find_runs(x, edges)
    got = [[] for _ in rows]
    for r, *found in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[r].append(tuple(found))
    assert got == [plain_runs(w) for w in rows]


@pytest.mark.parametrize("block", [64, 1 << 19])
def test_run_finder_at_any_block_size(block, monkeypatch):
    monkeypatch.setattr(runs, "GRID_BLOCK", block)
    w = ["a", "b", "c"] * 60 + ["x"] + ["d"] * 300
    x = mix(np.array([ord(c) for c in w], np.uint64))
    assert [c.tolist() for c in runs.find_runs(x, np.array([0, len(w)]))] == [[0, 0], [0, 181], [180, 300], [3, 1]]


def test_extensions_of_the_index_equal_word_by_word():
    rng = np.random.default_rng(0)
    x = mix(np.concatenate([np.tile(rng.integers(0, 9, 37), 20), rng.integers(0, 2, 3000), np.tile(rng.integers(0, 9, 300), 6)]).astype(np.uint64))
    index = runs.CoverIndex(x)
    i = rng.integers(0, len(x) - 1, 2000)
    j = i + 1 + rng.integers(0, len(x) - 1 - i)
    got = index.extend(i, j, len(x) - j)
    for a, b, n in zip(i.tolist(), j.tolist(), got.tolist()):
        assert (x[a : a + n] == x[b : b + n]).all() and (b + n == len(x) or x[a + n] != x[b + n])


@pytest.mark.parametrize("edit", [False, True])
def test_rows_equal_brute_force(spark, edit):
    rng = random.Random(5)
    docs = [(k, " ".join(periodic(rng, rng.choice([0, 5, 30, 200]))) + rng.choice(["", " ", "\n\x0b é"])) for k in range(120)]
    docs += [(500, None), (501, ""), (502, " \t\n"), (7, "a a a a a a a"), (7, "a a a a a a a"), (None, "b " * 9), (503, "a b c d " * 400)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, start string, row int")
    got = sorted(map(tuple, runs.periodic_runs(df, edit).collect()), key=str)
    assert got == sorted((plain_row(*d, edit) for d in docs), key=str)


def test_empty_table_and_collapsed_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.periodic_runs(empty).count() == 0 and runs.collapse_runs(empty).count() == 0
    df = spark.createDataFrame([(1, "x  a b a b\na b a b y"), (2, "no  run"), (3, None)], "doc_id int, text string")
    assert sorted(map(tuple, runs.collapse_runs(df).collect())) == [(1, "x a b y"), (2, "no  run"), (3, None)]
