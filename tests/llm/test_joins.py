import random

import duckdb
import pytest

from brute import ascii_lower, components, removed_lines, words
from conforma.llm import line_dedup, ngram_join, sharding, simhash

DOCS = "doc_id long, text string, n long, h long, pos long, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, None) for d, t in rows], DOCS)


def near_copies(seed, n=120, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    base = [[rng.choice(vocabulary) for _ in range(size)] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        cut = rng.randint(10, 40)
        rows.append((i * 7 % 1009, " ".join(w[:cut]) + rng.choice(["\n", " ", "\n\n"]) + " ".join(w[cut:])))
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows += [(2000 + i, passage + "\n" + " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(40)]
    return rows + [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "a b"), (5004, "A b"), (5005, "a b c d e"), (5006, "x " * 3000), (5007, "the of"), (5008, "the of and")]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_finds_all_components(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == components(rows)


def test_ngram_join_handles_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (0, "A  B c d e f")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()), key=str)
    assert got == [(0, 0), (1, 0), (1, 0), (None, None)]
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    assert sorted(str(r["doc_id"]) for r in ngram_join.keep_one(frame(spark, rows)).collect()) == ["0", "None"]


def test_signature_tree_loses_no_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**63, 80, dtype=np.uint64)) for _ in range(6)]
    sets = []
    for i in range(150):
        s = base[i % 6].copy()
        k = int(rng.integers(0, 20))
        s[:k] = rng.integers(0, 2**63, k, dtype=np.uint64)
        sets.append(np.unique(s[: int(rng.integers(50, 80))]))
    sizes = np.array([len(s) for s in sets])
    first = [s[: int(ngram_join.prefix_length(np.array(len(s))))] for s in sets]
    tree = ngram_join.SignatureTree(ngram_join.bitmaps(np.concatenate(first), np.append(0, np.cumsum([len(f) for f in first]))), sizes)
    i, j = tree.join(tree)
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    for a in range(len(sets)):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                assert (b, a) in found
    assert len(found) < 150 * 149 / 2


def test_lines_whose_best_candidate_is_not_similar_look_further(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL_KEY", 5)
    rows = [(i, " ".join([f"w{i}x{k}" for k in range(300)] + [f"s{k}" for k in range(300)])) for i in range(60)]
    rows.append((99, rows[57][1] + " more"))
    assert {(r["doc_id"], r["line_no"]) for r in line_dedup.removed_lines(frame(spark, rows)).collect()} == {(99, 0)} == removed_lines(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup_removes_exactly_the_later_similar_lines(spark, seed):
    rows = near_copies(seed)
    want = removed_lines(rows)
    assert {(r["doc_id"], r["line_no"]) for r in line_dedup.removed_lines(frame(spark, rows)).collect()} == want
    texts = dict(rows)
    for r in line_dedup.dedup_lines(frame(spark, rows)).collect():
        lines = (texts[r["doc_id"]] or "").split("\n")
        stay = [x for i, x in enumerate(lines) if (r["doc_id"], i) not in want]
        assert r["text"] == (None if texts[r["doc_id"]] is None else "\n".join(stay))
        assert r["n_removed"] == len(lines) - len(stay)


@pytest.mark.parametrize("limits", [(2, 1 << 14, 512, 32), (2, 8, 512, 32), (2, 8, 6, 32), (2, 8, 512, 16), (2, 8, 6, 3), (4, 1 << 14, 4, 32), (512, 1 << 14, 512, 32)])
def test_line_dedup_splits_frequent_words_and_large_keys(spark, monkeypatch, limits):
    for name, limit in zip(("BAND_LINES", "SPLIT_LINES", "SMALL_KEY", "LONG"), limits):
        monkeypatch.setattr(line_dedup, name, limit)
    rng = random.Random(9)
    rows = [(10000 + i, f"user u{i} logged in\nuser u{i % 90} in logged " + "again " * (i % 2)) for i in range(60)]
    rows += [(20000 + i, " ".join(["user", "logged"] + [f"k{k}" for k in range(14)] + [f"r{rng.randrange(40)}" for _ in range(rng.randrange(6))])) for i in range(60)]
    rows += [(30000 + i, w) for i, w in enumerate(["once", "once once", "x", "x x x", "Once", "a b", "b a", "b a b", "a b c", "c\tb\ta"])]
    rows += [(40000 + i, " ".join(f"z{k + i // 3}" for k in range(150))) for i in range(40)] + near_copies(7, 60)
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.removed_lines(frame(spark, rows)).collect()}
    assert got == removed_lines(rows)


def test_a_long_line_of_frequent_words_has_few_keys(spark):
    rows = [(i, f"w{i} " * 9) for i in range(2000)] + [(9000 + k, " ".join(f"w{i}" for i in range(2000 - k))) for k in range(3)]
    lines = spark.createDataFrame([(k, d, 0, t.strip()) for k, (d, t) in enumerate(rows)], "line long, doc_id long, line_no int, low string")
    posts = line_dedup.posting_rows(lines, line_dedup.rarity_table(lines), band_lines=1, split_lines=1)
    assert posts.groupBy("line").count().agg({"count": "max"}).first()[0] <= 2 * 501
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.removed_lines(frame(spark, rows)).collect()}
    assert got == {(9001, 0), (9002, 0)}


def test_keys_are_made_again_for_lines_of_large_keys_alone(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL_KEY", 8)
    asked, made = [], line_dedup.posting_rows
    monkeypatch.setattr(line_dedup, "posting_rows", lambda lines, *a: asked.append(lines.count()) or made(lines, *a))
    rows = [(i, f"user u{i} logged in") for i in range(20)] + [(100 + i, f"a{i} b{i} c{i} d{i}") for i in range(50)] + [(200, "user u3 logged in again")]
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.removed_lines(frame(spark, rows)).collect()}
    assert got == removed_lines(rows) == {(200, 0)}
    assert asked == [71, 20]


@pytest.mark.parametrize("far", [1 << 20, (1 << 63) - 200])
def test_lines_are_in_order_of_doc_id_and_number_however_large(spark, far):
    rows = [(far - d, t) for d, t in near_copies(5, 60)] + [(-far + d, t) for d, t in near_copies(6, 30)]
    lines = line_dedup.distinct_lines(line_dedup.line_rows(frame(spark, rows)))
    got = lines.select("doc_id", "line_no", line_dedup.line_order(lines).alias("at")).orderBy("at").collect()
    assert [(r[0], r[1]) for r in got] == sorted((r[0], r[1]) for r in got)
    assert {(r["doc_id"], r["line_no"]) for r in line_dedup.removed_lines(frame(spark, rows)).collect()} == removed_lines(rows)


def test_texts_of_very_many_lines_are_rebuilt_in_order(spark):
    keep = [f"line number{k} of{k * 7} its own{k * 3} text{k * 5}" for k in range(40_000)]
    text = "\n".join(x for k, x in enumerate(keep) for x in ([x, x] if k % 2 else [x]))
    r = line_dedup.dedup_lines(frame(spark, [(1, text), (2, "\n".join(keep[:5])), (3, "free\n\n")])).orderBy("doc_id").collect()
    assert [x["n_removed"] for x in r] == [20_000, 5, 0] and [x["text"] for x in r] == ["\n".join(keep), "", "free\n\n"]


def test_a_key_of_one_form_of_lines_is_split_by_lengths(spark):
    # a very frequent word of many short lines that differ in one word: no key holds two lines that could be compared
    lines = spark.createDataFrame([(i, 10 * i, 0, f"user u{i} logged in") for i in range(200)], "line long, doc_id long, line_no int, low string")
    posts = line_dedup.posting_rows(lines, line_dedup.rarity_table(lines), band_lines=2, split_lines=8)
    assert posts.count() > 0 and posts.where("side % 3 = 0").count() == 0
    assert line_dedup.first_pairs(posts).count() == 0


def test_line_dedup_keeps_rows_that_share_a_doc_id_apart(spark):
    same = "same line of words"
    other = "totally different unrelated words here"
    get = lambda rows: sorted(r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    # equal rows are one document; other rows of a doc_id are documents of their own
    assert get([(1, same), (1, same)]) == [same, same]
    assert get([(1, same), (2, same), (2, other)]) == ["", same, other]
    rows = [(d // 3, t) for d, t in near_copies(8, 60) if t]
    keys = {(r["doc_id"], r["text"]): r["k"] for r in frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) AS k").collect()}
    lines = sorted({(d, i, keys[d, t], x) for d, t in rows for i, x in enumerate(t.split("\n"))})
    sets = [(x[:3], frozenset(words(ascii_lower(x[3])))) for x in lines]
    want = {(k[0], k[2], k[1]) for j, (k, s) in enumerate(sets) if s and any(len(s & o) >= 0.75 * len(s | o) - 1e-9 for _, o in sets[:j])}
    assert {(r["doc_id"], r["text_key"], r["line_no"]) for r in line_dedup.removed_lines(frame(spark, rows)).collect()} == want


def test_words_are_sorted_as_plain_numbers_and_their_counts_stored(spark, monkeypatch):
    names, stored, arrays, sort_array = [], line_dedup.materialise, [], line_dedup.F.sort_array
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: names.append(name) or stored(df, name))
    lines = spark.createDataFrame([(i, i, 0, f"user u{i} logged in") for i in range(9)], "line long, doc_id long, line_no int, low string")
    table = line_dedup.rarity_table(lines)
    # the shuffle of counts is cleaned with the table that it is stored in
    assert "word-counts" in names
    monkeypatch.setattr(line_dedup.F, "sort_array", lambda x: arrays.append(x) or sort_array(x))
    line_dedup.posting_rows(lines, table)
    made = lines.select("low", table.scalar().alias("classes")).select(arrays[0].alias("t")).schema["t"].dataType
    assert made.elementType.typeName() == "long" and not made.containsNull


def test_lowered_lines_keep_other_letters_and_have_spaces_alone(spark):
    rows = ["Plain ASCII", "A\tB\x0bC\x0cD\rE", "ÉTÉ Où\tÇa", "", "Ümlaut\rZ", "x\nY"]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select(line_dedup.lowered(line_dedup.F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == [ascii_lower(x).translate({k: " " for k in (9, 10, 11, 12, 13)}) for x in rows]


def test_line_dedup_takes_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "short line of text"), (4, "x" * 300_000), (5, "x" * 300_000)]
    got = {r["doc_id"]: (len(r["text"]), r["n_removed"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (len(long), 0), 2: (0, 1), 3: (18, 0), 4: (300_000, 0), 5: (0, 1)}


def test_line_dedup_handles_nulls_and_empty_tables(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    rows = [(None, "a b\na b"), (1, None), (2, "a b\na b"), (3, "")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {None: "a b\na b", 1: None, 2: "a b", 3: ""}


def test_simhash_texts_edits_and_likeness(spark):
    import hashlib

    rows = sorted((d, t) for d, t in near_copies(5) if t is not None)
    got = {r["doc_id"]: r for r in simhash.fingerprint_edits(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[1][:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        bits = [int(r[x], 16) for x in ("fingerprint", "edited_fingerprint")] + [int(got[other[0]]["fingerprint"], 16)]
        assert r["near_edited"] == 1 - (bits[0] ^ bits[1]).bit_count() / 128
        assert r["near_next"] == 1 - (bits[0] ^ bits[2]).bit_count() / 128
    same = {}
    for d, t in rows:
        assert same.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
    assert simhash.fingerprint_edits(frame(spark, [])).count() == 0
    odd = simhash.fingerprint_edits(frame(spark, [(None, "a b c"), (3, None), (3, None), (9, "x y z " * 2000)])).collect()
    assert sorted(str(r["doc_id"]) for r in odd) == ["3", "9", "None"]


def plain_fingerprint(text):
    """SimHash of 128 bits by counting each bit's votes, with the hashes that Spark's xxhash64 gives."""
    import xxhash

    def h(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x, seed=seed)
        return seed

    w = [h(x.encode()).to_bytes(8, "little") for x in words(text)]
    terms = [h(a, b).to_bytes(8, "little") for a, b in zip(w, w[1:])] or w
    votes = [int.from_bytes(t, "little") | h((1).to_bytes(4, "little"), t) << 64 for t in terms]
    ones = [2 * sum(v >> k & 1 for v in votes) > len(votes) for k in range(128)]
    return "".join(f"{sum(b << k for k, b in enumerate(ones[64 * i : 64 * i + 64])):016x}" for i in range(2))


def test_simhash_bits_against_plain_votes(spark):
    rows = [(d, t) for d, t in near_copies(9, 40)] + [(7000, "one"), (7001, "two words"), (7002, "é ü é"), (7003, "again again again")]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprint_edits(frame(spark, rows)).collect()}
    assert got == {d: plain_fingerprint(t or "") for d, t in rows}


def test_simhash_takes_texts_of_millions_of_terms(spark):
    rows = [(1, "x " * 2_200_000), (2, "x x x"), (3, "y z " * 10)]
    got = {r["doc_id"]: r for r in simhash.fingerprint_edits(frame(spark, rows)).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == plain_fingerprint("x x") and got[1]["n_chars"] == 4_400_000


def test_simhash_counts_near_fingerprints(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(400)] = f"v{rng.randrange(900)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{rng.randrange(900)}" for _ in range(50))) for i in range(30)] + [(200, None), (201, "")]
    got = {r["doc_id"]: r for r in simhash.fingerprint_edits(frame(spark, rows)).collect()}
    prints = {r["fingerprint"] for r in got.values()}
    for r in got.values():
        near = {p for p in prints if (int(p, 16) ^ int(r["fingerprint"], 16)).bit_count() <= simhash.RADIUS}
        assert r["n_near"] == len(near) - 1 and r["near_id"] == min(d for d, x in got.items() if x["fingerprint"] in near)
    assert max(r["n_near"] for r in got.values()) > 0


def test_simhash_block_tables_find_all_near_fingerprints(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(128) for _ in range(20)]
    values = {b ^ sum(1 << rng.randrange(128) for _ in range(rng.randint(0, 3))) for b in base for _ in range(4)}
    prints = sorted(f"{v:032x}" for v in values if v < 1 << 128)
    want = {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in prints for b in prints if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3}
    table = spark.createDataFrame([(p,) for p in [*prints, prints[0], None]], "fingerprint string")
    for blocks in (None, 4, 5):
        found = [tuple(r) for r in simhash.near_pairs(table, 3, blocks).collect()]
        assert len(found) == len(set(found)) and set(found) == want and want


def test_simhash_with_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)
    ids = random.Random(8).sample(range(-10**12, 10**12), 300)
    got = {r["doc_id"]: (r["next_id"], r["next_text"]) for r in simhash.with_next(frame(spark, [(i, f"t{i}") for i in ids])).collect()}
    ids.sort()
    assert got == {i: (j, f"t{j}") for i, j in zip(ids, ids[1:] + ids[:1])}


def test_sharding_is_a_seeded_shuffle_with_equal_counts(spark):
    rows = [(i, "x" * (i % 50)) for i in range(1000)] + [(2000, None), (None, "n"), (None, "m"), (2001, "y" * 100_000)]
    df = frame(spark, rows)
    one = sharding.shard_documents(df, 24, bucket_bytes=4000)
    got = [(r["doc_id"], r["shard"], r["slot"]) for r in one.collect()]
    assert len(got) == len(rows)
    sizes = [sorted(s for _, k, s in got if k == shard) for shard in range(24)]
    assert all(s == list(range(len(s))) for s in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    again = [(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(df.repartition(7), 24, bucket_bytes=4000).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert {r["doc_id"]: r["size"] for r in one.collect()}[2000] == 8
    assert sharding.shard_documents(frame(spark, []), 24).count() == 0


def test_sharding_order_does_not_depend_on_the_number_of_parts(spark, monkeypatch):
    df = frame(spark, [(i, "x" * (i % 50)) for i in range(1500)] + [(i, "copy") for i in (7, 7, 8)] * 20)

    def order():
        return sorted((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in sharding.shard_documents(df, 5, bucket_bytes=700).collect())

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for partitions, per_part in (("1", 64), ("1", 3), ("13", 64), ("500", 64)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            monkeypatch.setattr(sharding, "PART_BUCKETS", per_part)
            found.append(order())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found[0]) == 1560 and all(x == found[0] for x in found)


def test_sharding_query_columns_reserved_names_and_repeated_ids(spark, tmp_path, monkeypatch):
    import zlib

    from conforma.llm import queries

    monkeypatch.setattr(sharding, "BLOCK_BUCKETS", 3)
    rows = [(i % 7, f"é{i}" * (i % 30)) for i in range(300)] + [(3, None), (4, "same"), (4, "same")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_sharding(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    small = sharding.shard_documents(frame(spark, rows), 5, bucket_bytes=500).collect()
    assert sorted(r["slot"] for r in small if r["shard"] == 2) == list(range(sum(r["shard"] == 2 for r in small))) and len(small) == len(rows)
    for name in sharding.RESERVED:
        with pytest.raises(ValueError):
            sharding.shuffle_rows(frame(spark, rows).withColumnRenamed("n", name), "1")
