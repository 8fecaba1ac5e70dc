import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import brute
from conforma.llm import classifier, licenses, packing, pieces, quality, token_files, tokens
from conforma.llm.common import string_buffers
from conforma.llm.queries import PIECE_MODEL, TOKENIZER_BYTES, TOKENIZER_WORDS

ODD = [
    "", " ", "  a", "a  b", "a \n b\n", "it's  don't　x", "Ünï ćd́é   x", "a\x1cb", "<|endoftext|> x", "0 1 23 00", "\n\nfoo\n\n bar\t\tbaz ", "日本語 テキスト",
    "İstanbul ΣΑΣ", "a\0 b\0c", "x" * 5000 + " y", "ok !!! #### a's", "tail ", "ß ŉ ǆ", "▁x ▁ ▁▁y", "a b   c    d     e",
]
DOCS = "doc_id long, text string, piece int, length string, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", None) for d, t in rows], DOCS)


def invented(seed, n):
    rng = random.Random(seed)
    parts = ["th", "er", "an", "re", "É", "ü", "ing", "ble", "'s", "###", "7", "."]
    return [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 80))) + rng.choice(["", "\n", "\nA b"]) for _ in range(n)]


@pytest.mark.parametrize("path", [TOKENIZER_BYTES, TOKENIZER_WORDS, public_tokenizers.path("byte_bpe_50k.json")])
def test_ids_are_the_librarys(path):
    own = tokens.Encoder(path)
    texts = ODD + invented(1, 200)
    want = [np.array(x.ids, "<u4").tobytes() for x in own.library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want and own.encode(texts) == want


def test_pieces_are_the_librarys():
    coder = pieces.PieceEncoder(PIECE_MODEL)
    rng = random.Random(2)
    texts = ODD + invented(3, 200) + ["".join(rng.choice("abcdeinrst he▁.") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    want = [np.array(x, "<u4").tobytes() for x in coder.library.encode(texts, add_bos=True, add_eos=True)]
    assert coder.encode(texts) == want


def test_encode_decode_rows(spark):
    rows = [(1, "A b"), (2, None), (None, "A b"), (2, "")]
    got = pieces.encode_decode(frame(spark, rows), PIECE_MODEL).collect()
    assert sorted(str((r["doc_id"], r["decoded"], r["n_tokens"])) for r in got) == sorted(str(x) for x in [(1, "A b", 4), (2, "", 2), (None, "A b", 4), (2, "", 2)])
    assert pieces.encode_decode(frame(spark, []), PIECE_MODEL).count() == 0


@pytest.mark.parametrize("block", [5, 2048])
def test_word_aligned_code_round_trip(block):
    rng = np.random.default_rng(0)
    samples = [np.zeros(1000), rng.integers(0, 50257, 9001), rng.integers(0, 3, 5000), rng.integers(0, 2**62, 3001), np.array([7]), np.zeros(0), np.array([2**60, 2**64 - 1, 0, 5, 2**63], np.uint64), np.repeat([0, 9, 0], 241)]
    for ids in samples:
        ids = ids.astype(np.uint64)
        words, firsts = token_files.encode_ids(ids, block)
        assert (token_files.decode_ids(words, firsts, len(ids), block) == ids).all()
        raw = token_files.file_bytes(np.array([3, 4]), np.array([1, len(ids) - 1]), ids) if len(ids) else None
        if raw:
            docs, lengths, back = token_files.read_file(raw)
            assert docs.tolist() == [3, 4] and (back == ids).all() and lengths.sum() == len(ids)


def test_token_files_hold_all_documents_in_order(spark):
    rows = [(i * 7 % 101, t) for i, t in enumerate(invented(4, 101))] + [(200, None), (None, "null id"), (300, "x " * 20000)]
    path, manifest = token_files.write_token_files(frame(spark, rows), TOKENIZER_BYTES, files=5)
    got = {r["doc_id"]: r for r in token_files.read_token_files(spark, path, manifest).collect()}
    own, before = tokens.Encoder(TOKENIZER_BYTES), 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want = own.library.encode(t or "", add_special_tokens=False).ids + [0]
        r = got[d]
        assert (r["start"], r["n_tokens"], r["ids"]) == (before, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        before += len(want)
    path, manifest = token_files.write_token_files(frame(spark, []), TOKENIZER_BYTES)
    assert token_files.read_token_files(spark, path, manifest).count() == 0


def test_token_files_keep_repeated_rows_and_order_by_number(spark):
    rows = [(5, "b a"), (5, "b a"), (5, "a b"), (-3, ""), (9, "x")]
    path, manifest = token_files.write_token_files(frame(spark, rows), TOKENIZER_BYTES, files=3)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_token_files(spark, path, manifest).collect()))
    own = tokens.Encoder(TOKENIZER_BYTES).library
    want = [(d, len(own.encode(t, add_special_tokens=False).ids) + 1) for d, t in sorted(rows)]
    assert [(d, n) for _, d, n in got] == want and [s for s, _, _ in got] == [sum(n for _, n in want[:k]) for k in range(5)]
    made = [("part-1000000.ids", 1, 1), ("part-999999.ids", 1, 1)]
    assert sorted(made, key=token_files.file_number)[0][0] == "part-999999.ids"


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(30):
        capacity = rng.choice([10, 37, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
        histogram = {s: sizes.count(s) for s in set(sizes)}
        rows = packing.plan_packing(histogram, capacity)
        bins: dict[int, list] = {}
        for length, lo, hi, first, per, at in rows:
            for r in range(lo, hi):
                bins.setdefault(first + (r - lo) // per, []).append((at + (r - lo) % per * length, length))
        for items in bins.values():
            end = 0
            for at, length in sorted(items):
                assert at == end
                end += length
            assert end <= capacity
        plain: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [k for k, room in enumerate(plain) if room >= s]
            if fits:
                k = min(fits, key=lambda k: plain[k])
                plain[k] -= s
            else:
                plain.append(capacity - s)
        assert len(bins) == len(plain) and sum(map(len, bins.values())) == len(sizes)
    with pytest.raises(ValueError):
        packing.plan_packing({11: 1}, 10)


def test_pack_takes_columns_of_any_name_but_its_own(spark):
    df = spark.createDataFrame([(k, 1 + k % 5, k, 2, 3, 4, 5, "x") for k in range(40)], "doc_id long, length int, lo long, hi long, first long, per int, at int, n string")
    got = packing.pack(df, 5)
    assert got.columns == [*df.columns, "sequence_id", "offset"] and got.count() == 40
    assert {(r["doc_id"], r["lo"], r["at"]) for r in got.collect()} == {(k, k, 5) for k in range(40)}
    with pytest.raises(ValueError, match="reserved"):
        packing.pack(df.withColumnRenamed("lo", "_lo"), 5)


def test_packed_pieces_of_documents(spark):
    rows = [(i, t) for i, t in enumerate(invented(6, 150))] + [(500, "w " * 500), (501, None), (None, "a"), (7, "again"), (7, "again")]
    got = packing.pack_documents(frame(spark, rows), TOKENIZER_WORDS, capacity=128).collect()
    places: dict[int, list] = {}
    for r in got:
        assert len(r["ids"]) == r["length"] <= 128 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in places.values():
        end = 0
        for at, length in sorted(items):
            assert at == end
            end += length
        assert end <= 128
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 500)
    assert [x[1] for x in long] == [128 * k for k in range(len(long))] and all(x[2] == 128 for x in long[:-1])
    total = sum(r["length"] for r in got)
    assert len(places) <= total / 128 * 1.25 + 2
    assert packing.pack_documents(frame(spark, []), TOKENIZER_WORDS).count() == 0


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(7)
    bits = ["a", "b ", "c", "  ", "\n", "d e ", "é# ", "a b c d e f g h i j k l ", "\t%"]
    texts = [None, "", " \n ", "a", "a\n\na\n", "é ü é ü é ü é ü é ü x", "a b c d e " * 6] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    m = quality.measure(*string_buffers(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert [int(m[f][i]) for f in quality.FIELDS] == brute.quality(t)
    rows = list(enumerate(texts)) + [(None, "x " * 3000)]
    got = quality.score_quality(frame(spark, rows)).collect()
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    kept = quality.keep_quality(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "piece", "length", "lang"] and kept.count() == sum(r["kept"] for r in got)
    assert quality.score_quality(frame(spark, [])).count() == 0


def test_long_repeats_fail_the_rules_own_limits():
    rng = random.Random(8)
    plain = [f"w{i}" for i in range(2000)]
    rng.shuffle(plain)
    passage = plain[:60]
    texts = [" ".join(plain), " ".join(passage + plain[60:] + passage)]
    failed, kept = quality._verdicts(quality.measure(*string_buffers(pa.array(texts))))
    assert failed.tolist() == [False, False] and kept.tolist() == [True, False]


def test_each_own_limit_of_the_quality_rules_rejects_by_itself():
    word = (f"w{i}" for i in range(10**6))
    some = lambda n: [next(word) for _ in range(n)]
    twice = [some(12) for _ in range(4)]
    # four passages of 12 words twice: 96 of 576 words, none longer than 12
    cover = [w for p in twice for w in p + some(60)] + [w for p in twice for w in p + some(60)]
    passage = some(60)
    # one passage of 60 words twice in 1800 words
    longest = passage + some(1680) + passage
    texts = [" ".join(x) for x in (cover, longest, some(500))]
    m = quality.measure(*string_buffers(pa.array(texts)))
    covered = (100 * m["n_repeats_covered"] > quality.MAX_PERCENT * m["n_words"]).tolist()
    long = (m["longest_repeat"] > quality.MAX_REPEAT).tolist()
    failed, kept = quality._verdicts(m)
    assert (covered, long) == ([True, False, False], [False, True, False])
    assert failed.tolist() == [False] * 3 and kept.tolist() == [False, False, True]


def thue_morse(k):
    """Two strings of 2**k signs, complementary, that polynomials modulo 2**64 don't tell apart."""
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_word_hashes_tell_different_spans_apart(spark):
    from conforma.llm.ngram_join import jaccard_components
    from conforma.llm.words import span_hashes

    a, b = thue_morse(11)
    m = quality.measure(*string_buffers(pa.array([f"{a}\n{b}", f"{a}\n{a}"])))
    assert m["n_dup_lines"].tolist() == [0, 1]
    rows = [(k, " ".join([x] * 4 + [str(k)])) for k, x in enumerate((a, b))] + [(7, " ".join(["p", a, "q", "r"])), (8, " ".join(["p", b, "q", "r"]))]
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(frame(spark, rows)).collect()} == {0: 0, 1: 1, 7: 7, 8: 8}
    rng = random.Random(1)
    spans = ["".join(rng.choice("ab\0") for _ in range(rng.randint(0, 80))).encode() for _ in range(4000)]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(x) for x in spans])
    h = span_hashes(data, ends - [len(x) for x in spans], ends)
    seen = {}
    for x, v in zip(spans, h.tolist()):
        assert seen.setdefault(v, x) == x
    assert len(seen) == len(set(spans))


def test_log_ratios_and_the_hinge_model_against_brute_force():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 12))) for _ in range(120)]
    y = np.where(rng.random(120) < 0.4, 1.0, -1.0)
    got = classifier.log_ratios(rows, y)
    total = {s: classifier.N_FEATURES + sum(len(r) for r, v in zip(rows, y) if v == s) for s in (1, -1)}
    for f in range(45):
        share = {s: (1 + sum(f in r.tolist() for r, v in zip(rows, y) if v == s)) / total[s] for s in (1, -1)}
        assert got[f] == pytest.approx(np.log(share[1] / share[-1]))
    cost = np.full(120, 10.0)
    w, bias = classifier.fit_hinge(rows, y, got, cost, epochs=4000)
    x = [got[r] / (np.sqrt(got[r] @ got[r]) or 1) for r in rows]
    # w is a sum of rows with dual variables in range, so the dual value bounds the primal one from below; both are near
    margins = np.array([w[r] @ v + bias for r, v in zip(rows, x)])
    primal = 0.5 * (w @ w + bias * bias) + (cost * np.maximum(0, 1 - y * margins)).sum()
    dense = np.zeros((120, 46))
    for i, (r, v) in enumerate(zip(rows, x)):
        dense[i, r], dense[i, 45] = v, 1
    z = dense * y[:, None]
    alpha, square = np.zeros(120), (z * z).sum(axis=1)
    for _ in range(20_000):
        i = int(rng.integers(120))
        alpha[i] = min(max(alpha[i] - (z[i] @ (alpha @ z) - 1) / square[i], 0), 10)
    dual = alpha.sum() - 0.5 * ((alpha @ z) ** 2).sum()
    assert dual - 1e-6 <= primal <= dual * 1.02 + 1e-6


def test_classifier_takes_one_text_of_rows_that_share_a_doc_id(spark):
    docs = frame(spark, [(1, f"text {i}") for i in range(50)] + [(2, "other"), (3, "words"), (3, "words")])
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit_documents(docs, marks)
    assert classifier.score_documents(docs, model).count() == 53 and np.isfinite(model.bias)


def test_classifier_learns_and_holds_out(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        w = [rng.choice(["river", "stone", "walks", "under", "light", "of", "the"]) + rng.choice(["", "er", "ly"]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w])))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (None, "the stone"), (1001, "")]
    marks = spark.createDataFrame(labels + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = classifier.fit_documents(docs, marks)
    got = {r["doc_id"]: r for r in classifier.score_documents(docs, model).collect()}
    for d, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0)
    right = [got[i]["predicted"] == q for i, q, _ in labels if got[i]["held_out"]]
    assert sum(right) / len(right) > 0.95
    # held-out labels don't matter
    flipped = spark.createDataFrame([(i, 1 - q if got[i]["held_out"] else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in classifier.score_documents(docs, classifier.fit_documents(docs, flipped)).collect()}
    assert all(again[d] == r["score"] for d, r in got.items())
    none = classifier.fit_documents(docs, marks.limit(0))
    assert {r["predicted"] for r in classifier.score_documents(docs, none).collect()} == {1}
    assert classifier.keep_predicted(docs, model).columns == docs.columns


def test_licence_scans_against_plain_dice(spark):
    import re

    @functools.cache
    def pairs(t):
        w = re.sub("[^A-Za-z0-9]+", " ", t).strip().lower().split(" ")
        return (set(zip(w, w[1:])) or {tuple(w)}) if w != [""] else set()

    rng = random.Random(10)
    # long licences hold notices of others within them; see the next test
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts if len(pairs(t)) <= licenses.RUN_BIGRAMS]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(["the", "river", "license", "version", "under"]) for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(1, 4))]
        notice = rng.choice(notices).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            notice[rng.randrange(len(notice))] = "changed"
        lines.insert(rng.randint(0, len(lines)), rng.choice(["", " ".join(notice).upper(), " ".join(notice)]))
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "license"), (None, "Released under the MIT License.")]
    got = {r["doc_id"]: r for r in licenses.scan_documents(frame(spark, rows)).collect()}
    for d, t in rows:
        units = ([t] if "\n" in (t or "") else []) + (t or "").split("\n")
        best, hits = [], 0
        for u in units:
            a = pairs(u)
            dice = [(2 * len(a & pairs(x)) / (len(a) + len(pairs(x))), name) for name, xs in licenses.TEMPLATES.items() for x in xs] if a else []
            found = [(-v, name) for v, name in dice if v >= 0.8]
            hits += bool(found)
            best += found
        # runs of adjacent sentences other than lines and the text count too; every such run is tried here
        parts = [x for line in (t or "").split("\n") for x in re.split(licenses.SENTENCE_GAP, line)]
        runs = {" ".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)}
        extra = [(-v, name) for u in runs for a in [pairs(u)] for name, xs in licenses.TEMPLATES.items() for x in xs for v in [2 * len(a & pairs(x)) / (len(a) + len(pairs(x)))] if a and v >= 0.8]
        if extra and not best:
            assert got[d]["n_matches"] > 0 and (-got[d]["dice"], got[d]["license"]) == (round(min(extra)[0], 6), min(extra)[1])
            continue
        assert got[d]["n_matches"] == hits
        assert (got[d]["license"], got[d]["dice"]) == ((min(best)[1], round(-min(best)[0], 6)) if best else (None, None))
    assert licenses.scan_documents(frame(spark, [])).count() == 0


def test_licence_scans_find_whole_licences_and_count_equal_rows_once(spark):
    from pathlib import Path

    files = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(licenses.__file__).parent / "license_texts").iterdir())}
    names = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0"}
    want = [names.get(n, n) for n in files] + ["MIT", "BSD-3-Clause"]
    rows = list(enumerate([*files.values(), licenses.MIT_TEXT, licenses.TEMPLATES["BSD-3-Clause"][-1]]))
    rows += [(20 + k, f"A short note on this copy.\n{t}") for k, t in enumerate(files.values())]
    rows += [(50, "Released under the MIT License."), (50, "Released under the MIT License."), (51, "Released under the MIT License."), (51, "Licensed under CC BY 4.0.")]
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in licenses.scan_documents(frame(spark, rows)).collect()}
    assert [got[k][0] for k in range(len(want))] == want and [got[20 + k][0] for k in range(len(files))] == want[: len(files)]
    assert all(0.8 <= got[k][1] <= 1 for k in got) and got[50] == ("MIT", 1.0, 1) and got[51][2] == 2


def test_long_licences_are_found_by_their_bodies_alone(spark):
    from pathlib import Path

    rng = random.Random(14)
    prose = "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(11)) + "." for _ in range(300))
    folder = Path(licenses.__file__).parent / "license_texts"
    read = {n: (folder / f"{f}.txt").read_text(encoding="utf-8") for n, f in licenses.FILES.items()}
    # bodies: without the opening, and without the appendix on how to apply them (which holds other notices)
    body = {n: t[len(t) // 20 :].split("END OF TERMS AND CONDITIONS")[0] for n, t in read.items()}
    rows = [(k, body[n]) for k, n in enumerate(read)] + [(20 + k, f"{prose}\n{body[n]}\n{prose}") for k, n in enumerate(read)]
    # a heading without a body, half a body, a body on one line, and two licences in one file
    rows += [(40, "\n".join(read["GPL-3.0"].split("\n")[:8]) + "\n" + prose), (41, read["MPL-2.0"][: len(read["MPL-2.0"]) // 2] + prose)]
    rows += [(42, prose + "\n" + " ".join(body["Apache-2.0"].split()) + "\n"), (43, f"{body['Apache-2.0']}\n{prose}\n{body['MPL-2.0']}"), (44, None), (45, "")]
    got = {r["doc_id"]: r for r in licenses.scan_documents(frame(spark, rows)).collect()}
    # the Mozilla licence's exhibit is a line that matches by itself
    for k, n in enumerate(read):
        assert got[k]["license"] == n and got[20 + k]["license"] == n and got[20 + k]["n_matches"] == 1 + (n == "MPL-2.0") and got[20 + k]["dice"] > 0.85, (n, got[k], got[20 + k])
    assert [got[k]["n_matches"] for k in (40, 41, 44, 45)] == [0] * 4
    assert (got[42]["license"], got[42]["n_matches"]) == ("Apache-2.0", 1) and got[43]["n_matches"] == 3


def test_candidates_of_long_licences_lose_no_match(spark):
    from pathlib import Path

    # texts that share ever less of a licence: those that a plain count keeps are the candidates
    text = (Path(licenses.__file__).parent / "license_texts" / "CC0-1.0.txt").read_text(encoding="utf-8")
    words = text.split(" ")
    rng = random.Random(15)
    rows = []
    for k in range(40):
        w = words[:]
        for _ in range(k * 8):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    _, long = licenses.by_size({"CC0-1.0": [text]})
    texts, found = licenses.long_texts(frame(spark, rows), long)
    own = licenses._template_pairs(text)
    want = {k for k, t in rows if len(licenses._template_pairs(t) & own) >= len(own) * 0.8 / 1.2 - 1e-9}
    assert {r["doc_id"] for r in texts.collect()} == want and 5 < len(want) < 40 and found.count() == len(want)


def test_licence_scans_of_very_many_lines(spark):
    lines = ["Released under the MIT License." if k % 2 else f"plain line {k} of text" for k in range(20_000)]
    r = licenses.scan_documents(frame(spark, [(1, "\n".join(lines))])).first()
    assert (r["n_matches"], r["license"]) == (10_000, "MIT")


def test_licence_scans_find_wrapped_notices_and_sentences(spark):
    import textwrap

    rng = random.Random(12)
    prose = "Boats lay in the river.\n" + "\n".join(" ".join(f"w{rng.randrange(500)}" for _ in range(9)) for _ in range(60))
    wrapped = lambda name, k, width: "\n".join(textwrap.wrap(licenses.TEMPLATES[name][k], width))
    rows = [
        (1, f"{prose}\n\n{wrapped('MIT', -1, 70)}\n\n{prose}"),
        (2, f"{prose}\n{wrapped('BSD-3-Clause', 0, 72)}:\n{prose}"),
        (3, "Copyright 2020 A. Author. Released under the MIT License. See the file LICENSE for the terms."),
        (4, f"{prose}\n{wrapped('BSD-2-Clause', -1, 60)}\n{prose}\nReleased under\nthe MIT License. {prose}"),
        (5, f"{prose}\nLicensed under CC BY-SA 4.0.\n{prose}"),
        (6, prose),
        (8, f"{wrapped('MIT', -1, 60)}\nThis work is licensed under a\nCreative Commons Attribution\n4.0 International License."),
        (7, "Released under the MIT License.\nReleased under the MIT License. " + prose),
    ]
    got = {r["doc_id"]: (r["n_matches"], r["license"]) for r in licenses.scan_documents(frame(spark, rows)).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "BSD-3-Clause"), 3: (1, "MIT"), 4: (2, "BSD-2-Clause"), 5: (1, "CC-BY-SA-4.0"), 6: (0, None), 7: (2, "MIT"), 8: (2, "CC-BY-4.0")}


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.count()
        assert 0 < after <= before
        before = after
    sets = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(c == d for d, (_, c) in brute.components(sets).items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {d for d, _ in sets}
