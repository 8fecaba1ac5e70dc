import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conforma.operators import bootstrap as B
from conforma.operators import compare as C
from conforma.operators import density as D
from conforma.operators import ranktest as R

WIDE = "ensemble int, frame long, vals array<double>"


def ensembles(spark, seed=0, n=(40, 30, 50), features=3):
    rng = np.random.default_rng(seed)
    rows = [(e, f, [float(x) for x in rng.normal(e * 0.3, 1 + e * 0.2, features)]) for e, k in enumerate(n) for f in range(k)]
    return spark.createDataFrame(rows, WIDE).repartition(3)


def test_range_and_nan(spark):
    r = D.value_range(spark.createDataFrame([(0, 0, [1.0, 5.0]), (1, 0, [-2.0, 3.0])], WIDE)).first()
    assert (r["lo"], r["hi"]) == (-2.0, 5.0)
    r = D.value_range(spark.createDataFrame([(0, 0, [1.0, float("nan")])], WIDE)).first()
    assert math.isnan(r["lo"]) and math.isnan(r["hi"])


def test_bandwidth(spark):
    x = np.random.default_rng(1).normal(size=100)
    x = (x - x.mean()) / x.std(ddof=1)
    df = spark.createDataFrame([(0, float(v)) for v in x], "feature int, value double")
    assert D.bandwidth(df, ["feature"]).first()["h"] == pytest.approx(75 ** (-1 / 5))
    weighted = df.withColumn("weight", F.lit(2.0))
    assert D.bandwidth(weighted, ["feature"]).first()["sd"] == pytest.approx(np.repeat(x, 2).std(ddof=1))
    flat = spark.createDataFrame([(0, 1.0), (0, 1.0)], "feature int, value double")
    assert D.bandwidth(flat, ["feature"], "zero").first()["h"] == 0
    with pytest.raises(Exception, match="no density"):
        D.bandwidth(flat, ["feature"]).collect()
    with pytest.raises(ValueError):
        D.bandwidth(flat, ["feature"], "ignore")


def test_density_is_the_textbook_sum(spark):
    x = np.random.default_rng(2).normal(size=57)
    df = spark.createDataFrame([(0, 0, float(v)) for v in x], "ensemble int, feature int, value double").repartition(5)
    keys = ["ensemble", "feature"]
    got = D.pdf_points(D.densities(df, keys, -3.0, 3.0), keys, -3.0, 3.0).orderBy("k").collect()
    h = x.std(ddof=1) * (57 * 0.75) ** -0.2
    grid = np.linspace(-3, 3, 100)
    want = np.exp(-(((grid[:, None] - x) / h) ** 2) / 2).sum(axis=1) / (57 * h * np.sqrt(2 * np.pi))
    assert [r["x"] for r in got] == pytest.approx(grid) and [r["p"] for r in got] == pytest.approx(want)


def test_distance_is_a_metric_in_the_unit_interval():
    rng = np.random.default_rng(3)
    p, q = rng.random((5, 20)), rng.random((5, 20))
    d = D.jensen_shannon(p, q)
    assert (d > 0).all() and (d < 1).all() and d == pytest.approx(D.jensen_shannon(q, p))
    assert D.jensen_shannon(p, 3 * p) == pytest.approx(0, abs=1e-7)
    assert D.jensen_shannon(np.array([[1.0, 0]]), np.array([[0, 1.0]])) == pytest.approx(1)
    assert D.jensen_shannon(np.zeros((1, 4)), p[:1, :4]) == 0


def test_schedule():
    assert len(B.draw_table(5)) == 70 and len(B.pair_schedule(5)) == 45
    assert len(B.draw_table(5, "v1")) == 10 and len(B.pair_schedule(5, "v1")) == 45
    for variant in ("v1", "v2"):
        sides = dict(B.draw_table(5, variant))
        for kind, _, a, b in B.pair_schedule(5, variant):
            assert (sides[a] != sides[b]) == (kind == "inter")
    used = [d for _, _, a, b in B.pair_schedule(5) for d in (a, b)]
    assert sorted(set(used)) == list(range(70))
    with pytest.raises(ValueError):
        B.pair_schedule(1)


def test_frame_index_is_dense_in_frame_order(spark):
    rows = [(e, f * 5000 + e, [0.0]) for e in (0, 1) for f in range(50)]
    got = B.frame_index(spark.createDataFrame(rows, WIDE).repartition(4)).orderBy("ensemble", "frame").collect()
    assert [r["idx"] for r in got] == list(range(50)) * 2 and {r["n"] for r in got} == {50}


def test_draws_have_the_asked_size_and_depend_on_the_seed(spark):
    got = B.draws(spark, {0: 20, 1: 30}, 0, 2, 100, 7)
    assert {r["n"] for r in got.groupBy("ensemble", "draw").agg(F.sum("weight").alias("n")).collect()} == {100.0}
    again, other = (sorted(map(tuple, B.draws(spark, {0: 20, 1: 30}, 0, 2, 100, s).collect())) for s in (7, 8))
    assert sorted(map(tuple, got.collect())) == again != other


def test_drawn_frames_filter_the_wide_table_before_its_values_are_shuffled(spark):
    wide = ensembles(spark, n=(200, 300))
    drawn = B.draws(spark, {0: 200, 1: 300}, 0, 2, 3, 5)
    for most in (None, 100):
        got = B.drawn_values(wide, drawn, most)
        rows = {(r["source"], r["idx"]): r["weight"] for r in drawn.groupBy("source", "idx").agg(F.sum("weight").alias("weight")).collect()}
        assert got.where("feature = 0").agg(F.sum("weight")).first()[0] == sum(rows.values())
        values = {(r["ensemble"], r["frame"]): r["vals"] for r in wide.collect()}
        assert {r["value"] for r in got.where("feature = 1").collect()} == {values[k][1] for k in rows}
    plan = B.drawn_values(wide, drawn, 100)._jdf.queryExecution().executedPlan().toString()
    semi = plan[plan.index("LeftSemi") :].split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in semi


def test_older_version_compares_stacked_ensembles_with_the_first(spark):
    # ranges come from all ensembles stacked; then each is compared with the first
    wide = ensembles(spark, n=(60, 60, 60))
    lo, hi = C.bounds(wide)
    alone = {}
    for e in (1, 2):
        pair = wide.where(F.col("ensemble").isin(0, e))
        got = C.compare(pair, 0, s_num=3, sample_size=50, variant="v1", lo=lo, hi=hi).collect()
        assert {r["ensemble"] for r in got} == {e} and all(0 <= r["local"] <= r["jsd"] <= 1 for r in got)
        alone |= {(e, r["feature"]): (r["jsd"], r["local"]) for r in got}
    both = {(r["ensemble"], r["feature"]): (r["jsd"], r["local"]) for r in C.compare(wide, 0, s_num=3, sample_size=50, variant="v1", lo=lo, hi=hi).collect()}
    assert both.keys() == alone.keys() and all(both[k][0] == pytest.approx(alone[k][0]) for k in both)


def test_mann_whitney_by_hand(spark):
    rows = [("inter", v) for v in (1.0, 2.0, 2.0, 5.0)] + [("intra", v) for v in (2.0, 3.0, 7.0)]
    df = spark.createDataFrame([(0, k, v) for k, v in rows], "ensemble int, kind string, value double")
    r = R.mann_whitney(df, ["ensemble"]).first()
    # ranks 1, 3, 3, 6 against 3, 5, 7; one tie of three
    u = max(13 - 10, 12 - 3)
    sd = math.sqrt(12 / 12 * (8 - 24 / 42))
    assert (r["n1"], r["n2"], r["u"]) == (4, 3, u)
    assert r["z"] == pytest.approx((u - 6 - 0.5) / sd) and r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)))
    assert R.mann_whitney(df, ["ensemble"], exact_erfc=False).first()["p"] == pytest.approx(r["p"], abs=1e-6)


def test_exact_test_counts_all_arrangements():
    from itertools import combinations

    n1, n2 = 4, 5
    us = [sum(x) + n1 - n1 * (n1 + 1) // 2 for x in combinations(range(n1 + n2), n1)]
    for u in range(10, 21):
        assert R.exact_p(u, n1, n2) == pytest.approx(min(1, 2 * sum(v >= u for v in us) / len(us)))


def test_gate_keeps_values_of_a_nan_test(spark):
    df = spark.createDataFrame([(0.01,), (0.05,), (0.5,), (float("nan"),)], "p double")
    assert [r[0] for r in df.select(C.gate(F.col("p"), F.lit(2.0))).collect()] == [2.0, 0.0, 0.0, 2.0]


def test_an_ensemble_against_itself_is_not_different(spark):
    one = ensembles(spark, n=(40,)).drop("ensemble")
    both = one.withColumn("ensemble", F.lit(0)).unionByName(one.withColumn("ensemble", F.lit(1)))
    got = C.compare(both.select("ensemble", "frame", "vals"), 0, s_num=2, sample_size=30).collect()
    assert [r["jsd"] for r in got] == pytest.approx([0] * 3, abs=1e-7)


@pytest.mark.parametrize("variant", ["v2", "v1"])
def test_comparison_and_records(spark, variant):
    wide = ensembles(spark)
    lo, hi = C.bounds(wide)
    got = C.compare(wide, -3, s_num=3, sample_size=40, variant=variant, lo=lo, hi=hi, exact_small=variant == "v1")
    records = C.comparison_records(got, variant).orderBy("ensemble_index").collect()
    assert [r["ensemble_index"] for r in records] == [1, 2]
    for r in records:
        assert len(r["local_dissimilarity"]) == 3
        assert r["global_dissimilarity"] == pytest.approx(np.mean(r["local_dissimilarity"]))
        p = r["p_value"]
        assert all(0 <= x <= 1 for x in (p if variant == "v1" else [p]))
    if variant == "v1":
        with pytest.raises(ValueError):
            C.compare(wide, 0, variant="v1")
    with pytest.raises(ValueError):
        C.compare(wide, 9)


def plain_distances(wide, drawn, schedule, lo, hi):
    """Distances of drawn samples from the textbook formulas, one value at a time."""
    values = {(r["ensemble"], r["frame"]): r["vals"] for r in wide.collect()}
    index = {(r["ensemble"], r["idx"]): r["frame"] for r in B.frame_index(wide).collect()}
    grid, samples = np.linspace(lo, hi, 100), {}
    for r in drawn.collect():
        vals = values[r["source"], index[r["source"], r["idx"]]]
        for f, v in enumerate(vals):
            if "feature" not in r or r["feature"] == f:
                samples.setdefault((r["ensemble"], r["draw"], f), []).extend([v] * int(r["weight"]))
    dens = {}
    for k, x in samples.items():
        x = np.array(x)
        h = x.std(ddof=1) * (len(x) * 0.75) ** -0.2
        dens[k] = np.exp(-(((grid[:, None] - x) / h) ** 2) / 2).sum(axis=1)
    out = {}
    for e, f in {(e, f) for e, _, f in dens}:
        for kind, pair, a, b in schedule:
            out[e, kind, pair, f] = D.jensen_shannon(dens[e, a, f][None], dens[e, b, f][None])[0]
    return out


@pytest.mark.parametrize("variant", ["v1", "v2"])
def test_distances_of_samples_equal_the_textbook(spark, variant, monkeypatch):
    monkeypatch.setattr(B, "FEATURE_BLOCK", 2)
    wide = ensembles(spark, n=(20, 25, 30), features=5)
    drawn = B.draws(spark, {0: 20, 1: 25, 2: 30}, 0, 2, 40, 3, variant, 5)
    got = B.sampled_distances(B.drawn_frames(wide, drawn), B.pair_schedule(2, variant), -5.0, 6.0, 5, 40)
    want = plain_distances(wide, drawn, B.pair_schedule(2, variant), -5.0, 6.0)
    rows = {(r["ensemble"], r["kind"], r["pair"], r["feature"]): r["value"] for r in got.collect()}
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_degenerate_samples_stop_or_give_zero(spark):
    wide = spark.createDataFrame([(e, f, [1.0, float(f)]) for e in (0, 1) for f in range(9)], WIDE)
    with pytest.raises(Exception, match="no density"):
        C.bootstrap_distances(wide, 0, 2, 10, lo=0.0, hi=9.0).collect()
    rows = C.bootstrap_distances(wide, 0, 2, 10, lo=0.0, hi=9.0, on_degenerate="zero").collect()
    assert {r["value"] for r in rows if r["feature"] == 0} == {0.0} and any(r["value"] > 0 for r in rows)


def plain_ranks(rows):
    """(n1, n2, rank sum, ties) of (kind, value) rows, by sorting."""
    values = sorted(v for _, v in rows)
    first = {v: values.index(v) for v in values}
    count = {v: values.count(v) for v in values}
    rank = lambda v: first[v] + (count[v] + 1) / 2
    n1 = sum(k == "inter" for k, _ in rows)
    return (float(n1), float(len(rows) - n1), sum(rank(v) for k, v in rows if k == "inter"), float(sum(c**3 - c for c in count.values())))


@pytest.mark.parametrize("range_rows", [1, 7, 100_000])
def test_ranks_by_ranges_equal_one_sort(spark, range_rows):
    rng = np.random.default_rng(9)
    # one group is far larger, one is all ties, and a value spans what cuts would be
    groups = {0: np.round(rng.normal(size=400), 1), 1: np.full(30, 2.5), 2: rng.normal(size=3), 3: np.append(np.zeros(200), rng.normal(size=50))}
    rows = [(g, "inter" if rng.random() < 0.4 else "intra", float(v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "g int, kind string, value double").repartition(5)
    got = {r["g"]: (r["n1"], r["n2"], r["r1"], r["ties"]) for r in R.rank_sums(df, ["g"], range_rows).collect()}
    assert got == {g: plain_ranks([(k, v) for h, k, v in rows if h == g]) for g in groups}
    assert R.rank_sums(df.limit(0), ["g"], range_rows).count() == 0
