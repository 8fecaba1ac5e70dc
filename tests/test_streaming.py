"""Streamed distances against batches over all rows so far."""

import numpy as np
import pytest

from conforma.operators import density as D
from conforma.streaming import distances as S

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "ensemble int, feature int, value double"


def test_binned_densities_keep_their_error_bound(spark):
    rng = np.random.default_rng(1)
    rows = [(e, f, float(v)) for e in (0, 1) for f in (0, 1) for v in rng.normal(e, 1 + f, 300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    keys = ["ensemble", "feature"]
    exact = {(r["ensemble"], r["feature"]): r for r in D.densities(df, keys, -9.0, 9.0).collect()}
    for fine in (200, 4096):
        for r in D.binned_densities(df, keys, -9.0, 9.0, fine=fine).collect():
            want = exact[r["ensemble"], r["feature"]]
            step = 18 / (fine - 1)
            assert (r["n"], r["h"]) == pytest.approx((want["n"], want["h"]))
            assert np.abs(np.array(r["sums"]) - want["sums"]).max() <= r["n"] * step**2 / (8 * r["h"] ** 2) + 1e-9
    weighted = {(r["ensemble"], r["feature"]): r["sums"] for r in D.binned_densities(df.selectExpr("*", "2.0 AS weight"), keys, -9.0, 9.0, on_degenerate="zero").collect()}
    assert weighted.keys() == exact.keys()
    flat = spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0)], SCHEMA)
    assert set(D.binned_densities(flat, keys, 0.0, 2.0, on_degenerate="zero").first()["sums"]) == {0.0}
    with pytest.raises(Exception, match="no density"):
        D.binned_densities(flat, keys, 0.0, 2.0).collect()


def test_stream_equals_batch_after_each_micro_batch_and_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        rng = np.random.default_rng(2)
        lo, hi = -6.0, 8.0
        reference = spark.createDataFrame([(f, float(v)) for f in (0, 1) for v in rng.normal(f, 1, 200)], "feature int, value double")
        known = S.reference_densities(reference, lo, hi)
        # the second batch holds rows that come late; a feature without a reference, a null and one lone value are among them
        batches = [[(e, f, float(v)) for e in (1, 2) for f in (0, 1) for v in rng.normal(e * b, 1, 40)] for b in range(3)]
        batches[1] += [(1, 7, 1.0), (1, 0, None), (3, 0, 2.0)]
        source, seen, emitted = str(tmp_path / "in"), [], {}
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

        def keep(df, _):
            emitted.update({(r["ensemble"], r["feature"]): r for r in df.collect()})

        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            seen += rows
            # a new query on the same checkpoint: a restart before every batch
            q = S.streamed_distances(stream, known, lo, hi).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
            q.awaitTermination()
            assert not q.exception()
            groups = {}
            for e, f, v in seen:
                groups.setdefault((e, f), []).extend([v] if v is not None else [])
            assert emitted.keys() == groups.keys()
            for key, x in groups.items():
                got, x = emitted[key], np.array(x)
                assert got["n"] == len(x) and got["mean"] == pytest.approx(x.mean())
                if len(x) < 2 or key[1] not in known:
                    assert got["jsd"] is None
                    continue
                _, h = D.moments_width(np.array([len(x)]), np.array([(x - lo).sum()]), np.array([((x - lo) ** 2).sum()]))
                sums = D.sums_of_bins(D.linear_bins(x, np.ones(len(x)), lo, hi, S.FINE)[None], h, lo, hi)
                assert got["jsd"] == pytest.approx(D.jensen_shannon(sums, known[key[1]][None])[0], abs=1e-9)
                assert got["sd"] == pytest.approx(x.std(ddof=1))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
