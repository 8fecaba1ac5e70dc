"""Dissimilarity of ensembles: density distances, bootstrap test, significance gate, mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .bootstrap import S_NUM, SAMPLE_SIZE, draw_table, draws, drawn_frames, pair_schedule, sampled_distances
from .density import GRID, densities, jsd_between, value_range
from .ranktest import mann_whitney, small_samples_exact

ALPHA = 0.05


def gate(p: Column, value: Column, alpha: float = ALPHA) -> Column:
    """0 where the test isn't significant (p >= alpha). A NaN p leaves the value, as a NaN comparison is false in numpy."""
    return F.when(~F.isnan(p) & (p >= alpha), F.lit(0.0)).otherwise(value)


def resolve_reference(ensembles: list[int], ref: int) -> int:
    """The reference among ascending ensemble ids; a negative ref counts from the end."""
    found = ensembles[ref] if ref < 0 and -ref <= len(ensembles) else ref
    if found not in ensembles:
        raise ValueError(f"no ensemble {ref}")
    return found


def ensemble_sizes(wide: DataFrame) -> dict[int, int]:
    """Frames of each ensemble: one row per ensemble is collected."""
    return {r["ensemble"]: r["n"] for r in wide.groupBy("ensemble").agg(F.count("*").alias("n")).collect()}


def bounds(wide: DataFrame) -> tuple[float, float]:
    r = value_range(wide).first()
    if r["lo"] is None or r["lo"] != r["lo"]:
        raise ValueError("the representation is empty or has NaN values")
    return r["lo"], r["hi"]


def local_dissimilarity(wide: DataFrame, ref: int, x_num: int = GRID, lo: float | None = None, hi: float | None = None, on_degenerate: str = "error") -> DataFrame:
    """(ensemble, feature, jsd) of each other ensemble against ref, on whole ensembles."""
    if lo is None or hi is None:
        lo, hi = bounds(wide)
    values = wide.select("ensemble", F.posexplode("vals").alias("feature", "value"))
    return jsd_between(densities(values, ["ensemble", "feature"], lo, hi, x_num, on_degenerate), ref)


def bootstrap_distances(wide: DataFrame, ref: int, s_num: int = S_NUM, sample_size: int = SAMPLE_SIZE, x_num: int = GRID, seed: int = 0, variant: str = "v2", lo: float | None = None, hi: float | None = None, on_degenerate: str = "error") -> DataFrame:
    """(ensemble, kind, pair, feature, value): distances of the drawn samples, rounded to 9 places so that ranks are stable."""
    if lo is None or hi is None:
        lo, hi = bounds(wide)
    spark, sizes = wide.sparkSession, ensemble_sizes(wide)
    features = wide.select(F.size("vals").alias("n")).first()["n"]
    drawn = draws(spark, sizes, ref, s_num, sample_size, seed, variant, features)
    # no more frames are drawn than there are places, nor than there are frames
    places = (len(sizes) - 1) * len(draw_table(s_num, variant)) * sample_size * (features if variant == "v1" else 1)
    met = drawn_frames(wide, drawn, min(places, sum(sizes.values())))
    return sampled_distances(met, pair_schedule(s_num, variant), lo, hi, features, sample_size, x_num, on_degenerate)


def compare(wide: DataFrame, ref: int = 0, x_num: int = GRID, s_num: int = S_NUM, sample_size: int = SAMPLE_SIZE, seed: int = 0, variant: str = "v2", lo: float | None = None, hi: float | None = None, on_degenerate: str = "error", exact_erfc: bool = True, exact_small: bool = False) -> DataFrame:
    """(ensemble, feature, jsd, local, p, z, u): local is jsd after the gate. v2 tests a comparison as a whole, v1 each feature.

    variant "v1" needs lo and hi, as that version did.
    """
    if variant == "v1" and (lo is None or hi is None):
        raise ValueError("variant v1 needs lo and hi")
    if lo is None or hi is None:
        lo, hi = bounds(wide)
    ref = resolve_reference(sorted(ensemble_sizes(wide)), ref)
    full = local_dissimilarity(wide, ref, x_num, lo, hi, on_degenerate)
    values = bootstrap_distances(wide, ref, s_num, sample_size, x_num, seed, variant, lo, hi, on_degenerate)
    values = stored(values, "bootstrap") if exact_small else values
    keys = ["ensemble", "feature"] if variant == "v1" else ["ensemble"]
    tests = mann_whitney(values, keys, exact_erfc)
    if exact_small:
        tests = small_samples_exact(tests, values, keys)
    joined = full.join(tests, keys)
    return joined.select("ensemble", "feature", "jsd", gate(F.col("p"), F.col("jsd")).alias("local"), "p", "z", "u")


def comparison_records(compared: DataFrame, variant: str = "v2") -> DataFrame:
    """(ensemble_index, global_dissimilarity, local_dissimilarity array, p_value): one row per comparison; v1: p_value is an array."""
    packed = F.array_sort(F.collect_list(F.struct("feature", "local", "p"))).alias("x")
    got = compared.groupBy("ensemble").agg(F.avg("local").alias("global_dissimilarity"), packed)
    p = F.col("x.p") if variant == "v1" else F.element_at("x", 1)["p"]
    return got.select(F.col("ensemble").alias("ensemble_index"), "global_dissimilarity", F.col("x.local").alias("local_dissimilarity"), p.alias("p_value"))


def exclude_reference(df: DataFrame, ref: int) -> DataFrame:
    return df.where(F.col("ensemble") != ref)
