"""Registered queries of the ensemble operators, each over whole tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import atoms, bootstrap, compare, components, density, embedding, measures, ranktest, reduce
from .plans import figures, pictures
from .streaming.moments import windowed_moments

REF = 0
S_NUM, SAMPLE, SEED = 5, bootstrap.SAMPLE_SIZE, 0
#: The gate's own query draws so few frames that some features stay insignificant, so both of its branches are met.
GATE_SAMPLE = 50
#: Frames whose number this divides are compared with all frames.
QUERY_FRAMES = 50
#: Neighbours of nearest_frames, and the ensemble of pca_points.
NEAREST, ONE = 15, 1
#: Distance in nm under which near_atoms counts an atom.
REACH = 0.8
#: Pixels of the picture of heatmap_pixels each way: fewer than frames and than features, so pixels are means.
PICTURE_SIDE = 16


def rounded(c: str | Column, digits: int = 6) -> Column:
    # adding 0 turns -0.0 into 0.0
    return F.round(c, digits) + F.lit(0.0)


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return model.rep_of_embeddings(spark, d)


def _selected(spark: SparkSession, name: str) -> DataFrame:
    topology = model.beta_atoms_of_embeddings(spark) if name == "CB" else model.atoms_of_embeddings(spark)
    return atoms.select_atoms(topology, name)


# -- atoms, pairs, measures --------------------------------------------------------------------------------------------


def atom_select(spark, d):
    chosen = F.broadcast(_selected(spark, "CB"))
    got = atoms.coordinates(model.frames_of_embeddings(spark, d)).join(chosen, "atom")
    return got.select("ensemble", "frame", F.col("pos").cast("int").alias("pos"), *[rounded(c).alias(c) for c in "xyz"])


def pair_distances(spark, d):
    got = atoms.pair_distances(model.frames_of_embeddings(spark, d), atoms.pair_table(_selected(spark, "CB")))
    return got.select("ensemble", "frame", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), rounded("d").alias("d"))


def pair_degrees(spark, d):
    pairs = atoms.incident_pairs(atoms.pair_table(_selected(spark, "CB")))
    frames = atoms.coordinates(model.frames_of_embeddings(spark, d)).join(F.broadcast(_selected(spark, "CB")), "atom")
    degrees = F.broadcast(pairs.groupBy("pos").agg(F.count("*").alias("partners")))
    met = frames.join(degrees, "pos", "left")
    return met.groupBy("ensemble", F.col("pos").cast("int").alias("pos")).agg(F.sum(F.coalesce("partners", F.lit(0))).alias("pair_rows"))


def _measure(spark, d, measure: str, variant: str = "v2") -> DataFrame:
    topology = model.beta_atoms_of_embeddings(spark) if measure == "cbcn" else model.atoms_of_embeddings(spark)
    return measures.represent(model.frames_of_embeddings(spark, d), topology, measure, variant)


def _measure_rows(spark, d, measure: str, variant: str = "v2") -> DataFrame:
    return model.to_long(_measure(spark, d, measure, variant)).select("ensemble", "frame", "feature", rounded("value").alias("value"))


def contact_cb(spark, d):
    return _measure_rows(spark, d, "cbcn")


def contact_ca(spark, d):
    return _measure_rows(spark, d, "cacn")


def bond_angle(spark, d):
    return _measure_rows(spark, d, "caba")


def bond_angle_v1(spark, d):
    return _measure_rows(spark, d, "caba", "v1")


def torsion(spark, d):
    return _measure_rows(spark, d, "cata")


def sasa(spark, d):
    return _measure_rows(spark, d, "sasa")


def near_atoms(spark, d):
    """Atoms nearer than REACH to each atom, by the cells that surfaces use."""
    got = measures.neighbours(model.frames_of_embeddings(spark, d), REACH)
    return got.select("ensemble", "frame", "atom", F.col("n").alias("near"), rounded("nearest").alias("nearest"))


def rep_long_to_wide(spark, d):
    wide = model.to_wide(model.to_long(_embeddings(spark, d)))
    return wide.select("ensemble", "frame", F.size("vals").alias("n"), *[rounded(F.element_at("vals", k + 1)).alias(f"f{k}") for k in (0, 31, 63)])


# -- densities and distances -------------------------------------------------------------------------------------------


def value_range(spark, d):
    return density.value_range(_embeddings(spark, d)).select(rounded("lo").alias("lo"), rounded("hi").alias("hi"))


def bandwidth(spark, d):
    got = density.bandwidth(model.to_long(_embeddings(spark, d)), ["ensemble", "feature"])
    return got.select("ensemble", "feature", F.col("n").cast("long").alias("n"), rounded("sd").alias("sd"), rounded("h").alias("h"))


def bandwidth_lineitem(spark, d):
    got = density.bandwidth(model.rep_of_lineitem(spark, d), ["ensemble", "feature"])
    return got.select("ensemble", "feature", F.col("n").cast("long").alias("n"), rounded("sd", 4).alias("sd"), rounded("h", 4).alias("h"))


def kde_pdf(spark, d):
    wide = _embeddings(spark, d)
    lo, hi = compare.bounds(wide)
    keys = ["ensemble", "feature"]
    points = density.pdf_points(density.densities(model.to_long(wide), keys, lo, hi), keys, lo, hi)
    return points.select("ensemble", "feature", "k", rounded("x").alias("x"), rounded("p").alias("p"))


def kde_pdf_binned(spark, d):
    """kde_pdf by linear bins, in one pass over the values."""
    wide = _embeddings(spark, d)
    lo, hi = compare.bounds(wide)
    keys = ["ensemble", "feature"]
    points = density.pdf_points(density.binned_densities(model.to_long(wide), keys, lo, hi), keys, lo, hi)
    return points.select("ensemble", "feature", "k", rounded("p").alias("p"))


def kde_pdf_events(spark, d):
    rep = model.rep_of_events(spark, d)
    r = density.long_range(rep).first()
    keys = ["ensemble", "feature"]
    points = density.pdf_points(density.densities(rep, keys, r["lo"], r["hi"]), keys, r["lo"], r["hi"])
    return points.select("ensemble", "k", rounded("x").alias("x"), rounded("p").alias("p"))


def _local(spark, d):
    return compare.local_dissimilarity(_embeddings(spark, d), REF)


def jsd_local(spark, d):
    return _local(spark, d).select("ensemble", "feature", rounded("jsd").alias("jsd"))


def jsd_global(spark, d):
    return _local(spark, d).groupBy("ensemble").agg(rounded(F.avg("jsd")).alias("jsd"))


# -- bootstrap and test ------------------------------------------------------------------------------------------------


def _draws(spark, d, variant: str) -> DataFrame:
    return bootstrap.draws(spark, compare.ensemble_sizes(_embeddings(spark, d)), REF, S_NUM, SAMPLE, SEED, variant, 64)


def bootstrap_draws(spark, d):
    index = bootstrap.frame_index(_embeddings(spark, d)).select(F.col("ensemble").alias("source"), "frame", "idx")
    got = _draws(spark, d, "v2").join(index, ["source", "idx"])
    return got.select("ensemble", "draw", "source", "frame", F.col("weight").cast("long").alias("weight"))


def bootstrap_draws_v1(spark, d):
    got = _draws(spark, d, "v1")
    return got.select("ensemble", "draw", "feature", "source", "idx", F.col("weight").cast("long").alias("weight"))


def _distances(spark, d, variant: str) -> DataFrame:
    return compare.bootstrap_distances(_embeddings(spark, d), REF, S_NUM, SAMPLE, seed=SEED, variant=variant)


def jsd_bootstrap(spark, d):
    return _distances(spark, d, "v2").select("ensemble", "kind", "pair", "feature", rounded("value").alias("value"))


def mann_whitney(spark, d):
    got = ranktest.mann_whitney(_distances(spark, d, "v2"), ["ensemble"], exact_erfc=False)
    return got.select("ensemble", "n1", "n2", rounded("u", 1).alias("u"), rounded("z").alias("z"), rounded("p").alias("p"))


def mann_whitney_v1(spark, d):
    got = ranktest.mann_whitney(_distances(spark, d, "v1"), ["ensemble", "feature"], exact_erfc=False)
    return got.select("ensemble", "feature", "n1", "n2", rounded("u", 1).alias("u"), rounded("z").alias("z"), rounded("p").alias("p"))


def _compared(spark, d, variant: str = "v2", sample: int = SAMPLE) -> DataFrame:
    wide = _embeddings(spark, d)
    lo, hi = compare.bounds(wide)
    return compare.compare(wide, REF, s_num=S_NUM, sample_size=sample, seed=SEED, variant=variant, lo=lo, hi=hi, exact_erfc=False)


def significance_gate(spark, d):
    got = _compared(spark, d, "v1", GATE_SAMPLE)
    return got.select("ensemble", "feature", rounded("jsd").alias("jsd"), rounded("local").alias("gated"), rounded("p").alias("p"))


def compare_ensembles(spark, d):
    got = _compared(spark, d)
    return got.select("ensemble", "feature", rounded("local").alias("local"), rounded(F.avg("local").over(_by_ensemble())).alias("global_dissimilarity"), rounded("p").alias("p"))


def compare_ensembles_v1(spark, d):
    got = _compared(spark, d, "v1").groupBy("ensemble")
    return got.agg(rounded(F.avg("local")).alias("global_dissimilarity"), F.sum((F.col("local") > 0).cast("long")).alias("significant"))


def _by_ensemble():
    from pyspark.sql import Window

    return Window.partitionBy("ensemble")


# -- sets, figures, results --------------------------------------------------------------------------------------------


def exclude_reference(spark, d):
    got = compare.exclude_reference(_embeddings(spark, d), REF).groupBy("ensemble")
    return got.agg(F.count("*").alias("frames"), rounded(F.avg(F.element_at("vals", 1))).alias("mean0"))


def stack_ensembles(spark, d):
    """Every ensemble, named by its place in their order: one scan."""
    return atoms.number_ensembles(_embeddings(spark, d)).select("ensemble", "frame", rounded(F.element_at("vals", 1)).alias("f0"))


def concat_trajectories(spark, d):
    """All ensembles, in their order, as one trajectory: one index of the whole table."""
    got = atoms.joined_trajectory(_embeddings(spark, d))
    return got.select("frame", F.col("source_frame").alias("vec_id"))


def heatmap_cells(spark, d):
    got = figures.heatmap_cells(_measure(spark, d, "cbcn"))
    return got.select("ensemble", "y", "x", rounded("value").alias("value"), "vmin", "vmax")


def heatmap_pixels(spark, d):
    got = pictures.pixels(_measure(spark, d, "cbcn"), PICTURE_SIDE, PICTURE_SIDE)
    return got.select("ensemble", "py", "px", "n", rounded("value").alias("value"))


def heatmap_ticks(spark, d):
    return figures.heatmap_ticks(_measure(spark, d, "cbcn"))


def _records(spark, d) -> DataFrame:
    return compare.comparison_records(_compared(spark, d))


def local_axis(spark, d):
    got = figures.local_lines(_records(spark, d))
    return got.select("ensemble_index", F.col("x").cast("int").alias("x"), rounded("y").alias("y"), F.col("step").cast("int").alias("step"))


def combined_local(spark, d):
    got = figures.local_lines(_records(spark, d))
    return got.select("legend", "colour", F.col("x").cast("int").alias("x"), rounded("y").alias("y"))


def palette_global_bar(spark, d):
    return figures.global_bars(_records(spark, d)).select("ensemble_index", rounded("y").alias("y"), "colour")


def palette_global_line(spark, d):
    return figures.global_line(_records(spark, d)).select("ensemble_index", rounded("y").alias("y"), "colour", "marker")


def comparison_json(spark, d):
    records = _records(spark, d)
    schema = records.drop("ensemble_index").schema
    back = figures.records_json(records).select("ensemble_index", F.from_json("json", schema).alias("r"))
    return back.select("ensemble_index", rounded("r.global_dissimilarity").alias("global_dissimilarity"), F.size("r.local_dissimilarity").alias("features"), rounded(F.array_max("r.local_dissimilarity")).alias("largest"), rounded("r.p_value").alias("p_value"))


def pairwise_distance_matrix(spark, d):
    """Distances of every frame whose number QUERY_FRAMES divides, a stated query set, to all frames."""
    wide = _embeddings(spark, d)
    return reduce.distances_from(wide.where(F.col("frame") % QUERY_FRAMES == 0), wide).select("frame_a", "frame_b", rounded("d").alias("d"))


def nearest_frames(spark, d):
    """The NEAREST nearest other frames of every frame, as the neighbour embedding finds them."""
    got = embedding.nearest_frames(_embeddings(spark, d), NEAREST)
    return got.select("frame_a", "rank", "frame_b", rounded("d").alias("d"))


def pca(spark, d):
    got = figures.scatter(reduce.pca(_embeddings(spark, d)))
    return got.select("ensemble", "frame", rounded("c1", 5).alias("c1"), rounded("c2", 5).alias("c2"), "colour")


def pca_points(spark, d):
    """The projected frames of one ensemble."""
    got = reduce.points_of(reduce.pca(_embeddings(spark, d)), ONE)
    return got.select("frame", rounded("c1", 5).alias("c1"), rounded("c2", 5).alias("c2"))


def pca_variance(spark, d):
    """Variance along the first components, as sums over all features' covariances have it."""
    _, loads, values = components.fit_components(_embeddings(spark, d))
    rows = [(k + 1, float(v), float(loads[:, k].max())) for k, v in enumerate(values)]
    got = spark.createDataFrame(rows, "component int, variance double, largest double")
    return got.select("component", rounded("variance").alias("variance"), rounded("largest", 5).alias("largest"))


def mds(spark, d):
    return figures.scatter(reduce.mds(_embeddings(spark, d)))


def tsne(spark, d):
    return figures.scatter(reduce.tsne(_embeddings(spark, d)))


def event_moments(spark, d):
    rep = model.table(spark, d, "events").select("ts", F.col("event_type").alias("ensemble"), F.col("value").cast("double").alias("value"))
    got = windowed_moments(rep, window="1 day")
    return got.select(F.col("window_start").cast("date").alias("day"), "ensemble", "n", *[rounded(c, 4).alias(c) for c in ("mean", "sd", "lo", "hi")])


ROWS_ONLY = ("mds", "tsne")
ALL = [
    atom_select, pair_distances, pair_degrees, contact_cb, contact_ca, bond_angle, bond_angle_v1, torsion, sasa, near_atoms, rep_long_to_wide,
    value_range, bandwidth, bandwidth_lineitem, kde_pdf, kde_pdf_binned, kde_pdf_events, jsd_local, jsd_global, bootstrap_draws, bootstrap_draws_v1,
    jsd_bootstrap, mann_whitney, mann_whitney_v1, significance_gate, compare_ensembles, compare_ensembles_v1, exclude_reference,
    stack_ensembles, concat_trajectories, heatmap_cells, heatmap_pixels, heatmap_ticks, local_axis, combined_local, palette_global_bar, palette_global_line,
    comparison_json, pairwise_distance_matrix, nearest_frames, pca, pca_points, pca_variance, mds, tsne, event_moments,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
