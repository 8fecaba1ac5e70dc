"""Atom selection and atom pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bootstrap import frame_index

#: Residues between two atoms of a contact: more than so many apart.
MIN_SEPARATION = 2
#: Rows of a few numbers that may be broadcast; a topology of a thousand selected atoms has half a million pairs.
BROADCAST_ROWS = 2_000_000


def select_atoms(atoms: DataFrame, name: str) -> DataFrame:
    """(pos, atom, res_index) of the atoms of a name, pos from 0 in atom order. A topology is small, so one window does."""
    order = Window.orderBy("atom")
    return atoms.where(F.col("name") == name).select((F.row_number().over(order) - 1).alias("pos"), "atom", "res_index")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if rows, its counted size, is within BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def pair_table(selected: DataFrame, separation: int = MIN_SEPARATION) -> DataFrame:
    """Unordered pairs (i, j) of positions, i < j, whose residues are more than separation apart."""
    a, b = selected.alias("a"), small(selected, selected.count()).alias("b")
    far = (F.col("a.pos") < F.col("b.pos")) & (F.abs(F.col("a.res_index") - F.col("b.res_index")) > separation)
    return a.join(b, far).select(F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), F.col("a.atom").alias("atom_i"), F.col("b.atom").alias("atom_j"))


def incident_pairs(pairs: DataFrame) -> DataFrame:
    """(pos, partner): each pair seen from both of its atoms."""
    return pairs.select(F.explode(F.array(F.struct(F.col("i").alias("pos"), F.col("j").alias("partner")), F.struct(F.col("j").alias("pos"), F.col("i").alias("partner")))).alias("p")).select("p.*")


def pair_distances(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ensemble, frame, i, j, d) of each pair in each frame. The pair table goes to the frames: frames aren't shuffled.

    The result has a row for every frame and pair; more pairs than may be broadcast raise. Measures take their pairs in
    arrays instead (see measures), whatever their number.
    """
    pairs_count = pairs.count()
    if pairs_count > BROADCAST_ROWS:
        raise ValueError(f"{pairs_count} pairs are too many for a row each; use a measure")

    def axis(k: int):
        return F.element_at("xyz", F.col("atom_i") * 3 + k + 1) - F.element_at("xyz", F.col("atom_j") * 3 + k + 1)

    def image(k: int):
        d = axis(k)
        return F.when(F.col("cell").isNull(), d).otherwise(d - F.element_at("cell", k + 1) * F.rint(d / F.element_at("cell", k + 1)))

    skewed = F.raise_error(F.lit("distances of pairs need orthorhombic cells; measures take skewed ones")).cast("array<double>")
    frames = frames.withColumn("cell", F.when(F.size("cell") > 3, skewed).otherwise(F.col("cell")))
    met = frames.crossJoin(F.broadcast(pairs))
    square = sum((image(k) * image(k) for k in range(3)), F.lit(0.0))
    return met.select("ensemble", "frame", "i", "j", F.sqrt(square).alias("d"))


def coordinates(frames: DataFrame) -> DataFrame:
    """Long form (ensemble, frame, atom, x, y, z) of frames."""
    n = (F.size("xyz") / 3).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda a: F.struct(*[F.element_at("xyz", a * 3 + k + 1).alias(c) for k, c in enumerate("xyz")]))
    exploded = frames.select("ensemble", "frame", F.posexplode(points).alias("atom", "p"))
    return exploded.select("ensemble", "frame", "atom", "p.x", "p.y", "p.z")


def concat_trajectories(parts: list[DataFrame]) -> DataFrame:
    """Frames of several trajectories of one ensemble as one, numbered on in the given order. Frames are from 0 in each part."""
    sizes = [p.agg(F.coalesce(F.max("frame") + 1, F.lit(0)).alias("n")).first()["n"] for p in parts]
    out, before = None, 0
    for p, n in zip(parts, sizes):
        moved = p.withColumn("frame", F.col("frame") + F.lit(before))
        out = moved if out is None else out.unionByName(moved)
        before += n
    if out is None:
        raise ValueError("no trajectory given")
    return out


def stack_ensembles(parts: list[DataFrame]) -> DataFrame:
    """Representations one below the other; ensemble is the position in the list."""
    out = None
    for k, p in enumerate(parts):
        named = p.withColumn("ensemble", F.lit(k))
        out = named if out is None else out.unionByName(named)
    if out is None:
        raise ValueError("no ensemble given")
    return out


def number_ensembles(rep: DataFrame) -> DataFrame:
    """A table of several ensembles with ensemble as the place in their order, in one scan: the ids, a row an ensemble, are counted and joined."""
    ids = [r["ensemble"] for r in rep.select("ensemble").distinct().collect()]
    numbers = rep.sparkSession.createDataFrame([(e, k) for k, e in enumerate(sorted(ids))], "id int, place int")
    return rep.join(small(numbers, len(ids)), rep["ensemble"] == numbers["id"]).withColumn("ensemble", F.col("place")).drop("id", "place")


def joined_trajectory(rep: DataFrame) -> DataFrame:
    """(frame, ensemble, source_frame): all ensembles' frames as one trajectory, ensemble after ensemble in their order.

    One dense index of the whole table gives each frame's place in its ensemble; the ensembles' sizes, a row each, give what lies before.
    """
    index = frame_index(rep)
    sizes = sorted((r["ensemble"], r["n"]) for r in rep.groupBy("ensemble").agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for e, n in sizes:
        offsets.append((e, before))
        before += n
    named = rep.sparkSession.createDataFrame(offsets, "id int, before long")
    return index.join(small(named, len(offsets)), index["ensemble"] == named["id"]).select((F.col("idx") + F.col("before")).alias("frame"), "ensemble", F.col("frame").alias("source_frame"))
