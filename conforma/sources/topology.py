"""PDB topologies and coordinates as text, by fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANGSTROM = 0.1  # in nm


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Atom records with their line and model numbers. A PDB file is one topology, read as one text file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "v"))
    kind = F.trim(F.substring("v", 1, 6))
    order = Window.orderBy("line")
    model = F.sum((kind == "MODEL").cast("int")).over(order)
    return lines.select("line", "v", kind.alias("kind"), model.alias("model")).where(F.col("kind").isin("ATOM", "HETATM"))


def _cell(spark: SparkSession, path: str) -> list[float] | None:
    """Lengths in nm, with the angles unless all are right, of a PDB file's CRYST1 record; None without one or for the unit cube that stands for none."""
    first = spark.read.text(path).where(F.col("value").startswith("CRYST1")).first()
    if first is None:
        return None
    v = [float(first["value"][a:b]) for a, b in ((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54))]
    if v[:3] == [1.0, 1.0, 1.0]:
        return None
    lengths = [x * ANGSTROM for x in v[:3]]
    return lengths if v[3:] == [90.0, 90.0, 90.0] else lengths + v[3:]


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of the first model. res_index counts residues in file order: it rises where chain, number, insertion code or name changes."""
    rows = _records(spark, path)
    first = rows.agg(F.min("model").alias("m")).first()["m"]
    rows = rows.where(F.col("model") == F.lit(first))

    def cut(at: int, n: int):
        return F.trim(F.substring("v", at, n))

    order = Window.orderBy("line")
    residue = F.concat_ws("|", F.substring("v", 22, 1), F.substring("v", 23, 5), cut(18, 3))
    named = rows.select("line", cut(13, 4).alias("name"), cut(77, 2).alias("element"), cut(18, 3).alias("res_name"), cut(22, 1).alias("chain"), residue.alias("residue"))
    fresh = (F.col("residue") != F.lag("residue").over(order)).cast("int")
    guess = F.regexp_extract("name", "([A-Za-z])", 1)
    out = named.withColumn("res_index", F.sum(F.coalesce(fresh, F.lit(0))).over(order).cast("int"))
    return out.select((F.row_number().over(order) - 1).alias("atom"), "name", F.when(F.col("element") == "", guess).otherwise(F.col("element")).alias("element"), "res_index", "res_name", "chain")


def read_pdb_frames(spark: SparkSession, path: str, ensemble: int = 0) -> DataFrame:
    """Frames of a PDB file: one per model. All have the cell of its CRYST1 record, if it has one."""
    rows, cell = _records(spark, path), _cell(spark, path)
    axes = F.array(*[F.trim(F.substring("v", at, 8)).cast("double") * ANGSTROM for at in (31, 39, 47)])
    packed = rows.select("model", "line", axes.alias("p")).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("line", "p"))).alias("a"))
    frame = F.greatest(F.col("model") - 1, F.lit(0)).cast("long")
    return packed.select(F.lit(ensemble).alias("ensemble"), frame.alias("frame"), F.flatten(F.col("a.p")).alias("xyz"), (F.lit(None) if cell is None else F.array(*map(F.lit, cell))).cast("array<double>").alias("cell"))
