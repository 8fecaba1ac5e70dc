"""Data model: frames of coordinates, topologies, and per-frame features of ensembles, as DataFrames.

frames      ensemble INT, frame BIGINT, xyz ARRAY<DOUBLE> (x0, y0, z0, x1, ... in nm), cell ARRAY<DOUBLE> (box lengths or null)
atoms       atom INT, name STRING, element STRING, res_index INT, res_name STRING, chain STRING
rep         ensemble INT, frame BIGINT, feature INT, value DOUBLE (one row per frame and feature)
wide rep    ensemble INT, frame BIGINT, vals ARRAY<DOUBLE> (in feature order)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = ("cbcn", "cacn", "caba", "cata", "sasa")
TECHNIQUES = ("pca", "mds", "tsne")
#: Rows up to which a side of a join is small enough to broadcast; callers count before they hint.
BROADCAST_ROWS = 1_000_000


def normalise_measure(name: str) -> str:
    """Lower-case measure name without surrounding space; ValueError if there is no such measure."""
    found = str(name).strip().lower()
    if found not in MEASURES:
        raise ValueError(f"unknown measure {name!r}; choose from {', '.join(MEASURES)}")
    return found


def normalise_measures(names) -> list[str]:
    """Measures of a comma-separated string or a list, in order."""
    return [normalise_measure(n) for n in (names.split(",") if isinstance(names, str) else names)]


def normalise_techniques(names) -> list[str]:
    """Techniques of a comma-separated string or a list; None, "" and "none" mean no technique."""
    if names is None or isinstance(names, str) and names.strip().lower() in ("", "none"):
        return []
    out = []
    for n in names.split(",") if isinstance(names, str) else names:
        found = str(n).strip().lower()
        if found not in TECHNIQUES:
            raise ValueError(f"unknown technique {n!r}; choose from {', '.join(TECHNIQUES)}")
        out.append(found)
    return out


def to_long(wide: DataFrame) -> DataFrame:
    """Long form of a wide representation."""
    return wide.select("ensemble", "frame", F.posexplode("vals").alias("feature", "value"))


def to_wide(rep: DataFrame) -> DataFrame:
    """Wide form of a long representation; one shuffle on (ensemble, frame), one row's features per group."""
    packed = rep.groupBy("ensemble", "frame").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("p"))
    return packed.select("ensemble", "frame", F.col("p.value").alias("vals"))


# -- adapters: tables of other kinds seen as ensembles -----------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rep_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a wide representation: ensemble = label, frame = vec_id."""
    vals = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("ensemble"), F.col("vec_id").cast("long").alias("frame"), vals.alias("vals"))


def frames_of_embeddings(spark: SparkSession, sf_dir: str, atoms: int = 21, scale: float = 4.0) -> DataFrame:
    """embeddings as frames: atom a has the coordinates scale * (e[3a], e[3a + 1], e[3a + 2])."""
    xyz = F.transform(F.slice("embedding", 1, 3 * atoms), lambda x: x.cast("double") * scale)
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("ensemble"), F.col("vec_id").cast("long").alias("frame"), xyz.alias("xyz"), F.lit(None).cast("array<double>").alias("cell"))


def atoms_of_embeddings(spark: SparkSession, atoms: int = 21) -> DataFrame:
    """Topology for frames_of_embeddings: a CA in each residue; every seventh residue has no CB."""
    a = F.col("id").cast("int")
    return spark.range(atoms).select(a.alias("atom"), F.lit("CA").alias("name"), F.lit("C").alias("element"), a.alias("res_index"), F.when(a % 7 == 0, "GLY").otherwise("ALA").alias("res_name"), F.lit("A").alias("chain"))


def beta_atoms_of_embeddings(spark: SparkSession, atoms: int = 21) -> DataFrame:
    """The same topology with CB in place of CA where a residue has one."""
    return atoms_of_embeddings(spark, atoms).withColumn("name", F.when(F.col("res_name") == "GLY", "CA").otherwise("CB"))


def rep_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a long representation with one feature; ensembles are the event types in alphabetical order."""
    events = table(spark, sf_dir, "events")
    kinds = [r["event_type"] for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    number = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(None).cast("int"))
    return events.select(number.cast("int").alias("ensemble"), F.col("event_id").cast("long").alias("frame"), F.lit(0).alias("feature"), F.col("value").cast("double").alias("value"))


def rep_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as feature values of each return flag; rows have no frame key, so only order-free operators apply."""
    stack = "stack(4, 0, CAST(l_quantity AS DOUBLE), 1, CAST(l_extendedprice AS DOUBLE), 2, CAST(l_discount AS DOUBLE), 3, CAST(l_tax AS DOUBLE)) AS (feature, value)"
    return table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS ensemble", stack)
