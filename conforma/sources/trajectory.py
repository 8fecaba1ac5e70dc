"""Loading of trajectories: one file per ensemble, or several files joined into one."""

from __future__ import annotations

import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.atoms import concat_trajectories
from .dcd import DcdSource
from .topology import read_pdb_frames


def resolve_paths(given) -> list[str]:
    """Paths of a list, or of a string: cut at commas if it has any, else a pattern (itself, if nothing matches)."""
    if isinstance(given, (list, tuple)):
        return [str(p) for p in given]
    if not isinstance(given, str):
        raise ValueError("trajectories are a string or a list of paths")
    if "," in given:
        return [p.strip() for p in given.split(",") if p.strip()]
    return sorted(glob.glob(given)) or [given]


def load_trajectory(spark: SparkSession, path: str, ensemble: int = 0, atoms: list[int] | None = None) -> DataFrame:
    """Frames of a DCD or PDB file, or of a Parquet folder of frames. Other formats raise ValueError.

    atoms: of a DCD file, the atoms to read, numbered anew in this order. Filters on frame and ensemble reach its reader.
    """
    kind = path.strip().lower()
    if atoms is not None and not kind.endswith(".dcd"):
        raise ValueError(f"{path}: atoms are chosen while reading .dcd files alone")
    if kind.endswith(".dcd"):
        spark.dataSource.register(DcdSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        source = spark.read.format("dcd").option("ensemble", ensemble).option("pushFilters", "true")
        return (source if atoms is None else source.option("atoms", ",".join(map(str, atoms)))).load(path)
    if kind.endswith(".pdb"):
        return read_pdb_frames(spark, path, ensemble)
    if kind.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).withColumn("ensemble", F.lit(ensemble)).select("ensemble", "frame", "xyz", "cell")
    raise ValueError(f"{path}: only .dcd, .pdb and .parquet trajectories are supported")


def load_trajectories(spark: SparkSession, given, ensemble: int = 0) -> DataFrame:
    """Frames of one or more files as one trajectory."""
    parts = [load_trajectory(spark, p, ensemble) for p in resolve_paths(given)]
    return parts[0] if len(parts) == 1 else concat_trajectories(parts)


def load_ensembles(spark: SparkSession, given) -> DataFrame:
    """Frames of several files, each an ensemble numbered by its place."""
    out = None
    for k, p in enumerate(resolve_paths(given)):
        part = load_trajectory(spark, p, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no trajectory given")
    return out
