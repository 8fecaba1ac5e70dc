"""Sinks: matrices and projections as CSV text, matrices as pictures, comparisons as JSON, all as Parquet."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import pictures
from ..storage import stored
from .onefile import write_one_file


def output_dir(measure: str, root: str | None = None) -> str:
    """<root>/<measure>_output, or <measure>_output here; made if it is missing."""
    # absolute, as Spark's own working folder may be another
    path = os.path.abspath(os.path.join(root or "", f"{measure}_output"))
    os.makedirs(path, exist_ok=True)
    return path


def csv_lines(wide: DataFrame, order: list[str]) -> DataFrame:
    """(order, value): each frame's vals as one comma-separated line of %.18e numbers.

    Python writes the digits: those of Java's formatter end at the shortest form, and zeros follow.
    """
    schema = ", ".join(f"{c} {t}" for c, t in wide.select(*order).dtypes) + ", value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [",".join([f"{x:.18e}" for x in v]) for v in batch.column("vals").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), pa.array(lines, pa.string())], [*order, "value"])

    return wide.select(*order, "vals").mapInArrow(run, schema)


def write_lines(lines: DataFrame, path: str, single: bool) -> str:
    """Write a column value as lines of text, in order: one file, or a folder of text parts whose order is that of their names."""
    if single:
        return write_one_file(lines, path)
    lines.write.mode("overwrite").text(path)
    return path


def write_matrix_csv(wide: DataFrame, ensemble: int, folder: str, single: bool = False) -> str:
    """ensemble_<i>_matrix.csv: lines that are the frames in order (see write_lines)."""
    rows = csv_lines(wide.where(F.col("ensemble") == ensemble), ["frame"])
    return write_lines(rows.orderBy("frame").select("value"), os.path.join(folder, f"ensemble_{ensemble}_matrix.csv"), single)


def write_matrix_png(wide: DataFrame, ensemble: int, folder: str, side: int = pictures.SIDE) -> str | None:
    """ensemble_<i>_matrix.png: the ensemble's matrix, frames downwards and features to the right, at most side pixels each way.

    Colours run from the floor of the least value to the ceiling of the greatest, as in heatmap_cells. None without cells.
    """
    one = wide.where(F.col("ensemble") == ensemble)
    span = pictures.spans(one).first()
    if not span or not span["cols"] or span["cols"] < 1:
        return None
    low, high = (math.floor(span["low"]), math.ceil(span["high"])) if span["low"] is not None else (0, 0)
    rows = pictures.png_rows(pictures.pixels(one, side, side), min(side, span["rows"]), min(side, span["cols"]), low, high, lambda df: stored(df, "bands"))
    return write_one_file(rows, os.path.join(folder, f"ensemble_{ensemble}_matrix.png"))


def write_projection_csv(reduced: DataFrame, technique: str, folder: str, single: bool = False) -> tuple[str, str]:
    """dim_reduction_<technique>_data.csv and _labels.csv, in the order of ensemble and frame; labels are written as floats."""
    data, labels = (os.path.join(folder, f"dim_reduction_{technique}_{k}.csv") for k in ("data", "labels"))
    for path, vals in ((data, F.array("c1", "c2")), (labels, F.array(F.col("ensemble").cast("double")))):
        lines = csv_lines(reduced.select("ensemble", "frame", vals.alias("vals")), ["ensemble", "frame"])
        write_lines(lines.orderBy("ensemble", "frame").select("value"), path, single)
    return data, labels


def results_json(results: dict[str, DataFrame]) -> str:
    """JSON text of all measures' comparisons, ascending by ensemble: one record per comparison is collected."""
    out = {m: [json.loads(r["j"]) for r in df.orderBy("ensemble_index").select(F.to_json(F.struct(*df.columns)).alias("j")).collect()] for m, df in results.items()}
    return json.dumps(out, indent=4)
