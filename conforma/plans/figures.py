"""Figures as tables (plot specifications): what a plotting library needs, computed in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The palette's names in their order.
PALETTE = ("blue", "orange", "green", "red", "purple", "brown", "pink", "gray", "olive", "cyan", "magenta", "yellow")


def colour(index: Column) -> Column:
    """Palette name of an ensemble; beyond the palette a hex colour that its index decides."""
    names = F.array(*[F.lit(c) for c in PALETTE])
    made = F.concat(F.lit("#"), F.substring(F.md5(index.cast("string")), 1, 6))
    return F.when(index < len(PALETTE), F.element_at(names, F.least(index, F.lit(len(PALETTE) - 1)).cast("int") + 1)).otherwise(made)


def heatmap_cells(wide: DataFrame) -> DataFrame:
    """(ensemble, y, x, value, vmin, vmax): a cell for each value, y the frame's and x the feature's number; vmin and vmax are the ensemble's least and largest value, rounded outwards."""
    span = wide.groupBy("ensemble").agg(F.floor(F.min(F.array_min("vals"))).cast("long").alias("vmin"), F.ceil(F.max(F.array_max("vals"))).cast("long").alias("vmax"))
    # one row an ensemble, far fewer than frames
    met = wide.join(span, "ensemble")
    return met.select("ensemble", F.col("frame").alias("y"), F.posexplode("vals").alias("x", "value"), "vmin", "vmax")


def heatmap_ticks(wide: DataFrame) -> DataFrame:
    """(ensemble, tick): whole-number colour-bar ticks from floor(min), in steps of 1, 5 or 10, until ceil(max) is reached or passed."""
    span = wide.groupBy("ensemble").agg(F.floor(F.min(F.array_min("vals"))).cast("long").alias("lo"), F.ceil(F.max(F.array_max("vals"))).cast("long").alias("hi"))
    width = F.col("hi") - F.col("lo")
    step = F.when(width <= 10, 1).when(width <= 50, 5).otherwise(10).cast("long")
    count = F.ceil(width / step).cast("long")
    return span.select("ensemble", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count), lambda k: F.col("lo") + k * step)).alias("tick"))


def global_bars(records: DataFrame) -> DataFrame:
    """(ensemble_index, y, colour) of the global dissimilarities."""
    return records.select("ensemble_index", F.col("global_dissimilarity").alias("y"), colour(F.col("ensemble_index")).alias("colour"))


def global_line(records: DataFrame, line_colour: str = "black", marker: str = "o") -> DataFrame:
    return records.select("ensemble_index", F.col("global_dissimilarity").alias("y"), F.lit(line_colour).alias("colour"), F.lit(marker).alias("marker"))


def axis_step(n: Column) -> Column:
    return F.when(n <= 20, 2).when(n <= 50, 5).otherwise(10)


def local_lines(records: DataFrame, line_colour: str | None = None) -> DataFrame:
    """(ensemble_index, x, y, step, colour, legend): local dissimilarities; x counts features from 1. No rows for no comparison."""
    n = F.size("local_dissimilarity")
    shown = F.lit(line_colour) if line_colour else colour(F.col("ensemble_index"))
    rows = records.select("ensemble_index", n.alias("n"), F.posexplode("local_dissimilarity").alias("k", "y"))
    legend = F.concat(F.lit("Ensemble "), F.col("ensemble_index").cast("string"))
    return rows.select("ensemble_index", (F.col("k") + 1).alias("x"), "y", axis_step(F.col("n")).alias("step"), shown.alias("colour"), legend.alias("legend"))


def scatter(reduced: DataFrame) -> DataFrame:
    """(ensemble, frame, c1, c2, colour) of projected frames; an ensemble has the colour that its bar has."""
    return reduced.select("ensemble", "frame", "c1", "c2", colour(F.col("ensemble")).alias("colour"))


def replot_global(records: DataFrame, kind: str = "bar", color: str | None = None, xlabel: str = "Ensemble index", ylabel: str = "Global dissimilarity", title: str | None = None) -> DataFrame:
    """Bars or line of global dissimilarities with the caller's styling as columns."""
    if kind not in ("bar", "line"):
        raise ValueError("kind is 'bar' or 'line'")
    base = global_bars(records) if kind == "bar" else global_line(records)
    styled = base.withColumn("colour", F.lit(color)) if color else base
    return styled.withColumns({"xlabel": F.lit(xlabel), "ylabel": F.lit(ylabel), "title": F.lit(title).cast("string")})


def replot_local(records: DataFrame, ensemble_index: int, color: str | None = None, xlabel: str = "Residue", ylabel: str = "Local dissimilarity", title: str | None = None) -> DataFrame:
    """Local line of one comparison, with the caller's styling as columns; ValueError if there is no such comparison."""
    one = comparison_of(records, ensemble_index)
    return local_lines(one, color).withColumns({"xlabel": F.lit(xlabel), "ylabel": F.lit(ylabel), "title": F.lit(title).cast("string")})


def comparison_of(records: DataFrame, ensemble_index: int) -> DataFrame:
    one = records.where(F.col("ensemble_index") == ensemble_index)
    if not one.take(1):
        raise ValueError(f"no comparison with ensemble {ensemble_index}")
    return one


def records_json(records: DataFrame) -> DataFrame:
    """(ensemble_index, json): each comparison as JSON."""
    return records.select("ensemble_index", F.to_json(F.struct("ensemble_index", "global_dissimilarity", "local_dissimilarity", "p_value")).alias("json"))
