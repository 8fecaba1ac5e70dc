"""Distances of arriving frames' densities to a reference, by arbitrary stateful processing.

For every (ensemble, feature) the state holds mergeable sums: number of values, their first two moments, and linear bins. Each
micro-batch adds its values and emits the distance as it then is. The state's size doesn't depend on the number of frames. Rows
count whenever they arrive, so late ones change later distances just as they would in a batch over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import BROADCAST_ROWS
from ..operators.density import GRID, binned_densities, jensen_shannon, linear_bins, moments_width, sums_of_bins

OUT = "ensemble int, feature int, n long, mean double, sd double, jsd double"
#: Points of a state's linear bins; the error of a kernel is as in sums_of_bins.
FINE = 1024


class DistanceState(StatefulProcessor):
    """Sums of one (ensemble, feature), and its distance to the reference's density of the feature; null while it has none."""

    def __init__(self, reference: dict[int, np.ndarray], lo: float, hi: float, fine: int = FINE):
        self.reference, self.lo, self.hi, self.fine = reference, lo, hi, fine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n double, total double, square double, bins array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, square, bins = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0.0, np.zeros(self.fine))
        bins = np.array(bins, float)
        for part in rows:
            x = part["value"].to_numpy(float)
            x = x[~np.isnan(x)]
            d = x - self.lo
            n, total, square = n + len(x), total + d.sum(), square + d @ d
            bins += linear_bins(x, np.ones(len(x)), self.lo, self.hi, self.fine)
        self.sums.update((float(n), float(total), float(square), bins.tolist()))
        ensemble, feature = key
        mean = self.lo + total / n if n else None
        _, h = moments_width(np.array([n]), np.array([total]), np.array([square]), "zero")
        sd = float(np.sqrt(max((square - total * total / n) / (n - 1), 0))) if n > 1 else None
        jsd = None
        if h[0] > 0 and feature in self.reference:
            jsd = float(jensen_shannon(sums_of_bins(bins[None], h, self.lo, self.hi), self.reference[feature][None])[0])
        yield pd.DataFrame({"ensemble": [ensemble], "feature": [feature], "n": [int(n)], "mean": [mean], "sd": [sd], "jsd": [jsd]})

    def close(self) -> None:
        pass


def reference_densities(rep: DataFrame, lo: float, hi: float, fine: int = FINE) -> dict[int, np.ndarray]:
    """Kernel sums of each feature of a reference, a batch with columns feature and value: GRID numbers a feature, counted."""
    dens = binned_densities(rep.selectExpr("CAST(feature AS INT) AS feature", "value"), ["feature"], lo, hi, GRID, fine)
    rows = dens.select("feature", "sums").limit(BROADCAST_ROWS // GRID + 1).collect()
    if len(rows) > BROADCAST_ROWS // GRID:
        raise ValueError("the reference has too many features to go to every task")
    return {r["feature"]: np.array(r["sums"]) for r in rows}


def streamed_distances(rep: DataFrame, reference: dict[int, np.ndarray], lo: float, hi: float, fine: int = FINE) -> DataFrame:
    """OUT of every (ensemble, feature) that a micro-batch of rep (ensemble, feature, value) touches, for output mode update.

    Needs the RocksDB state store. Values beyond lo and hi count at the ends, NaN and null ones not at all.
    """
    rows = rep.selectExpr("CAST(ensemble AS INT) AS ensemble", "CAST(feature AS INT) AS feature", "CAST(value AS DOUBLE) AS value")
    return rows.groupBy("ensemble", "feature").transformWithStateInPandas(DistanceState(reference, lo, hi, fine), OUT, "Update", "None")
