"""Special functions that Spark lacks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Coefficients of the rational approximation 7.1.26 of Abramowitz and Stegun (error under 1.5e-7).
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc_approx(x: Column) -> Column:
    """erfc of x >= 0 as a column expression."""
    t = 1 / (1 + F.lit(ERFC_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERFC_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)


def _erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(v) if v is not None and v == v else float("nan"))


def erfc(x: Column) -> Column:
    """erfc to full precision; used on one row per test."""
    return F.pandas_udf(_erfc, DoubleType())(x)
