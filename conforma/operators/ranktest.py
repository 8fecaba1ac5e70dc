"""Mann-Whitney U test, two-sided, with tie and continuity corrections."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import erfc, erfc_approx
from ..storage import stored

#: With so few values in the smaller sample and no ties, the exact distribution is used (if asked for).
EXACT_UP_TO = 8
#: Different values of a group ranked in one range; a group has at most MOST_RANGES ranges.
RANGE_ROWS = 100_000
MOST_RANGES = 1000


def rank_sums(values: DataFrame, keys: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, n1, n2, r1, ties): sizes of the samples, sum of the average ranks of 'inter' values, and sum of t^3 - t over ties.

    Equal values of a group are counted first, so a tie is one row. Groups of more than range_rows different values are cut into
    ranges of values (by approximate quantiles, whose errors only move the cuts); ranks run within a range, and the ranges'
    counts, a few rows a group, give what lies before each. No task holds a whole group.
    """
    inter = F.col("kind") == "inter"
    tied = values.groupBy(*keys, "value").agg(F.sum(inter.cast("long")).alias("a"), F.count("*").alias("t"))
    tied = stored(tied, "ties")
    most = tied.groupBy(*keys).count().agg(F.max("count").alias("most")).first()["most"] or 0
    ranges = min(MOST_RANGES, -(-most // range_rows))
    if ranges > 1:
        cuts = tied.groupBy(*keys).agg(F.percentile_approx("value", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("cuts"))
        at = F.size(F.filter("cuts", lambda c: c < F.col("value")))
        tied = tied.join(cuts, keys).select(*keys, "value", "a", "t", at.alias("at"))
    else:
        tied = tied.withColumn("at", F.lit(0))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*keys, "at").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.select(*keys, "at", "a", "t", (before + (F.col("t") + 1) / 2).alias("r"))
    t = F.col("t").cast("double")
    counted = ranked.groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("t").alias("t"), F.sum(F.col("a") * F.col("r")).alias("r"), F.sum(t * t * t - t).alias("ties"))
    ahead = F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = counted.withColumn("ahead", ahead).groupBy(*keys)
    n1 = F.sum("a").cast("double")
    return whole.agg(n1.alias("n1"), (F.sum("t") - n1).cast("double").alias("n2"), F.sum(F.col("r") + F.col("ahead") * F.col("a")).alias("r1"), F.sum("ties").alias("ties"))


def mann_whitney(values: DataFrame, keys: list[str], exact_erfc: bool = True) -> DataFrame:
    """(keys, n1, n2, u, z, p) of values (keys, kind 'inter' or 'intra', value); the groups' sizes follow from the draw schedule.

    U = max(U1, n1 n2 - U1), z = (U - n1 n2 / 2 - 1/2) / sd, p = erfc(z / sqrt 2), at most 1. All equal: sd is 0, z and p NaN.
    """
    got = rank_sums(values, keys)
    n1, n2 = F.col("n1"), F.col("n2")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    total = n1 + n2
    var = n1 * n2 / 12 * ((total + 1) - F.col("ties") / (total * (total - 1)))
    got = got.withColumn("u", F.greatest(u1, n1 * n2 - u1)).withColumn("sd", F.sqrt(F.greatest(var, F.lit(0.0))))
    z = F.when(F.col("sd") > 0, (F.col("u") - n1 * n2 / 2 - 0.5) / F.col("sd")).otherwise(F.lit(float("nan")))
    got = got.withColumn("z", z)
    half = F.abs(F.col("z")) / F.lit(math.sqrt(2))
    tail = erfc(half) if exact_erfc else erfc_approx(half)
    # a statistic just under its mean gives a negative z, whose two-sided p is over 1
    p = F.when(F.isnan("z"), F.lit(float("nan"))).when(F.col("z") < 0, F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0)))
    return got.select(*keys, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), "u", "z", p.alias("p"))


@lru_cache(maxsize=64)
def _counts(n1: int, n2: int) -> tuple[int, ...]:
    """How many of the choices of n1 among n1 + n2 ranks give each value of U."""
    if not n1 or not n2:
        return (1,)
    a, b = _counts(n1 - 1, n2), _counts(n1, n2 - 1)
    out = [0] * (n1 * n2 + 1)
    for k, x in enumerate(a):
        out[k + n2] += x
    for k, x in enumerate(b):
        out[k] += x
    return tuple(out)


def exact_p(u: float, n1: int, n2: int) -> float:
    """Two-sided p of the larger U statistic without ties, from the exact distribution."""
    counts = _counts(n1, n2)
    return min(1.0, 2 * sum(counts[math.ceil(u) :]) / sum(counts))


def small_samples_exact(tests: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """tests with p replaced by the exact one where a sample has at most EXACT_UP_TO values and no value is tied."""
    distinct = values.groupBy(*keys).agg((F.countDistinct("value") == F.count("*")).alias("_plain"))
    few = F.col("_plain") & (F.least("n1", "n2") <= EXACT_UP_TO)
    got = tests.join(distinct, keys)
    # the sizes of samples follow from the schedule, so there are few; each has a p for every value of U
    sizes = [(r["n1"], r["n2"]) for r in got.where(few).select("n1", "n2").distinct().collect()]
    table = [(a, b, u, exact_p(u, a, b)) for a, b in sizes for u in range(a * b + 1)]
    exact = tests.sparkSession.createDataFrame(table, "n1 long, n2 long, _u long, _exact double")
    got = got.withColumn("_u", F.when(few, F.ceil("u")).cast("long")).join(exact, ["n1", "n2", "_u"], "left")
    return got.withColumn("p", F.coalesce("_exact", "p")).select(*tests.columns)
