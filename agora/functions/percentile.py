"""Exact PERCENTILE_CONT without gathering values in one task.

The built-in ``percentile_cont`` merges a value -> count map of the whole
input into a single task, so its memory grows with the number of distinct
values. Here the order statistic is closed in on instead, one path for every
input:

1. ``percentile_approx``, a mergeable sketch, proposes three values of the
   current range around the wanted rank;
2. one aggregate counts the rows below and up to each of them, exactly;
3. either one of the values holds the rank, or the rank lies strictly
   between two of them (or outside all three), which is the next range.

A range loses its ends in every step, so the search always ends, and it
holds about a sketch's rank error of rows after a step: a few steps, whatever
the size or the shape of the values. Only counts come to the driver.
Interpolation follows SQL's PERCENTILE_CONT: lo + (hi - lo) * fraction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pivots(at: float, accuracy: int) -> Column:
    """Three values around the fraction ``at``, from a mergeable sketch."""
    slack = 2.0 / accuracy
    fractions = [max(at - slack, 0.0), min(at, 1.0), min(at + slack, 1.0)]
    return F.percentile_approx("v", fractions, accuracy).alias("pivots")


def _order_statistic(vals: DataFrame, rank: int, n: int, accuracy: int, pivots: list[float] | None) -> tuple[float, int]:
    """The value of 0-based ``rank`` among the ``n`` rows of ``vals`` (v), and
    the number of rows up to that value; ``pivots``: three values to begin with."""
    v = F.col("v")
    low: float | None = None
    high: float | None = None
    below = 0  # rows up to ``low``
    while True:
        scope = vals
        if low is not None:
            scope = scope.filter(v > F.lit(low))
        if high is not None:
            scope = scope.filter(v < F.lit(high))
        pivots = pivots or scope.agg(_pivots((rank - below + 0.5) / n, accuracy)).first()["pivots"]
        counts = scope.agg(
            *[F.count_if(v < F.lit(x)).alias(f"lt{k}") for k, x in enumerate(pivots)],
            *[F.count_if(v <= F.lit(x)).alias(f"le{k}") for k, x in enumerate(pivots)],
        ).first()
        start, ends = below, None
        for k, x in enumerate(pivots):
            if rank < start + counts[f"lt{k}"]:
                high, ends = x, start + counts[f"lt{k}"]
                break
            if rank < start + counts[f"le{k}"]:
                return x, start + counts[f"le{k}"]
            low, below = x, start + counts[f"le{k}"]
        n = (ends if ends is not None else start + n) - below
        pivots = None


def exact_percentile(df: DataFrame, value: str | Column, p: float, *, accuracy: int = 10_000) -> float | None:
    """PERCENTILE_CONT(p) of ``value`` over ``df`` (NULLs ignored)."""
    if not 0.0 <= p <= 1.0:
        raise ValueError(f"percentile must lie in [0, 1], got {p}")
    column = F.col(value) if isinstance(value, str) else value
    vals = df.select(column.cast("double").alias("v")).filter(F.col("v").isNotNull())
    first = vals.agg(F.count(F.lit(1)).alias("n"), _pivots(p, accuracy)).first()
    n = first["n"]
    if not n:
        return None
    pos = p * (n - 1)
    rank = math.floor(pos)
    lo, up_to = _order_statistic(vals, rank, n, accuracy, first["pivots"])
    if pos == rank or rank + 1 < up_to:
        return float(lo)
    # The next order statistic is the smallest larger value.
    hi = vals.filter(F.col("v") > F.lit(lo)).agg(F.min("v")).first()[0]
    return lo + (hi - lo) * (pos - rank)
