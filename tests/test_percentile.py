"""exact_percentile equals SQL PERCENTILE_CONT, also on the bracket path."""

from __future__ import annotations

import math

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from agora.functions.percentile import exact_percentile


def reference(values, p):
    xs = sorted(v for v in values if v is not None)
    if not xs:
        return None
    pos = p * (len(xs) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    if lo == hi or xs[lo] == xs[hi]:
        return float(xs[lo])
    return xs[lo] + (xs[hi] - xs[lo]) * (pos - lo)


def df_of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_matches_duckdb_on_ties_and_skew(spark, p):
    values = [float(i % 7) for i in range(3000)] + [1e6, -5.0, 2.5] + [float(i) ** 1.5 for i in range(500)]
    got = exact_percentile(df_of(spark, values), "v", p)
    want = duckdb.sql(
        f"SELECT percentile_cont({p}) WITHIN GROUP (ORDER BY v) FROM (SELECT unnest(?::DOUBLE[]) AS v)",
        params=[values],
    ).fetchall()[0][0]
    assert got == want == reference(values, p)


@settings(max_examples=25, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=0, max_size=300),
    st.sampled_from([0.1, 0.5, 0.75, 0.9]),
)
def test_property_bracket_path(spark, values, p):
    got = exact_percentile(df_of(spark, values), "v", p, accuracy=7)
    assert got == reference(values, p)


def test_empty_and_invalid(spark):
    assert exact_percentile(df_of(spark, [None]), "v", 0.5) is None
    with pytest.raises(ValueError):
        exact_percentile(df_of(spark, [1.0]), "v", 1.5)


SHAPES = {
    "log_uniform": [10.0 ** (k / 37) for k in range(-2000, 2000)],
    "constant": [3.25] * 2000,
    "two_values": [1.0] * 1500 + [2.0] * 1500,
    "outlier": [k / 7 for k in range(2000)] + [1e300, -1e300],
    "ties_and_gaps": [float(k % 13) for k in range(999)] + [k * 0.001 for k in range(3000)],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.75, 1.0])
def test_a_coarse_sketch_still_finds_the_exact_value(spark, p, shape):
    # The sketch's error covers many distinct values, so several steps are
    # needed; the number of steps is not limited.
    got = exact_percentile(df_of(spark, SHAPES[shape]), "v", p, accuracy=20)
    assert got == reference(SHAPES[shape], p)
