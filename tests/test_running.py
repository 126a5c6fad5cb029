"""Running totals over range partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from agora.catalog import clean
from agora.functions.running import running_total
from agora.operators import customer
from agora.plans.inspect import plan_text
from tests.conftest import SF_SMALL


def brute(values, descending):
    out = []
    for v in values:
        before = [w for w in values if w is not None and (v is None or (w >= v if descending else w <= v))]
        out.append((v, sum(before) if before else None))
    return out


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_equals_brute_force(spark, descending, adaptive):
    rng = random.Random(3)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        # A third of the rows share one value; some have none.
        for values in ([7] * 60 + [rng.choice([None, -3, *range(50)]) for _ in range(120)], [None, None], [5], []):
            df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(values)], "k long, v long, total_value string").repartition(4)
            rows = running_total(df, "v", descending).collect()
            assert sorted(((r.v, r.running) for r in rows), key=str) == sorted(brute(values, descending), key=str)
            known = [v for v in values if v is not None]
            assert {r.total for r in rows} <= {sum(known) if known else None}
            assert sorted(r.k for r in rows) == list(range(len(values)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_decimals_stay_exact(spark):
    df = spark.range(1000).select((F.col("id") % 37 / 100).cast("decimal(18,2)").alias("v"))
    last = running_total(df, "v").agg(F.max("running"), F.first("total")).first()
    assert last[0] == last[1] == df.agg(F.sum("v")).first()[0]


def test_no_step_puts_all_customers_into_one_task(spark):
    assert "SinglePartition" not in plan_text(customer.revenue_by_customer(clean(spark, SF_SMALL)), "simple")
