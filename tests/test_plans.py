"""Physical-plan properties the operators are designed for."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
from agora.catalog import QUERIES, clean
from agora.operators import category, cleaning, customer, delivery, overview, seller
from agora.plans.inspect import PAIRWISE_NODES, PYTHON_NODES, plan_nodes, plan_text, pushed_filters, read_schemas
from agora.sources import sinks
from tests.conftest import SF_SMALL

KEYS = [k for k in QUERIES if k not in ("dashboard_extracts", "stored_flat_by_month", "stored_tables", "updated_flat_by_month") and not k.endswith("_from_states")]


@pytest.mark.parametrize("key", KEYS)
def test_no_python_and_no_pairwise_joins(spark, key):
    df = entry.queries()[key](spark, SF_SMALL)
    assert plan_nodes(df, PYTHON_NODES) == []
    assert plan_nodes(df, PAIRWISE_NODES) == []


def test_seller_metrics_avoid_distinct_expansion(spark):
    df = seller.seller_scorecard(clean(spark, SF_SMALL))
    assert "Expand" not in plan_text(df, "simple")


def test_scans_read_only_needed_columns(spark):
    df = seller.seller_risk(clean(spark, SF_SMALL))
    # Seller risk needs only the ids of order items, never their amounts.
    items = [s for s in read_schemas(df) if "l_suppkey" in s]
    assert items
    for s in items:
        assert "l_extendedprice" not in s and "l_tax" not in s


def test_filters_reach_the_scan_of_written_tables(spark, scratch):
    base = os.path.join(scratch, "plan_tables")
    sinks.write_tables(clean(spark, SF_SMALL), base)
    t = sinks.read_tables(spark, base)
    filters = " ".join(pushed_filters(delivery.on_time_rate(t.orders)))
    assert "EqualTo(order_status,delivered)" in filters
    assert "IsNotNull(order_delivered_customer_date)" in filters


def test_per_order_preaggregate_reuses_order_partitioning(spark):
    # With broadcasts off (both sides large, as at scale) the order joins are
    # sort-merge joins on order_id; the (seller, order) pre-aggregate must
    # not add a shuffle of its own - only the per-seller step shuffles.
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        text = plan_text(seller.seller_scorecard(clean(spark, SF_SMALL)), "simple")
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    physical = text.split("== Physical Plan ==")[-1]
    assert "SortMergeJoin" in physical
    assert "Exchange hashpartitioning(seller_id" in physical
    shuffles = [line for line in physical.splitlines() if "Exchange hashpartitioning" in line]
    assert not [s for s in shuffles if "seller_id" in s and "order_id" in s]


AGGREGATES = ("HashAggregate", "ObjectHashAggregate", "SortAggregate")


def _single_partition_inputs(text: str) -> list[str]:
    """For each Exchange SinglePartition, the first operator below it that
    is not a Project/Filter/Sort wrapper."""
    lines = text.split("== Physical Plan ==")[-1].splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            for below in lines[i + 1 :]:
                node = below.strip(" :+-*()0123456789")
                if not node.startswith(("Project", "Filter", "Sort ", "ColumnarToRow")):
                    found.append(node)
                    break
    return found


@pytest.mark.parametrize("key", KEYS)
def test_single_partition_exchanges_carry_only_aggregated_rows(spark, key):
    # Whole-result windows and global aggregates funnel into one task; what
    # they receive must already be aggregated (partial sums, per-state or
    # per-type rows), never item or order rows.
    df = entry.queries()[key](spark, SF_SMALL)
    for node in _single_partition_inputs(plan_text(df, "simple")):
        assert node.startswith(AGGREGATES), f"{key}: single-partition exchange over {node[:80]}"


BY_ORDER = {
    "overview_totals": lambda t: overview.overview_totals(t.orders, t.payments),
    "review_by_timeliness": lambda t: delivery.review_by_timeliness(t.orders, t.reviews),
    "category_performance": category.category_performance,
    "seller_scorecard": seller.seller_scorecard,
    "seller_risk": seller.seller_risk,
    "spend_per_customer_by_state": customer.spend_per_customer_by_state,
    "high_value_categories": category.high_value_categories,
    "flat_orders": cleaning.flat_orders,
}


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("prepared"))
    sinks.write_tables(clean(spark, SF_SMALL), base)
    return sinks.read_tables(spark, base, ("payment_legs",))


@pytest.mark.parametrize("key", BY_ORDER)
def test_prepared_tables_need_no_shuffle_by_order(spark, prepared, key):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        df = BY_ORDER[key](prepared)
        text = plan_text(df, "simple")
        got = sorted(map(str, df.collect()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert not re.search(r"Exchange hashpartitioning\(order_id", text)
    # Seller risk counts items by seller and product before any join by order.
    assert key == "seller_risk" or "Bucketed: true" in text
    assert got == sorted(map(str, QUERIES[key](spark, SF_SMALL).collect()))
