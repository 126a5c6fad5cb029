"""Stored daily states: old days and a new batch equal a full run."""

from __future__ import annotations

import os
from decimal import Decimal

from agora.catalog import TREND_WINDOW, _batches, clean
from agora.operators import cleaning, overview, partials, payment, seller
from agora.plans.inspect import plan_text
from agora.sources import store
from agora.sources.schema import PAYMENTS
from tests.conftest import SF_SMALL


def reports(spark, base, sellers):
    return {
        "totals": partials.overview_totals(spark, base),
        "trend": partials.monthly_trend(spark, base, *TREND_WINDOW),
        "sellers": partials.top_sellers_by_revenue(spark, base, sellers),
        "legs": partials.payment_mix(spark, base),
        "main": partials.payment_mix(spark, base, main_method=True),
    }


def test_old_states_and_a_new_batch_equal_a_full_run(spark, tmp_path):
    base, t = str(tmp_path / "states"), clean(spark, SF_SMALL)
    old, new = _batches(spark, SF_SMALL)
    partials.write_states(old, base)
    folder = store.current(spark, base)
    before = {n: set(os.listdir(os.path.join(folder, n))) for n in partials.STATES}
    first = {n: {d: os.listdir(os.path.join(folder, n, d)) for d in days if d.startswith("purchase_month")} for n, days in before.items()}
    wanted = {
        "totals": overview.overview_totals(t.orders, t.payments),
        "trend": overview.monthly_trend(t.orders, t.payments, *TREND_WINDOW),
        "sellers": seller.top_sellers_by_revenue(t),
        "legs": payment.payment_mix(t.payment_legs),
        "main": payment.payment_mix_main_method(t.payments),
    }
    wanted = {k: df.collect() for k, df in wanted.items()}
    # Adding the batch twice changes nothing.
    for _ in range(2):
        partials.add_days(new, base)
        got = {k: df.collect() for k, df in reports(spark, base, t.sellers).items()}
        assert got == wanted
    # The months before keep their files.
    for name, days in first.items():
        assert {d: os.listdir(os.path.join(folder, name, d)) for d in days} == days


def test_the_trend_reads_only_its_days(spark, tmp_path):
    base = str(tmp_path / "states")
    partials.write_states(clean(spark, SF_SMALL), base, ("paid",))
    text = plan_text(partials.monthly_trend(spark, base, "1996-01-01", "1996-02-01"), "formatted")
    assert "PartitionFilters" in text and "1996-01-01" in text.split("PartitionFilters")[1][:300]


def test_rows_without_a_day(spark, tmp_path):
    from tests.golden import item, order, tables

    base = str(tmp_path / "states")
    legs = [("A", "card", 1), ("B", "card", 2), ("lost", "voucher", 3)]
    t = tables(spark, orders=[order("A", purchase=0), order("B", purchase=None)], items=[item("A"), item("B"), item("lost")])
    legs = spark.createDataFrame([(o, 1, k, 1, Decimal(v)) for o, k, v in legs], PAYMENTS)
    t = t.with_(payments=cleaning.order_payments(legs), payment_legs=legs)
    partials.write_states(t, base)
    for _ in range(2):
        assert partials.overview_totals(spark, base).collect() == overview.overview_totals(t.orders, t.payments).collect()
        assert partials.payment_mix(spark, base).collect() == payment.payment_mix(t.payment_legs).collect()
        assert partials.top_sellers_by_revenue(spark, base, t.sellers).collect() == seller.top_sellers_by_revenue(t).collect()
        partials.add_days(t, base)
