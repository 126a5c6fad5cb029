"""Golden micro-tables, one per trap (FIXTURES.md section 4); expected values
worked out by hand in the comments."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from agora.operators import category, cleaning, customer, delivery, overview, payment, quality, seller
from tests.golden import order, item, tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_m1_review_grain_and_item_weighting(spark):
    # Order A: 2 items, reviews 3 and 4 (order average 3.5: neither low nor
    # high). Order B: 1 item, review 5. Item-weighted: (3.5*2 + 5) / 3 = 4.0.
    t = tables(
        spark,
        orders=[order("A"), order("B")],
        items=[item("A"), item("A"), item("B")],
        reviews=[("A", 3, None, None), ("A", 4, None, None), ("B", 5, None, None)],
    )
    q7 = category.category_performance(t, min_orders=1).first()
    assert (q7["order_volume"], q7["avg_review_score"], q7["low_reviews"], q7["high_reviews"]) == (2, 4.0, 0, 1)
    assert q7["total_revenue"] == 30.0 and q7["revenue_per_order"] == 15.0
    # Q6 weighs every review: (3 + 4 + 5) / 3 = 4.0 on time.
    assert rows(delivery.review_by_timeliness(t.orders, t.reviews), "delivery_timeliness", "avg_review_score") == [
        ("On-time", 4.0)
    ]


def test_m2_delivered_without_date(spark):
    t = tables(spark, orders=[order("A", delivered=None), order("B", delivered=2)])
    assert cleaning.invalid_delivered(t.orders).count() == 1
    assert rows(t.orders, "order_id", "is_invalid_delivered") == [("A", True), ("B", False)]
    q4a = delivery.delivery_time_overall(t.orders).first()
    assert (q4a["n_orders"], q4a["avg_delivery_days"], q4a["median_delivery_days"]) == (1, 2.0, 2.0)
    assert rows(delivery.delivery_time_by_state(t.orders, t.customers), "customer_state", "avg_delivery_days") == [
        ("ST", 2.0)
    ]


def test_m3_missing_estimate_counts_in_denominator(spark):
    t = tables(spark, orders=[order("A", delivered=12, estimated=10), order("B", estimated=None)])
    r = delivery.on_time_rate(t.orders).first()
    assert (r["late_pct"], r["on_time_pct"]) == (50.0, 0.0)


def _seller_orders(prefix, seller_id, n, late, scores):
    """n delivered orders of one item each; the first ``late`` are late;
    scores[i] is the list of review scores of order i (may be empty)."""
    orders, items, reviews = [], [], []
    for i in range(n):
        oid = f"{prefix}{i}"
        orders.append(order(oid, delivered=12 if i < late else 5, estimated=10))
        items.append(item(oid, seller=seller_id))
        reviews += [(oid, s, None, None) for s in scores[i]]
    return orders, items, reviews


def test_m4_seller_without_reviews(spark):
    # X: 5 orders, 1 late (20 %), no reviews -> At Risk through lateness.
    # Y: 100 orders, 1 late (1 %), no reviews -> Healthy (NULL < 3.5 is unknown).
    ox, ix, _ = _seller_orders("x", "X", 5, 1, [[]] * 5)
    oy, iy, _ = _seller_orders("y", "Y", 100, 1, [[]] * 100)
    t = tables(spark, orders=ox + oy, items=ix + iy, sellers=[("X",), ("Y",)])
    m = seller.seller_metrics(t).withColumn("flag", seller.seller_flag(3.5, 14.5))
    assert rows(m, "seller_id", "avg_review_score", "late_pct", "flag") == [
        ("X", None, 20.0, "At Risk"),
        ("Y", None, 1.0, "Healthy"),
    ]
    risk = seller.seller_risk(t, min_orders=5)
    assert rows(risk, "seller_id", "seller_flag", "top_category", "items_sold") == [("X", "At Risk", "cat_a_en", 5)]


def test_m5_thresholds_compare_rounded_values(spark):
    # 110 orders: 54 scored 4, 55 scored 3, one with reviews 3 and 4 (3.5):
    # 384.5 / 110 = 3.4954 -> 3.50; 16 late of 110 = 14.545 -> 14.5.
    # Unrounded both thresholds are crossed; rounded, neither is: Healthy.
    scores = [[4]] * 54 + [[3]] * 55 + [[3, 4]]
    o, i, r = _seller_orders("m", "M", 110, 16, scores)
    t = tables(spark, orders=o, items=i, reviews=r, sellers=[("M",)])
    m = seller.seller_metrics(t).withColumn("flag", seller.seller_flag(3.5, 14.5)).first()
    assert (m["avg_review_score"], m["late_pct"], m["flag"]) == (3.5, 14.5, "Healthy")
    assert seller.seller_risk(t, min_orders=100).count() == 0


def test_m6_payment_collapse_ties_and_nulls(spark):
    t = tables(
        spark,
        cleaned=False,
        payments=[
            ("A", "credit_card", Decimal("50.00")),
            ("A", "voucher", Decimal("50.00")),
            ("A", "boleto", Decimal("10.00")),
            ("B", "debit_card", None),
        ],
    )
    got = rows(cleaning.order_payments(t.payments), "order_id", "payment_value", "payment_type")
    assert got == [("A", Decimal("110.00"), "voucher"), ("B", Decimal("0.00"), "debit_card")]


def test_m7_equal_state_revenue_shares_running_total(spark):
    # A = 100, B = 100, C = 50 of 250: shares 40 / 40 / 20; A and B tie, so
    # both carry the running share 80 (RANGE frame), C 100.
    customers = [("ca", "ua", "x", "A"), ("cb", "ub", "x", "B"), ("cc", "uc", "x", "C")]
    orders = [order("1", cust="ca"), order("2", cust="cb"), order("3", cust="cc")]
    items = [item("1", price="100.00"), item("2", price="60.00", freight="40.00"), item("3", price="50.00")]
    t = tables(spark, orders=orders, items=items, customers=customers)
    got = rows(customer.revenue_by_state(t), "customer_state", "total_revenue", "pct_of_total", "cumulative_pct")
    assert got == [("A", 100.0, 40.0, 80.0), ("B", 100.0, 40.0, 80.0), ("C", 50.0, 20.0, 100.0)]


def test_m8_person_in_two_states_counts_in_both(spark):
    customers = [("c1", "u1", "x", "A"), ("c2", "u1", "x", "B"), ("c3", "u3", "x", "A")]
    orders = [order("1", cust="c1"), order("2", cust="c2"), order("3", cust="c3")]
    items = [item("1", price="10.00"), item("2", price="30.00"), item("3", price="20.00")]
    t = tables(spark, orders=orders, items=items, customers=customers)
    got = rows(customer.spend_per_customer_by_state(t), "customer_state", "unique_customers", "avg_spend_per_customer")
    assert got == [("A", 2, 15.0), ("B", 1, 30.0)]
    r = customer.repeat_customers(t).first()
    # u1 has two orders, u3 one: 50 % each, 2 people.
    assert (r["one_time_pct"], r["repeat_pct"], r["total_unique_customers"]) == (50.0, 50.0, 2)


def test_m9_dropped_product_and_untranslated_category(spark):
    # p2 has no weight (dropped by cleaning), p3's category has no
    # translation. Order 1 holds all three products, order 2 only p2.
    products = [("p1", "cat_a", 100.0), ("p2", "cat_a", None), ("p3", "cat_b", 1.0)]
    orders = [order("1"), order("2")]
    items = [item("1", "p1", price="100.00"), item("1", "p2", price="5.00"), item("1", "p3"), item("2", "p2")]
    t = tables(spark, orders=orders, items=items, products=products)
    top = category.top_categories_by_revenue(t).collect()
    assert [(r["category"], r["total_revenue"], r["order_volume"]) for r in top] == [("cat_a_en", 100.0, 1)]
    flat = cleaning.flat_orders(t)
    assert flat.count() == 4
    assert rows(flat.filter(F.col("product_id") == "p2"), "order_id", "product_category_name") == [
        ("1", None),
        ("2", None),
    ]
    # Q16 (P75 of order totals 115 and 10 -> 88.75): order 1 is high value; the
    # share's denominator counts it even though only p1 has a category.
    hv = category.high_value_categories(t, min_orders=1).collect()
    assert [(r[0], r[1], r[2]) for r in hv] == [("cat_a_en", 1, 100.0)]


def test_m10_date_coercion(spark):
    df = spark.createDataFrame(
        [("1", "2018-01-02 03:04:05"), ("2", "2018-01-02"), ("3", "x"), ("4", ""), ("5", None)],
        "order_id string, order_purchase_timestamp string",
    )
    got = rows(cleaning.coerce_order_dates(df, ["order_purchase_timestamp"]), "order_id", "order_purchase_timestamp")
    assert got == [
        ("1", dt.datetime(2018, 1, 2, 3, 4, 5)),
        ("2", dt.datetime(2018, 1, 2)),
        ("3", None),
        ("4", None),
        ("5", None),
    ]


def test_m12_orders_without_items_or_payment(spark):
    t = tables(
        spark,
        orders=[order("A"), order("B"), order("C")],
        items=[item("A"), item("B")],
        payments=[("A", "boleto", Decimal("10.00")), ("C", "voucher", Decimal("4.00"))],
    )
    q1 = overview.overview_totals(t.orders, t.payments).first()
    assert (q1["total_revenue"], q1["total_orders"], q1["avg_order_value"]) == (14.0, 2, 7.0)
    flat = cleaning.flat_orders(t)
    assert rows(flat, "order_id", "product_id", "payment_type") == [
        ("A", "p1", "boleto"),
        ("B", "p1", None),
        ("C", None, "voucher"),
    ]
    check = quality.flat_row_check(t.orders, flat).first()
    assert tuple(check) == (3, 3, 3, 1.0)


def test_m13_category_extension_is_idempotent(spark):
    t = tables(spark, cleaned=False)
    once = cleaning.extend_category_dim(t.product_category)
    twice = cleaning.extend_category_dim(once)
    assert rows(twice, "product_category_name", "product_category_name_english") == [
        ("cat_a", "cat_a_en"),
        ("unknown", "unknown"),
    ]


def test_m14_unknown_status_stays_in_denominator(spark):
    t = tables(spark, orders=[order("A"), order("B", status="lost_in_space"), order("C", status="canceled"), order("D", status="created")])
    r = overview.order_status_mix(t.orders).first()
    assert tuple(r) == (25.0, 25.0, 25.0, 0.0)


def test_m15_category_without_reviews_sorts_last(spark):
    products = [("p1", "cat_a", 1.0), ("p2", "cat_b", 1.0)]
    categories = [("cat_a", "a"), ("cat_b", "b")]
    t = tables(
        spark,
        orders=[order("A"), order("B")],
        items=[item("A", "p1"), item("B", "p2")],
        reviews=[("A", 5, None, None)],
        products=products,
        category=categories,
    )
    got = [(r["category"], r["avg_review_score"]) for r in category.category_performance(t, min_orders=1).collect()]
    assert got == [("a", 5.0), ("b", None)]


def test_review_comment_flag_precedes_fill(spark):
    t = tables(
        spark,
        orders=[order("A"), order("B")],
        items=[item("A"), item("B")],
        reviews=[("A", 2, None, None), ("B", 1, "t", "broken")],
    )
    assert rows(t.reviews, "order_id", "review_comment_message", "has_comment") == [
        ("A", "", False),
        ("B", "broken", True),
    ]
    # The empty string is one of the distinct comments of bad reviews.
    assert rows(category.bad_review_comments(t, "cat_a_en"), "review_comment_message") == [("",), ("broken",)]
    means = rows(quality.review_mean_by_comment(t.reviews), "has_comment", "mean_review_score")
    assert means == [(False, 2.0), (True, 1.0)]


def test_null_audit_and_profile(spark):
    t = tables(spark, cleaned=False, orders=[order("A", delivered=None), order("B"), order("C"), order("D")])
    audit = rows(quality.null_audit(t.orders), "column_name", "null_count", "null_percentage")
    assert audit == [
        ("order_approved_at", 4, 100.0),
        ("order_delivered_carrier_date", 4, 100.0),
        ("order_delivered_customer_date", 1, 25.0),
    ]
    prof = rows(quality.table_profile({"orders": t.orders}).filter("column_name = 'order_id'"), "data_type", "n_rows", "non_null")
    assert prof == [("string", 4, 4)]


def test_assert_unique_key(spark):
    t = tables(spark, cleaned=False, payments=[("A", "x", Decimal("1.00")), ("A", "y", Decimal("2.00"))])
    with pytest.raises(quality.DuplicateKeyError):
        quality.assert_unique_key(t.payments, ["order_id"])
    quality.assert_unique_key(cleaning.order_payments(t.payments), ["order_id"])
    assert tuple(quality.key_check(t.payments, ["order_id"]).first()) == (2, 1, 1)


def test_monthly_trend_window_is_half_open(spark):
    orders = [order("A", purchase=-1), order("B", purchase=0), order("C", purchase=31), order("D", purchase=59)]
    payments = [(o, "boleto", Decimal("1.50")) for o in "ABCD"]
    t = tables(spark, orders=orders, payments=payments)
    got = rows(overview.monthly_trend(t.orders, t.payments, "2018-01-01", "2018-03-01"), "month", "orders", "revenue")
    # A is in Dec 2017, D on 2018-03-01 (excluded).
    assert got == [("2018-01", 1, 1.5), ("2018-02", 1, 1.5)]


def test_payment_mix_grains(spark):
    # Order A pays 30 by card + 10 by voucher, order B 20 by card.
    payments = [("A", "credit_card", Decimal("30.00")), ("A", "voucher", Decimal("10.00")), ("B", "credit_card", Decimal("20.00"))]
    t = tables(spark, orders=[order("A"), order("B")], payments=payments)
    legs = rows(
        payment.payment_mix(t.payment_legs),
        "payment_type", "n_orders", "pct_of_orders", "avg_order_value", "pct_of_revenue",
    )
    assert legs == [("credit_card", 2, 66.67, 25.0, 83.33), ("voucher", 1, 33.33, 10.0, 16.67)]
    main = rows(payment.payment_mix_main_method(t.payments), "payment_type", "n_orders", "total_revenue")
    assert main == [("credit_card", 2, 60.0)]


def test_windowed_retention_definition(spark):
    # u1: first order day 0, second day 100 -> retained; u2: first day 0,
    # second day 200 -> not retained; u3: first day 300, last purchase in
    # the data is day 400 -> not eligible (300 + 180 > 400).
    customers = [("c1", "u1", "x", "S"), ("c2", "u2", "x", "S"), ("c3", "u3", "x", "S")]
    orders = [
        order("1", cust="c1", purchase=0), order("2", cust="c1", purchase=100),
        order("3", cust="c2", purchase=0), order("4", cust="c2", purchase=200),
        order("5", cust="c3", purchase=300), order("6", cust="c3", purchase=400),
    ]
    t = tables(spark, orders=orders, customers=customers)
    got = rows(customer.windowed_retention(t, 180), "cohort_month", "eligible_customers", "retained_customers", "retention_pct")
    assert got == [("2018-01", 2, 1, 50.0), ("2018-10", 0, 0, None), ("ALL", 2, 1, 50.0)]
