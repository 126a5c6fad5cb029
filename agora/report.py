"""The whole analysis over one set of tables: every statement and finding,
with the original parameters as defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from agora.model import Tables
from agora.operators import category, customer, delivery, findings, overview, payment, seller


@dataclass(frozen=True)
class Params:
    trend_start: str = "2017-08-01"
    trend_end: str = "2018-09-01"
    segment: str = "office_furniture"
    bad_review_max_score: int = 3
    category_min_orders: int = 100
    seller_min_orders: int = 100
    review_threshold: float = 3.5
    late_threshold: float = 14.5
    high_value_percentile: float = 0.75
    high_value_min_orders: int = 30
    retention_days: int = 180
    top_states: int = 3


def analyses(t: Tables, flat: DataFrame, p: Params = Params()) -> dict[str, DataFrame]:
    """Q1-Q17 and G1-G4 as named DataFrames over cleaned tables ``t`` and
    the flat table ``flat``. Built in order; the few operators that compute
    a scalar or checkpoint an intermediate run that job while building."""
    risk = seller.seller_risk(t, p.review_threshold, p.late_threshold, p.seller_min_orders)
    return {
        "overview_totals": overview.overview_totals(t.orders, t.payments),
        "order_status_mix": overview.order_status_mix(t.orders),
        "monthly_trend": overview.monthly_trend(t.orders, t.payments, p.trend_start, p.trend_end),
        "delivery_time_overall": delivery.delivery_time_overall(t.orders),
        "delivery_time_by_state": delivery.delivery_time_by_state(t.orders, t.customers),
        "on_time_rate": delivery.on_time_rate(t.orders),
        "review_by_timeliness": delivery.review_by_timeliness(t.orders, t.reviews),
        "delivery_time_distribution": delivery.delivery_time_distribution(t.orders),
        "category_performance": category.category_performance(t, p.category_min_orders),
        "category_segment_check": category.category_segment_check(flat, p.segment),
        "bad_review_comments": category.bad_review_comments(t, p.segment, p.bad_review_max_score),
        "top_categories_by_revenue": category.top_categories_by_revenue(t),
        "high_value_categories": category.high_value_categories(
            t, p.high_value_percentile, p.high_value_min_orders
        ),
        "top_sellers_by_revenue": seller.top_sellers_by_revenue(t),
        "seller_scorecard": seller.seller_scorecard(t, p.seller_min_orders),
        "seller_risk": risk,
        "revenue_by_state": customer.revenue_by_state(t),
        "repeat_customers": customer.repeat_customers(t),
        "spend_per_customer_by_state": customer.spend_per_customer_by_state(t),
        "windowed_retention": customer.windowed_retention(t, p.retention_days),
        "payment_mix": payment.payment_mix(t.payment_legs),
        "payment_mix_main_method": payment.payment_mix_main_method(t.payments),
        "risk_category_spread": findings.risk_category_spread(risk),
        "revenue_top_n_share": findings.revenue_top_n_share(t, p.top_states),
        "timeliness_review_gap": findings.timeliness_review_gap(t),
    }
