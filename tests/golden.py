"""Hand-written marketplace tables for the golden tests (string ids, as in
the original CSVs)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from agora.model import Tables
from agora.operators.cleaning import clean_tables

S, TS, M = StringType(), TimestampNTZType(), DecimalType(18, 2)


def _schema(*cols):
    return StructType([StructField(n, t, True) for n, t in cols])


ORDERS = _schema(
    ("order_id", S),
    ("customer_id", S),
    ("order_status", S),
    ("order_purchase_timestamp", TS),
    ("order_approved_at", TS),
    ("order_delivered_carrier_date", TS),
    ("order_delivered_customer_date", TS),
    ("order_estimated_delivery_date", TS),
)
ITEMS = _schema(("order_id", S), ("product_id", S), ("seller_id", S), ("price", M), ("freight_value", M))
PAYMENTS = _schema(("order_id", S), ("payment_type", S), ("payment_value", M))
REVIEWS = _schema(
    ("order_id", S), ("review_score", IntegerType()), ("review_comment_title", S), ("review_comment_message", S)
)
PRODUCTS = _schema(("product_id", S), ("product_category_name", S), ("product_weight_g", DoubleType()))
SELLERS = _schema(("seller_id", S))
CATEGORY = _schema(("product_category_name", S), ("product_category_name_english", S))
CUSTOMERS = _schema(("customer_id", S), ("customer_unique_id", S), ("customer_city", S), ("customer_state", S))

BASE = dt.datetime(2018, 1, 1)


def day(n: float) -> dt.datetime:
    return BASE + dt.timedelta(days=n)


def order(oid, status="delivered", cust="c1", purchase=0, delivered=5, estimated=10):
    """An order row; day offsets from 2018-01-01, None for a missing date."""
    p = day(purchase) if purchase is not None else None
    return (
        oid,
        cust,
        status,
        p,
        None,
        None,
        day(delivered) if delivered is not None else None,
        day(estimated) if estimated is not None else None,
    )


def item(oid, product="p1", seller="s1", price="10.00", freight="0.00"):
    return (oid, product, seller, Decimal(price), Decimal(freight))


def tables(
    spark: SparkSession,
    orders=(),
    items=(),
    payments=(),
    reviews=(),
    products=(("p1", "cat_a", 100.0),),
    sellers=(("s1",),),
    category=(("cat_a", "cat_a_en"),),
    customers=(("c1", "u1", "city", "ST"),),
    cleaned: bool = True,
) -> Tables:
    t = Tables(
        orders=spark.createDataFrame(list(orders), ORDERS),
        customers=spark.createDataFrame(list(customers), CUSTOMERS),
        order_items=spark.createDataFrame(list(items), ITEMS),
        payments=spark.createDataFrame(list(payments), PAYMENTS),
        reviews=spark.createDataFrame(list(reviews), REVIEWS),
        products=spark.createDataFrame(list(products), PRODUCTS),
        sellers=spark.createDataFrame(list(sellers), SELLERS),
        product_category=spark.createDataFrame(list(category), CATEGORY),
    )
    return clean_tables(t) if cleaned else t
