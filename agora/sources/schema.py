"""Declared schemas of the marketplace tables (never inferred).

Ids and code-like columns stay strings: inference would turn a code such as
``01040`` into a number and drop its leading zero. Money is DECIMAL(18,2) so
sums are exact and independent of the order partitions are combined in.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(18, 2)

# The five order timestamps, in table order.
ORDER_DATE_COLUMNS = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]


def _s(*names: str) -> list[StructField]:
    return [StructField(n, StringType(), True) for n in names]


# Raw layouts as delivered in the CSV files: timestamps arrive as text and
# are coerced by the cleaning step.
ORDERS_CSV = StructType(_s("order_id", "customer_id", "order_status", *ORDER_DATE_COLUMNS))

CUSTOMERS = StructType(
    _s("customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state")
)

ORDER_ITEMS = StructType(
    _s("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date")
    + [StructField("price", MONEY, True), StructField("freight_value", MONEY, True)]
)

PAYMENTS = StructType(
    _s("order_id")
    + [StructField("payment_sequential", IntegerType(), True)]
    + _s("payment_type")
    + [StructField("payment_installments", IntegerType(), True), StructField("payment_value", MONEY, True)]
)

REVIEWS = StructType(
    _s("review_id", "order_id")
    + [StructField("review_score", IntegerType(), True)]
    + _s("review_comment_title", "review_comment_message", "review_creation_date", "review_answer_timestamp")
)

PRODUCTS = StructType(
    _s("product_id", "product_category_name")
    + [
        StructField(c, DoubleType(), True)
        for c in (
            "product_name_lenght",
            "product_description_lenght",
            "product_photos_qty",
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
        )
    ]
)

SELLERS = StructType(_s("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"))

PRODUCT_CATEGORY = StructType(_s("product_category_name", "product_category_name_english"))

GEOLOCATION = StructType(
    _s("geolocation_zip_code_prefix")
    + [StructField("geolocation_lat", DoubleType(), True), StructField("geolocation_lng", DoubleType(), True)]
    + _s("geolocation_city", "geolocation_state")
)

# Declared layout of each table of a raw CSV drop.
CSV_TABLES: dict[str, StructType] = {
    "orders": ORDERS_CSV,
    "geolocation": GEOLOCATION,
    "order_items": ORDER_ITEMS,
    "payments": PAYMENTS,
    "reviews": REVIEWS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "product_category": PRODUCT_CATEGORY,
    "customers": CUSTOMERS,
}
