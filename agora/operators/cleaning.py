"""Cleaning operators (C2, C6-C8, C11-C14, C16) and the cleaning pipeline.

Each step is a pure ``DataFrame -> DataFrame`` function; nothing runs until
an action. ``clean_tables`` applies them in the order the analysis needs
(the comment flag must be taken before the text is filled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.model import Tables
from agora.sources.schema import ORDER_DATE_COLUMNS

UNKNOWN_CATEGORY = "unknown"


# Text that is a date or a timestamp; anything else (a year, a month, a zone
# suffix) is not what the files declare.
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$"


def coerce_order_dates(orders: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text timestamps ('yyyy-MM-dd HH:mm:ss' or 'yyyy-MM-dd') become
    timestamp_ntz, no time zone involved; any other text becomes NULL.
    Already typed columns pass through unchanged."""
    text = {f.name for f in orders.schema if f.dataType.simpleString() == "string"}
    cols = [c for c in (columns or ORDER_DATE_COLUMNS) if c in text]
    return orders.withColumns({c: F.when(F.col(c).rlike(DATE_TEXT), F.col(c)).try_cast("timestamp_ntz") for c in cols})


def invalid_delivered(orders: DataFrame) -> DataFrame:
    """Orders marked delivered that carry no delivery date."""
    return orders.filter(
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNull()
    )


def flag_invalid_delivered(orders: DataFrame) -> DataFrame:
    """Add ``is_invalid_delivered``; every row is kept. A NULL status
    gives False, not NULL."""
    flag = (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNull()
    return orders.withColumn("is_invalid_delivered", F.coalesce(flag, F.lit(False)))


def flag_has_comment(reviews: DataFrame) -> DataFrame:
    """``has_comment`` = the review has a message. Must precede C11."""
    return reviews.withColumn("has_comment", F.col("review_comment_message").isNotNull())


def fill_review_text(reviews: DataFrame) -> DataFrame:
    """C11: missing review title / message become the empty string."""
    return reviews.na.fill("", ["review_comment_title", "review_comment_message"])


def clean_products(products: DataFrame) -> DataFrame:
    """Missing category -> 'unknown', then drop products without weight."""
    return products.na.fill(UNKNOWN_CATEGORY, ["product_category_name"]).na.drop(
        subset=["product_weight_g"]
    )


def extend_category_dim(category: DataFrame) -> DataFrame:
    """Append the ('unknown', 'unknown') translation unless present, so
    running it twice appends once."""
    row = category.sparkSession.createDataFrame(
        [(UNKNOWN_CATEGORY, UNKNOWN_CATEGORY)], category.select(
            "product_category_name", "product_category_name_english"
        ).schema,
    )
    missing = row.join(category, "product_category_name", "left_anti")
    return category.unionByName(missing)


def order_payments(payments: DataFrame) -> DataFrame:
    """C14: one row per order - summed value and the type of the largest leg.

    A single aggregation (one shuffle on order_id, partial sums map-side).
    Ties on the largest value go to the greatest type name. An order whose
    values are all NULL sums to 0.
    """
    return payments.groupBy("order_id").agg(
        F.coalesce(F.sum("payment_value"), F.lit(0)).cast("decimal(38,2)").alias("payment_value"),
        F.max_by("payment_type", F.struct("payment_value", "payment_type")).alias("payment_type"),
    )


def item_products(t: Tables) -> DataFrame:
    """Every item with its product's category: product_category_name, its
    translation (NULL if there is none) and ``translated``, whether the
    category has an entry. Products get their translation at product grain,
    so item rows meet one relation."""
    if t.item_products is not None:
        return t.item_products
    category = t.product_category.select("product_category_name", "product_category_name_english", F.lit(True).alias("entry"))
    products = t.products.select("product_id", "product_category_name").join(category, "product_category_name", "left")
    items = t.order_items.select("order_id", "product_id", "seller_id", "price", "freight_value")
    return items.join(products, "product_id", "left").withColumn("translated", F.col("entry").isNotNull()).drop("entry")


def order_customers(t: Tables) -> DataFrame:
    """Every order with its customer's city and state."""
    if t.order_customers is not None:
        return t.order_customers
    return t.orders.join(t.customers.select("customer_id", "customer_city", "customer_state"), "customer_id", "left").select(
        *t.orders.columns, "customer_city", "customer_state"
    )


def flat_orders(t: Tables) -> DataFrame:
    """The flat order table - every order, left-joined to its customer,
    items (with product category and translation), collapsed payment and
    reviews. One row per order x item x review.

    The joins on the fanned-out rows are by order_id and share one hash
    partitioning; over prepared tables there is no other join and no shuffle.
    Right-side keys are never NULL, so SQL and dataframe NULL-key matching
    agree.
    """
    items = item_products(t).drop("translated")
    pays = t.payments.select("order_id", "payment_type", "payment_value")
    revs = t.reviews.select("order_id", "review_score", "review_comment_title", "review_comment_message")
    flat = (
        order_customers(t)
        .join(items, "order_id", "left")
        .join(pays, "order_id", "left")
        .join(revs, "order_id", "left")
    )
    return flat.select(
        *t.orders.columns,
        "customer_city",
        "customer_state",
        "product_id",
        "seller_id",
        "price",
        "freight_value",
        "payment_type",
        "payment_value",
        "review_score",
        "review_comment_title",
        "review_comment_message",
        "product_category_name",
        F.col("product_category_name_english").alias("product_category_en"),
    )


def clean_tables(raw: Tables, verify_keys: bool = False) -> Tables:
    """The cleaning pipeline over raw tables.

    orders: C2 + C7; reviews: C8 then C11; products: C12; categories: C13;
    payments: C14, with the legs kept aside. Nothing is written: the other
    tables are those of ``raw``. With ``verify_keys`` the collapsed payments
    and the orders are checked for unique order ids (C15).
    """
    from agora.operators.quality import assert_unique_key

    orders = flag_invalid_delivered(coerce_order_dates(raw.orders))
    payments = order_payments(raw.payments)
    if verify_keys:
        assert_unique_key(payments, ["order_id"])
        assert_unique_key(orders, ["order_id"])
    return raw.with_(
        orders=orders,
        reviews=fill_review_text(flag_has_comment(raw.reviews)),
        products=clean_products(raw.products),
        product_category=extend_category_dim(raw.product_category),
        payments=payments,
        payment_legs=raw.payments,
    )
