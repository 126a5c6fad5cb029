"""Marketplace roles projected from the driver's TPC-H style tables.

The test data has no marketplace tables, so each role is a deterministic
projection of a driver table (FIXTURES.md section 3). The same projection
is written in DuckDB SQL for the oracle (``agora.oracle``); both must give
identical rows. Every role is a narrow projection of a scan, so column
pruning and filters still reach the parquet reader.

The modulo rules below derive values deterministically (a status, a missing
date, whether an order has a first and a second review, a missing category
or weight); they are not samples: every row of every driver table is used.

k = o_orderkey, p = p_partkey below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.model import Tables
from agora.sources.readers import read_parquet_table


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def orders_role(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    order_status = (
        F.when(status == "F", "delivered")
        .when((status == "O") & (k % 4 == 0), "delivered")
        .when((status == "O") & (k % 3 == 0), "shipped")
        .when((status == "O") & (k % 3 == 1), "invoiced")
        .when(status == "O", "processing")
        .when(k % 5 == 0, "unavailable")
        .when(k % 5 == 1, "canceled")
        .otherwise("delivered")
    )
    purchase = F.col("o_orderdate") + _seconds((k * 61) % 86400)
    delivered = F.when(
        (k % 101 != 0) & (status != "O"),
        F.col("o_orderdate") + _days(1 + (k * 37) % 45) + _seconds((k * 7919) % 86400),
    )
    estimated = F.when(k % 211 != 0, F.col("o_orderdate") + _days(F.lit(40)))
    return orders.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        order_status.alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        (purchase + _seconds(F.lit(3600))).alias("order_approved_at"),
        (purchase + _days(F.lit(1))).alias("order_delivered_carrier_date"),
        delivered.alias("order_delivered_customer_date"),
        estimated.alias("order_estimated_delivery_date"),
    )


def _price() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)")


def order_items_role(lineitem: DataFrame) -> DataFrame:
    freight = F.round(_price() * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(18,2)")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        _price().alias("price"),
        freight.alias("freight_value"),
    )


def payments_role(lineitem: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    payment_type = (
        F.when(flag == "A", "credit_card").when(flag == "N", "boleto").when(flag == "R", "voucher")
    )
    value = F.round(_price() * (1 - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(18,2)")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        payment_type.alias("payment_type"),
        value.alias("payment_value"),
    )


# Fixed values of the binding: review score picked by (k*17) % 7, in order.
REVIEW_SCORE_CYCLE = [5, 5, 5, 4, 3, 2, 1]


def reviews_role(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    cycle = F.array(*[F.lit(v) for v in REVIEW_SCORE_CYCLE])
    text = F.lit(None).cast("string")
    first = F.struct(
        k.alias("order_id"),
        F.element_at(cycle, ((k * 17) % 7 + 1).cast("int")).cast("int").alias("review_score"),
        F.when(k % 6 == 0, F.concat(F.lit("title "), (k % 10).cast("string"))).alias("review_comment_title"),
        F.when(k % 3 == 0, F.concat(F.lit("msg "), (k % 40).cast("string"))).alias("review_comment_message"),
    )
    second = F.struct(
        k.alias("order_id"),
        (2 + (k * 11) % 4).cast("int").alias("review_score"),
        text.alias("review_comment_title"),
        text.alias("review_comment_message"),
    )
    # Both reviews of an order come from one scan.
    both = F.array_compact(F.array(F.when(k % 10 != 0, first), F.when(k % 23 == 0, second)))
    return orders.select(F.inline(both))


def products_role(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    return part.select(
        p.alias("product_id"),
        F.when(p % 50 != 0, F.col("p_brand")).alias("product_category_name"),
        F.when(p % 40 != 1, (F.col("p_size") * 100).cast("double")).alias("product_weight_g"),
    )


def product_category_role(part: DataFrame) -> DataFrame:
    names = part.select(F.col("p_brand").alias("product_category_name")).distinct()
    english = F.lower(F.replace(F.col("product_category_name"), F.lit("#"), F.lit("_")))
    return names.select("product_category_name", english.alias("product_category_name_english"))


def sellers_role(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").alias("seller_id"))


def customers_role(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "inner").select(
        F.col("c_custkey").alias("customer_id"),
        F.expr("c_custkey div 2").alias("customer_unique_id"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def bind_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Raw (uncleaned) marketplace tables over the parquet files in ``sf_dir``."""

    def t(name: str) -> DataFrame:
        return read_parquet_table(spark, sf_dir, name)

    lineitem = t("lineitem")
    orders = t("orders")
    part = t("part")
    return Tables(
        orders=orders_role(orders),
        customers=customers_role(t("customer"), t("nation")),
        order_items=order_items_role(lineitem),
        payments=payments_role(lineitem),
        reviews=reviews_role(orders),
        products=products_role(part),
        sellers=sellers_role(t("supplier")),
        product_category=product_category_role(part),
    )
