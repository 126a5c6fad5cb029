"""The set of marketplace tables one analysis runs on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    """Normalised marketplace tables.

    Before cleaning ``payments`` holds one row per payment leg; after
    ``clean_tables`` it holds one row per order and the legs are kept in
    ``payment_legs``.

    ``item_products`` and ``order_customers`` are the two joins by other keys
    than order_id that order-level results need (every item with its
    product's category, every order with its customer's place). Prepared
    tables carry them, so that such results need no shuffle by order_id;
    where they are absent the operators join.
    """

    orders: DataFrame
    customers: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    product_category: DataFrame
    geolocation: DataFrame | None = None
    payment_legs: DataFrame | None = None
    item_products: DataFrame | None = None
    order_customers: DataFrame | None = None

    def with_(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)

    def named(self) -> dict[str, DataFrame]:
        """Tables by name, leaving out the ones that are absent."""
        out = {
            "orders": self.orders,
            "customers": self.customers,
            "order_items": self.order_items,
            "payments": self.payments,
            "reviews": self.reviews,
            "products": self.products,
            "sellers": self.sellers,
            "product_category": self.product_category,
            "geolocation": self.geolocation,
        }
        return {k: v for k, v in out.items() if v is not None}
