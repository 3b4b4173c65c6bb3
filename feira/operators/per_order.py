"""Per-order summaries that stand in for the one-to-many joins between items, payments and reviews.

Sums and counts over items x payments x reviews only need each side's per-order totals, multiplied.
Each side therefore shrinks before its shuffle and never meets the others row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def payments_per_order(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.count("*").alias("n_payments"),
        F.count("payment_value").alias("n_values"),
        F.sum("payment_value").alias("paid"),
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(
        F.count("*").alias("n_reviews"),
        F.count("review_score").alias("n_scores"),
        F.sum("review_score").alias("score_sum"),
        F.count(F.when(F.col("review_score") == 5, 1)).alias("n_five"),
    )


def items_per_order(items: DataFrame, *group: str) -> DataFrame:
    """One row per order and ``group``: at most as many rows per order as the group has values.

    Totals a query does not read are pruned from its plan.
    """
    gross = F.col("price") + F.col("freight_value")
    return items.groupBy("order_id", *group).agg(
        F.count("*").alias("n_items"),
        F.count("seller_id").alias("n_sellers"),
        F.count("price").alias("n_prices"),
        F.sum("price").alias("price_sum"),
        F.sum(gross).alias("gross_sum"),
    )


def order_totals(orders: DataFrame, payment_totals: DataFrame, reviews: DataFrame) -> DataFrame:
    """What items need to know of their order, for the paid orders: year, payments and, if any, reviews."""
    known = orders.select(
        "order_id",
        F.year("order_purchase_timestamp").alias("year"),
        F.when(F.col("customer_id").isNotNull(), 1).otherwise(0).alias("has_customer"),
    )
    return known.join(payment_totals, "order_id").join(reviews_per_order(reviews), "order_id", "left")


def order_years(orders: DataFrame) -> DataFrame:
    return orders.select("order_id", F.year("order_purchase_timestamp").alias("year"))
