"""Figures the reports quote on top of the KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions import exprs as X
from feira.operators.conform import enrich
from feira.plans.orders import YEARS
from feira.plans.views import product_lifecycles
from feira.tables import CleanTables

# Our own choice of words; texts are English translations.
COMPLAINTS = {"refund": r"\b(refund\w*|money back|reimburs\w*)", "invoice": r"\binvoic\w*"}


def _seller_gross(t: CleanTables) -> DataFrame:
    return t.items.groupBy("seller_id").agg(
        X.money(F.sum(F.col("price") + F.col("freight_value"))).alias("revenue")
    )


def top_seller_concentration(t: CleanTables, top: int = 15) -> DataFrame:
    """Share of item revenue that the ``top`` sellers make."""
    sellers = _seller_gross(t)
    total = sellers.agg(F.sum("revenue")).scalar()
    return (
        sellers.orderBy(F.desc_nulls_last("revenue"), "seller_id")
        .limit(top)
        .agg(F.count("*").alias("top_sellers"), X.money(F.sum("revenue")).alias("top_revenue"))
        .withColumn("total_revenue", X.money(total))
        .withColumn("top_share", X.ratio("top_revenue", "total_revenue"))
    )


def revenue_per_seller_by_city(t: CleanTables) -> DataFrame:
    rows = _seller_gross(t).join(t.sellers.select("seller_id", "seller_city"), "seller_id")
    sums = [F.count_distinct("seller_id").alias("total_sellers"), X.money(F.sum("revenue")).alias("revenue")]
    cities = X.group_folded(rows, ["seller_city"], *sums)
    return cities.withColumn("revenue_per_seller", X.rounded_ratio("revenue", "total_sellers"))


def lifecycle_share(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    counts = product_lifecycles(t, years).groupBy("product_lifecycle").agg(F.count("*").alias("total_products"))
    return counts.withColumn(
        "product_share", X.ratio("total_products", F.sum("total_products").over(Window.partitionBy()))
    )


def _cancelled(t: CleanTables, status: str) -> DataFrame:
    return t.orders.where(F.col("order_status") == status).select("order_id")


def cancelled_payment_mix(t: CleanTables, status: str = "canceled") -> DataFrame:
    """Cancelled orders per payment type. An order paid in two ways counts under both, so shares overlap."""
    cancelled = _cancelled(t, status)
    total = cancelled.agg(F.count_distinct("order_id")).scalar()
    return (
        cancelled.join(t.payments.select("order_id", "payment_type"), "order_id")
        .groupBy("payment_type")
        .agg(F.count_distinct("order_id").alias("cancelled_orders"))
        .withColumn("share_of_cancelled", X.ratio("cancelled_orders", total))
    )


def review_category(text: Column | str) -> Column:
    """The first complaint a text makes, or NULL."""
    text = F.lower(X.col(text))
    (first, pattern), *others = COMPLAINTS.items()
    out = F.when(text.rlike(pattern), first)
    for name, pattern in others:
        out = out.when(text.rlike(pattern), name)
    return out


def categorized_reviews(t: CleanTables) -> DataFrame:
    reviews = enrich(t.english_reviews, t.review_keys, "review_id", "review_id_values")
    return reviews.select(
        "review_id_values", "review_score", "review_english", review_category("review_english").alias("review_category")
    )


def complaint_categories(t: CleanTables, status: str = "canceled") -> DataFrame:
    """Reviews of cancelled orders that ask for a refund or an invoice, per payment type, each review counted once."""
    text = F.lower("review_english")
    flags = [text.rlike(p).alias(f"is_{name}") for name, p in COMPLAINTS.items()]
    reviews = _cancelled(t, status).join(t.reviews.select("review_id", "order_id", "review_comment_message"), "order_id")
    pays = t.payments.select("order_id", "payment_type").distinct()
    return (
        t.translate(reviews)
        .select("review_id", "order_id", *flags)
        .join(pays, "order_id")
        .groupBy("payment_type", "review_id")
        .agg(*[F.max(f"is_{name}").alias(f"is_{name}") for name in COMPLAINTS])
        .groupBy("payment_type")
        .agg(
            *[
                X.count_if(F.col(f"is_{name}") & F.col("review_id").isNotNull()).alias(f"{name}_complaints")
                for name in COMPLAINTS
            ]
        )
    )
