"""The cleaning jobs, table by table."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.functions import exprs as X
from feira.operators import conform, keys, rules

if TYPE_CHECKING:
    from feira.tables import CleanTables, RawTables

ITEM_KEYS = ["order_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"]


# Surrogate keys -----------------------------------------------------------------------------------
def map_order_ids(raw: RawTables) -> DataFrame:
    return keys.build_mapping("order_id", "A", raw.orders, raw.items, raw.payments, raw.reviews)


def map_product_ids(raw: RawTables) -> DataFrame:
    return keys.build_mapping("product_id", "P", raw.items, raw.products)


def map_seller_ids(raw: RawTables) -> DataFrame:
    return keys.build_mapping("seller_id", "S", raw.items, raw.sellers)


def map_customer_ids(raw: RawTables) -> DataFrame:
    return keys.build_mapping("customer_id", "C", raw.orders, raw.customers)


def map_review_ids(raw: RawTables) -> DataFrame:
    return keys.build_mapping("review_id", "R", raw.reviews)


# Tables -------------------------------------------------------------------------------------------
def typed_items(raw: RawTables) -> DataFrame:
    items = conform.drop_all_null(raw.items, ["order_id", "order_item_id", "product_id", "seller_id"])
    items = conform.to_dates(items, "shipping_limit_date")
    return conform.to_money(items, "price", "freight_value")


def dedup_items(items: DataFrame) -> DataFrame:
    """Keep one of several items that differ in nothing but their number. Dates and money must be final."""
    return conform.keep_first(items, ITEM_KEYS, "order_item_id")


def clean_payments(raw: RawTables) -> DataFrame:
    payments = conform.drop_all_null(raw.payments, raw.payments.columns)
    payments = conform.to_money(payments, "payment_value")
    return payments.withColumns(
        {
            "payment_type_raw": F.col("payment_type"),
            "payment_type": conform.recode("payment_type", "boleto", "voucher"),
        }
    )


def clean_reviews(raw: RawTables) -> DataFrame:
    return conform.to_dates(raw.reviews, "review_creation_date", "review_answer_timestamp")


def translated(reviews: DataFrame, lookup: DataFrame) -> DataFrame:
    ids = [c for c in ("review_id", "order_id") if c in reviews.columns]
    return conform.translate_text(reviews, lookup, "review_comment_message", "review_english", ids)


def clean_orders(raw: RawTables) -> DataFrame:
    orders = conform.to_seconds(raw.orders, "order_purchase_timestamp", "order_approved_at")
    return conform.to_dates(
        orders, "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"
    )


def orders_as_text(orders: DataFrame) -> DataFrame:
    """The two timestamps in their 19-character form."""
    return orders.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("order_purchase_timestamp", "order_approved_at")}
    )


def classified_categories(dictionary: DataFrame) -> DataFrame:
    return dictionary.withColumn("main_categories", rules.main_category("category_en"))


def extended_categories(dictionary: DataFrame) -> DataFrame:
    """The classified dictionary with the categories it lacked."""
    return conform.append_rows(
        classified_categories(dictionary), rules.EXTRA_CATEGORIES, ["category_pt", "category_en", "main_categories"]
    )


def clean_products(raw: RawTables) -> DataFrame:
    one_each = (
        extended_categories(raw.category_translation)
        .groupBy(X.folded("category_pt").alias("__name"))
        .agg(F.min(F.struct("category_en", "main_categories")).alias("category"))
    )
    named = raw.products.withColumn("__name", X.folded("product_category_name"))
    return named.join(one_each, "__name", "left").select(
        *raw.products.columns, "category.category_en", "category.main_categories"
    )


def clean_sellers(raw: RawTables) -> DataFrame:
    return conform.append_rows(
        rules.clean_cities(raw.sellers), [rules.EXTRA_SELLER], ["seller_city", "seller_state"]
    )


# Tables with their surrogate keys -------------------------------------------------------------------
def items_with_keys(t: CleanTables, items: DataFrame | None = None) -> DataFrame:
    items = t.items if items is None else items
    items = conform.enrich(items, t.order_keys, "order_id", "order_id_values")
    items = conform.enrich(items, t.product_keys, "product_id", "product_id_values")
    return conform.enrich(items, t.seller_keys, "seller_id", "seller_id_values")


def payments_with_keys(t: CleanTables) -> DataFrame:
    return conform.enrich(t.payments, t.order_keys, "order_id", "order_id_values")


def reviews_with_keys(t: CleanTables, reviews: DataFrame | None = None) -> DataFrame:
    reviews = t.english_reviews if reviews is None else reviews
    reviews = conform.enrich(reviews, t.review_keys, "review_id", "review_id_values")
    return conform.enrich(reviews, t.order_keys, "order_id", "order_id_values")


def orders_with_keys(t: CleanTables) -> DataFrame:
    orders = conform.enrich(t.orders, t.order_keys, "order_id", "order_id_values")
    return conform.enrich(orders, t.customer_keys, "customer_id", "customer_id_values")


def products_with_keys(t: CleanTables) -> DataFrame:
    return conform.enrich(t.products, t.product_keys, "product_id", "product_id_values")


def sellers_with_keys(t: CleanTables) -> DataFrame:
    return conform.enrich(t.sellers, t.seller_keys, "seller_id", "seller_id_values")


def customers_with_keys(t: CleanTables) -> DataFrame:
    return conform.enrich(t.customers, t.customer_keys, "customer_id", "customer_id_values")


# Audits -------------------------------------------------------------------------------------------
def audit_duplicate_items(t: CleanTables) -> DataFrame:
    return conform.duplicates(t.typed_items, ITEM_KEYS)


def audit_duplicate_payments(t: CleanTables, payments: DataFrame | None = None) -> DataFrame:
    columns = ["order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"]
    found = conform.duplicates(t.payments if payments is None else payments, columns)
    return conform.enrich(found, t.order_keys, "order_id", "order_id_values")


def audit_duplicate_reviews(t: CleanTables, reviews: DataFrame | None = None) -> DataFrame:
    """Repeats are looked for among digests of whole rows; only the few found are read with their texts and translated."""
    reviews = t.reviews if reviews is None else reviews
    columns = reviews.columns
    texts = ["review_comment_title", "review_comment_message"]
    fields = [F.sha2(F.col(c), 256) if c in texts else F.col(c).cast("string") for c in columns]
    # Each value with its length, and a mark for null: rows are equal if these texts are.
    parts = [F.coalesce(F.concat(F.length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    marked = reviews.withColumn("__row", F.sha2(F.concat(*parts), 256))
    found = marked.groupBy("__row").agg(F.count("*").alias("duplicate_count")).where("duplicate_count > 1")
    again = marked.join(found, "__row").groupBy("__row").agg(
        F.first("duplicate_count").alias("duplicate_count"), *[F.first(c).alias(c) for c in columns]
    )
    rows = t.translate(again.drop("__row"))
    return reviews_with_keys(t, rows.select(*columns, "review_english", "duplicate_count"))


def audit_duplicate_orders(t: CleanTables, orders: DataFrame | None = None) -> DataFrame:
    orders = t.orders if orders is None else orders
    return conform.duplicates(orders, orders.columns, "duplicates")


def audit_duplicate_categories(dictionary: DataFrame) -> DataFrame:
    return conform.duplicates(dictionary, ["category_pt", "category_en", "main_categories"], "duplicates")


def audit_multi_seller_orders(t: CleanTables, more_than: int = 1) -> DataFrame:
    found = (
        t.items_or_repeats.groupBy("order_id")
        .agg(F.count_distinct("seller_id").alias("seller_count"))
        .where(F.col("seller_count") > more_than)
    )
    return conform.enrich(found, t.order_keys, "order_id", "order_id_values").select("order_id_values", "seller_count")


def audit_category_values(t: CleanTables) -> DataFrame:
    return X.group_folded(t.products, ["product_category_name", "category_en", "main_categories"])


def audit_product_ids(t: CleanTables) -> DataFrame:
    return t.products.select("product_id").distinct()


def audit_city_variants(sellers: DataFrame, part: str = "ao paulo") -> DataFrame:
    found = sellers.where(F.lower("seller_city").contains(part.lower()))
    return X.group_folded(found, ["seller_city", "seller_state"])


def audit_unmapped_categories(t: CleanTables) -> DataFrame:
    return t.products.where(F.col("main_categories").isNull())
