"""The tables the jobs work on: raw as loaded, and clean."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.operators.per_order import items_per_order, order_totals, payments_per_order
from feira.plans import cleaning
from feira.session import write_and_read


@dataclass(frozen=True)
class RawTables:
    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    customers: DataFrame
    geolocation: DataFrame
    category_translation: DataFrame
    review_translation: DataFrame


class CleanTables:
    """Cleaned tables, each built when first asked for.

    All joins run on the natural ids. The surrogate ids (``*_id_values``) are looked up in the key
    mappings for the rows a query returns; a mapping is written once per instance.

    With ``store_items`` the items are also written once when their duplicates are removed, the one
    cleaning step that shuffles a whole fact table; pays off from the second query on.
    """

    def __init__(self, raw: RawTables, store_items: bool = False):
        self.raw = raw
        self.store_items = store_items

    @cached_property
    def orders(self) -> DataFrame:
        return cleaning.clean_orders(self.raw)

    @cached_property
    def typed_items(self) -> DataFrame:
        """Items before duplicates are removed."""
        return cleaning.typed_items(self.raw)

    @cached_property
    def items(self) -> DataFrame:
        items = cleaning.dedup_items(self.typed_items)
        return write_and_read(items, "items") if self.store_items else items

    @property
    def items_or_repeats(self) -> DataFrame:
        """For distinct counts, which repeats do not change: whichever items cost no extra shuffle."""
        return self.items if self.store_items else self.typed_items

    @cached_property
    def payment_totals(self) -> DataFrame:
        """One row per paid order, written once: as a table it is shuffled by order like any other input of a join."""
        return write_and_read(payments_per_order(self.payments), "payment-totals")

    @cached_property
    def order_totals(self) -> DataFrame:
        """One row per paid order with its year, payments and reviews, written once."""
        return write_and_read(order_totals(self.orders, self.payment_totals, self.reviews), "order-totals")

    @cached_property
    def paid_items(self) -> DataFrame:
        """One row per paid order with the number and value of its items, written once."""
        totals = items_per_order(self.items).select(
            "order_id", F.col("n_items").alias("order_items"), F.col("gross_sum").alias("order_gross")
        )
        return write_and_read(totals.join(self.payment_totals.select("order_id", "paid"), "order_id"), "paid-items")

    @cached_property
    def payments(self) -> DataFrame:
        return cleaning.clean_payments(self.raw)

    @cached_property
    def reviews(self) -> DataFrame:
        return cleaning.clean_reviews(self.raw)

    @cached_property
    def english_reviews(self) -> DataFrame:
        """Reviews with ``review_english``."""
        return self.translate(self.reviews)

    def translate(self, df: DataFrame) -> DataFrame:
        """Add ``review_english``; best on rows that are already filtered, as it shuffles by text."""
        return cleaning.translated(df, self.raw.review_translation)

    @cached_property
    def products(self) -> DataFrame:
        return cleaning.clean_products(self.raw)

    @cached_property
    def sellers(self) -> DataFrame:
        return cleaning.clean_sellers(self.raw)

    @cached_property
    def customers(self) -> DataFrame:
        return self.raw.customers

    @cached_property
    def order_keys(self) -> DataFrame:
        return cleaning.map_order_ids(self.raw)

    @cached_property
    def product_keys(self) -> DataFrame:
        return cleaning.map_product_ids(self.raw)

    @cached_property
    def seller_keys(self) -> DataFrame:
        return cleaning.map_seller_ids(self.raw)

    @cached_property
    def customer_keys(self) -> DataFrame:
        return cleaning.map_customer_ids(self.raw)

    @cached_property
    def review_keys(self) -> DataFrame:
        return cleaning.map_review_ids(self.raw)


TABLE_NAMES = ("orders", "items", "payments", "reviews", "products", "sellers", "customers")
KEY_NAMES = ("order_keys", "product_keys", "seller_keys", "customer_keys", "review_keys")
YEAR = "purchase_year"
STORED = (*TABLE_NAMES, "typed_items", "english_reviews", "payment_totals", "order_totals", "paid_items", *KEY_NAMES)


class SavedTables:
    """The same tables read back from a folder written by ``save_clean``."""

    def __init__(self, spark: SparkSession, folder: str):
        for name in STORED:
            setattr(self, name, spark.read.parquet(f"{folder}/{name}"))
        self.orders_by_year = self.orders
        self.orders = self.orders_by_year.drop(YEAR)
        self.items_or_repeats = self.items
        self.review_translation = spark.read.parquet(f"{folder}/review_translation")

    def translate(self, df: DataFrame) -> DataFrame:
        return cleaning.translated(df, self.review_translation)

    def orders_of(self, *years: int) -> DataFrame:
        """Orders bought in ``years``; only those years' files are listed and read."""
        return self.orders_by_year.where(F.col(YEAR).isin(*years)).drop(YEAR)


def save_clean(t: CleanTables, folder: str) -> SavedTables:
    """Write all clean tables and key mappings once; every later query starts from plain scans.

    Orders lie in one folder for each year of purchase. They are dealt out by year first, and a year that is
    too large for one file is split, so neither does every task write to every year nor one task a whole year.
    """
    for name in STORED:
        if name == "orders":
            by_year = t.orders.withColumn(YEAR, F.year("order_purchase_timestamp")).hint("rebalance", YEAR)
            by_year.write.mode("overwrite").partitionBy(YEAR).parquet(f"{folder}/orders")
        else:
            getattr(t, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    t.raw.review_translation.write.mode("overwrite").parquet(f"{folder}/review_translation")
    return SavedTables(t.orders.sparkSession, folder)
