"""Order KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.functions import exprs as X
from feira.operators.conform import enrich
from feira.tables import CleanTables

YEARS = (2016, 2017, 2018)
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
PURCHASE = "order_purchase_timestamp"


def orders_per_year(t: CleanTables) -> DataFrame:
    return t.orders.groupBy(F.year(PURCHASE).alias("year")).agg(F.count_distinct("order_id").alias("total_orders"))


def status_by_year(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    return t.orders.groupBy("order_status").agg(*X.per_year(F.year(PURCHASE), years, F.lit(1), "orders"))


def _late_and_on_time(df: DataFrame, due: str) -> DataFrame:
    """Deliveries after and before ``due``; those on the very day are neither."""
    delivered = F.col("order_delivered_customer_date")
    return df.groupBy(F.year(PURCHASE).alias("year")).agg(
        X.count_if(delivered > F.col(due)).alias("late_deliveries"),
        X.count_if(delivered < F.col(due)).alias("on_time_deliveries"),
    )


def late_vs_on_time(t: CleanTables) -> DataFrame:
    return _late_and_on_time(t.orders, "order_estimated_delivery_date")


def late_vs_shipping_limit(t: CleanTables) -> DataFrame:
    return _late_and_on_time(t.orders.join(t.items, "order_id"), "shipping_limit_date")


def shipping_delay_detail(t: CleanTables) -> DataFrame:
    return t.orders.join(t.items, "order_id").select(
        "order_delivered_customer_date",
        "shipping_limit_date",
        X.days_between("shipping_limit_date", "order_delivered_customer_date").alias("dfrnc"),
    )


def fulfilment_durations(t: CleanTables) -> DataFrame:
    approved, carrier, customer = (
        "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
    )
    return t.orders.agg(
        X.int_avg(X.hours_between(PURCHASE, approved)).alias("hours_taken_to_approve"),
        X.int_avg(X.days_between(approved, carrier)).alias("days_taken_to_get_to_seller"),
        X.int_avg(X.days_between(carrier, customer)).alias("days_taken_from_seller_to_customer"),
        X.int_avg(X.days_between(approved, customer)).alias("days_from_aproval_to_customer"),
        X.int_avg(X.days_between(PURCHASE, customer)).alias("total_days_delivery_time"),
    )


def _item_rows_per_seller(t: CleanTables) -> DataFrame:
    return t.items.groupBy("seller_id").agg(F.count("order_id").alias("total_orders"))


def orders_per_seller(t: CleanTables) -> DataFrame:
    """Item rows per seller."""
    return (
        enrich(_item_rows_per_seller(t), t.seller_keys, "seller_id", "seller_id_values")
        .select("seller_id_values", "total_orders")
        .orderBy("seller_id_values")
    )


def _orders_per_place(t: CleanTables, place: str) -> DataFrame:
    """Counted per seller first, so that a big city is summed from few rows."""
    rows = _item_rows_per_seller(t).join(t.sellers.select("seller_id", place), "seller_id")
    return X.group_folded(rows, [place], F.sum("total_orders").alias("total_orders"))


def orders_per_city(t: CleanTables) -> DataFrame:
    return _orders_per_place(t, "seller_city")


def orders_per_state(t: CleanTables) -> DataFrame:
    return _orders_per_place(t, "seller_state")


def orders_by_weekday(t: CleanTables) -> DataFrame:
    counts = t.orders.groupBy(X.weekday(PURCHASE).alias("day")).agg(F.count("order_id").alias("total_orders"))
    return X.with_text(counts, {"total_orders": X.fmt_number("total_orders")})


def hour_by_weekday(t: CleanTables) -> DataFrame:
    day = X.weekday(PURCHASE)
    return (
        t.orders.select(F.hour(PURCHASE).alias("hour"), day.alias("day"))
        .groupBy("hour")
        .agg(*[X.count_if(F.col("day") == d).alias(f"total_orders_{d}") for d in WEEKDAYS])
        .orderBy("hour")
    )


def orders_by_month(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    counts = t.orders.groupBy(F.month(PURCHASE).alias("month")).agg(
        *X.per_year(F.year(PURCHASE), years, F.lit(1), "total_orders")
    )
    names = [f"total_orders_{y}" for y in years]
    return X.with_text(counts, {n: X.fmt_number(n) for n in names}).orderBy("month")


def distinct_item_orders(t: CleanTables) -> DataFrame:
    return t.items_or_repeats.agg(F.count_distinct("order_id").alias("total_orders"))


def orders_per_status(t: CleanTables) -> DataFrame:
    return t.orders.groupBy("order_status").agg(F.count("order_id").alias("total_orders"))


def peak_month(t: CleanTables) -> DataFrame:
    """The calendar month with most orders, the earliest on a tie."""
    return (
        t.orders.groupBy(F.year(PURCHASE).alias("year"), F.month(PURCHASE).alias("month"))
        .agg(F.count("order_id").alias("total_orders"))
        .orderBy(F.desc("total_orders"), "year", "month")
        .limit(1)
    )
