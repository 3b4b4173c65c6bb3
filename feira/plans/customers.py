"""Customer retention KPIs, by person (not by the per-order customer id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.functions import exprs as X
from feira.operators.conform import enrich
from feira.plans.orders import PURCHASE
from feira.session import write_and_read
from feira.tables import CleanTables


YEAR_BLOCKS = (1840, 1904, 1968, 2032)  # 64 years each


def _orders_of_people(t: CleanTables) -> DataFrame:
    orders = t.orders.select("customer_id", "order_id", F.year(PURCHASE).alias("order_year"))
    return orders.join(t.customers, "customer_id").select("customer_unique_id", "order_id", "order_year")


def customer_orders(t: CleanTables) -> DataFrame:
    rows = enrich(_orders_of_people(t), t.order_keys, "order_id", "order_id_values")
    return rows.select("customer_unique_id", "order_id_values", "order_year")


def customer_summary(t: CleanTables) -> DataFrame:
    """Distinct orders and distinct years per person.

    A person's years are bits of four numbers, so only the orders are counted as distinct and no row is
    expanded; a year outside them ends the job instead of being lost.
    """
    year = F.col("order_year")
    sets = [
        F.bit_or(F.when(year.between(first, first + 63), F.expr(f"shiftleft(1L, order_year - {first})")))
        for first in YEAR_BLOCKS
    ]
    known = year.isNull() | year.between(YEAR_BLOCKS[0], YEAR_BLOCKS[-1] + 63)
    rows = _orders_of_people(t).withColumn(
        "order_year", F.when(known, year).otherwise(F.raise_error(F.concat(F.lit("year out of range: "), year.cast("string"))))
    )
    years = sum((F.coalesce(F.bit_count(s), F.lit(0)) for s in sets), F.lit(0))
    return rows.groupBy("customer_unique_id").agg(
        F.count_distinct("order_id").alias("order_count"), years.cast("bigint").alias("years_active")
    )


def _rate(summary: DataFrame, measure: str, count: str, pct: str) -> DataFrame:
    # The summary has one row per person, so counting them is a plain count.
    rate = summary.agg(
        F.count("customer_unique_id").alias("total_customers"), X.count_if(F.col(measure) > 1).alias(count)
    ).withColumn(pct, X.ratio(F.col(count) * 100, "total_customers"))
    text = X.fmt_number(X.rounded_ratio(F.col(count) * 100, "total_customers"), 2)
    return X.with_text(rate, {pct: text})


def repeat_rate(summary: DataFrame) -> DataFrame:
    return _rate(summary, "order_count", "repeat_customers", "repeat_customer_pct")


def multi_year_rate(summary: DataFrame) -> DataFrame:
    return _rate(summary, "years_active", "multi_year_customers", "multi_year_pct")


def order_count_histogram(summary: DataFrame) -> DataFrame:
    return summary.groupBy("order_count").agg(F.count("*").alias("num_customers")).orderBy("order_count")


def retention_report(t: CleanTables) -> dict[str, DataFrame]:
    """The three retention outputs over one summary, which is computed once and written."""
    summary = write_and_read(customer_summary(t), "customer-summary")
    return {
        "repeat_rate": repeat_rate(summary),
        "multi_year_rate": multi_year_rate(summary),
        "order_count_histogram": order_count_histogram(summary),
    }


def repeat_by_customer_key(t: CleanTables) -> DataFrame:
    """Per-order customer keys seen more than once in a year; none, as each order has its own key."""
    found = (
        t.orders.groupBy("customer_id", F.year(PURCHASE).alias("year"))
        .agg(F.count("customer_id").alias("count"))
        .where(F.col("count") > 1)
    )
    return enrich(found, t.customer_keys, "customer_id", "customer_id_values").select(
        "customer_id_values", "year", "count"
    )
