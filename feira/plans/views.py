"""The reporting views, as first defined and in corrected form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions import exprs as X
from feira.operators.conform import enrich, not_broadcast
from feira.operators.per_order import items_per_order, order_years
from feira.plans.orders import PURCHASE, YEARS
from feira.sources.loaders import register_views
from feira.tables import CleanTables


# The labels below are fixed values.
def _lifecycle(first: Column, middle: Column, last: Column) -> Column:
    """The label as first defined: the label for all three years can never be reached."""
    return (
        F.when(first & middle, "First two years")
        .when(last & middle, "last two years")
        .when(first & last, "first and last year")
        .otherwise("only one year")
    )


def _lifecycle_corrected(first: Column, middle: Column, last: Column) -> Column:
    return (
        F.when(first & middle & last, "throughout the years")
        .when(first & middle, "First two years")
        .when(middle & last, "last two years")
        .when(first & last, "first and last year")
        .when(first | middle | last, "only one year")
        .otherwise("none of the years")
    )


def _product_sums(t: CleanTables, years: Sequence[int], products: DataFrame | None = None) -> DataFrame:
    """One row per product over items x payments x reviews, from per-order totals; only of ``products`` if given.

    An item stands in the full join once per payment and review of its order, so every total is the
    item's own figure times those counts.
    """
    copies = F.col("n_payments") * F.col("n_reviews")
    sold = F.col("n_items") * copies
    items = t.items
    if products is not None:
        items = items.join(not_broadcast(products.select("product_id")), "product_id", "left_semi")
    return (
        items_per_order(items, "product_id")
        .join(t.order_totals.where("n_reviews IS NOT NULL"), "order_id")
        .groupBy("product_id")
        .agg(
            F.sum(sold).alias("total_quantity_sold"),
            F.sum(F.col("n_sellers") * copies).alias("sellers_inolved"),
            X.money(F.sum(F.col("gross_sum") * copies)).alias("transaction_value"),
            F.sum(sold * F.col("has_customer")).alias("total_customers_bought"),
            F.sum(F.col("n_items") * F.col("n_payments") * F.col("score_sum")).alias("score_sum"),
            F.sum(F.col("n_items") * F.col("n_payments") * F.col("n_scores")).alias("n_scores"),
            X.money(F.sum(F.col("price_sum") * copies)).alias("price_sum"),
            F.sum(F.col("n_prices") * copies).alias("n_prices"),
            *[F.max(X.flag(F.col("year") == y)).alias(f"sold_{y}") for y in years],
        )
    )


def _sold_products(t: CleanTables, years: Sequence[int], label, products: DataFrame | None = None) -> DataFrame:
    """``Revenue_<year>`` is the product's average price over all years if it sold in that year."""
    avg_price = X.rounded_ratio("price_sum", "n_prices").cast("decimal(18,2)")
    prices = [F.when(F.col(f"sold_{y}") == 1, F.col("avg_price")).otherwise(0) for y in years]
    known = t.products if products is None else products
    return (
        _product_sums(t, years, products)
        .join(not_broadcast(known.select("product_id", "main_categories")), "product_id")
        .withColumn("avg_price", avg_price)
        .withColumns({f"Revenue_{y}": p.cast("decimal(18,2)") for p, y in zip(prices, years)})
        .withColumn("product_lifecycle", label(*[p > 0 for p in prices]))
    )


def _product_rows(t: CleanTables, years: Sequence[int], products: DataFrame | None = None) -> DataFrame:
    rows = _sold_products(t, years, _lifecycle, products)
    return enrich(rows, t.product_keys, "product_id", "product_id_values").select(
        "product_id_values",
        X.ratio("score_sum", "n_scores").alias("avg_review"),
        "main_categories",
        "total_quantity_sold",
        *[f"Revenue_{y}" for y in years],
        "product_lifecycle",
        "sellers_inolved",
        "transaction_value",
        "total_customers_bought",
    )


def product_view(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    return _product_rows(t, years)


def product_lifecycles(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    """(product_id, product_lifecycle) as in the product view, without the labels and sums that takes."""
    return _sold_products(t, years, _lifecycle).select("product_id", "product_lifecycle")


def product_lifecycle_corrected(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    rows = _sold_products(t, years, _lifecycle_corrected)
    rows = enrich(rows.select("product_id", "product_lifecycle"), t.product_keys, "product_id", "product_id_values")
    return rows.select("product_id_values", "product_lifecycle")


def audit_unmapped_products(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    """The rows of the product view without a main category; items of other products go before anything is summed."""
    return _product_rows(t, years, t.products.where(F.col("main_categories").isNull()))


def _seller_years(t: CleanTables) -> DataFrame:
    """Products, orders and revenue per seller and year, equal items of an order counted once.

    Items are shuffled by order once, to meet its year; equal ones are merged where they then lie, and one
    aggregate by seller and year follows.
    """
    # Equal but for the shipping date counts as equal here, which covers what removing duplicates does.
    items = t.items_or_repeats.select("seller_id", "order_id", "product_id", "price", "freight_value")
    lines = items.join(order_years(t.orders), "order_id").distinct()
    return lines.groupBy("seller_id", "year").agg(
        F.count("product_id").alias("n_products"),
        F.count("*").alias("n_orders"),
        X.money(F.sum(F.col("price") + F.col("freight_value"))).alias("revenue"),
    )


def _seller_rows(t: CleanTables, years: Sequence[int]) -> DataFrame:
    """One row per seller and active year, all figures over the seller's whole life.

    ``Revenue_<year>`` repeats the all-time revenue for every active year, and ``total_revenue`` is
    their sum. The windows run over a seller's years, a handful of rows each.
    """
    seller = Window.partitionBy("seller_id")
    rows = (
        _seller_years(t)
        .join(t.sellers.select("seller_id", "seller_city", "seller_state").distinct(), "seller_id")
        .withColumns(
            {
                "total_products": F.sum("n_products").over(seller),
                "total_orders": F.sum("n_orders").over(seller),
                "all_time": F.sum("revenue").over(seller),
            }
        )
    )
    per_year = {
        f"Revenue_{y}": X.money(F.sum(F.when(F.col("year") == y, F.col("all_time")).otherwise(0)).over(seller))
        for y in years
    }
    return rows.withColumns(per_year | {"total_revenue": X.money(F.sum("all_time").over(seller))})


def _seller_columns(years: Sequence[int]) -> list[str]:
    return [f"Revenue_{y}" for y in years]


def seller_view(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    rows = enrich(_seller_rows(t, years), t.seller_keys, "seller_id", "seller_id_values")
    return rows.select(
        "seller_id_values", "seller_city", "seller_state", "total_products", *_seller_columns(years),
        "total_revenue", "total_orders",
    )


def seller_view_clean(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    """The seller view without its repeats: one row per seller."""
    best = Window.partitionBy("seller_id").orderBy(F.desc(f"Revenue_{years[-1]}"), "seller_city", "seller_state")
    top = _seller_rows(t, years).withColumn("row_num", F.row_number().over(best)).where("row_num = 1")
    return enrich(top, t.seller_keys, "seller_id", "seller_id_values").select(
        "seller_id_values", "seller_city", "seller_state", "total_products", "total_orders",
        *_seller_columns(years), "total_revenue",
    )


def seller_view_corrected(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    """One row per seller with the revenue of each year in its own column."""
    sums = (
        _seller_years(t)
        .groupBy("seller_id")
        .agg(
            F.sum("n_products").alias("total_products"),
            F.sum("n_orders").alias("total_orders"),
            *[
                X.money(c).alias(f"Revenue_{y}")
                for c, y in zip(X.per_year("year", years, F.col("revenue"), "Revenue"), years)
            ],
            X.money(F.sum("revenue")).alias("total_revenue"),
        )
    )
    rows = sums.join(t.sellers.select("seller_id", "seller_city", "seller_state"), "seller_id")
    return enrich(rows, t.seller_keys, "seller_id", "seller_id_values").select(
        "seller_id_values", "seller_city", "seller_state", "total_products", "total_orders",
        *_seller_columns(years), "total_revenue",
    )


def order_view(t: CleanTables) -> DataFrame:
    """One row per order, seller, review score and item price, equal rows merged.

    Year, status, customer and place follow from the ids, so rows are merged while they hold ids and figures
    only, where the join by order has put them; labels come after.
    """
    lines = (
        t.items.groupBy("order_id", "seller_id", "price", "freight_value")
        .agg(
            F.count("product_id").alias("n_products"),
            F.sum(F.col("price") + F.col("freight_value")).alias("gross"),
        )
    )
    reviews = t.reviews.groupBy("order_id", "review_score").agg(F.count("*").alias("n_reviews"))
    figures = [
        (F.col("n_products") * F.col("n_reviews")).alias("products_ordered"),
        X.money(F.col("gross") * F.col("n_reviews")).alias("Revenue"),
    ]
    rows = lines.join(reviews, "order_id").select("order_id", "seller_id", "review_score", *figures).distinct()
    # Customer and seller labels go on the one-row-per-id sides, so that the long side is shuffled by order and
    # by seller only. Every join by order has a plain shuffle on its right, which run-time splitting needs.
    orders = t.orders.select("order_id", "customer_id", "order_status", F.year(PURCHASE).alias("year"))
    orders = enrich(orders, t.customer_keys, "customer_id", "customer_id_values")
    sellers = enrich(t.sellers, t.seller_keys, "seller_id", "seller_id_values")
    rows = enrich(rows.join(orders, "order_id"), t.order_keys, "order_id", "order_id_values")
    return rows.join(sellers, "seller_id").select(
        "order_id_values", "products_ordered", "Revenue", "seller_id_values", "seller_city", "seller_state",
        "review_score", "year", "order_status", "customer_id_values",
    )


def all_views(t: CleanTables, years: Sequence[int] = YEARS) -> dict[str, DataFrame]:
    return {
        "product_view": product_view(t, years),
        "seller_view": seller_view(t, years),
        "seller_view_clean": seller_view_clean(t, years),
        "order_view": order_view(t),
    }


def register_all(t: CleanTables, years: Sequence[int] = YEARS) -> None:
    """Make the views available to SQL under their names."""
    register_views(all_views(t, years))


def export_all(t: CleanTables, folder: str, years: Sequence[int] = YEARS, fmt: str = "parquet") -> None:
    """Write every view to ``folder/<name>`` for dashboards."""
    for name, df in all_views(t, years).items():
        df.write.mode("overwrite").option("header", True).format(fmt).save(f"{folder}/{name}")
