"""Revenue, payment and product KPIs.

Where the source business logic multiplies payments by items, so does this module: a payment counts once
per item of its order. ``seller_revenue_allocated`` and ``aov_per_order`` give the undistorted figures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions import exprs as X
from feira.operators.conform import enrich, not_broadcast
from feira.operators.per_order import items_per_order, order_years, payments_per_order
from feira.plans.orders import PURCHASE, YEARS
from feira.tables import CleanTables

# --- Fixed values: the labels of the financial categories and the statuses of projected revenue ---
BOOKED = "In Our Books"
PROJECTED = "Projected Earnings"
LOST = "Canceled / Unavailable"
PROJECTED_STATUSES = ["approved", "created", "invoiced", "processing", "shipped"]
# --- End of fixed values ---


def _brl(*names: str) -> dict[str, Column]:
    return {n: X.fmt_brl(n) for n in names}


def _revenue_names(years: Sequence[int]) -> list[str]:
    return [f"Revenue_{y}" for y in years]


def _money_per_year(years: Sequence[int], value: Column, prefix: str = "Revenue") -> list[Column]:
    names = [f"{prefix}_{y}" for y in years]
    return [X.money(c).alias(n) for c, n in zip(X.per_year("year", years, value, prefix), names)]


def item_payment_detail(t: CleanTables) -> DataFrame:
    """Every item with every payment of its order, in order of the order key.

    Product and seller labels are looked up before the join multiplies the rows. Items meet payments as two
    plain shuffles, so that an order with very many items can be split at run time; the order's label comes
    after, on the partitioning of that join. The further sort columns let the range shuffle split it, too.
    """
    items = t.items.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
    items = enrich(items, t.product_keys, "product_id", "product_id_values")
    items = enrich(items, t.seller_keys, "seller_id", "seller_id_values")
    payments = t.payments.select(
        "order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"
    )
    rows = enrich(items.join(payments, "order_id"), t.order_keys, "order_id", "order_id_values")
    return rows.select(
        "order_id_values", "order_item_id", "product_id_values", "seller_id_values", "payment_sequential",
        "payment_type", "payment_installments", "payment_value", "price", "freight_value",
    ).orderBy("order_id_values", "order_item_id", "payment_sequential", "product_id_values")


def total_revenue(t: CleanTables) -> DataFrame:
    return X.with_text(t.payments.agg(X.money(F.sum("payment_value")).alias("revenue")), _brl("revenue"))


def _orders_with_paid(t: CleanTables, how: str) -> DataFrame:
    orders = t.orders.select("order_id", "order_status", PURCHASE)
    return orders.join(payments_per_order(t.payments), "order_id", how).withColumn("year", F.year(PURCHASE))


def revenue_per_year(t: CleanTables) -> DataFrame:
    sums = _orders_with_paid(t, "left").groupBy("year").agg(X.money(F.sum("paid")).alias("revenue"))
    return X.with_text(sums, _brl("revenue")).orderBy("year")


def revenue_by_month(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    sums = (
        _orders_with_paid(t, "left")
        .groupBy(F.month(PURCHASE).alias("month"))
        .agg(*_money_per_year(years, F.col("paid"), "total_Revenue"))
    )
    names = [f"total_Revenue_{y}" for y in years]
    return X.with_text(sums, {n: X.fmt_number(n) for n in names}).orderBy("month")


def revenue_by_quarter(t: CleanTables) -> DataFrame:
    sums = (
        _orders_with_paid(t, "inner")
        .groupBy("year", F.quarter(PURCHASE).alias("quarter"))
        .agg(X.money(F.sum("paid")).alias("revenue"))
    )
    return X.with_text(sums, _brl("revenue")).orderBy("year", "quarter")


def _share_of_all(df: DataFrame, digits: int) -> DataFrame:
    """Add each row's share of all revenue. The window sees only the few rows left after grouping."""
    shares = df.withColumn("all_revenue", F.sum("revenue").over(Window.partitionBy())).withColumn(
        "pct_revenue", X.ratio("revenue", "all_revenue")
    )
    share_text = X.fmt_pct("revenue", "all_revenue", digits)
    return X.with_text(shares, _brl("revenue") | {"pct_revenue": share_text}).drop("all_revenue")


def revenue_by_status(t: CleanTables) -> DataFrame:
    sums = (
        _orders_with_paid(t, "inner")
        .groupBy("order_status")
        .agg(F.sum("n_payments").alias("total_orders"), X.money(F.sum("paid")).alias("revenue"))
    )
    return _share_of_all(sums, 3)


def financial_category(
    t: CleanTables, booked: Sequence[str] = ("delivered",), projected: Sequence[str] = PROJECTED_STATUSES
) -> DataFrame:
    status = F.col("order_status")
    category = (
        F.when(status.isin(list(booked)), BOOKED).when(status.isin(list(projected)), PROJECTED).otherwise(LOST)
    )
    sums = (
        _orders_with_paid(t, "inner")
        .groupBy("year", category.alias("financial_category"))
        .agg(F.sum("n_payments").alias("total_orders"), X.money(F.sum("paid")).alias("revenue"))
    )
    return _share_of_all(sums, 2).orderBy("year", "financial_category")


def aov(t: CleanTables) -> DataFrame:
    """Revenue over payment rows."""
    return t.payments.agg(X.rounded_ratio(F.sum("payment_value"), F.count("order_id")).alias("AOV"))


def aov_per_order(t: CleanTables) -> DataFrame:
    """Revenue over orders."""
    per_order = t.payments.groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    return per_order.agg(X.rounded_ratio(F.sum("paid"), F.count("order_id")).alias("AOV"))


def multi_payment_counts(t: CleanTables) -> DataFrame:
    return (
        t.payments.where("payment_sequential > 1")
        .groupBy("payment_sequential")
        .agg(F.count("order_id").alias("total_orders"))
        .select("total_orders", "payment_sequential")
    )


def payment_type_stacking(t: CleanTables) -> DataFrame:
    sequence = F.sum(F.col("payment_sequential").cast("decimal(10,3)"))
    return (
        t.payments.groupBy("payment_type")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.sum("payment_sequential").alias("total_sequentials"),
            X.rounded_ratio(sequence, F.count("order_id"), 3).alias("avg_payments_per_order"),
        )
        .select("total_orders", "payment_type", "total_sequentials", "avg_payments_per_order")
    )


def installments_by_type(t: CleanTables) -> DataFrame:
    sums = t.payments.groupBy("payment_type").agg(F.sum("payment_installments").alias("total_installemnts"))
    return X.with_text(sums, {"total_installemnts": X.fmt_number("total_installemnts")})


def cancelled_by_payment(t: CleanTables, status: str = "canceled", payment_type: str = "credit_card") -> DataFrame:
    orders = t.orders.where(F.col("order_status") == status).select("order_id", "order_status")
    payments = t.payments.where(F.col("payment_type") == payment_type).select("order_id", "payment_type")
    reviews = t.reviews.select("review_id", "order_id", "review_comment_message")
    rows = orders.join(payments, "order_id").join(reviews, "order_id")
    return t.translate(rows).select("payment_type", "order_status", "review_english")


def seller_payment_sums(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    """Payments counted once per item, per seller and year.

    Items meet the stored totals of their orders as two plain shuffles, so an order whose items differ in
    seller or product, and that therefore keeps many rows, can be split at run time. So do the jobs below.
    """
    value = F.col("n_items") * F.col("paid")
    return (
        items_per_order(t.items, "seller_id")
        .join(t.order_totals.select("order_id", "year", "paid"), "order_id")
        .groupBy("seller_id")
        .agg(*_money_per_year(years, value), X.money(F.sum(value)).alias("total"))
    )


def revenue_per_seller(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    names = _revenue_names(years)
    sums = enrich(seller_payment_sums(t, years), t.seller_keys, "seller_id", "seller_id_values")
    texts = X.with_text(sums.select("seller_id_values", *names, "total"), _brl(*names))
    return texts.orderBy("total", "seller_id_values").drop("total")


def _revenue_per_place(t: CleanTables, place: str, years: Sequence[int]) -> DataFrame:
    names = _revenue_names(years)
    rows = seller_payment_sums(t, years).join(t.sellers.select("seller_id", place), "seller_id")
    sums = X.group_folded(rows, [place], *[X.money(F.sum(n)).alias(n) for n in [*names, "total"]])
    return X.with_text(sums, _brl(*names))


def revenue_per_city(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    return _revenue_per_place(t, "seller_city", years).orderBy("total", "seller_city").drop("total")


def revenue_per_state(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    return _revenue_per_place(t, "seller_state", years).drop("total")


def lucrative_gap_cities(t: CleanTables, threshold: float = 100000) -> DataFrame:
    """Per city: sellers, products and revenue, where revenue exceeds ``threshold``.

    Sellers and products are counted apart, each from rows that are already one per city and seller or
    product, over the same pairs of seller and product: no row is expanded for the second count, and Spark
    reuses the pairs' shuffle.
    """
    pairs = (
        items_per_order(t.items, "seller_id", "product_id")
        .join(t.payment_totals.select("order_id", "paid", "n_values"), "order_id")
        .groupBy("seller_id", "product_id")
        .agg(
            X.money(F.sum(F.col("n_items") * F.col("paid"))).alias("paid"),
            F.sum(F.col("n_items") * F.col("n_values")).alias("n_values"),
        )
    )
    city = X.folded("seller_city").alias("city")
    placed = pairs.join(t.sellers.select("seller_id", "seller_city", city), "seller_id")
    sellers = placed.groupBy("city", "seller_id").agg(
        F.min("seller_city").alias("seller_city"), F.sum("paid").alias("paid"), F.sum("n_values").alias("n_values")
    )
    cities = (
        sellers.groupBy("city")
        .agg(
            F.min("seller_city").alias("seller_city"),
            F.count("seller_id").alias("total_sellers"),
            X.money(F.sum("paid")).alias("Revenue"),
            X.rounded_ratio(F.sum("paid"), F.sum("n_values")).alias("avg_payment_value"),
        )
        .where(F.col("Revenue") > threshold)
    )
    products = placed.groupBy("city", "product_id").agg(F.lit(1).alias("one"))
    products = products.groupBy(F.col("city").alias("city_sold")).agg(F.count("product_id").alias("total_products"))
    both = cities.join(products, F.col("city").eqNullSafe(F.col("city_sold")))
    columns = both.select("seller_city", "total_sellers", "Revenue", "total_products", "avg_payment_value")
    return X.with_text(columns, _brl("Revenue")).orderBy("total_sellers", "seller_city")


def phased_out_products(
    t: CleanTables, years: Sequence[int] = YEARS, product: str | None = None
) -> DataFrame:
    """Gross revenue of products without revenue in the first and last year; optionally of one product."""
    items = t.items
    if product is not None:
        # The mapping is one row per id and label, so this is at most one row.
        wanted = t.product_keys.where(F.col("product_id_values") == product).select("product_id")
        items = items.join(F.broadcast(wanted), "product_id", "left_semi")
    gross = F.col("gross_sum") * F.col("n_payments")
    paid = F.col("n_items") * F.col("paid")
    names = _revenue_names(years)
    paid_in = {y: F.sum(F.when(F.col("year") == y, paid).otherwise(0)) for y in (years[0], years[-1])}
    sums = (
        items_per_order(items, "product_id")
        .join(t.order_totals.select("order_id", "year", "paid", "n_payments"), "order_id")
        .groupBy("product_id")
        .agg(
            F.sum(F.col("n_items") * F.col("n_payments")).alias("total_orders"),
            *_money_per_year(years, gross),
            X.money(F.sum(gross)).alias("total_Revenue"),
            paid_in[years[0]].alias("paid_first"),
            paid_in[years[-1]].alias("paid_last"),
        )
        .where("paid_first = 0 AND paid_last = 0")
    )
    labelled = enrich(sums, t.product_keys, "product_id", "product_id_values")
    return X.with_text(
        labelled.select("product_id_values", "total_orders", *names, "total_Revenue"), _brl(*names, "total_Revenue")
    )


def net_revenue_per_product(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    names = _revenue_names(years)
    sums = (
        items_per_order(t.items, "product_id")
        .join(order_years(t.orders), "order_id")
        .groupBy("product_id")
        .agg(F.sum("n_items").alias("total_orders"), *_money_per_year(years, F.col("price_sum")))
    )
    labelled = enrich(sums, t.product_keys, "product_id", "product_id_values")
    return X.with_text(labelled.select("product_id_values", "total_orders", *names), _brl(*names))


def low_reviews_by_product(t: CleanTables, threshold: int = 3) -> DataFrame:
    reviews = t.english_reviews.where(F.col("review_score") < threshold).select("order_id", "review_english")
    rows = t.items.select("order_id", "product_id").join(reviews, "order_id")
    rows = enrich(rows, t.order_keys, "order_id", "order_id_values")
    rows = enrich(rows, t.product_keys, "product_id", "product_id_values")
    return rows.select("order_id_values", "product_id_values", "review_english")


def revenue_by_category(t: CleanTables, years: Sequence[int] = YEARS) -> DataFrame:
    """Price and freight per category, counted once per payment of the order."""
    names = _revenue_names(years)
    gross = F.col("gross_sum") * F.col("n_payments")
    products = (
        items_per_order(t.items, "product_id")
        .join(t.order_totals.select("order_id", "year", "n_payments"), "order_id")
        .groupBy("product_id")
        .agg(*_money_per_year(years, gross))
    )
    sums = (
        products.join(not_broadcast(t.products.select("product_id", "main_categories")), "product_id")
        .groupBy("main_categories")
        .agg(
            F.count_distinct("product_id").alias("total_products"),
            *[X.money(F.sum(n)).alias(n) for n in names],
        )
    )
    return X.with_text(sums, _brl(*names))


def seller_revenue_allocated(t: CleanTables) -> DataFrame:
    """Each order's payments shared out over its sellers by price and freight.

    Shares are exact decimals with six digits, so the sum does not depend on the order of the rows.
    Orders whose items are all free are shared out by item count.
    """
    shares = items_per_order(t.items, "seller_id").select("order_id", "seller_id", "n_items", "gross_sum")
    by_value = F.col("order_gross") != 0
    weight = F.when(by_value, F.col("gross_sum")).otherwise(F.col("n_items")).cast("decimal(20,2)")
    whole = F.when(by_value, F.col("order_gross")).otherwise(F.col("order_items")).cast("decimal(20,2)")
    part = (F.col("paid").cast("decimal(17,2)") * weight / whole).cast("decimal(38,6)")
    return (
        shares.join(t.paid_items, "order_id")
        .select("seller_id", part.alias("part"))
        .groupBy("seller_id")
        .agg(F.sum("part").cast("decimal(38,6)").alias("allocated_revenue"))
    )
