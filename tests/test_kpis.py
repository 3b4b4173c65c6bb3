"""Edge cases of the KPIs and views on small marketplaces."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feira.plans import customers, derived, orders, revenue, reviews, views
from tests.frames import DAY, item, marketplace, order, payment, review, rows

YEARS = (2016, 2017, 2018)


def year(y):
    return datetime(y, 6, 1)


@pytest.mark.parametrize(
    "hours, label",
    [(-3, "under 12 hours"), (11, "under 12 hours"), (12, "12 to 24 hours"), (24, "12 to 24 hours"),
     (25, "24 to 48 hours"), (48, "24 to 48 hours"), (49, "over two days"), (None, "over two days")],
)
def test_approval_edges(spark, hours, label):
    df = spark.createDataFrame([(hours,)], "h int")
    assert df.select(reviews.bucket("h", reviews.APPROVAL_BUCKETS, reviews.APPROVAL_REST)).first()[0] == label


@pytest.mark.parametrize(
    "hours, label",
    [(48, "approx two days"), (72, "took four days"), (96, "took four days"), (120, "took a week"), (168, "took a week"),
     (336, "took two weeks"), (360, "took a month"), (7220, "took a month"), (7221, "more than a month"),
     (None, "more than a month")],
)
def test_delivery_edges(spark, hours, label):
    df = spark.createDataFrame([(hours,)], "h int")
    assert df.select(reviews.bucket("h", reviews.DELIVERY_BUCKETS, reviews.DELIVERY_REST)).first()[0] == label


def test_delivery_hours_come_from_dates(spark):
    t = marketplace(
        spark,
        orders=[order("o", carried=datetime(2017, 3, 1, 23, 0), arrived=datetime(2017, 3, 4, 1, 0))],
        reviews=[review("o", 5), review("o", 4, "r2")],
    )
    assert rows(reviews.review_by_delivery_time(t)) == [("took four days", 2, 4.5, "50", 50.0)]


def test_delivery_on_the_due_day_is_neither_late_nor_on_time(spark):
    due = datetime(2017, 3, 9)
    t = marketplace(
        spark,
        orders=[
            order("o1", arrived=due, promised=due),
            order("o2", arrived=due + timedelta(days=1), promised=due),
            order("o3", arrived=due - timedelta(days=1), promised=due),
            order("o4", promised=due),
        ],
    )
    assert rows(orders.late_vs_on_time(t)) == [(2017, 1, 1)]


def test_overlapping_cancellation_stages(spark):
    t = marketplace(spark, orders=[order("o", "canceled", approved=None, carried=DAY, arrived=DAY), order("p")])
    assert dict(rows(reviews.cancellation_stages(t))) == {
        "orders_cancelled_after_delivery": 1,
        "orders_cancelled_during_shipping": 0,
        "orders_cancelled_after_approval": 0,
        "orders_cancelled_before_approval": 1,
        "cancelled_orders": 1,
    }


def test_year_without_payments_has_no_revenue(spark):
    t = marketplace(spark, orders=[order("o1"), order("o2", bought=year(2018))], payments=[payment("o1", 1234.5)])
    assert rows(revenue.revenue_per_year(t)) == [
        (2017, "R$ 1.234,50", Decimal("1234.50")), (2018, None, None),
    ]


def test_payments_count_once_per_item_and_allocation_does_not(spark):
    t = marketplace(
        spark,
        orders=[order("o")],
        items=[item("o", 1, seller="s1", price=29.0), item("o", 2, "p2", "s1", 9.0), item("o", 3, "p3", "s2", 59.0)],
        payments=[payment("o", 60.0), payment("o", 40.0, 2)],
        sellers=[("s1", "x", "SP"), ("s2", "x", "SP")],
    )
    sums = {r["seller_id_values"]: r["Revenue_2017_num"] for r in revenue.revenue_per_seller(t).collect()}
    assert sums == {"S00001": Decimal("200.00"), "S00002": Decimal("100.00")}
    shared = {r["seller_id"]: r["allocated_revenue"] for r in revenue.seller_revenue_allocated(t).collect()}
    assert shared == {"s1": Decimal("40.000000"), "s2": Decimal("60.000000")}
    assert rows(revenue.revenue_per_city(t))[0][0] == "x"
    assert rows(revenue.lucrative_gap_cities(t, 299)) == [("x", 2, "R$ 300,00", Decimal("300.00"), 3, Decimal("50.00"))]
    assert rows(revenue.lucrative_gap_cities(t, 300)) == []


def test_free_orders_are_allocated_by_item_count(spark):
    t = marketplace(
        spark,
        items=[item("o", 1, price=0.0, freight=0.0), item("o", 2, "p2", "s2", 0.0, 0.0)],
        payments=[payment("o", 9.0)],
    )
    assert rows(revenue.seller_revenue_allocated(t)) == [("s1", Decimal("4.500000")), ("s2", Decimal("4.500000"))]


def test_allocated_revenue_adds_up(sample):
    paid_orders = sample.items.select("order_id").distinct()
    total = sample.payments.join(paid_orders, "order_id").agg(F.sum("payment_value")).first()[0]
    shared = revenue.seller_revenue_allocated(sample).agg(F.sum("allocated_revenue")).first()[0]
    assert abs(total - shared) < Decimal("0.01")


def test_shares_sum_to_one(sample):
    for df in (revenue.financial_category(sample), revenue.revenue_by_status(sample)):
        assert abs(df.agg(F.sum("pct_revenue_num")).first()[0] - 1) < 1e-9


def test_average_order_value_by_row_and_by_order(spark):
    t = marketplace(spark, payments=[payment("o1", 30.0), payment("o1", 10.0, 2), payment("o2", 10.01)])
    assert revenue.aov(t).first()[0] == Decimal("16.67")
    assert revenue.aov_per_order(t).first()[0] == Decimal("25.01")


def test_phased_out_products(spark):
    t = marketplace(
        spark,
        orders=[order("o1", bought=year(2017)), order("o2", bought=year(2018))],
        items=[item("o1", product="a"), item("o2", product="b"), item("o1", 2, product="c"), item("o2", 2, product="c")],
        payments=[payment("o1"), payment("o2")],
    )
    assert [r["product_id_values"] for r in revenue.phased_out_products(t).collect()] == ["P00001"]
    assert revenue.phased_out_products(t, product="P00001").count() == 1
    assert revenue.phased_out_products(t, product="P00002").count() == 0


def lifecycles(spark, *sold):
    t = marketplace(
        spark,
        orders=[order(f"o{y}", bought=year(y)) for y in (*YEARS, 2020)],
        items=[item(f"o{y}", product="a") for y in sold],
        payments=[payment(f"o{y}") for y in sold],
        reviews=[review(f"o{y}") for y in sold],
        products=[("a", None)],
    )
    return (
        views.product_view(t).first()["product_lifecycle"],
        views.product_lifecycle_corrected(t).first()["product_lifecycle"],
    )


@pytest.mark.parametrize(
    "sold, label, corrected",
    [
        (YEARS, "First two years", "throughout the years"),
        ((2016, 2017), "First two years", "First two years"),
        ((2017, 2018), "last two years", "last two years"),
        ((2016, 2018), "first and last year", "first and last year"),
        ((2017,), "only one year", "only one year"),
        ((2020,), "only one year", "none of the years"),
    ],
)
def test_lifecycle_labels(spark, sold, label, corrected):
    assert lifecycles(spark, *sold) == (label, corrected)


def test_seller_view_repeats_rows_and_clean_view_does_not(spark):
    t = marketplace(
        spark,
        orders=[order("o1", bought=year(2016)), order("o2", bought=year(2018))],
        items=[item("o1", price=9.0), item("o2", price=19.0)],
        sellers=[("s1", "x", "SP")],
    )
    row = ("S00001", "x", "SP", 2, Decimal("30.00"), Decimal("0.00"), Decimal("30.00"), Decimal("60.00"), 2)
    assert rows(views.seller_view(t)) == [row, row]
    assert rows(views.seller_view_clean(t)) == [row[:4] + row[-1:] + row[4:-1]]
    assert rows(views.seller_view_corrected(t)) == [
        ("S00001", "x", "SP", 2, 2, Decimal("10.00"), Decimal("0.00"), Decimal("20.00"), Decimal("30.00"))
    ]


def test_corrected_seller_revenue_is_the_true_total(sample):
    lines = sample.typed_items.select("seller_id", "order_id", "product_id", "price", "freight_value").distinct()
    true_total = lines.join(sample.orders, "order_id").agg(F.sum(F.col("price") + F.col("freight_value"))).first()[0]
    assert views.seller_view_corrected(sample).agg(F.sum("total_revenue")).first()[0] == true_total


def test_order_view_merges_equal_rows(spark):
    t = marketplace(
        spark,
        orders=[order("o")],
        items=[item("o", 1, price=10.0, freight=5.0), item("o", 2, price=9.0, freight=6.0)],
        reviews=[review("o")],
        sellers=[("s1", "x", "SP")],
    )
    assert rows(views.order_view(t)) == [
        ("A00001", 1, Decimal("15.00"), "S00001", "x", "SP", 5, 2017, "delivered", "C00001")
    ]


def test_retention_report_counts_people_not_order_keys(spark):
    t = marketplace(
        spark,
        orders=[order("o1"), order("o2"), order("o3", bought=year(2018)), order("o4")],
        customers=[("c-o1", "ann"), ("c-o2", "bob"), ("c-o3", "bob"), ("c-o4", "cy")],
    )
    report = customers.retention_report(t)
    assert rows(report["repeat_rate"])[0][:3] == (3, 1, "33.33")
    assert rows(report["multi_year_rate"])[0][:3] == (3, 1, "33.33")
    assert rows(report["order_count_histogram"]) == [(1, 2), (2, 1)]
    assert customers.repeat_by_customer_key(t).count() == 0


def test_repeated_customer_key_is_found(spark):
    t = marketplace(spark, orders=[order("o1", customer="c"), order("o2", customer="c")])
    assert rows(customers.repeat_by_customer_key(t)) == [("C00001", 2017, 2)]


def test_reviews_of_cancelled_orders_by_payment(spark):
    t = marketplace(
        spark,
        orders=[order("o1", "canceled"), order("o2", "canceled"), order("o3"), order("o4", "canceled")],
        payments=[payment("o1"), payment("o1", 1.0, 2), payment("o2"), payment("o3"), payment("o4", kind="boleto")],
        reviews=[review("o1", 1, message="Bom "), review("o2", 1), review("o3", 1, message="bom"), review("o4", 1, message="bom")],
        review_translation=[("bom", "good")],
    )
    got = revenue.cancelled_by_payment(t)
    assert got.columns == ["payment_type", "order_status", "review_english"]
    card = ("credit_card", "canceled")
    assert rows(got) == [(*card, "good"), (*card, "good"), (*card, None)]


def test_complaints_by_payment_type(spark):
    t = marketplace(
        spark,
        orders=[order("o1", "canceled"), order("o2", "canceled"), order("o3")],
        payments=[payment("o1"), payment("o1", 1.0, 2), payment("o2", kind="boleto"), payment("o3")],
        reviews=[review("o1", 1, message="a"), review("o2", 1, message="b"), review("o3", 1, message="a")],
        review_translation=[("a", "No REFUND and no invoice"), ("b", "I want my money back")],
    )
    assert rows(derived.complaint_categories(t)) == [("credit_card", 1, 1), ("voucher", 1, 0)]
    labels = {r["review_english"]: r["review_category"] for r in derived.categorized_reviews(t).collect()}
    assert set(labels.values()) == {"refund"}


def test_a_repeated_review_is_one_complaint(spark):
    twice = review("o1", 1, message="a")
    t = marketplace(
        spark,
        orders=[order("o1", "canceled"), order("o2", "canceled"), order("o2", "canceled")],
        payments=[payment("o1"), payment("o2"), payment("o2", kind="debit_card")],
        reviews=[twice, twice, review("o1", 1, "r2"), review("o2", 1, message="b")],
        review_translation=[("a", "refund"), ("b", "invoice")],
    )
    assert rows(derived.complaint_categories(t)) == [("credit_card", 1, 1), ("debit_card", 0, 1)]


def test_cancelled_payment_shares_may_overlap(spark):
    t = marketplace(
        spark,
        orders=[order("o1", "canceled"), order("o2", "canceled")],
        payments=[payment("o1"), payment("o1", 5.0, 2, "voucher")],
    )
    assert rows(derived.cancelled_payment_mix(t)) == [("credit_card", 1, 0.5), ("voucher", 1, 0.5)]


def test_top_sellers(spark):
    t = marketplace(spark, items=[item("o", n, seller=f"s{n}", price=float(n), freight=0.0) for n in range(1, 5)])
    assert rows(derived.top_seller_concentration(t, top=2)) == [(2, Decimal("7.00"), Decimal("10.00"), 0.7)]


def test_views_are_visible_to_sql(spark, sample):
    views.register_all(sample, (1996, 1997, 1998))
    assert spark.sql("SELECT count(*) FROM seller_view_clean").first()[0] == sample.seller_keys.count()


def test_views_export_as_csv(spark, sample, tmp_path):
    views.export_all(sample, str(tmp_path), (1996, 1997, 1998), "csv")
    back = spark.read.csv(f"{tmp_path}/seller_view_clean", header=True)
    assert back.columns == views.seller_view_clean(sample, (1996, 1997, 1998)).columns
    assert back.count() == sample.seller_keys.count()
