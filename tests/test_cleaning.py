from collections import Counter
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from feira.operators import conform
from feira.plans import cleaning, orders, revenue
from feira.tables import save_clean
from tests.frames import item, marketplace, order, payment, review, rows
from tests.test_skew import SKEW_CONF, settings


def test_only_all_null_rows_go(spark):
    df = spark.createDataFrame([(None, None), ("a", None), (None, 1)], "x string, y int")
    assert rows(conform.drop_all_null(df, ["x", "y"])) == [("a", None), (None, 1)]


def test_equal_items_keep_the_lowest_number(spark):
    t = marketplace(spark, items=[item("o", 2), item("o", 1), item("o", 3, price=11.0)])
    assert rows(t.items.select("order_item_id", "price")) == [(1, Decimal("10.00")), (3, Decimal("11.00"))]


def test_items_equal_up_to_null_are_one_group(spark):
    t = marketplace(spark, items=[item("o", 1, product=None), item("o", 2, product=None)])
    assert rows(t.items.select("order_item_id")) == [(1,)]


def test_items_are_compared_after_dates_and_money_are_final(spark):
    later = datetime(2017, 3, 1, 23, 0)
    t = marketplace(spark, items=[item("o", 1, price=10.001), item("o", 2, price=10.0, limit=later)])
    assert t.items.count() == 1
    assert t.items.first()["shipping_limit_date"] == date(2017, 3, 1)


def test_keep_first_is_idempotent_and_carries_other_columns(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 5, "c")], "key string, n int, rest string")
    once = conform.keep_first(df, ["key"], "n")
    assert rows(once) == [("k", 1, "a"), ("m", 5, "c")]
    assert rows(conform.keep_first(once, ["key"], "n")) == rows(once)


def test_keep_first_takes_null_as_lowest(spark):
    df = spark.createDataFrame([("k", 2), ("k", None)], "key string, n int")
    assert rows(conform.keep_first(df, ["key"], "n")) == [("k", None)]


def test_enrich_keeps_rows_and_old_values(spark):
    df = spark.createDataFrame([("a", "old"), ("b", "old"), (None, "old")], "id string, label string")
    lookup = spark.createDataFrame([("a", "new")], "id string, label string")
    assert rows(conform.enrich(df, lookup, "id", "label")) == [("a", "new"), ("b", "old"), (None, "old")]


def test_translation_yields_one_row_per_review(spark):
    t = marketplace(
        spark,
        reviews=[review("o1", message="bom"), review("o2", message="ruim"), review("o3", message="Bom"), review("o4")],
        review_translation=[("bom", "good"), ("bom", "fine"), (None, "nothing")],
    )
    assert rows(t.english_reviews.select("order_id", "review_english")) == [
        ("o1", "fine"), ("o2", None), ("o3", "fine"), ("o4", None),
    ]


def test_texts_are_translated_without_ids_beside_them(spark):
    texts = spark.createDataFrame([("BOM",), (None,)], "review_comment_message string")
    lookup = spark.createDataFrame([("bom", "good")], "column1 string, column2 string")
    assert rows(cleaning.translated(texts, lookup)) == [("BOM", "good"), (None, None)]


def test_reviews_without_text_do_not_all_meet_in_one_task(spark):
    reviews = spark.range(2000).select(
        F.col("id").cast("string").alias("review_id"), F.lit("o").alias("order_id"),
        F.when(F.col("id") == 7, "Oi ").alias("review_comment_message"),
    )
    lookup = spark.createDataFrame([("oi", "hi"), (None, "nothing")], "column1 string, column2 string")
    with settings(spark, SKEW_CONF):
        found = cleaning.translated(reviews, lookup).withColumn("task", F.spark_partition_id()).collect()
    assert [(r.review_id, r.review_english) for r in found if r.review_english] == [("7", "hi")] and len(found) == 2000
    assert max(Counter(r.task for r in found).values()) < 200


def test_payments_are_recoded_and_rounded(spark):
    t = marketplace(spark, payments=[payment("o", 9.995, kind="boleto")])
    got = t.payments.first()
    assert (got.payment_type, got.payment_type_raw, got.payment_value) == ("voucher", "boleto", Decimal("10.00"))


def test_timestamps_lose_fractions_and_dates_lose_times(spark):
    bought = datetime(2017, 3, 1, 23, 59, 59, 900000)
    t = marketplace(spark, orders=[order("o", bought=bought, approved=None, arrived=bought)])
    got = t.orders.first()
    assert got.order_purchase_timestamp == datetime(2017, 3, 1, 23, 59, 59)
    assert got.order_delivered_customer_date == date(2017, 3, 1)
    text = cleaning.orders_as_text(t.orders).first()
    assert (text.order_purchase_timestamp, text.order_approved_at) == ("2017-03-01 23:59:59", None)


def test_duplicate_audits_find_repeats(spark):
    t = marketplace(
        spark,
        orders=[order("o"), order("o"), order("p")],
        payments=[payment("o"), payment("o"), payment("p")],
        reviews=[review("o", message="x"), review("o", message="x"), review("p")],
    )
    assert [r["duplicates"] for r in cleaning.audit_duplicate_orders(t).collect()] == [2]
    found = cleaning.audit_duplicate_payments(t).collect()
    assert [(r["order_id_values"], r["duplicate_count"]) for r in found] == [("A00001", 2)]
    found = cleaning.audit_duplicate_reviews(t).collect()
    assert [(r["review_comment_message"], r["duplicate_count"], r["review_id_values"]) for r in found] == [("x", 2, "R00001")]


def test_products_take_their_category_and_unknown_ones_stay_empty(spark):
    t = marketplace(
        spark,
        products=[("p1", "moveis"), ("p2", "pc_gamer"), ("p3", "nada"), ("p4", None)],
        category_translation=[("moveis", "furniture_decor"), ("moveis", "furniture_decor")],
    )
    assert rows(t.products.select("product_id", "category_en", "main_categories")) == [
        ("p1", "furniture_decor", "Home & Furniture"),
        ("p2", "pc_gamer", "Electronics & Technology"),
        ("p3", None, None),
        ("p4", None, None),
    ]
    assert cleaning.audit_unmapped_categories(t).count() == 2


def test_a_seller_without_id_is_appended_and_joins_nothing(spark):
    t = marketplace(spark, sellers=[("s1", "sp", "SP")], items=[item("o")])
    assert rows(t.sellers) == [("s1", "são paulo", "SP"), (None, "Ipirá", "BA")]
    assert rows(orders.orders_per_city(t)) == [("são paulo", 1)]


def test_multi_seller_orders(spark):
    t = marketplace(spark, items=[item("o1"), item("o1", 2, seller="s2"), item("o2")])
    assert rows(cleaning.audit_multi_seller_orders(t)) == [("A00001", 2)]


def test_saved_tables_give_the_same_results(sample, tmp_path):
    saved = save_clean(sample, str(tmp_path))
    assert rows(revenue.revenue_by_category(saved)) == rows(revenue.revenue_by_category(sample))
    assert saved.orders.dtypes == sample.orders.dtypes
    assert saved.order_keys.count() == sample.orders.select(F.count_distinct("order_id")).first()[0]


def test_an_item_row_with_only_a_seller_stays(spark):
    raw = spark.createDataFrame(
        [(None, None, None, "s"), (None, None, None, None)],
        "order_id string, order_item_id int, product_id string, seller_id string",
    )
    kept = conform.drop_all_null(raw, ["order_id", "order_item_id", "product_id", "seller_id"])
    assert [r.seller_id for r in kept.collect()] == ["s"]


def test_saved_tables_keep_the_repeats_that_the_audit_reports(sample, tmp_path):
    saved = save_clean(sample, str(tmp_path))
    found = cleaning.audit_duplicate_items(sample).count()
    assert found > 0
    assert cleaning.audit_duplicate_items(saved).count() == found
