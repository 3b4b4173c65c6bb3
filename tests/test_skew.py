"""One order, seller, city or text that holds a large part of all rows."""

import contextlib
import dataclasses

import pytest
from pyspark.sql import functions as F

from feira import CleanTables, RawTables, schema
from feira.plans import orders, revenue, views

HOT = 30000
# Tiny limits make run-time skew handling act on test-sized data as it would on big data.
SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "64",
}


@contextlib.contextmanager
def settings(spark, conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot(spark):
    """Two items of three are in order o0; every second seller row and review text is the same."""
    n = spark.range(HOT).withColumn("hot", F.col("id") % 3 != 0)
    order_id = F.when(F.col("hot"), "o0").otherwise(F.concat(F.lit("o"), F.col("id")))
    ts = F.lit("2017-05-01 10:00:00").cast("timestamp_ntz")
    text = lambda p, c: F.concat(F.lit(p), c)
    items = n.select(
        order_id.alias("order_id"), F.col("id").cast("int").alias("order_item_id"),
        text("p", F.col("id") % 50).alias("product_id"), text("s", F.col("id") % 20).alias("seller_id"),
        (ts + F.make_dt_interval((F.col("id") * 7919 % 3000).cast("int"))).alias("shipping_limit_date"), (F.col("id") % 7 + F.col("id") / 100).alias("price"),
        F.lit(1.0).alias("freight_value"),
    )
    one = n.where(~F.col("hot"))
    oid = text("o", F.col("id"))
    frames = {
        "items": items,
        "orders": one.select(
            oid.alias("order_id"), text("c", F.col("id")).alias("customer_id"), F.lit("delivered").alias("order_status"),
            ts.alias("order_purchase_timestamp"), ts.alias("order_approved_at"), ts.alias("order_delivered_carrier_date"),
            F.expr("timestamp_ntz'2017-05-03 00:00:00'").alias("order_delivered_customer_date"),
            ts.alias("order_estimated_delivery_date"),
        ),
        "payments": one.select(
            oid.alias("order_id"), F.lit(1).alias("payment_sequential"), F.lit("credit_card").alias("payment_type"),
            F.lit(1).alias("payment_installments"), F.lit(10.0).alias("payment_value"),
        ),
        "reviews": n.select(
            text("r", F.col("id")).alias("review_id"), oid.alias("order_id"), F.lit(5).alias("review_score"),
            F.lit(None).cast("string").alias("review_comment_title"),
            F.when(F.col("hot"), "muito bom").otherwise(text("texto ", F.col("id"))).alias("review_comment_message"),
            ts.alias("review_creation_date"), ts.alias("review_answer_timestamp"),
        ),
        "sellers": spark.range(20).select(
            text("s", F.col("id")).alias("seller_id"), F.lit("sao paulo").alias("seller_city"), F.lit("SP").alias("seller_state")
        ),
        "review_translation": n.select(
            F.when(F.col("hot"), "muito bom").otherwise(text("texto ", F.col("id"))).alias("column1"),
            text("text ", F.col("id")).alias("column2"),
        ),
    }
    empty = {k: spark.createDataFrame([], v) for k, v in schema.TABLES.items() if k not in frames}
    return CleanTables(RawTables(**frames, **empty))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    result = df.collect()
    return result, df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "job",
    [
        orders.shipping_delay_detail,
        orders.late_vs_shipping_limit,
        lambda t: t.english_reviews.select("review_id", "review_english"),
        revenue.item_payment_detail,
        views.order_view,
        lambda t: revenue.low_reviews_by_product(t, threshold=6),
    ],
    ids=[
        "shipping_delay_detail", "late_vs_shipping_limit", "english_reviews", "item_payment_detail", "order_view",
        "low_reviews_by_product",
    ],
)
def test_hot_keys_of_detail_joins_are_split(spark, hot, job):
    plain = sorted(map(tuple, job(hot).collect()), key=repr)
    with settings(spark, SKEW_CONF):
        result, text = final_plan(job(hot))
    assert "skew=true" in text
    assert sorted(map(tuple, result), key=repr) == plain


def test_a_hot_order_is_reduced_before_it_is_joined(spark, hot):
    """The item side of the join holds one row per order and seller, however many items there are."""
    with settings(spark, SKEW_CONF):
        result, text = final_plan(revenue.seller_payment_sums(hot, (2017,)))
    assert "HashAggregate(keys=[order_id" in text
    hot_rows = hot.items.where("order_id = 'o0'").count()
    hot_groups = hot.items.where("order_id = 'o0'").select("seller_id").distinct().count()
    assert hot_groups <= 20 < hot_rows
    total = sum(r["total"] for r in result)
    assert total == hot.items.count() * 10


WIDE = 9000  # items of the hot order, no two of one product or seller


@pytest.fixture(scope="module")
def wide(spark, hot):
    """Two items of three are in order o0, and differ in product and seller, so no total per order shrinks them."""
    items = hot.raw.items.where(F.col("order_item_id") < WIDE).withColumns(
        {"product_id": F.concat(F.lit("p"), "order_item_id"), "seller_id": F.concat(F.lit("s"), F.col("order_item_id") % 4000)}
    )
    ids = spark.range(WIDE)
    sellers = ids.select(
        F.concat(F.lit("s"), "id").alias("seller_id"), F.concat(F.lit("city "), F.col("id") % 3000).alias("seller_city"),
        F.when(F.col("id") % 2 == 0, "SP").otherwise("sp ").alias("seller_state"),
    )
    products = ids.select(F.concat(F.lit("p"), "id").alias("product_id"), F.lit("telefonia").alias("product_category_name"))
    raw = dataclasses.replace(hot.raw, items=items, sellers=sellers, products=products)
    t = CleanTables(raw)
    for name in ("payment_totals", "order_totals", "paid_items", "product_keys", "seller_keys"):
        getattr(t, name)  # written before any plan is looked at
    return t


WIDE_JOBS = {
    "revenue_per_seller": lambda t: revenue.revenue_per_seller(t, (2017,)),
    "seller_revenue_allocated": revenue.seller_revenue_allocated,
    "revenue_per_city": lambda t: revenue.revenue_per_city(t, (2017,)),
    "revenue_per_state": lambda t: revenue.revenue_per_state(t, (2017,)),
    "lucrative_gap_cities": lambda t: revenue.lucrative_gap_cities(t, 30),
    "phased_out_products": lambda t: revenue.phased_out_products(t, (2016, 2018)),
    "revenue_by_category": lambda t: revenue.revenue_by_category(t, (2017,)),
    "product_view": lambda t: views.product_view(t, (2015, 2016, 2017)),
    "product_lifecycle_corrected": lambda t: views.product_lifecycle_corrected(t, (2015, 2016, 2017)),
    "seller_view_corrected": lambda t: views.seller_view_corrected(t, (2017,)),
}


@pytest.mark.parametrize("name", sorted(WIDE_JOBS))
def test_a_hot_order_of_different_products_and_sellers_is_split(spark, wide, name):
    plain = sorted(map(tuple, WIDE_JOBS[name](wide).collect()), key=repr)
    with settings(spark, SKEW_CONF):
        result, text = final_plan(WIDE_JOBS[name](wide))
    assert "skew=true" in text
    assert plain and sorted(map(tuple, result), key=repr) == plain


def test_one_city_with_all_sellers(hot):
    (row,) = orders.orders_per_city(hot).collect()
    assert (row["seller_city"], row["total_orders"]) == ("são paulo", hot.items.count())


def test_views_on_hot_order_match_the_literal_join(hot):
    joined = (
        hot.items.join(hot.payments, "order_id").join(hot.reviews, "order_id").join(hot.orders, "order_id")
        .groupBy("product_id").agg(F.count("*").alias("n"), F.sum("price").alias("v"))
    )
    sums = views._product_sums(hot, (2017,)).select("product_id", "total_quantity_sold", "price_sum")
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, joined.collect()))
