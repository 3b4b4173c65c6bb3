"""What the physical plans must and must not hold, with broadcasts off as for big tables."""

import contextlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracles import all_oracles
from feira.operators import keys
from feira.plans import cleaning, customers, derived, revenue, reviews, views
from feira.tables import save_clean


@contextlib.contextmanager
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, old)


# The library's own queries; those of the text operators are looked at in their own folder.
OWN = sorted(set(entry.queries()) & set(all_oracles()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", OWN)
def test_no_python_workers_and_no_cross_joins(name, spark, folder):
    with no_broadcast(spark):
        text = plan(entry.queries()[name](spark, folder))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "SerializeFromObject"):
        if node == "BroadcastHashJoin" and name == "phased_out_one_product":
            continue  # one mapping row
        assert node not in text, node


# The only windows without a partition run over a few grouped rows.
SHARES = {"revenue_by_status", "financial_category", "lifecycle_share"}
# One-row results and totals: partial sums meet in one task.
TOTALS = {
    "fulfilment_durations", "distinct_item_orders", "review_sentiment_counts", "negative_review_share",
    "cancellation_stages", "cancellation_stage_share", "review_response_time", "total_revenue", "aov",
    "aov_per_order", "repeat_rate", "multi_year_rate", "top_seller_concentration", "cancelled_payment_mix",
    "load_tables",
}


@pytest.mark.parametrize("name", sorted(set(OWN) - SHARES - TOTALS))
def test_nothing_is_gathered_in_one_task(name, spark, folder):
    assert "SinglePartition" not in plan(entry.queries()[name](spark, folder))


def test_one_task_only_sees_grouped_rows_or_partial_sums(spark, folder):
    for name in sorted(SHARES | TOTALS):
        text = plan(entry.queries()[name](spark, folder))
        below = re.findall(r"Exchange SinglePartition.*\n(.*)\n", text)
        assert all("Aggregate" in line or "Project" in line or "LocalLimit" in line for line in below), (name, below)


def test_review_texts_are_not_read_unless_asked_for(spark, folder):
    queries = entry.queries()
    for name in ("review_by_status", "product_view", "order_view", "review_response_time"):
        assert "doc_id" not in plan(queries[name](spark, folder)), name
    assert "doc_id" in plan(queries["good_reviews"](spark, folder))


def test_filters_and_columns_reach_the_files(spark, sample, tmp_path):
    saved = save_clean(sample, str(tmp_path))
    text = plan(reviews.cancellation_stages(saved))
    assert "EqualTo(order_status,canceled)" in text
    assert "customer_id" not in re.search(r"ReadSchema: (.*)", text).group(1)
    text = plan(reviews.bad_reviews(saved))
    assert "LessThan(review_score,3)" in text


def test_both_inputs_of_the_text_lookup_are_plain_shuffles(spark, folder):
    """So that run-time skew handling can split a message shared by very many reviews."""
    with no_broadcast(spark):
        text = plan(entry.queries()["review_translated"](spark, folder))
    sides = re.findall(r"Sort \[__digest#\d+ ASC NULLS FIRST\], false.*\n\W*(\w+)", text)
    assert sides == ["Exchange", "Exchange"], text


def test_numbering_sums_partition_sizes_only(spark, sample):
    """The one-task window and the broadcast hold one row per partition, never the ids."""
    ids = sample.orders.select("order_id")
    text = plan(keys.dense_numbers(ids, "order_id"))
    (gathered,) = re.findall(r"Exchange SinglePartition.*\n\W*(.*)", text)
    assert gathered.startswith("HashAggregate(keys=[part")
    (broadcast,) = re.findall(r"BroadcastExchange.*\n\W*(.*)", text)
    assert broadcast.startswith("Project [part")


def test_a_year_of_saved_orders_is_a_folder(spark, sample, tmp_path):
    saved = save_clean(sample, str(tmp_path))
    some = saved.orders_of(1996, 1997)
    assert re.search(r"PartitionFilters: \[.*purchase_year#\d+ IN \(1996,1997\)", plan(some))
    wanted = sample.orders.where(F.year("order_purchase_timestamp").isin(1996, 1997))
    assert some.count() > 0 and some.columns == sample.orders.columns
    assert some.exceptAll(wanted).count() == wanted.exceptAll(some).count() == 0
    assert saved.orders.columns == sample.orders.columns and saved.orders.count() == sample.orders.count()


def test_repeated_reviews_are_found_without_moving_texts(spark, sample):
    """Only digests reach the first aggregate; texts are read again for what it has found."""
    with no_broadcast(spark):
        text = plan(cleaning.audit_duplicate_reviews(sample))
    digests = re.findall(r"Exchange hashpartitioning\((__row#\d+), .*\n.*HashAggregate\(keys=\[__row#\d+\], functions=\[partial_count\(1\)\]", text)
    assert digests, text


def test_items_of_mapped_products_go_before_items_are_summed(spark, sample):
    with no_broadcast(spark):
        text = plan(views.audit_unmapped_products(sample, (1996, 1997, 1998)))
    semi, summed = text.index("LeftSemi"), text.index("HashAggregate(keys=[order_id")
    assert summed < semi  # the plan is written from the top


def test_orders_are_merged_by_ids_and_figures_only(spark, sample):
    with no_broadcast(spark):
        text = plan(views.order_view(sample))
    keys = [set(re.findall(r"(\w+)#", k)) for k in re.findall(r"HashAggregate\(keys=\[([^]]*)\]", text)]
    assert {"order_id", "seller_id", "review_score", "products_ordered", "Revenue"} in keys
    assert not any("order_status" in k or "seller_city" in k for k in keys)


def test_seller_years_shuffle_items_once(spark, sample):
    """By order, to meet its year; what is left after that is one row per seller and year."""
    with no_broadcast(spark):
        text = plan(views.seller_view_corrected(sample, (1996,)))
    assert len(re.findall(r"Exchange hashpartitioning\(order_id", text)) == 2  # items and orders
    assert "hashpartitioning(order_id#" in text and not re.search(r"hashpartitioning\(seller_id#\d+, order_id", text)
    assert not re.search(r"hashpartitioning\([^)]*product_id", text)


def test_distinct_counts_do_not_expand_rows(spark, sample):
    for df in (customers.customer_summary(sample), revenue.lucrative_gap_cities(sample)):
        assert "Expand" not in plan(df)


def test_lifecycle_share_needs_no_labels(spark, sample):
    text = plan(derived.lifecycle_share(sample, (1996, 1997, 1998)))
    assert "product_id_values" not in text and "sellers_inolved" not in text and "score_sum" not in text


PRODUCT_JOBS = [
    "audit_unmapped_products", "lifecycle_share", "product_lifecycle_corrected", "product_view", "revenue_by_category",
    "sql_product_view",
]


@pytest.mark.parametrize("name", PRODUCT_JOBS)
def test_products_are_never_broadcast(name, spark, folder):
    """However few Spark takes them for: it does not count the rows that an explode makes."""
    text = plan(entry.queries()[name](spark, folder))
    joins = re.findall(r"(\w+Join) \[product_id#\d+\], \[product_id#\d+\], (?:Inner|LeftSemi)", text)
    assert joins and set(joins) == {"SortMergeJoin"}
