"""Review and cancellation KPIs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.functions import exprs as X
from feira.operators.per_order import reviews_per_order
from feira.tables import CleanTables

# Bucket edges in hours and their labels. A bucket holds what is not above its edge and
# fell in no earlier one; the first edge is exclusive.
APPROVAL_BUCKETS = [(12, "under 12 hours"), (24, "12 to 24 hours"), (48, "24 to 48 hours")]
APPROVAL_REST = "over two days"
DELIVERY_BUCKETS = [
    (50, "approx two days"),
    (96, "took four days"),
    (168, "took a week"),
    (336, "took two weeks"),
    (7220, "took a month"),
]
DELIVERY_REST = "more than a month"
CANCELED = "canceled"


def bucket(hours: Column | str, edges: Sequence[tuple[int, str]], rest: str) -> Column:
    """The label of the first bucket that fits; NULL goes to ``rest``."""
    hours = X.col(hours)
    (first, label), *others = edges
    out = F.when(hours < first, label)
    for edge, label in others:
        out = out.when(hours <= edge, label)
    return out.otherwise(rest)


def _scores_by(t: CleanTables, group: Column) -> DataFrame:
    """Review totals per ``group`` of orders, from per-order totals."""
    return (
        t.orders.join(reviews_per_order(t.reviews), "order_id")
        .groupBy(group)
        .agg(
            F.sum("n_reviews").alias("total_orders"),
            F.sum("n_five").alias("n_five"),
            F.sum("score_sum").alias("score_sum"),
            F.sum("n_scores").alias("n_scores"),
        )
    )


def _five_stars() -> list[Column]:
    part = F.col("n_five") * 100
    text = X.fmt_number(X.rounded_ratio(part, "total_orders", 0))
    return [text.alias("five_star_pct"), X.ratio(part, "total_orders").alias("five_star_pct_num")]


def review_by_approval_time(
    t: CleanTables, edges: Sequence[tuple[int, str]] = APPROVAL_BUCKETS, rest: str = APPROVAL_REST
) -> DataFrame:
    hours = X.hours_between("order_purchase_timestamp", "order_approved_at")
    scores = _scores_by(t, bucket(hours, edges, rest).alias("approval_time_bucket"))
    score = X.rounded_ratio("score_sum", "n_scores").alias("avg_review_score")
    return scores.select("approval_time_bucket", *_five_stars(), "total_orders", score)


def review_by_delivery_time(
    t: CleanTables, edges: Sequence[tuple[int, str]] = DELIVERY_BUCKETS, rest: str = DELIVERY_REST
) -> DataFrame:
    hours = X.hours_between("order_delivered_carrier_date", "order_delivered_customer_date")
    scores = _scores_by(t, bucket(hours, edges, rest).alias("delivery_time_bucket"))
    score = X.ratio("score_sum", "n_scores").alias("avg_review_score")
    return scores.select("delivery_time_bucket", "total_orders", score, *_five_stars())


def _sentiment(t: CleanTables) -> DataFrame:
    score = F.col("review_score")
    return t.reviews.agg(
        F.count("order_id").alias("total_orders"),
        X.count_if(score.between(1, 2)).alias("bad_reviews"),
        X.count_if(score == 3).alias("average_reviews"),
        X.count_if(score.between(4, 5)).alias("good_reviews"),
    )


def review_sentiment_counts(t: CleanTables) -> DataFrame:
    counts = _sentiment(t)
    return X.with_text(counts, {c: X.fmt_number(c) for c in counts.columns})


def negative_review_share(t: CleanTables) -> DataFrame:
    return _sentiment(t).select(
        F.col("bad_reviews").alias("negative_reviews"),
        F.col("total_orders").alias("total_reviews"),
        X.ratio("bad_reviews", "total_orders").alias("negative_share"),
    )


def good_reviews(t: CleanTables, threshold: int = 3) -> DataFrame:
    return t.english_reviews.where(F.col("review_score") >= threshold).select("review_english", "review_score")


def bad_reviews(t: CleanTables, threshold: int = 3) -> DataFrame:
    return t.english_reviews.where(F.col("review_score") < threshold).select("review_english", "review_score")


def _cancellations(t: CleanTables, status: str) -> DataFrame:
    """All stage counts in one pass. Only "before approval" ignores the later dates, so stages may overlap."""
    approved, shipped, delivered = (
        F.col(c).isNotNull()
        for c in ("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date")
    )
    return t.orders.where(F.col("order_status") == status).agg(
        F.count(F.when(delivered, F.col("order_id"))).alias("orders_cancelled_after_delivery"),
        F.count(F.when(shipped & ~delivered, F.col("order_id"))).alias("orders_cancelled_during_shipping"),
        F.count(F.when(~shipped & ~delivered & approved, F.col("order_id"))).alias("orders_cancelled_after_approval"),
        F.count(F.when(~approved, F.col("order_id"))).alias("orders_cancelled_before_approval"),
        F.count("order_id").alias("cancelled_orders"),
    )


def cancellation_stages(t: CleanTables, status: str = CANCELED) -> DataFrame:
    counts = _cancellations(t, status)
    return counts.unpivot([], counts.columns, "measures_name", "measures_value")


def cancellation_stage_share(t: CleanTables, status: str = CANCELED) -> DataFrame:
    counts = _cancellations(t, status)
    stages = [c for c in counts.columns if c != "cancelled_orders"]
    return counts.unpivot(["cancelled_orders"], stages, "measures_name", "measures_value").select(
        "measures_name",
        "measures_value",
        "cancelled_orders",
        X.ratio("measures_value", "cancelled_orders").alias("stage_share"),
    )


def review_by_status(t: CleanTables) -> DataFrame:
    return (
        t.orders.join(reviews_per_order(t.reviews), "order_id")
        .groupBy("order_status")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            X.ratio(F.sum("score_sum"), F.sum("n_scores")).alias("avg_score"),
        )
    )


def review_response_pairs(t: CleanTables) -> DataFrame:
    return t.reviews.select("review_creation_date", "review_answer_timestamp")


def review_response_time(t: CleanTables) -> DataFrame:
    return t.reviews.agg(
        X.int_avg(X.hours_between("review_creation_date", "review_answer_timestamp")).alias("time_taken_for_answer")
    )
