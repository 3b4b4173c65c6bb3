"""Small marketplaces written out by hand."""

from datetime import datetime

from feira import CleanTables, RawTables, schema

DAY = datetime(2017, 3, 1, 10, 0, 0)


def marketplace(spark, **rows) -> CleanTables:
    """Clean tables from rows per table; tables that are not given are empty."""
    frames = {
        name: spark.createDataFrame(rows.get(name, []), fields).coalesce(1) for name, fields in schema.TABLES.items()
    }
    return CleanTables(RawTables(**frames))


def order(order_id, status="delivered", bought=DAY, approved=DAY, carried=None, arrived=None, promised=None, customer=None):
    return (order_id, customer or f"c-{order_id}", status, bought, approved, carried, arrived, promised)


def item(order_id, number=1, product="p1", seller="s1", price=10.0, freight=1.0, limit=DAY):
    return (order_id, number, product, seller, limit, price, freight)


def payment(order_id, value=10.0, sequence=1, kind="credit_card", installments=1):
    return (order_id, sequence, kind, installments, value)


def review(order_id, score=5, review_id=None, message=None, created=DAY, answered=DAY):
    return (review_id or f"r-{order_id}", order_id, score, None, message, created, answered)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
