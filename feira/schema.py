"""Column names and types of the source tables."""

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampNTZType


def _table(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


TEXT, INT, NUMBER, TIME = StringType(), IntegerType(), DoubleType(), TimestampNTZType()

ORDERS = _table(
    order_id=TEXT,
    customer_id=TEXT,
    order_status=TEXT,
    order_purchase_timestamp=TIME,
    order_approved_at=TIME,
    order_delivered_carrier_date=TIME,
    order_delivered_customer_date=TIME,
    order_estimated_delivery_date=TIME,
)
ORDER_ITEMS = _table(
    order_id=TEXT,
    order_item_id=INT,
    product_id=TEXT,
    seller_id=TEXT,
    shipping_limit_date=TIME,
    price=NUMBER,
    freight_value=NUMBER,
)
ORDER_PAYMENTS = _table(
    order_id=TEXT, payment_sequential=INT, payment_type=TEXT, payment_installments=INT, payment_value=NUMBER
)
ORDER_REVIEWS = _table(
    review_id=TEXT,
    order_id=TEXT,
    review_score=INT,
    review_comment_title=TEXT,
    review_comment_message=TEXT,
    review_creation_date=TIME,
    review_answer_timestamp=TIME,
)
PRODUCTS = _table(product_id=TEXT, product_category_name=TEXT)
SELLERS = _table(seller_id=TEXT, seller_city=TEXT, seller_state=TEXT)
CUSTOMERS = _table(customer_id=TEXT, customer_unique_id=TEXT)
GEOLOCATION = _table(geolocation_zip_code_prefix=TEXT, geolocation_city=TEXT, geolocation_state=TEXT)
CATEGORY_TRANSLATION = _table(category_pt=TEXT, category_en=TEXT)
CATEGORY_DICTIONARY = _table(category_pt=TEXT, category_en=TEXT, main_categories=TEXT)
REVIEW_TRANSLATION = _table(column1=TEXT, column2=TEXT)

TABLES = {
    "orders": ORDERS,
    "items": ORDER_ITEMS,
    "payments": ORDER_PAYMENTS,
    "reviews": ORDER_REVIEWS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "customers": CUSTOMERS,
    "geolocation": GEOLOCATION,
    "category_translation": CATEGORY_TRANSLATION,
    "review_translation": REVIEW_TRANSLATION,
}
