"""The raw and clean marketplace tables as common table expressions over the test tables."""

from feira.operators.rules import CATEGORY_CLASSES, EXTRA_CATEGORIES, EXTRA_SELLER, OTHER_CATEGORY
from feira.sources.sample import CATEGORY_NAMES, DIRTY_CITIES, ENGLISH_NAMES
from oracles.cities import UPDATES
from oracles.text import folded, quoted


def values(rows, alias):
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows) + f") AS {alias}"


RAW = f"""
base AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_totalprice AS total, printf('%010d', o_orderkey) AS order_id,
         o_orderdate + INTERVAL 1 SECOND * ((o_orderkey * 7919) % 86400) + INTERVAL 250 MILLISECOND AS bought
  FROM orders),
staged AS (
  SELECT *, CASE WHEN k % 100 < 3 THEN 'canceled' WHEN k % 100 = 3 THEN 'unavailable' WHEN k % 100 < 6 THEN 'shipped'
                 WHEN k % 100 = 6 THEN 'invoiced' WHEN k % 100 = 7 THEN 'processing' WHEN k % 100 = 8 THEN 'created'
                 WHEN k % 100 = 9 THEN 'approved' ELSE 'delivered' END AS order_status,
         CASE WHEN k % 100 <> 2 AND k % 41 <> 0 THEN bought + INTERVAL 1 SECOND * ((k * 613) % 260000) END AS approved
  FROM base),
sent AS (
  SELECT *, CASE WHEN order_status IN ('delivered', 'shipped') OR (order_status = 'canceled' AND k % 3 = 0)
                 THEN coalesce(approved, bought) + INTERVAL 1 DAY * (k % 6) END AS carried
  FROM staged),
raw_orders AS (
  SELECT order_id, 'c' || order_id AS customer_id, order_status, bought, approved, carried,
         CASE WHEN order_status = 'delivered' OR (order_status = 'canceled' AND k % 9 = 0)
              THEN carried + INTERVAL 1 DAY * ((k * 37) % 45) END AS arrived,
         bought + INTERVAL 1 DAY * (20 + k % 10) AS promised
  FROM sent),
c_customers AS (
  SELECT 'c' || order_id AS customer_id,
         CASE WHEN ck % 10 < 6 THEN 'u' || order_id
              WHEN ck % 10 < 8 THEN printf('y%08d-%d', ck, year(bought))
              ELSE printf('p%08d', ck) END AS customer_unique_id
  FROM base),
line AS (
  SELECT l_orderkey, printf('%010d', l_orderkey) AS order_id, CAST(l_linenumber AS BIGINT) AS order_item_id,
         printf('%08d-%d', l_partkey, l_suppkey % 10) AS product_id, printf('%06d', l_suppkey) AS seller_id,
         l_shipdate + INTERVAL 1 HOUR * l_linenumber AS ship_limit, l_extendedprice AS price, l_quantity AS freight
  FROM lineitem),
raw_items AS (
  SELECT order_id, order_item_id, product_id, seller_id, ship_limit, price, freight FROM line
  UNION ALL
  SELECT order_id, order_item_id + 100, product_id, seller_id, ship_limit, price, freight
  FROM line WHERE l_orderkey % 50 = 0),
paid AS (
  SELECT *, CASE WHEN k % 97 = 0 THEN greatest(k - 1, 1 - k) ELSE k END AS payer FROM base),
settled AS (
  SELECT *, printf('%010d', payer) AS payer_id,
         CASE WHEN payer = k THEN 0 WHEN payer % 8 = 0 THEN 2 ELSE 1 END AS ahead
  FROM paid),
raw_payments AS (
  SELECT payer_id AS order_id, CAST(ahead + 1 AS BIGINT) AS payment_sequential,
         CASE WHEN k % 10 < 7 THEN 'credit_card' WHEN k % 20 = 7 THEN 'Boleto '
              WHEN k % 10 < 9 THEN 'boleto' ELSE 'debit_card' END AS payment_type,
         k % 12 + 1 AS payment_installments, total AS payment_value
  FROM settled
  UNION ALL
  SELECT payer_id, ahead + 2, 'voucher', 1, 50.0 FROM settled WHERE k % 8 = 0),
texts AS (SELECT doc_id, min(text) AS text FROM documents GROUP BY doc_id),
raw_reviews AS (
  SELECT 'r' || order_id AS review_id,
         CASE WHEN k % 29 = 0 THEN printf('%010d', greatest(k - 1, 1 - k)) ELSE order_id END AS order_id,
         1 + (k * 13) % 5 AS review_score,
         CASE WHEN k % 31 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
              WHEN k % 37 = 0 THEN text || '  ' ELSE text END AS review_comment_message,
         bought + INTERVAL 30 DAY AS created, bought + INTERVAL 1 DAY * (30 + k % 7) AS answered
  FROM base LEFT JOIN texts ON doc_id = k
  UNION ALL
  SELECT 's' || order_id, order_id, 1, NULL, bought, bought FROM base WHERE k % 53 = 0),
named_parts AS (
  SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'AUTO' WHEN p_partkey % 11 = 0 THEN 'PERF' ELSE p_type END AS name
  FROM part),
raw_products AS (
  SELECT printf('%08d-%d', p_partkey, n) AS product_id,
         CASE n WHEN 3 THEN lower(name) WHEN 7 THEN name || ' ' ELSE name END AS product_category_name
  FROM named_parts, range(10) AS r(n)),
dirty AS (SELECT * FROM {values([(str(i), c, s) for i, (c, s) in enumerate(DIRTY_CITIES)], "d(pos, city, state)")}),
raw_sellers AS (
  SELECT printf('%06d', s_suppkey) AS seller_id,
         CASE WHEN s_suppkey % 3 <> 0 THEN city WHEN s_suppkey % 4 = 0 THEN lower(n_name) || ' - xx'
              WHEN s_suppkey % 4 = 1 THEN upper(n_name) WHEN s_suppkey % 4 = 2 THEN lower(n_name) || '  '
              ELSE lower(n_name) END AS seller_city,
         CASE WHEN s_suppkey % 3 <> 0 THEN state WHEN s_suppkey % 2 = 0 THEN lower(r_name) || ' '
              ELSE r_name END AS seller_state
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN dirty ON pos = CAST((s_suppkey - s_suppkey // 3 - 1) % {len(DIRTY_CITIES)} AS VARCHAR)),
names AS (SELECT * FROM {values(CATEGORY_NAMES, "c(category_pt, category_en)")}),
translation AS (
  SELECT text AS column1,
         CASE doc_id % 5 WHEN 0 THEN 'still waiting for the Refund of order note ' || doc_id
              WHEN 1 THEN 'never got the invoice, case ' || doc_id
              WHEN 2 THEN 'no invoice and no money back, case ' || doc_id
              ELSE 'note ' || doc_id || ' in ' || lang END AS column2
  FROM documents)"""


def main_category(name):
    """First class that lists the name or, for two classes, finds its word inside it."""
    arms = []
    for label, known, word in CATEGORY_CLASSES:
        test = f"lower({name}) IN ({', '.join(quoted(v) for v in known)})"
        if word:
            test += f" OR {name} ILIKE '%{word}%'"
        arms.append(f"WHEN {test} THEN {quoted(label)}")
    return f"CASE {' '.join(arms)} ELSE {quoted(OTHER_CATEGORY)} END"


def city_steps():
    """One update per step, each on the result of the one before."""
    steps, source = [], "raw_sellers"
    for i, (test, new_city, new_state) in enumerate(UPDATES):
        city = f"CASE WHEN {test} THEN {quoted(new_city)} ELSE seller_city END" if new_city else "seller_city"
        state = f"CASE WHEN {test} THEN {quoted(new_state)} ELSE seller_state END" if new_state else "seller_state"
        keys = f"SELECT *, {folded('seller_city')} AS ct, {folded('seller_state')} AS st FROM {source}"
        steps.append(f"city_{i} AS (SELECT seller_id, {city} AS seller_city, {state} AS seller_state FROM ({keys}))")
        source = f"city_{i}"
    steps.append(
        f"c_sellers AS (SELECT * FROM {source} UNION ALL"
        f" SELECT NULL, {quoted(EXTRA_SELLER[0])}, {quoted(EXTRA_SELLER[1])})"
    )
    return steps


CLEAN = f"""
c_orders AS (
  SELECT order_id, customer_id, order_status, date_trunc('second', bought) AS bought,
         date_trunc('second', approved) AS approved, CAST(carried AS DATE) AS carried,
         CAST(arrived AS DATE) AS arrived, CAST(promised AS DATE) AS promised
  FROM raw_orders),
c_typed AS (
  SELECT order_id, order_item_id, product_id, seller_id, CAST(ship_limit AS DATE) AS ship_limit,
         CAST(round(price, 2) AS DECIMAL(18,2)) AS price, CAST(round(freight, 2) AS DECIMAL(18,2)) AS freight
  FROM raw_items),
c_items AS (
  SELECT * FROM c_typed
  QUALIFY row_number() OVER (PARTITION BY order_id, product_id, seller_id, ship_limit, price, freight
                             ORDER BY order_item_id) = 1),
c_payments AS (
  SELECT order_id, payment_sequential, payment_type AS payment_type_raw,
         CASE WHEN {folded('payment_type')} = 'boleto' THEN 'voucher' ELSE payment_type END AS payment_type,
         payment_installments, CAST(round(payment_value, 2) AS DECIMAL(18,2)) AS payment_value
  FROM raw_payments),
english AS (SELECT {folded('column1')} AS said, min(column2) AS review_english FROM translation GROUP BY 1),
c_reviews AS (
  SELECT review_id, order_id, review_score, review_comment_message, CAST(created AS DATE) AS created,
         CAST(answered AS DATE) AS answered, review_english
  FROM raw_reviews LEFT JOIN english ON said = {folded('review_comment_message')}),
dictionary AS (
  SELECT category_pt, category_en, {main_category("category_en")} AS main_categories FROM names
  UNION ALL SELECT * FROM {values(EXTRA_CATEGORIES, "x")}),
c_products AS (
  SELECT product_id, product_category_name, category_en, main_categories
  FROM raw_products LEFT JOIN dictionary ON {folded('category_pt')} = {folded('product_category_name')}),
k_order AS (
  SELECT order_id, printf('A%05d', row_number() OVER (ORDER BY order_id NULLS FIRST)) AS order_id_values
  FROM (SELECT order_id FROM raw_orders UNION SELECT order_id FROM raw_items
        UNION SELECT order_id FROM raw_payments UNION SELECT order_id FROM raw_reviews)),
k_product AS (
  SELECT product_id, printf('P%05d', row_number() OVER (ORDER BY product_id NULLS FIRST)) AS product_id_values
  FROM (SELECT product_id FROM raw_items UNION SELECT product_id FROM raw_products)),
k_seller AS (
  SELECT seller_id, printf('S%05d', row_number() OVER (ORDER BY seller_id NULLS FIRST)) AS seller_id_values
  FROM (SELECT seller_id FROM raw_items UNION SELECT seller_id FROM raw_sellers)),
k_customer AS (
  SELECT customer_id, printf('C%05d', row_number() OVER (ORDER BY customer_id NULLS FIRST)) AS customer_id_values
  FROM (SELECT customer_id FROM raw_orders UNION SELECT customer_id FROM c_customers)),
k_review AS (
  SELECT review_id, printf('R%05d', row_number() OVER (ORDER BY review_id NULLS FIRST)) AS review_id_values
  FROM (SELECT DISTINCT review_id FROM raw_reviews))"""

LABELS = f"labels_en AS (SELECT * FROM {values([(str(i), n) for i, n in enumerate(ENGLISH_NAMES)], 'l(pos, category_en)')})"


def with_tables(body):
    """``body`` with the tables it can use; a leading ``name AS (...), SELECT`` list of its own may come first."""
    parts = [RAW, CLEAN, LABELS]
    if "c_sellers" in body or "city_" in body:
        parts += city_steps()
    return "WITH " + ",\n".join(p.strip() for p in parts) + body
