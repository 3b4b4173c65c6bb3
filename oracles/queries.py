"""One SQL text per registered query."""

from __future__ import annotations

from oracles.tables import main_category, with_tables
from oracles.text import big, brl, cents, dbl, folded, half_up, n0, pct, rounded

Y = (1996, 1997, 1998)
GAP = 152_000_000  # revenue that a good part of the cities misses
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def day(x):
    return f"CAST({x} AS VARCHAR) AS"


def q(select, *ctes):
    """A query over the tables, with its own extra tables in front."""
    extra = "".join(f",\n{c}" for c in ctes)
    return with_tables(f"{extra}\n{select}")


def by_year(value, prefix, when="year(bought)", other="0", wrap=dbl, years=Y):
    return ", ".join(
        wrap(f"sum(CASE WHEN {when} = {y} THEN {value} ELSE {other} END)") + f" AS {prefix}_{y}" for y in years
    )


def texts(names, fmt):
    return ", ".join(f"{fmt(n)} AS {n}, {dbl(n)} AS {n}_num" for n in names)


def years(prefix):
    return [f"{prefix}_{y}" for y in Y]


def as_is(x):
    return x


def cleaning():
    key = "{0}_id, {0}_id_values"
    out = {f"map_{k}_ids": q(f"SELECT {key.format(k)} FROM k_{k}") for k in ("order", "product", "seller", "customer", "review")}
    item = "order_id, order_item_id, product_id"
    ship = "CAST(ship_limit AS VARCHAR) AS shipping_limit_date"
    prices = f"{dbl('price')} AS price, {dbl('freight')} AS freight_value"
    stamps = (
        "strftime({0}bought, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp,"
        " strftime({0}approved, '%Y-%m-%d %H:%M:%S') AS order_approved_at"
    )
    dates = (
        "CAST(carried AS VARCHAR) AS order_delivered_carrier_date,"
        " CAST(arrived AS VARCHAR) AS order_delivered_customer_date,"
        " CAST(promised AS VARCHAR) AS order_estimated_delivery_date"
    )
    review_dates = f"{day('created')} review_creation_date, {day('answered')} review_answer_timestamp"
    pay = (
        f"order_id, {big('payment_sequential')} AS payment_sequential, payment_type,"
        f" {big('payment_installments')} AS payment_installments, {dbl('payment_value')} AS payment_value"
    )
    no_title = "CAST(NULL AS VARCHAR) AS review_comment_title"
    sources = {
        "orders": "raw_orders", "items": "raw_items", "payments": "raw_payments", "reviews": "raw_reviews",
        "products": "raw_products", "sellers": "raw_sellers", "customers": "c_customers", "geolocation": "nation",
        "category_translation": "names", "review_translation": "translation",
    }
    out |= {
        "load_tables": q(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in sources.items())),
        "read_csv": q("SELECT * FROM raw_sellers"),
        "read_headerless_csv": q(
            """SELECT * FROM dictionary WHERE category_pt IN (SELECT product_category_name FROM raw_products)
            OR category_pt NOT IN (SELECT category_pt FROM names)"""
        ),
        "items_with_keys": q(
            f"""SELECT {item}, seller_id, {ship}, {prices}, order_id_values, product_id_values, seller_id_values
            FROM c_items LEFT JOIN k_order USING (order_id) LEFT JOIN k_product USING (product_id)
            LEFT JOIN k_seller USING (seller_id)"""
        ),
        "payments_with_keys": q(
            f"SELECT {pay}, payment_type_raw, order_id_values FROM c_payments LEFT JOIN k_order USING (order_id)"
        ),
        "reviews_with_keys": q(
            f"""SELECT review_id, order_id, {big('review_score')} AS review_score, {no_title}, review_comment_message,
            {review_dates}, review_id_values, order_id_values
            FROM c_reviews LEFT JOIN k_review USING (review_id) LEFT JOIN k_order USING (order_id)"""
        ),
        "orders_with_keys": q(
            f"""SELECT order_id, customer_id, order_status, {stamps.format('')}, {dates},
            order_id_values, customer_id_values
            FROM c_orders LEFT JOIN k_order USING (order_id) LEFT JOIN k_customer USING (customer_id)"""
        ),
        "products_with_keys": q("SELECT * FROM c_products LEFT JOIN k_product USING (product_id)"),
        "sellers_with_keys": q("SELECT * FROM c_sellers LEFT JOIN k_seller USING (seller_id)"),
        "customers_with_keys": q("SELECT * FROM c_customers LEFT JOIN k_customer USING (customer_id)"),
        "drop_all_null_items": q(
            f"""SELECT {item}, seller_id, strftime(ship_limit, '%Y-%m-%d %H:%M:%S') AS shipping_limit_date, price,
            freight AS freight_value FROM holes
            WHERE order_id IS NOT NULL OR order_item_id IS NOT NULL OR product_id IS NOT NULL
            OR seller_id IS NOT NULL""",
            """holes AS (SELECT * FROM raw_items UNION ALL
            SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM raw_items WHERE order_item_id > 100)""",
        ),
        "drop_all_null_payments": q(
            f"""SELECT {pay} FROM holes WHERE NOT (order_id IS NULL AND payment_sequential IS NULL
            AND payment_type IS NULL AND payment_installments IS NULL AND payment_value IS NULL)""",
            """holes AS (SELECT * FROM raw_payments UNION ALL
            SELECT NULL, NULL, NULL, NULL, NULL FROM raw_payments WHERE payment_sequential = 2)""",
        ),
        "items_ship_date": q(f"SELECT {item}, {ship} FROM c_typed"),
        "reviews_dates": q(f"SELECT review_id, {review_dates} FROM c_reviews"),
        "orders_dates": q(f"SELECT order_id, {dates} FROM c_orders"),
        "orders_ts_normalized": q(f"SELECT order_id, {stamps.format('')} FROM c_orders"),
        "money_rounded": q(f"SELECT {item}, {prices} FROM c_typed"),
        "payments_money_rounded": q(
            f"SELECT order_id, payment_sequential, {dbl('payment_value')} AS payment_value FROM c_payments"
        ),
        "items_dedup": q(f"SELECT {item}, seller_id, {ship}, {prices} FROM c_items"),
        "dup_audit_items": q(
            f"""SELECT order_id, product_id, seller_id, {ship}, {prices}, count(*) AS duplicate_count FROM c_typed
            GROUP BY order_id, product_id, seller_id, ship_limit, price, freight HAVING count(*) > 1"""
        ),
        "dup_audit_payments": q(
            """SELECT g.*, order_id_values FROM g LEFT JOIN k_order USING (order_id)""",
            f"""twice AS (SELECT * FROM c_payments UNION ALL SELECT * FROM c_payments WHERE payment_sequential = 2),
            g AS (SELECT {pay}, count(*) AS duplicate_count FROM twice GROUP BY ALL HAVING count(*) > 1)""",
        ),
        "dup_audit_reviews": q(
            """SELECT g.*, review_id_values, order_id_values FROM g LEFT JOIN k_review USING (review_id)
            LEFT JOIN k_order USING (order_id)""",
            f"""twice AS (SELECT * FROM c_reviews UNION ALL SELECT * FROM c_reviews WHERE review_score = 2),
            g AS (SELECT review_id, order_id, {big('review_score')} AS review_score, {review_dates}, {no_title},
            review_comment_message, review_english, count(*) AS duplicate_count FROM twice
            GROUP BY ALL HAVING count(*) > 1)""",
        ),
        "dup_audit_orders": q(
            f"""SELECT order_id, customer_id, order_status, {stamps.format('')}, {dates}, count(*) AS duplicates
            FROM (SELECT * FROM c_orders UNION ALL SELECT * FROM c_orders WHERE order_status = 'canceled')
            GROUP BY ALL HAVING count(*) > 1"""
        ),
        "dup_audit_categories": q(
            """SELECT category_pt, category_en, main_categories, count(*) AS duplicates
            FROM (SELECT * FROM used UNION ALL SELECT * FROM used WHERE category_en IN ('auto', 'toys'))
            GROUP BY ALL HAVING count(*) > 1""",
            f"""used AS (SELECT category_pt, category_en, {main_category('category_en')} AS main_categories FROM names
            WHERE category_pt IN (SELECT product_category_name FROM raw_products))""",
        ),
        "payment_recode": q("SELECT order_id, payment_sequential, payment_type_raw, payment_type FROM c_payments"),
        "review_translated": q("SELECT review_id, order_id, review_english FROM c_reviews"),
        "category_classified": q(
            f"""SELECT p_partkey AS part_key, category_en, {main_category('category_en')} AS main_categories
            FROM part JOIN labels_en ON pos = CAST(p_partkey % (SELECT count(*) FROM labels_en) AS VARCHAR)"""
        ),
        "category_extended": q(
            """SELECT * FROM dictionary WHERE category_pt IN (SELECT product_category_name FROM raw_products)
            OR category_pt NOT IN (SELECT category_pt FROM names)"""
        ),
        "products_categorized": q("SELECT * FROM c_products"),
        "seller_city_clean": q("SELECT * FROM c_sellers WHERE seller_id IS NOT NULL"),
        "seller_append_ipira": q("SELECT * FROM c_sellers"),
        "audit_multi_seller_orders": q(
            """SELECT order_id_values, count(DISTINCT seller_id) AS seller_count
            FROM c_items JOIN k_order USING (order_id) GROUP BY ALL HAVING count(DISTINCT seller_id) > 1"""
        ),
        "audit_category_values": q(
            f"""SELECT min(product_category_name) AS product_category_name, min(category_en) AS category_en,
            min(main_categories) AS main_categories FROM c_products
            GROUP BY {folded('product_category_name')}, {folded('category_en')}, {folded('main_categories')}"""
        ),
        "audit_product_ids": q("SELECT DISTINCT product_id FROM c_products"),
        "audit_city_variants": q(
            f"""SELECT min(seller_city) AS seller_city, min(seller_state) AS seller_state FROM raw_sellers
            WHERE seller_city ILIKE '%ao paulo%' GROUP BY {folded('seller_city')}, {folded('seller_state')}"""
        ),
        "audit_unmapped_categories": q("SELECT * FROM c_products WHERE main_categories IS NULL"),
    }
    return out


def orders():
    late = f"""count(*) FILTER (arrived > {{due}}) AS late_deliveries,
            count(*) FILTER (arrived < {{due}}) AS on_time_deliveries"""
    place = """SELECT min({0}) AS {0}, count(order_id) AS total_orders FROM c_items JOIN c_sellers USING (seller_id)
        GROUP BY lower(rtrim({0}, ' '))"""
    weekdays = ", ".join(f"count(*) FILTER (dayname(bought) = '{d}') AS total_orders_{d}" for d in DAYS)
    return {
        "orders_per_year": q("SELECT year(bought) AS year, count(DISTINCT order_id) AS total_orders FROM c_orders GROUP BY 1"),
        "status_by_year": q(f"SELECT order_status, {by_year(1, 'orders', wrap=big)} FROM c_orders GROUP BY 1"),
        "late_vs_on_time": q(f"SELECT year(bought) AS year, {late.format(due='promised')} FROM c_orders GROUP BY 1"),
        "late_vs_shipping_limit": q(
            f"""SELECT year(bought) AS year, {late.format(due='ship_limit')}
            FROM c_items JOIN c_orders USING (order_id) GROUP BY 1"""
        ),
        "shipping_delay_detail": q(
            f"""SELECT {day('arrived')} order_delivered_customer_date, {day('ship_limit')} shipping_limit_date,
            date_diff('day', ship_limit, arrived) AS dfrnc FROM c_items JOIN c_orders USING (order_id)"""
        ),
        "fulfilment_durations": q(
            "SELECT "
            + ", ".join(
                f"CAST(trunc(avg(date_diff('{unit}', {a}, {b}))) AS BIGINT) AS {name}"
                for unit, a, b, name in [
                    ("hour", "bought", "approved", "hours_taken_to_approve"),
                    ("day", "approved", "carried", "days_taken_to_get_to_seller"),
                    ("day", "carried", "arrived", "days_taken_from_seller_to_customer"),
                    ("day", "approved", "arrived", "days_from_aproval_to_customer"),
                    ("day", "bought", "arrived", "total_days_delivery_time"),
                ]
            )
            + " FROM c_orders"
        ),
        "orders_per_seller": q(
            """SELECT seller_id_values, count(order_id) AS total_orders FROM c_items JOIN k_seller USING (seller_id)
            GROUP BY 1"""
        ),
        "orders_per_city": q(place.format("seller_city")),
        "orders_per_state": q(place.format("seller_state")),
        "orders_by_weekday": q(
            f"SELECT day, {n0('n')} AS total_orders, n AS total_orders_num FROM d",
            "d AS (SELECT dayname(bought) AS day, count(*) AS n FROM c_orders GROUP BY 1)",
        ),
        "hour_by_weekday": q(f"SELECT hour(bought) AS hour, {weekdays} FROM c_orders GROUP BY 1"),
        "orders_by_month": q(
            "SELECT month, " + ", ".join(f"{n0(c)} AS {c}, {c} AS {c}_num" for c in years("total_orders")) + " FROM m",
            f"m AS (SELECT month(bought) AS month, {by_year(1, 'total_orders', wrap=big)} FROM c_orders GROUP BY 1)",
        ),
        "distinct_item_orders": q("SELECT count(DISTINCT order_id) AS total_orders FROM c_items"),
        "orders_per_status": q("SELECT order_status, count(*) AS total_orders FROM c_orders GROUP BY 1"),
        "peak_month": q(
            """SELECT year(bought) AS year, month(bought) AS month, count(*) AS total_orders FROM c_orders
            GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1"""
        ),
    }


def reviews():
    scores = "count(*) AS n, count(*) FILTER (review_score = 5) AS five, sum(review_score) AS score"
    five = f"CAST({half_up('five', 'n', 100)} AS VARCHAR) AS five_star_pct, CAST(five * 100 AS DOUBLE) / n AS five_star_pct_num"
    stages = """cut AS (SELECT * FROM c_orders WHERE order_status = 'canceled'),
        s AS (SELECT 'orders_cancelled_after_delivery' AS measures_name, count(*) AS measures_value FROM cut
              WHERE arrived IS NOT NULL
              UNION ALL SELECT 'orders_cancelled_during_shipping', count(*) FROM cut
              WHERE carried IS NOT NULL AND arrived IS NULL
              UNION ALL SELECT 'orders_cancelled_after_approval', count(*) FROM cut
              WHERE carried IS NULL AND arrived IS NULL AND approved IS NOT NULL
              UNION ALL SELECT 'orders_cancelled_before_approval', count(*) FROM cut WHERE approved IS NULL)"""
    sentiment = """s AS (SELECT count(*) AS total_orders, count(*) FILTER (review_score IN (1, 2)) AS bad_reviews,
        count(*) FILTER (review_score = 3) AS average_reviews, count(*) FILTER (review_score IN (4, 5)) AS good_reviews
        FROM c_reviews)"""
    names = ["total_orders", "bad_reviews", "average_reviews", "good_reviews"]
    score = big("review_score") + " AS review_score"
    return {
        "review_by_approval_time": q(
            f"SELECT b AS approval_time_bucket, {five}, n AS total_orders, {rounded('score', 'n')} AS avg_review_score FROM g",
            f"""h AS (SELECT date_diff('hour', bought, approved) AS hours, review_score
                FROM c_orders JOIN c_reviews USING (order_id)),
            g AS (SELECT CASE WHEN hours < 12 THEN 'under 12 hours' WHEN hours <= 24 THEN '12 to 24 hours'
                  WHEN hours <= 48 THEN '24 to 48 hours' ELSE 'over two days' END AS b, {scores} FROM h GROUP BY 1)""",
        ),
        "review_by_delivery_time": q(
            f"SELECT b AS delivery_time_bucket, n AS total_orders, {dbl('score')} / n AS avg_review_score, {five} FROM g",
            f"""h AS (SELECT date_diff('day', carried, arrived) * 24 AS hours, review_score
                FROM c_orders JOIN c_reviews USING (order_id)),
            g AS (SELECT CASE WHEN hours < 50 THEN 'approx two days' WHEN hours <= 96 THEN 'took four days'
                  WHEN hours <= 168 THEN 'took a week' WHEN hours <= 336 THEN 'took two weeks'
                  WHEN hours <= 7220 THEN 'took a month' ELSE 'more than a month' END AS b, {scores}
                  FROM h GROUP BY 1)""",
        ),
        "review_sentiment_counts": q(
            "SELECT " + ", ".join(f"{n0(c)} AS {c}, {c} AS {c}_num" for c in names) + " FROM s", sentiment
        ),
        "negative_review_share": q(
            f"""SELECT bad_reviews AS negative_reviews, total_orders AS total_reviews,
            {dbl('bad_reviews')} / total_orders AS negative_share FROM s""",
            sentiment,
        ),
        "good_reviews": q(f"SELECT review_english, {score} FROM c_reviews WHERE review_score >= 3"),
        "bad_reviews": q(f"SELECT review_english, {score} FROM c_reviews WHERE review_score < 3"),
        "cancellation_stages": q("SELECT * FROM s UNION ALL SELECT 'cancelled_orders', count(*) FROM cut", stages),
        "cancellation_stage_share": q(
            f"""SELECT measures_name, measures_value, cancelled_orders,
            {dbl('measures_value')} / cancelled_orders AS stage_share
            FROM s, (SELECT count(*) AS cancelled_orders FROM cut)""",
            stages,
        ),
        "review_by_status": q(
            f"""SELECT order_status, count(DISTINCT order_id) AS total_orders,
            {dbl('sum(review_score)')} / count(review_score) AS avg_score
            FROM c_orders JOIN c_reviews USING (order_id) GROUP BY 1"""
        ),
        "review_response_pairs": q(
            f"SELECT {day('created')} review_creation_date, {day('answered')} review_answer_timestamp FROM c_reviews"
        ),
        "review_response_time": q(
            """SELECT CAST(trunc(avg(date_diff('hour', CAST(created AS TIMESTAMP), CAST(answered AS TIMESTAMP))))
            AS BIGINT) AS time_taken_for_answer FROM c_reviews"""
        ),
    }


def revenue():
    paid = "FROM c_orders {} JOIN c_payments USING (order_id)"
    share = f"""{brl('v')} AS revenue, {dbl('v')} AS revenue_num, {dbl('v')} / {dbl('sum(v) OVER ()')} AS pct_revenue_num"""

    def pct_text(digits):
        return pct(cents("v"), cents("sum(v) OVER ()"), digits, ",") + " || '%' AS pct_revenue"

    def per_place(column, source):
        return q(
            f"SELECT {column}, {texts(years('Revenue'), brl)} FROM g",
            f"""g AS (SELECT min({column}) AS {column}, {by_year('payment_value', 'Revenue', wrap=as_is)}
            FROM c_payments JOIN c_items USING (order_id) JOIN c_orders USING (order_id)
            JOIN {source} USING (seller_id) GROUP BY {folded(column)})""",
        )

    gross = """g AS (SELECT product_id_values, count(*) AS total_orders,
        {}, sum(price + freight) AS total_Revenue,
        sum(CASE WHEN year(bought) IN ({}, {}) THEN payment_value ELSE 0 END) AS edge_paid
        FROM c_items JOIN c_payments USING (order_id) JOIN c_orders USING (order_id) JOIN k_product USING (product_id)
        GROUP BY 1 HAVING edge_paid = 0)""".format(by_year("price + freight", "Revenue", wrap=as_is), Y[0], Y[-1])
    gross_out = f"SELECT product_id_values, total_orders, {texts([*years('Revenue'), 'total_Revenue'], brl)} FROM g"
    return {
        "item_payment_detail": q(
            f"""SELECT order_id_values, {big('order_item_id')} AS order_item_id, product_id_values, seller_id_values,
            payment_sequential, payment_type, {big('payment_installments')} AS payment_installments,
            {dbl('payment_value')} AS payment_value, {dbl('price')} AS price, {dbl('freight')} AS freight_value
            FROM c_items JOIN c_payments USING (order_id) JOIN k_order USING (order_id)
            JOIN k_product USING (product_id) JOIN k_seller USING (seller_id)"""
        ),
        "total_revenue": q(
            f"SELECT {brl('v')} AS revenue, {dbl('v')} AS revenue_num FROM (SELECT sum(payment_value) AS v FROM c_payments)"
        ),
        "revenue_per_year": q(
            f"SELECT year, {brl('v')} AS revenue, {dbl('v')} AS revenue_num FROM g",
            f"g AS (SELECT year(bought) AS year, sum(payment_value) AS v {paid.format('LEFT')} GROUP BY 1)",
        ),
        "revenue_by_month": q(
            f"SELECT month, {texts(years('total_Revenue'), n0)} FROM g",
            f"""g AS (SELECT month(bought) AS month, {by_year('payment_value', 'total_Revenue', wrap=as_is)}
            {paid.format('LEFT')} GROUP BY 1)""",
        ),
        "revenue_by_quarter": q(
            f"SELECT year, quarter, {brl('v')} AS revenue, {dbl('v')} AS revenue_num FROM g",
            f"""g AS (SELECT year(bought) AS year, quarter(bought) AS quarter, sum(payment_value) AS v
            {paid.format('')} GROUP BY 1, 2)""",
        ),
        "revenue_by_status": q(
            f"SELECT order_status, n AS total_orders, {share}, {pct_text(3)} FROM g",
            f"g AS (SELECT order_status, count(*) AS n, sum(payment_value) AS v {paid.format('')} GROUP BY 1)",
        ),
        "financial_category": q(
            f"SELECT year, financial_category, n AS total_orders, {share}, {pct_text(2)} FROM g",
            f"""g AS (SELECT year(bought) AS year,
            CASE WHEN order_status = 'delivered' THEN 'In Our Books' WHEN order_status IN
              ('approved', 'created', 'invoiced', 'processing', 'shipped') THEN 'Projected Earnings'
              ELSE 'Canceled / Unavailable' END AS financial_category,
            count(*) AS n, sum(payment_value) AS v {paid.format('')} GROUP BY 1, 2)""",
        ),
        "aov": q(f"SELECT {rounded(cents('sum(payment_value)'), 'count(*) * 100')} AS AOV FROM c_payments"),
        "aov_per_order": q(
            f"SELECT {rounded(cents('sum(payment_value)'), 'count(DISTINCT order_id) * 100')} AS AOV FROM c_payments"
        ),
        "multi_payment_counts": q(
            """SELECT count(*) AS total_orders, payment_sequential FROM c_payments WHERE payment_sequential > 1
            GROUP BY 2"""
        ),
        "payment_type_stacking": q(
            f"""SELECT count(*) AS total_orders, payment_type, {big('sum(payment_sequential)')} AS total_sequentials,
            {rounded('sum(payment_sequential)', 'count(*)', 3)} AS avg_payments_per_order FROM c_payments GROUP BY 2"""
        ),
        "installments_by_type": q(
            f"SELECT payment_type, {n0('n')} AS total_installemnts, n AS total_installemnts_num FROM g",
            f"g AS (SELECT payment_type, {big('sum(payment_installments)')} AS n FROM c_payments GROUP BY 1)",
        ),
        "cancelled_by_payment": q(
            """SELECT payment_type, order_status, review_english FROM c_orders JOIN c_payments USING (order_id)
            JOIN c_reviews USING (order_id) WHERE payment_type = 'credit_card' AND order_status = 'canceled'"""
        ),
        "revenue_per_seller": per_place("seller_id_values", "k_seller"),
        "revenue_per_city": per_place("seller_city", "c_sellers"),
        "revenue_per_state": per_place("seller_state", "c_sellers"),
        "lucrative_gap_cities": q(
            f"""SELECT seller_city, total_sellers, {brl('v')} AS Revenue, {dbl('v')} AS Revenue_num, total_products,
            {rounded(cents('v'), 'n * 100')} AS avg_payment_value FROM g WHERE v > {GAP}""",
            f"""g AS (SELECT min(seller_city) AS seller_city, count(DISTINCT seller_id) AS total_sellers, sum(payment_value) AS v,
            count(DISTINCT product_id) AS total_products, count(payment_value) AS n
            FROM c_sellers JOIN c_items USING (seller_id) JOIN c_payments USING (order_id)
            GROUP BY {folded('seller_city')})""",
        ),
        "phased_out_products": q(gross_out, gross),
        "phased_out_one_product": q(f"{gross_out} WHERE product_id_values = 'P00010'", gross),
        "net_revenue_per_product": q(
            f"SELECT product_id_values, n AS total_orders, {texts(years('Revenue'), brl)} FROM g",
            f"""g AS (SELECT product_id_values, count(*) AS n, {by_year('price', 'Revenue', wrap=as_is)}
            FROM c_items JOIN c_orders USING (order_id) JOIN k_product USING (product_id) GROUP BY 1)""",
        ),
        "low_reviews_by_product": q(
            """SELECT order_id_values, product_id_values, review_english FROM c_items JOIN c_reviews USING (order_id)
            JOIN k_order USING (order_id) JOIN k_product USING (product_id) WHERE review_score < 3"""
        ),
        "revenue_by_category": q(
            f"SELECT main_categories, n AS total_products, {texts(years('Revenue'), brl)} FROM g",
            f"""g AS (SELECT main_categories, count(DISTINCT product_id) AS n,
            {by_year('price + freight', 'Revenue', wrap=as_is)}
            FROM c_items JOIN c_products USING (product_id) JOIN c_payments USING (order_id)
            JOIN c_orders USING (order_id) GROUP BY 1)""",
        ),
        "seller_revenue_allocated": q(
            f"SELECT seller_id, {rounded('sum(micros)', '1000000')} AS allocated_revenue FROM parts GROUP BY 1",
            f"""p AS (SELECT order_id, {cents('sum(payment_value)')} AS paid FROM c_payments GROUP BY 1),
            l AS (SELECT order_id, seller_id, {cents('sum(price + freight)')} AS gross FROM c_items GROUP BY 1, 2),
            s AS (SELECT seller_id, CAST(paid AS HUGEINT) AS paid, gross, sum(gross) OVER (PARTITION BY order_id) AS whole
                  FROM l JOIN p USING (order_id)),
            parts AS (SELECT seller_id, {half_up('paid * gross', 'whole', 10000)} AS micros FROM s)""",
        ),
    }


def customers():
    people = """people AS (SELECT customer_unique_id, count(DISTINCT order_id) AS order_count,
        count(DISTINCT year(bought)) AS years_active
        FROM c_orders JOIN c_customers USING (customer_id) GROUP BY 1)"""

    def rate(measure, count, share):
        return q(
            f"""SELECT n AS total_customers, r AS {count}, {pct('r', 'n', 2, '.')} AS {share},
            CAST(r * 100 AS DOUBLE) / n AS {share}_num
            FROM (SELECT count(*) AS n, count(*) FILTER ({measure} > 1) AS r FROM people)""",
            people,
        )

    return {
        "customer_orders": q(
            """SELECT customer_unique_id, order_id_values, year(bought) AS order_year
            FROM c_orders JOIN c_customers USING (customer_id) JOIN k_order USING (order_id)"""
        ),
        "customer_summary": q("SELECT * FROM people", people),
        "repeat_rate": rate("order_count", "repeat_customers", "repeat_customer_pct"),
        "multi_year_rate": rate("years_active", "multi_year_customers", "multi_year_pct"),
        "order_count_histogram": q("SELECT order_count, count(*) AS num_customers FROM people GROUP BY 1", people),
        "repeat_by_customer_key": q(
            """SELECT customer_id_values, year(bought) AS year, count(*) AS count
            FROM c_orders JOIN k_customer USING (customer_id) GROUP BY 1, 2 HAVING count(*) > 1"""
        ),
    }


def views():
    # Windows and DISTINCT over the full join, as the views were first written.
    product = f"""full_join AS (
        SELECT product_id_values, main_categories, year(bought) AS year, price, freight, review_score, seller_id, customer_id
        FROM c_items JOIN c_payments USING (order_id) JOIN c_reviews USING (order_id) JOIN c_orders USING (order_id)
        JOIN c_products USING (product_id) JOIN k_product USING (product_id)),
      seen AS (
        SELECT DISTINCT product_id_values, main_categories, year,
          CAST(sum(review_score) OVER w AS DOUBLE) / count(review_score) OVER w AS avg_review,
          {rounded(cents('sum(price) OVER w'), 'count(price) OVER w * 100')} AS avg_price,
          count(*) OVER w AS total_quantity_sold, count(seller_id) OVER w AS sellers_inolved,
          CAST(sum(price + freight) OVER w AS DOUBLE) AS transaction_value,
          count(customer_id) OVER w AS total_customers_bought
        FROM full_join WINDOW w AS (PARTITION BY product_id_values)),
      pv AS (
        SELECT * EXCLUDE (year, avg_price), {by_year('avg_price', 'Revenue', when='year', wrap=as_is)}
        FROM seen GROUP BY ALL)"""
    a, b, c = (f"Revenue_{y} > 0" for y in Y)
    label = f"""CASE WHEN {a} AND {b} THEN 'First two years' WHEN {c} AND {b} THEN 'last two years'
        WHEN {a} AND {c} THEN 'first and last year' ELSE 'only one year' END"""
    right = f"""CASE CAST({a} AS INT) + 2 * CAST({b} AS INT) + 4 * CAST({c} AS INT)
        WHEN 7 THEN 'throughout the years' WHEN 3 THEN 'First two years' WHEN 6 THEN 'last two years'
        WHEN 5 THEN 'first and last year' WHEN 0 THEN 'none of the years' ELSE 'only one year' END"""
    columns = f"""product_id_values, avg_review, main_categories, total_quantity_sold,
        {', '.join(years('Revenue'))}, {label} AS product_lifecycle, sellers_inolved, transaction_value,
        total_customers_bought"""
    seller = f"""lines AS (
        SELECT DISTINCT seller_id_values, seller_city, seller_state, year(bought) AS year, product_id, order_id, freight, price
        FROM c_sellers JOIN k_seller USING (seller_id) JOIN c_items USING (seller_id) JOIN c_orders USING (order_id)),
      active AS (
        SELECT DISTINCT seller_id_values, seller_city, seller_state, year, count(product_id) OVER w AS total_products,
          count(order_id) OVER w AS total_orders, sum(price + freight) OVER w AS revenue
        FROM lines WINDOW w AS (PARTITION BY seller_id_values)),
      sv AS (
        SELECT seller_id_values, seller_city, seller_state, total_products,
          {', '.join(f"CAST(sum(CASE WHEN year = {y} THEN revenue ELSE 0 END) OVER w AS DOUBLE) AS Revenue_{y}" for y in Y)},
          CAST(sum(revenue) OVER w AS DOUBLE) AS total_revenue, total_orders
        FROM active WINDOW w AS (PARTITION BY seller_id_values))"""
    return {
        "product_view": q(f"SELECT {columns} FROM pv", product),
        "product_lifecycle_corrected": q(f"SELECT product_id_values, {right} AS product_lifecycle FROM pv", product),
        "audit_unmapped_products": q(f"SELECT {columns} FROM pv WHERE main_categories IS NULL", product),
        "lifecycle_share": q(
            f"""SELECT product_lifecycle, n AS total_products, {dbl('n')} / {dbl('sum(n) OVER ()')} AS product_share
            FROM (SELECT {label} AS product_lifecycle, count(*) AS n FROM pv GROUP BY 1)""",
            product,
        ),
        "seller_view": q("SELECT * FROM sv", seller),
        "seller_view_clean": q(
            f"""SELECT * FROM sv QUALIFY row_number() OVER
            (PARTITION BY seller_id_values ORDER BY Revenue_{Y[-1]} DESC, seller_city, seller_state) = 1""",
            seller,
        ),
        "seller_view_corrected": q(
            f"""SELECT seller_id_values, seller_city, seller_state, count(*) AS total_products, count(*) AS total_orders,
            {by_year('price + freight', 'Revenue', when='year')}, {dbl('sum(price + freight)')} AS total_revenue
            FROM lines GROUP BY 1, 2, 3""",
            seller,
        ),
        "order_view": q(
            f"""SELECT DISTINCT order_id_values, n AS products_ordered, {dbl('v')} AS Revenue, seller_id_values,
            seller_city, seller_state, {big('review_score')} AS review_score, year(bought) AS year, order_status,
            customer_id_values FROM g""",
            """g AS (SELECT order_id_values, order_status, customer_id_values, seller_id_values, seller_city, seller_state,
              review_score, price, freight, bought, count(*) AS n, sum(price + freight) AS v
            FROM c_items JOIN c_orders USING (order_id) JOIN c_reviews USING (order_id) JOIN c_sellers USING (seller_id)
            JOIN k_order USING (order_id) JOIN k_seller USING (seller_id) JOIN k_customer USING (customer_id)
            GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)""",
        ),
    }


def derived():
    gross = "s AS (SELECT seller_id, sum(price + freight) AS v FROM c_items GROUP BY 1)"
    refund = r"regexp_matches(lower(review_english), '\b(refund\w*|money back|reimburs\w*)')"
    invoice = r"regexp_matches(lower(review_english), '\binvoic\w*')"
    return {
        "top_seller_concentration": q(
            f"""SELECT count(*) AS top_sellers, {dbl('sum(v)')} AS top_revenue, {dbl('(SELECT sum(v) FROM s)')} AS total_revenue,
            {dbl('sum(v)')} / {dbl('(SELECT sum(v) FROM s)')} AS top_share FROM (SELECT v FROM s ORDER BY v DESC LIMIT 15)""",
            gross,
        ),
        "revenue_per_seller_by_city": q(
            f"""SELECT seller_city, n AS total_sellers, {dbl('v')} AS revenue, {rounded(cents('v'), 'n * 100')} AS revenue_per_seller
            FROM (SELECT min(seller_city) AS seller_city, count(*) AS n, sum(v) AS v FROM s JOIN c_sellers USING (seller_id)
                  GROUP BY {folded('seller_city')})""",
            gross,
        ),
        "cancelled_payment_mix": q(
            f"""SELECT payment_type, count(DISTINCT order_id) AS cancelled_orders, {dbl('count(DISTINCT order_id)')} /
            (SELECT count(*) FROM c_orders WHERE order_status = 'canceled') AS share_of_cancelled
            FROM c_orders JOIN c_payments USING (order_id) WHERE order_status = 'canceled' GROUP BY 1"""
        ),
        "complaint_categories": q(
            f"""SELECT payment_type, count(DISTINCT review_id) FILTER ({refund}) AS refund_complaints,
            count(DISTINCT review_id) FILTER ({invoice}) AS invoice_complaints
            FROM c_orders JOIN c_payments USING (order_id) JOIN c_reviews USING (order_id)
            WHERE order_status = 'canceled' GROUP BY 1"""
        ),
        "review_categories": q(
            f"""SELECT review_id_values, {big('review_score')} AS review_score, review_english,
            CASE WHEN {refund} THEN 'refund' WHEN {invoice} THEN 'invoice' END AS review_category
            FROM c_reviews JOIN k_review USING (review_id)"""
        ),
    }


def all_oracles() -> dict[str, str]:
    by_sql = {f"sql_{name}": views()[name] for name in ("product_view", "seller_view", "seller_view_clean", "order_view")}
    return by_sql | cleaning() | orders() | reviews() | revenue() | customers() | views() | derived()
