"""The marketplace tables derived from the TPC-H-like test tables.

Raw on purpose: timestamps carry fractions and times of day, prices are doubles, some items
appear twice, city names are misspelt and payment types unharmonised.
Every table comes from one scan of its whole input.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.operators.conform import literal_rows
from feira.operators.rules import CATEGORY_CLASSES
from feira.schema import CATEGORY_TRANSLATION
from feira.tables import RawTables

CATEGORY_NAMES = [
    ("ECONOMY", "telephony"),
    ("SMALL", "toys"),
    ("MEDIUM", "bed_bath_table"),
    ("LARGE", "fashion_shoes"),
    ("PROMO", "books_technical"),
    ("AUTO", "auto"),
    ("PERF", "perfumery"),
]

ENGLISH_NAMES = [name for _, names, _ in CATEGORY_CLASSES for name in names] + [
    "auto", "stationery", "garden_tools", "market_place", "art", "books_technical", "books_imported",
    "books_general_interest", "health & beauty", "FASHION_X", "Toys", None,
]

# Misspelt (city, state) pairs, at least one for each correction, handed to two sellers of three in turn.
DIRTY_CITIES = [
    ("sao paulo", "SP"),
    ("sao paulo", "RJ"),
    ("sao pauo", "SP"),
    ("sao pauo", "RJ"),
    ("são paulo", "SP"),
    ("sp", "RJ"),
    ("sp / sp", "RJ"),
    ("sbc", "SP"),
    ("sbc/sp", "SP"),
    ("s jose do rio preto", "SP"),
    ("s jose do rio preto", "MG"),
    ("sao jose dos pinhais", "SP"),
    ("aguas claras df", "SP"),
    ("ipira", "BA"),
    ("ipiranga", "PR"),
    ("mogi das cruses", "SP"),
    ("mogi das cruses", "RJ"),
    ("mogi das cruzes / sp", "RJ"),
    ("RIO DE JANEIRO, brasil", "SP"),
    ("volta redonda", "SP"),
    ("belo horizont", "SP"),
    ("balneario camboriu", "SC"),
    ("sao bernardo do capo", "SP"),
    (None, "SP"),
    ("vila sao paulo", "SP"),
    ("angra dos reis rj", "RJ"),
    ("arraial d'ajuda (porto seguro)", "BA"),
    ("minas gerais - mg", "MG"),
    ("Auriflama/SP", "sp"),
    ("andradas", "SP"),
    ("ao bernardo do campo", "RJ"),
    ("BRASILIA df", "DF"),
    ("cariacica / es", "ES"),
    ("caxias do sul, brasil", "SC"),
    ("chapeco sc", "RS"),
    ("curitiba - pr", "SP"),
    ("ferraz de  vasconcelos sp", "SP"),
    ("itajai", "sc "),
    ("jaguariuna", "MG"),
    ("Jacutinga", "SP"),
    ("juiz de fora", "RJ"),
    ("lages - sc", "SC"),
    ("londrina", "SP"),
    ("marechal candido rondon", "SC"),
    ("novo hamburgo, rio grande do sul, brasil", "RS"),
    ("palhoca", "SP"),
    ("pinhalzinho", "SP"),
    ("porto alegre", "SP"),
    ("ribeirao pretp", "SP"),
    ("rio bonito", "SP"),
    ("santa barbara d oeste", "SP"),
    ("santa barbara d'oeste ", "SP"),
    ("sao jose do rio pret", "SP"),
    ("sao jose dos pinhas", "SP"),
    ("sao miguel d'oeste", "SC"),
    ("sao paulop", "SP"),
    ("VOLTA REDONDA ", "rj"),
    ("Volta Redonda", "RJ "),
    ("sp / sp", "SP"),
]


def _padded(number: str, width: int) -> str:
    """Zero-padded to at least ``width`` digits, longer numbers unharmed."""
    text = f"CAST({number} AS STRING)"
    return f"lpad({text}, greatest(length({text}), {width}), '0')"


def _moved(every: int) -> str:
    """The order that order ``k``'s rows are filed under: each ``every``-th order hands them to its neighbour."""
    return f"CASE WHEN k % {every} <> 0 THEN k WHEN k = 0 THEN 1 ELSE k - 1 END"


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _order_base(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _read(spark, folder, "orders")
        .selectExpr(
            "o_orderkey AS k",
            "o_custkey AS ck",
            "o_totalprice AS total",
            f"{_padded('o_orderkey', 10)} AS order_id",
            "o_orderdate + INTERVAL '1' SECOND * ((o_orderkey * 7919) % 86400)"
            " + INTERVAL '0.250' SECOND AS order_purchase_timestamp",
        )
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    r = F.col("k") % 100
    status = (
        F.when(r < 3, "canceled")
        .when(r == 3, "unavailable")
        .when(r < 6, "shipped")
        .when(r == 6, "invoiced")
        .when(r == 7, "processing")
        .when(r == 8, "created")
        .when(r == 9, "approved")
        .otherwise("delivered")
    )
    return (
        _order_base(spark, folder)
        .withColumn("order_status", status)
        .withColumn(
            "order_approved_at",
            F.expr(
                "CASE WHEN k % 100 = 2 OR k % 41 = 0 THEN NULL"
                " ELSE order_purchase_timestamp + INTERVAL '1' SECOND * ((k * 613) % 260000) END"
            ),
        )
        .withColumn(
            "order_delivered_carrier_date",
            F.expr(
                "CASE WHEN order_status IN ('delivered', 'shipped') OR (order_status = 'canceled' AND k % 3 = 0)"
                " THEN coalesce(order_approved_at, order_purchase_timestamp) + INTERVAL '1' DAY * (k % 6) END"
            ),
        )
        .selectExpr(
            "order_id",
            "'c' || order_id AS customer_id",
            "order_status",
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "CASE WHEN order_status = 'delivered' OR (order_status = 'canceled' AND k % 9 = 0)"
            " THEN order_delivered_carrier_date + INTERVAL '1' DAY * ((k * 37) % 45) END"
            " AS order_delivered_customer_date",
            "order_purchase_timestamp + INTERVAL '1' DAY * (20 + k % 10) AS order_estimated_delivery_date",
        )
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return _order_base(spark, folder).selectExpr(
        "'c' || order_id AS customer_id",
        "CASE WHEN ck % 10 < 6 THEN 'u' || order_id"
        f" WHEN ck % 10 < 8 THEN 'y' || {_padded('ck', 8)} || '-' || year(order_purchase_timestamp)"
        f" ELSE 'p' || {_padded('ck', 8)} END AS customer_unique_id",
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "lineitem").selectExpr(
        f"{_padded('l_orderkey', 10)} AS order_id",
        "explode(IF(l_orderkey % 50 = 0, array(l_linenumber, l_linenumber + 100), array(l_linenumber))) AS order_item_id",
        f"{_padded('l_partkey', 8)} || '-' || l_suppkey % 10 AS product_id",
        f"{_padded('l_suppkey', 6)} AS seller_id",
        "l_shipdate + INTERVAL '1' HOUR * l_linenumber AS shipping_limit_date",
        "l_extendedprice AS price",
        "l_quantity AS freight_value",
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """Every 97th order is unpaid: its payments come after those of its neighbour."""
    return (
        _order_base(spark, folder)
        .selectExpr(
            "*",
            f"{_moved(97)} AS payer",
        )
        .selectExpr("*", f"{_padded('payer', 10)} AS payer_id")  # once per order, before its payments are listed
        .selectExpr(
            "*",
            "explode(CASE WHEN k % 8 = 0 THEN array(1, 2) ELSE array(1) END) AS own",
        )
        .selectExpr(
            "payer_id AS order_id",
            "own + CASE WHEN payer = k THEN 0 WHEN payer % 8 = 0 THEN 2 ELSE 1 END AS payment_sequential",
            "CASE WHEN own = 2 THEN 'voucher' WHEN k % 10 < 7 THEN 'credit_card'"
            " WHEN k % 20 = 7 THEN 'Boleto ' WHEN k % 10 < 9 THEN 'boleto' ELSE 'debit_card' END AS payment_type",
            "CAST(CASE WHEN own = 2 THEN 1 ELSE k % 12 + 1 END AS INT) AS payment_installments",
            "CASE WHEN own = 2 THEN 50D ELSE total END AS payment_value",
        )
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """A review with its document's text for every order; that of every 29th order is its neighbour's second one.

    Some messages are in capitals or end in blanks, unlike the texts in the translation table.
    """
    # One text per document id; grouping tells Spark the id is unique, so that it drops the join
    # from every query that does not read the text.
    texts = _read(spark, folder, "documents").groupBy("doc_id").agg(F.min("text").alias("text"))
    base = _order_base(spark, folder)
    return (
        base.join(texts, base.k == texts.doc_id, "left")
        .selectExpr(
            "*",
            "explode(IF(k % 53 = 0, array('r', 's'), array('r'))) AS kind",
        )
        .selectExpr(
            "kind || order_id AS review_id",
            f"IF(kind = 'r', {_padded(f'({_moved(29)})', 10)}, order_id) AS order_id",
            "CAST(IF(kind = 's', 1, 1 + (k * 13) % 5) AS INT) AS review_score",
            "CAST(NULL AS STRING) AS review_comment_title",
            f"CASE WHEN kind <> 'r' THEN NULL WHEN k % 31 = 0 THEN translate(text, '{ascii_lowercase}', '{ascii_uppercase}')"
            " WHEN k % 37 = 0 THEN text || '  ' ELSE text END AS review_comment_message",
            "order_purchase_timestamp + INTERVAL '1' DAY * IF(kind = 'r', 30, 0) AS review_creation_date",
            "order_purchase_timestamp + INTERVAL '1' DAY * IF(kind = 'r', 30 + k % 7, 0) AS review_answer_timestamp",
        )
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Ten variants of a part; the category of two of them is spelt differently.

    Parts are dealt out before they become ten rows each, as a file of one row group is read by one task.
    """
    parts = _read(spark, folder, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 9 = 0 THEN 'AUTO' WHEN p_partkey % 11 = 0 THEN 'PERF' ELSE p_type END AS name"
    )
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    variants = parts.selectExpr("*", "explode(sequence(0, 9)) AS variant")
    return variants.selectExpr(
        f"{_padded('p_partkey', 8)} || '-' || variant AS product_id",
        "CASE variant WHEN 3 THEN lower(name) WHEN 7 THEN name || ' ' ELSE name END AS product_category_name",
    )


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    dirty = F.array(*[F.struct(F.lit(c).cast("string").alias("city"), F.lit(s).alias("state")) for c, s in DIRTY_CITIES])
    place = F.expr(f"CAST((s_suppkey - s_suppkey div 3 - 1) % {len(DIRTY_CITIES)} AS INT)")
    pick = F.when(F.col("s_suppkey") % 3 != 0, F.get(dirty, place))
    supplier, nation, region = (_read(spark, folder, n) for n in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("dirty", pick)
        .selectExpr(
            f"{_padded('s_suppkey', 6)} AS seller_id",
            "CASE WHEN s_suppkey % 3 <> 0 THEN dirty.city WHEN s_suppkey % 4 = 0 THEN lower(n_name) || ' - xx'"
            " WHEN s_suppkey % 4 = 1 THEN upper(n_name) WHEN s_suppkey % 4 = 2 THEN lower(n_name) || '  '"
            " ELSE lower(n_name) END AS seller_city",
            "CASE WHEN s_suppkey % 3 <> 0 THEN dirty.state WHEN s_suppkey % 2 = 0 THEN lower(r_name) || ' '"
            " ELSE r_name END AS seller_state",
        )
    )


def geolocation(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = (_read(spark, folder, n) for n in ("nation", "region"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        f"{_padded('n_nationkey', 5)} AS geolocation_zip_code_prefix",
        "lower(n_name) AS geolocation_city",
        "r_name AS geolocation_state",
    )


def review_translation(spark: SparkSession, folder: str) -> DataFrame:
    """Text and English text; copied documents make some texts appear more than once."""
    return _read(spark, folder, "documents").selectExpr(
        "text AS column1",
        "CASE WHEN doc_id % 5 = 0 THEN 'still waiting for the Refund of order note ' || doc_id"
        " WHEN doc_id % 5 = 1 THEN 'never got the invoice, case ' || doc_id"
        " WHEN doc_id % 5 = 2 THEN 'no invoice and no money back, case ' || doc_id"
        " ELSE 'note ' || doc_id || ' in ' || lang END AS column2",
    )


def category_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every part with one of the English category names in turn: known, other, oddly cased and missing."""
    labels = F.array(*[F.lit(v).cast("string") for v in ENGLISH_NAMES])
    return _read(spark, folder, "part").select(
        F.col("p_partkey").alias("part_key"),
        F.get(labels, (F.col("p_partkey") % len(ENGLISH_NAMES)).cast("int")).alias("category_en"),
    )


def category_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary of the categories that products really use."""
    used = products(spark, folder).select(F.col("product_category_name").alias("category_pt")).distinct()
    return used.join(literal_rows(spark, CATEGORY_NAMES, CATEGORY_TRANSLATION), "category_pt")


def with_repeats(df: DataFrame, where: str) -> DataFrame:
    """``df`` with every row that meets the condition twice."""
    times = F.when(F.expr(where), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("copy", F.explode(times)).drop("copy")


def with_empty_rows(df: DataFrame, where: str) -> DataFrame:
    """``df`` plus a row of NULLs for every row that meets the condition."""
    copies = df.withColumn("copy", F.explode(F.when(F.expr(where), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return copies.select(*[F.when(F.col("copy") == 0, F.col(c)).alias(c) for c in df.columns])


def sample_tables(spark: SparkSession, folder: str) -> RawTables:
    return RawTables(
        orders=orders(spark, folder),
        items=items(spark, folder),
        payments=payments(spark, folder),
        reviews=reviews(spark, folder),
        products=products(spark, folder),
        sellers=sellers(spark, folder),
        customers=customers(spark, folder),
        geolocation=geolocation(spark, folder),
        category_translation=literal_rows(spark, CATEGORY_NAMES, CATEGORY_TRANSLATION),
        review_translation=review_translation(spark, folder),
    )
