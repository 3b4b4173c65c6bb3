import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feira import schema
from feira.functions.exprs import folded
from feira.operators.conform import append_rows
from feira.plans import orders
from feira.sources import loaders, sample
from feira.tables import CleanTables
from tests.frames import rows


def test_dictionary_with_byte_order_mark_and_quoted_commas(spark, tmp_path):
    path = tmp_path / "dictionary.csv"
    path.write_text('﻿category_pt,category_en,main_categories\nbebes,baby,"Sports, Toys & Leisure"\n', encoding="utf-8")
    df = loaders.read_csv(spark, str(path), schema.CATEGORY_DICTIONARY)
    assert rows(df) == [("bebes", "baby", "Sports, Toys & Leisure")]


def test_lost_header_is_a_row_again(spark, tmp_path):
    path = tmp_path / "no_header.csv"
    path.write_text("informatica_acessorios,computers_accessories\nbebes,baby\n")
    df = loaders.read_headerless_csv(spark, str(path), schema.CATEGORY_TRANSLATION)
    assert rows(df) == [("bebes", "baby"), ("informatica_acessorios", "computers_accessories")]


def test_appended_rows_leave_other_columns_empty(spark):
    df = spark.createDataFrame([("s1", "x", "SP")], schema.SELLERS)
    assert rows(append_rows(df, [("Ipirá", "BA")], ["seller_city", "seller_state"])) == [
        ("s1", "x", "SP"), (None, "Ipirá", "BA"),
    ]


def test_tables_load_with_fixed_schemas(spark, sample, tmp_path):
    for name, fields in schema.TABLES.items():
        df = getattr(sample.raw, name)
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in fields], name
        loaders.save(df, str(tmp_path / name))
    loaded = CleanTables(loaders.load_tables(spark, str(tmp_path)))
    assert rows(orders.status_by_year(loaded)) == rows(orders.status_by_year(sample))
    assert loaded.raw.geolocation.count() == sample.raw.geolocation.count()


def test_tables_load_from_csv(spark, tmp_path):
    (tmp_path / "sellers_file.csv").write_text("seller_id,seller_city,seller_state\ns1,\"a, b\",SP\n")
    df = loaders.read_table(spark, str(tmp_path / "sellers_file.csv"), schema.SELLERS, "csv")
    assert rows(df) == [("s1", "a, b", "SP")]


def test_document_ids_are_unique(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    assert documents.select("doc_id").distinct().count() == documents.count()


def test_sample_tables_keep_every_text_and_amount(spark, folder):
    read = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "orders")}
    reviews, payments = sample.reviews(spark, folder), sample.payments(spark, folder)
    keys = read["orders"].select("o_orderkey")
    texts = read["documents"].join(keys, F.col("doc_id") == F.col("o_orderkey")).select(folded("text").alias("text"))
    assert texts.exceptAll(reviews.select(folded("review_comment_message").alias("text"))).count() == 0
    total = read["orders"].agg(F.sum("o_totalprice") + 50 * F.count_if(F.col("o_orderkey") % 8 == 0)).first()[0]
    assert payments.agg(F.sum("payment_value")).first()[0] == pytest.approx(total, rel=1e-12)
    assert payments.select("order_id", "payment_sequential").distinct().count() == payments.count()
    assert reviews.select("review_id").distinct().count() == reviews.count()
    unpaid = keys.filter("o_orderkey % 97 = 0").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("order_id"))
    assert unpaid.count() > 0 and payments.join(unpaid, "order_id").count() == 0


def test_blanks_quotes_and_nulls_survive_a_csv(spark, tmp_path):
    df = spark.createDataFrame([("s1", ' a, "b"  ', None), ("s2", "c ", "SP")], schema.SELLERS)
    loaders.save_csv(df, str(tmp_path / "x"))
    assert rows(loaders.read_csv(spark, str(tmp_path / "x"), schema.SELLERS, multi_line=False)) == rows(df)


def test_csv_without_line_breaks_in_values_is_split(spark, tmp_path):
    path = tmp_path / "words.csv"
    path.write_text("\ufeffa,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(20000)), encoding="utf-8")
    fields = StructType.fromDDL("a long, b string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        split = loaders.read_csv(spark, str(path), fields, multi_line=False)
        whole = loaders.read_csv(spark, str(path), fields)
        assert split.rdd.getNumPartitions() > 1 == whole.rdd.getNumPartitions()
        assert split.count() == 20000 and split.exceptAll(whole).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_tables_with_texts_are_read_whole():
    assert set(loaders.MULTI_LINE) <= set(schema.TABLES)


def test_variants_of_parts_are_made_by_several_tasks(spark, folder):
    """Though the file is one row group."""
    tasks = sample.products(spark, folder).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
