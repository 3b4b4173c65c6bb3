from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from feira.operators import keys
from tests.frames import rows


def numbered(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(3)
    return {r["id"]: r["rn"] for r in keys.dense_numbers(df, "id").collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ids=st.sets(st.text(alphabet="0123456789abcdefXYZ-é", min_size=0, max_size=8), max_size=40))
def test_numbers_follow_id_order_without_gaps(spark, ids):
    expected = {v: n for n, v in enumerate(sorted(ids, key=lambda s: s.encode()), 1)}
    assert numbered(spark, ids) == expected


def test_null_comes_first(spark):
    assert numbered(spark, ["b", None, "a"]) == {None: 1, "a": 2, "b": 3}


def test_same_numbers_as_one_global_window(spark):
    ids = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
    expected = ids.select("id", F.row_number().over(Window.orderBy("id")).cast("bigint").alias("rn"))
    assert rows(keys.dense_numbers(ids, "id")) == rows(expected)


def test_mapping_is_one_to_one_over_the_union(spark, sample):
    for mapping in (sample.order_keys, sample.product_keys, sample.seller_keys, sample.customer_keys, sample.review_keys):
        key, label = mapping.columns
        n, ids, labels, longest = mapping.agg(
            F.count("*"), F.count_distinct(key), F.count_distinct(label), F.max(F.substring(label, 2, 20).cast("int"))
        ).first()
        assert n == ids == labels == longest


def test_a_repeated_id_gets_one_number(spark):
    a = spark.createDataFrame([("x",)] * 500 + [("y",)], "id string")
    b = spark.createDataFrame([("w",), ("x",)], "id string")
    assert rows(keys.build_mapping("id", "A", a, b)) == [("w", "A00001"), ("x", "A00002"), ("y", "A00003")]
