"""T-SQL semantics on single values."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feira.functions import exprs as X
from feira.operators.keys import surrogate_label


def value(spark, column, kind, *inputs):
    kinds = kind if isinstance(kind, (list, tuple)) else [kind] * len(inputs)
    names = [f"c{i}" for i in range(len(inputs))]
    df = spark.createDataFrame([tuple(inputs)], ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return df.select(column(*[F.col(n) for n in names])).first()[0]


def at(hour, minute, day=1):
    return datetime(2017, 3, day, hour, minute)


@pytest.mark.parametrize(
    "start, end, hours",
    [
        (at(10, 59), at(11, 1), 1),
        (at(10, 0), at(10, 59), 0),
        (at(11, 1), at(10, 59), -1),
        (at(23, 59), at(0, 0, 2), 1),
        (None, at(1, 0), None),
    ],
)
def test_hours_count_boundaries(spark, start, end, hours):
    assert value(spark, X.hours_between, "timestamp_ntz", start, end) == hours


def test_hours_between_dates_are_whole_days(spark):
    assert value(spark, X.hours_between, "date", date(2017, 3, 1), date(2017, 3, 4)) == 72


def test_days_count_midnights(spark):
    assert value(spark, X.days_between, "timestamp_ntz", at(23, 59), at(0, 1, 2)) == 1


@pytest.mark.parametrize("numbers, mean", [([-1, -2, -2], -1), ([1, 2, 2], 1), ([None, 3], 3), ([None], None)])
def test_integer_average_cuts_towards_zero(spark, numbers, mean):
    df = spark.createDataFrame([(n,) for n in numbers], "n int")
    assert df.agg(X.int_avg("n")).first()[0] == mean


@pytest.mark.parametrize("number, text", [("2.5", "3"), ("3.5", "4"), ("1234567", "1,234,567"), ("0.4", "0")])
def test_plain_numbers(spark, number, text):
    assert value(spark, X.fmt_number, "decimal(18,2)", Decimal(number)) == text


@pytest.mark.parametrize(
    "number, text",
    [("1234567.5", "R$ 1.234.567,50"), ("0", "R$ 0,00"), ("-12.30", "-R$ 12,30"), (None, None)],
)
def test_currency(spark, number, text):
    assert value(spark, X.fmt_brl, "decimal(18,2)", number and Decimal(number)) == text


@pytest.mark.parametrize(
    "part, whole, digits, text", [(1, 8, 2, "12,50%"), (1, 3, 3, "33,333%"), (1, 1, 2, "100,00%"), (1, 1600, 2, "0,06%")]
)
def test_percent(spark, part, whole, digits, text):
    assert value(spark, lambda a, b: X.fmt_pct(a, b, digits), "bigint", part, whole) == text


@pytest.mark.parametrize(
    "part, whole, result",
    [("85209.95", 6, "14201.66"), ("0.05", 2, "0.03"), ("-0.05", 2, "-0.03"), ("1.00", 0, None), (None, 3, None)],
)
def test_rounded_ratio_keeps_halves(spark, part, whole, result):
    got = value(spark, X.rounded_ratio, ["decimal(18,2)", "bigint"], part and Decimal(part), whole)
    assert got == (result and Decimal(result))


def test_weekday_names(spark):
    assert value(spark, X.weekday, "timestamp_ntz", at(1, 0, 5)) == "Sunday"


@pytest.mark.parametrize("number, label", [(7, "A00007"), (99999, "A99999"), (100000, "A100000"), (1234567, "A1234567")])
def test_labels_never_lose_digits(spark, number, label):
    df = spark.createDataFrame([(number,)], "rn bigint")
    assert df.select(surrogate_label("A")).first()[0] == label


def test_spellings_are_merged_by_hash_before_their_least_is_found_by_sorting(spark):
    df = spark.createDataFrame([("a ", "x"), ("A", "X"), ("a ", "x"), (None, "x"), (None, "X ")], "a string, b string")
    grouped = X.group_folded(df, ["a", "b"])
    assert sorted(map(tuple, grouped.collect()), key=repr) == [("A", "X"), (None, "X ")]
    plan = grouped._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") == 2 and plan.rindex("HashAggregate") > plan.rindex("SortAggregate")
