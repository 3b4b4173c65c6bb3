"""Every registered query against its SQL text in another engine, on the same files."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracles import all_oracles

NAMES = sorted(set(entry.queries()) & set(all_oracles()))
# Rightly empty on these tables.
EMPTY = {"repeat_by_customer_key"}
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    text_operators = {n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()} | {"pipeline"}
    assert set(entry.queries()) - text_operators == set(NAMES) == set(all_oracles())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(name, spark, folder, duck):
    df = entry.queries()[name](spark, folder)
    expected = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds

    def ordered(rows, names):
        return sorted((tuple(r[names.index(c)] for c in columns) for r in rows), key=repr)

    found = df.collect()
    assert ordered(found, df.columns) == ordered(expected.fetchall(), expected.columns)
    assert found or name in EMPTY


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
