"""The registered queries on the given tables: against SQL where there is any, and the plans of the native ones."""

import os

import duckdb
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from feira.llm import registry

KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
NATIVE = ["op2_source_mixing", "op5_document_fingerprints", "op6_line_dedup", "op8_chat_tool_calls"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(name, spark, folder):
    df = registry.QUERIES[name](spark, folder)
    duck = duckdb.connect()
    for file in os.listdir(folder):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    expected = duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(expected.columns, map(str, expected.types), strict=True))
    places = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in places) for r in expected.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == want and got
    duck.close()


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python_and_pair_no_rows_at_large(name, spark, folder, monkeypatch):
    """In any of their plans, those of the tables written on the way included."""
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    df = registry.QUERIES[name](spark, folder)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin", "SerializeFromObject", "Exchange SinglePartition, REPARTITION"):
            assert node not in plan, node


def test_every_operator_is_registered():
    assert [int(name[2:].split("_")[0]) for name in registry.QUERIES] == list(range(1, 14))
