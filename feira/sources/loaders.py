"""Readers and writers: source tables, dictionaries, literal rows, views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from feira import schema
from feira.tables import RawTables


# Tables whose values may hold line breaks: as CSV, a file of them is one task. Files of other tables are split.
MULTI_LINE = ("reviews", "review_translation")


def read_table(
    spark: SparkSession, path: str, fields: StructType, fmt: str = "parquet", multi_line: bool = True
) -> DataFrame:
    """Read one table with a fixed schema; nothing is inferred from the data."""
    if fmt == "csv":
        return read_csv(spark, path, fields, multi_line=multi_line)
    return spark.read.schema(fields).format(fmt).load(path)


def read_csv(
    spark: SparkSession, path: str, fields: StructType, header: bool = True, multi_line: bool = True
) -> DataFrame:
    """Quoted UTF-8 CSV. The given schema keeps a byte-order mark out of the first column's name.

    With ``multi_line`` values may hold line breaks, and a file is one task; without it files are split.
    """
    return spark.read.schema(fields).csv(
        path, header=header, quote='"', escape='"', multiLine=multi_line, encoding="UTF-8", enforceSchema=True
    )


def read_headerless_csv(spark: SparkSession, path: str, fields: StructType, multi_line: bool = True) -> DataFrame:
    """A file without column names: its first line is a row like any other. Files are split without ``multi_line``."""
    return read_csv(spark, path, fields, header=False, multi_line=multi_line)


def load_tables(
    spark: SparkSession, folder: str, fmt: str = "parquet", names: Mapping[str, str] | None = None
) -> RawTables:
    """All source tables from ``folder/<name>``; ``names`` maps a table to another file name."""
    names = names or {}
    suffix = ".csv" if fmt == "csv" else ""
    return RawTables(
        **{
            table: read_table(spark, f"{folder}/{names.get(table, table + suffix)}", fields, fmt, table in MULTI_LINE)
            for table, fields in schema.TABLES.items()
        }
    )


def save(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write ``df``; with ``partition_by`` in a folder for each value, its rows dealt out by it first."""
    writer = (df.hint("rebalance", partition_by) if partition_by else df).write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def save_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Write ``df`` as ``read_csv`` reads it: quoted where needed, blanks kept as they are."""
    df.write.mode("overwrite").csv(
        path, header=header, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def save_tables(raw: RawTables, folder: str) -> None:
    """Write all source tables where ``load_tables`` finds them."""
    for name in schema.TABLES:
        save(getattr(raw, name), f"{folder}/{name}")


def register_views(frames: Mapping[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
