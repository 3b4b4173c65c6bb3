"""Cleaning steps as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feira.functions.exprs import folded


def enrich(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Fill ``column`` from ``lookup`` by ``key``, keeping the old value (or NULL) where nothing matches.

    ``lookup`` has one row per key.
    """
    found = lookup.select(key, F.col(column).alias("__found"))
    joined = df.join(found, key, "left")
    value = F.coalesce("__found", column) if column in df.columns else F.col("__found")
    kept = [F.col(c) for c in df.columns if c != column]
    return joined.select(*kept, value.alias(column))


def not_broadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and merged, whatever size Spark expects it to have.

    For tables that grow with the data and whose rows come from fewer ones: Spark does not count how many rows
    an explode makes, so it would send a table many times its limit through the driver.
    """
    return df.hint("merge")


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(how="all", subset=list(columns))


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per ``keys``: the one lowest in ``order``, NULL lowest of all.

    An aggregate instead of a ranking window: copies collapse before the shuffle, so a group that
    holds a large part of the table reaches its reducer as a few rows. Nothing is
    sorted where ``keys`` and ``order`` are all columns; with others, Spark sorts to aggregate the rows.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    if not rest:
        lowest = F.when(F.count(order) == F.count(F.lit(1)), F.min(order))
        return df.groupBy(*keys).agg(lowest.alias(order)).select(*df.columns)
    row = F.min(F.struct(order, *rest)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*").select(*df.columns)


def duplicates(df: DataFrame, columns: Sequence[str], count: str = "duplicate_count") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(count)).where(F.col(count) > 1)


def to_dates(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.to_date(c) for c in columns})


def to_seconds(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_trunc("second", F.col(c)).cast("timestamp_ntz") for c in columns})


def to_money(df: DataFrame, *columns: str) -> DataFrame:
    """Two decimals, halves away from zero; the cast itself rounds."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in columns})


def recode(column: str, old: str, new: str) -> Column:
    """``new`` where the text is ``old``, case and trailing blanks aside."""
    return F.when(folded(column) == old.lower().rstrip(" "), new).otherwise(F.col(column))


def translate_text(df: DataFrame, lookup: DataFrame, text: str, target: str, ids: Sequence[str] = ()) -> DataFrame:
    """Attach ``lookup.column2`` where ``lookup.column1`` equals ``text``, case and trailing blanks aside.

    Digests of the folded texts stand in for the texts in the shuffle. The lookup shrinks to one row per text; grouping it
    by the length as well keeps that grouping's partitioning from serving the join, so both join inputs
    are plain shuffles and a message shared by very many rows can be split at run time. Rows without a text
    find nothing: they are dealt out by their ``ids``, as a null would bring them all to one task.
    """
    digest = lambda c: F.sha2(folded(c), 256)
    one_each = (
        lookup.where(F.col("column1").isNotNull())
        .select(digest("column1").alias("__digest"), F.length(folded("column1")).alias("__length"), "column2")
        .groupBy("__digest", "__length")
        .agg(F.min("column2").alias(target))
        .select("__digest", target)
    )
    none = [F.concat(F.lit("-"), F.xxhash64(*ids).cast("string"))] if ids else []  # no digest begins with -
    return df.withColumn("__digest", F.coalesce(digest(text), *none)).join(one_each, "__digest", "left").drop("__digest")


def literal_rows(spark: SparkSession, rows: Iterable[tuple], fields: StructType) -> DataFrame:
    """A few constant rows as part of the plan itself."""
    structs = [
        F.struct(*[F.lit(value).cast(f.dataType).alias(f.name) for value, f in zip(row, fields)]) for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def append_rows(df: DataFrame, rows: Iterable[tuple], columns: list[str]) -> DataFrame:
    """Add literal rows; columns that are not named become NULL."""
    extra = literal_rows(df.sparkSession, rows, StructType([df.schema[c] for c in columns]))
    return df.unionByName(extra, allowMissingColumns=True)
