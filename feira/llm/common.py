"""Helpers shared by the operators: tables, text expressions, distributed ranks."""

from __future__ import annotations

import functools
import os
import string
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feira.operators.keys import ROW_BITS
from feira.session import configure, write_and_read

BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
HELD_OUT_OF, HELD_OUT = 4, 2

# Arrow batches are kept small enough that a batch of very long texts fits beside the others.
ARROW_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # Python workers look for this package where the driver found it, if it isn't installed for them.
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is: ``lower`` would also fold other letters, so it serves pure ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def n_words(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed, carriage return."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents whose labels are never learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(True))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, bit by bit."""
    byte = f"ascii(substr({text}, CAST(k // 8 + 1 AS INTEGER), 1))"
    bits = f"list_transform(range(8 * length({text})), lambda k: CAST(({byte} >> CAST(k % 8 AS INTEGER)) & 1 AS BIGINT))"
    step = "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), {step}), 4294967295)"


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose own columns begin with an underscore, made safe for callers' columns that do so, too.

    Those go through it under other names and get theirs back.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        taken, away = set(docs.columns), {}
        for c in docs.columns:
            if c.startswith("_"):
                away[c] = next(n for n in (f"caller{i}{c}" for i in range(len(taken) + 1)) if n not in taken)
                taken.add(away[c])
        if not away:
            return operator(docs, *args, **options)
        out = operator(docs.withColumnsRenamed(away), *args, **options)
        return out.withColumnsRenamed({v: k for k, v in away.items()})

    return run


def same(left: list[Column], right: list[Column]) -> Column:
    """Equality by position that also pairs null with null."""
    test = left[0].eqNullSafe(right[0])
    for a, b in zip(left[1:], right[1:], strict=True):
        test = test & a.eqNullSafe(b)
    return test


def ranked(df: DataFrame, group: list[str], order: list[str], extra: DataFrame | None = None) -> DataFrame:
    """``df`` with ``_rank``: its place, from 1, in its group by ``order``; no task sees a whole group.

    Rows are range-partitioned by group and order, so a large group spreads over many partitions. Their
    places are written out; a row's rank is then its place less that of the first row of its group in the
    partition, plus the rows that the group has in earlier partitions. The table of these bases has one
    row per partition and group; ``extra`` (one row per group) is joined to it instead of to the rows.
    Rows equal in group and order are ranked in any order.
    """
    keys = [*group, *order]
    placed = write_and_read(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("_part", F.shiftright("_place", ROW_BITS))
    sizes = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(
        F.col("_part").alias("_base_part"),
        *[F.col(g).alias(f"_base_{g}") for g in group],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"),
    )
    if extra is not None:
        values = [c for c in extra.columns if c not in group]
        renamed = extra.select(*[F.col(g).alias(f"_extra_{g}") for g in group], *values)
        base = base.join(renamed, same([F.col(f"_base_{g}") for g in group], [F.col(f"_extra_{g}") for g in group]))
        base = base.drop(*[f"_extra_{g}" for g in group])
    base = write_and_read(base, "bases")
    left = [F.col("_part"), *[F.col(g) for g in group]]
    right = [F.col("_base_part"), *[F.col(f"_base_{g}") for g in group]]
    out = placed.join(base, same(left, right)).withColumn("_rank", F.col("_place") + F.col("_base"))
    return out.drop("_place", "_part", "_base_part", "_base", *[f"_base_{g}" for g in group])
