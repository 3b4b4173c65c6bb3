"""Dense surrogate keys: ids numbered 1..n in id order, without one task ever seeing them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.session import write_and_read

LABEL_DIGITS = 5
ROW_BITS = 33  # monotonically_increasing_id keeps the row's place within its partition in the low bits


def distinct_ids(column: str, *frames: DataFrame) -> DataFrame:
    """The set union of ``column`` over several tables; repeats combine before the shuffle."""
    return reduce(DataFrame.unionAll, [f.select(column) for f in frames]).distinct()


def dense_numbers(ids: DataFrame, column: str, number: str = "rn") -> DataFrame:
    """``row_number() over (order by column)`` over distinct ids, as a distributed job.

    Range partitions hold consecutive ids, so a row's number is the count of rows in earlier
    partitions plus its place in its own. The places are written out before anything is counted:
    range bounds come from a sample and could move if the shuffle ran a second time.
    """
    place = F.monotonically_increasing_id()
    placed = write_and_read(
        ids.repartitionByRange(column).sortWithinPartitions(column).select(column, place.alias("place")),
        f"placed-{column}",
    ).select(
        column,
        F.shiftright("place", ROW_BITS).alias("part"),
        F.col("place").bitwiseAND((1 << ROW_BITS) - 1).alias("idx"),
    )
    # One row per shuffle partition, however many ids there are: safe to sum in one task and to broadcast.
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "part").select(column, (F.col("offset") + F.col("idx") + 1).alias(number))


def surrogate_label(prefix: str, number: str = "rn"):
    """``A00007``; wider numbers keep all their digits, so labels never collide."""
    digits = F.col(number).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(LABEL_DIGITS)), F.lit("0")))


def build_mapping(column: str, prefix: str, *frames: DataFrame) -> DataFrame:
    """(id, id_values) over the union of ids in ``frames``, written to the shared folder."""
    numbered = dense_numbers(distinct_ids(column, *frames), column)
    return write_and_read(
        numbered.select(column, surrogate_label(prefix).alias(f"{column}_values")), f"mapping-{column}"
    )
