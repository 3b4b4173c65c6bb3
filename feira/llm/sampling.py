"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm.common import held_out


def spread(column: str) -> Column:
    """A fixed shuffle of the ids."""
    return F.xxhash64(F.lit(11), column)


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the ids that may be learnt from; an id labelled both ways counts as 1."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max(label).alias("label"))


def sample(ids: DataFrame, most: int) -> DataFrame:
    """``most`` rows at the most, the same in every run: those whose ids come first in a fixed shuffle."""
    return ids.orderBy(spread("doc_id"), "doc_id").limit(most)
