"""A corpus made ready for training: five stages, each written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm import decontaminate, line_dedup, mixing, near_join, quality
from feira.llm.common import table
from feira.session import write_and_read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; all of them where there is nothing to fit it on.

    Null and empty texts are judged like any other, repeated rows alike; no documents give none. The caller's
    columns are kept, whatever their names.
    """
    labels = table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels)
    if not net.fitted:
        return docs
    row = docs.select("text", F.struct("*").alias("row"))
    return quality.score(row, net).filter(F.col("score") >= quality.CUT).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows the text.

    Null text becomes empty. Rows of one id count as one document; each stays a row. No documents give none.
    """
    kept = line_dedup.line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies; documents that have lost all their lines are one class.

    Of rows equal in id and text any one stays; a null id comes after all others. No documents give none.
    """
    return near_join.one_per_class(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, up to one edit in ten characters.

    Null and empty texts hold none, nor does an empty benchmark drop anything. Repeated rows go or stay together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document once per copy taken, numbered in ``copy``.

    Documents without words take no part. Repeated rows are documents of their own, a null source is one of
    its own; no documents give none.
    """
    mixed = mixing.emit(mixing.mix(docs))
    return mixed.select(*docs.columns, "copy")


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

# The stages that learn, hash and embed have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
