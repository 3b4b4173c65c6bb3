"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import n_words, prepare, ranked, shielded, table, text_or_empty
from feira.session import write_and_read

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
OFFSET_STEPS = 1 << 20


def offset(source: Column) -> Column:
    """The random start of a source: fixed by its name, a multiple of 2**-20 below 1."""
    name = F.coalesce(source, F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(name), 1, 5), 16, 10).cast("double") / OFFSET_STEPS


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target size by source from (source, source_size); one row per source goes in and out.

    Weights go round the sources by code point, null last. A target stops at ``most`` times its source's
    size; what is above is shared again by weight until none is above. Each round is one aggregate over
    the sources, of which two numbers reach the driver.
    """
    by_name = sizes.withColumn("_null", F.col("source").isNull()).withColumn("_all", F.lit(0))
    numbered = ranked(by_name, ["_all"], ["_null", "source"]).select(
        "source",
        "source_size",
        F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int"))
        .cast("double")
        .alias("weight"),
    )
    numbered = write_and_read(numbered, "weights")
    limit = most * F.col("source_size")
    whole = numbered.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, stopped, before = None, F.lit(False), 0
    while True:
        taken, weight, count = numbered.agg(
            F.coalesce(F.sum(F.when(stopped, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(stopped, 1)),
        ).first()
        if share is not None and count == before:
            break
        share, before = (whole - taken) / weight if weight else share or 0.0, count
        # The share only grows, so what was stopped once stays below it.
        stopped = limit < F.col("weight") * F.lit(share)
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(share))
    return numbered.select("source", "source_size", "weight", target.alias("target"))


def with_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size`` and what orders rows of one size: a shuffle of the ids, then the text's hash."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumns(
        {"size": n_words(text_or_empty()), "_shuffled": F.md5(name.cast("binary")), "_text": F.xxhash64("text")}
    )


def copies(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The result of ``mix`` from rows that went through ``with_sizes``; they need no text any more."""
    names = [c for c in rows.columns if c not in ("_shuffled", "_text")]
    sizes = write_and_read(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    goals = write_and_read(targets(sizes, weights, most), "targets")
    both = F.explode(F.array(F.lit(True), F.lit(False))).alias("_empty")
    goals = goals.select("source", "source_size", "target", both)
    laid = ranked(
        rows.withColumn("_empty", F.col("size") == 0), ["source", "_empty"], ["size", "_shuffled", "_text"], goals
    )
    rate, start = F.col("target") / F.col("source_size"), offset(F.col("source"))
    crossed = F.floor(F.col("_rank") * rate + start) - F.floor((F.col("_rank") - 1) * rate + start)
    taken = F.when(F.col("_empty"), 0).otherwise(F.least(crossed, F.lit(most))).cast("long")
    return laid.select(*names, "source_size", "target", taken.alias("copies"))


@shielded
def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``copies`` (times the mix takes the row).

    Within a source every document with words has the same expected number of copies, target over source
    size. Documents are laid in a row by size, their expected copies are summed up from the front, and with
    one random offset a document is taken once for each whole number that the sum crosses at it. As
    neighbours have like sizes, the words taken stay within about one document of the target.

    * Null text counts as empty. Documents without words take no part: ``copies`` is 0.
    * A null source is a source of its own, the last.
    * Repeated rows are documents of their own. Among rows equal in source, size, id and text it is open
      which one is taken.
    * Other columns are passed on; result columns replace columns of their names.

    A document's sum is its rank times the rate, so it does not depend on how rows are spread over tasks.
    """
    prepare(docs.sparkSession)
    return copies(with_sizes(docs.drop("size", "source_size", "target", "copies")), weights, most)


def emit(mixed: DataFrame) -> DataFrame:
    """Each row once per copy, numbered in ``copy``; rows without copies go."""
    numbers = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return mixed.filter("copies > 0").withColumn("copy", F.explode(numbers))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    # The words are counted once; the steps after that read ids and sizes only.
    rows = write_and_read(with_sizes(docs).drop("text"), "sizes")
    taken = F.col("copies") * F.col("size")
    return copies(rows).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sources
), filled AS (
  SELECT *, coalesce(sum(3 * source_size) OVER w, 0)::BIGINT AS stopped, coalesce(sum(weight) OVER w, 0) AS spent,
         sum(source_size) OVER () AS whole, sum(weight) OVER () AS weights,
         row_number() OVER (ORDER BY 3 * source_size / weight, source) AS place
  FROM weighed
  WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((whole - stopped)::DOUBLE / (weights - spent), place) FILTER (
    WHERE 3 * source_size >= weight * ((whole - stopped)::DOUBLE / (weights - spent))) AS share FROM filled
), goals AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * coalesce(share, 0)) AS target FROM weighed, level
), laid AS (
  SELECT s.*, g.source_size, g.target,
         row_number() OVER (PARTITION BY s.source, s.size = 0 ORDER BY s.size, md5(coalesce(s.doc_id::VARCHAR, ''))) AS k,
         ('0x' || substr(md5(coalesce(s.source, '')), 1, 5))::BIGINT::DOUBLE / 1048576 AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, c * size AS taken, c AS copies FROM (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(3, floor(k * (target / source_size) + start)
    - floor((k - 1) * (target / source_size) + start))::BIGINT END AS c FROM laid)
"""
