"""Line dedup: lines found in many documents go, everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import BLANKS, ascii_lower, prepare, same, sha256_hex, shielded, table, text_or_empty
from feira.session import write_and_read


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _digest(line: Column, min_chars: int) -> Column:
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key.cast("binary"))))


@shielded
def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` less its frequent lines, and ``n_lines`` (before), ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and is found in at least ``min_docs`` distinct
    documents is dropped from every document; the others stay in their order, joined by line feeds.

    * Null or empty text is one empty line; the result's text is never null.
    * Rows of one ``doc_id`` (null is an id, too) are one document when documents are counted; each row
      stays a row of the result.
    * Other columns are passed on; ``n_lines`` and ``n_dropped`` replace columns of these names.

    Lines travel as 128-bit digests. Documents per key are counted with two partial aggregations, so a
    line found everywhere costs one row per task; the frequent keys are written, and the join that marks
    the lines has plain shuffles on both sides, which adaptive execution splits where a key is hot.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped").withColumn("text", text_or_empty())
    row = F.xxhash64("text")
    pieces = F.transform(F.split("text", "\n"), lambda x: _digest(x, min_chars))
    lines = docs.select("doc_id", row.alias("_row"), F.posexplode(pieces).alias("_pos", "_key")).filter("_key is not null")
    frequent = (
        lines.groupBy("_key").agg(F.count_distinct(F.struct("doc_id")).alias("_n")).filter(F.col("_n") >= min_docs)
    )
    frequent = write_and_read(frequent.select("_key"), "frequent-lines")
    dropped = (
        lines.join(frequent, "_key", "left_semi")
        .groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_id_row"))
        .agg(F.collect_set("_pos").alias("_dropped"))
    )
    found = docs.withColumn("_row", row).join(
        dropped, same([F.col("doc_id"), F.col("_row")], [F.col("_id"), F.col("_id_row")]), "left"
    )
    pieces = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("_dropped"))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(pieces, i)), "\n")
    )
    counts = {"n_lines": F.size(pieces).cast("long"), "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)).cast("long")}
    counts["n_dropped"] = F.when(F.col("_dropped").isNull(), F.lit(0).cast("long")).otherwise(counts["n_dropped"])
    return found.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        *[c.alias(name) for name, c in counts.items()],
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines
), frequent AS (
  SELECT line_key FROM keyed WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.doc_id, k.line, k.pos, f.line_key IS NOT NULL AS gone
  FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
