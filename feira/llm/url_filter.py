"""URL filter: rules by host and path, then host words from unigram Viterbi under multinomial naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import ascii_lower, prepare, table
from feira.session import write_and_read

# Rules (host and path, verdict): fixed values.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Words that make a host an example of what to block; the rest of what marks such hosts is learnt.
SEEDS = ("adult", "bet", "bets", "casino", "pills", "poker", "porn", "spam", "xxx")
LONGEST_WORD = 20


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def pieces(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(ascii_lower(text), F.lit("([a-z]+)"), 1)


def unigrams(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(word, n): words in the pages' visible text, and pieces of host labels that are hyphenated."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<(script|style).*?</\1>|<[^>]*>|&[a-z#0-9]+;", " ")
    text = pages.select(F.explode(pieces(bare)).alias("word"))
    labels = hosts.select(F.explode(F.split("host", r"\.")).alias("label")).filter(F.col("label").contains("-"))
    both = text.union(labels.select(F.explode(pieces(F.col("label")))))
    return both.filter(F.length("word").between(2, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def segment(piece: str, words: dict[str, int], total: int) -> list[str]:
    """The likeliest split into words under unigram probabilities, found by dynamic programming.

    An unknown stretch of k letters counts as ten words' worth of mass spread over 10**k spellings.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    unknown = math.log(10 / max(total, 1))
    for end in range(1, len(piece) + 1):
        choices = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = words.get(piece[start:end])
            score = math.log(n / total) if n else unknown - (end - start) * math.log(10)
            choices.append((best[start][0] + score, start))
        best.append(max(choices))
    out, end = [], len(piece)
    while end:
        start = best[end][1]
        out.append(piece[start:end])
        end = start
    return out[::-1]


def segments(names: DataFrame, words: DataFrame) -> DataFrame:
    """(piece, words) for distinct pieces; the vocabulary is joined by substring, never sent whole to a task."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    starts = F.sequence(F.lit(1), F.length("piece"))
    lengths = F.sequence(F.lit(2), F.lit(LONGEST_WORD))
    parts = F.array_distinct(
        F.flatten(F.transform(starts, lambda i: F.transform(lengths, lambda k: F.substring(F.col("piece"), i, k))))
    )
    known = names.select("piece", F.explode(parts).alias("word")).join(words, "word")
    known = known.groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch, found in rows:
            out = []
            for piece, known in zip(batch, found, strict=True):
                counts = {k["word"]: k["n"] for k in known} if known is not None else {}
                out.append(segment(piece, counts, total))
            yield pd.Series(out)

    return names.join(known, "piece", "left").select("piece", split("piece", "known").alias("words"))


def judge(pages: DataFrame, rules: tuple = RULES, seeds: tuple = SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url, html).

    The verdict is the longest rule's; where none fits, naive Bayes decides: block where the log-odds
    ``score`` is above 0. Its tokens are the words of the host and of the path, kept apart; host names
    run together are split into words first. Rows whose host has a seed word as a delimited piece are its
    examples of class block, all others those of allow, so a host that only reads like them is judged by the words
    that it shares. Counts are over all rows.

    * A url that is null or has no ``://`` has an empty host and path and is judged by the class odds.
    * Repeated rows and repeated ids are judged each by itself and count as examples each. An empty table
      gives no rows. Other columns are not read.

    Distinct pieces are segmented once. Word weights meet the rows in a join by token with plain shuffles on
    both sides, which is split where a token is hot; nothing that grows is broadcast or collected.
    """
    prepare(pages.sparkSession)
    url = F.coalesce("url", F.lit(""))
    known = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumns(
        {"_rule": rule_of(F.col("host"), F.col("path"), rules), "_row": F.monotonically_increasing_id()}
    )
    seeded = F.arrays_overlap(pieces(F.col("host")), F.array(*map(F.lit, seeds)))
    rows = write_and_read(known.select("*", seeded.alias("_block")), "urls")

    def parts_of(column: str) -> Column:
        return F.transform(pieces(F.col(column)), lambda p: F.struct(F.lit(column).alias("kind"), p.alias("piece")))

    parts = F.concat(parts_of("host"), parts_of("path"))
    named = write_and_read(rows.select("_row", "_block", F.explode(parts).alias("p")).select("_row", "_block", "p.*"), "pieces")
    words = write_and_read(unigrams(pages, rows.select("host").distinct()), "unigrams")
    split = write_and_read(segments(named.select("piece").distinct(), words), "segments")
    tokens = named.join(split, "piece").select(
        "_row", "_block", F.explode("words").alias("word"), "kind"
    )
    tokens = tokens.select("_row", "_block", F.concat_ws(":", "kind", "word").alias("token"))
    tokens = write_and_read(tokens, "tokens")

    flag = F.col("_block").cast("long")
    counts = tokens.groupBy("token").agg(F.sum(flag).alias("block"), F.sum(1 - flag).alias("allow"))
    counts = write_and_read(counts, "token-counts")
    vocabulary, block, allow = counts.agg(
        F.count("*"), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))
    ).first()
    n_block, n_all = rows.agg(F.coalesce(F.sum(flag), F.lit(0)), F.count("*")).first()
    odds = math.log((n_block + 1) / (n_all - n_block + 1))
    weight = F.log((F.col("block") + 1) / (block + vocabulary)) - F.log((F.col("allow") + 1) / (allow + vocabulary))
    weights = write_and_read(counts.select("token", weight.alias("weight")), "token-weights")
    scores = tokens.join(weights, "token").groupBy("_row").agg(F.sum("weight").alias("_sum"))
    out = rows.join(scores, "_row", "left").withColumn("score", F.lit(odds) + F.coalesce("_sum", F.lit(0.0)))
    learnt = F.when(F.col("score") > 0, "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learnt).alias("verdict"), "score"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"))
