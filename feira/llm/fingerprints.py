"""Document fingerprints: one-permutation MinHash, optimally densified, packed to four bits a bin."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import BLANKS, prepare, ranked, same, sha256_hex, table, text_or_empty
from feira.session import write_and_read

BIN_BITS = 8  # 256 bins
BINS = 1 << BIN_BITS
FIELD = 4  # low-order bits kept of a bin's value
WORDS = 5
BLANK_RUN = r"[\x20\x09-\x0D]+"
_EMPTY = (1 << 56) - 1  # the largest value of a bin, which stands for no shingle


def _walks() -> tuple[list[int], list[int], list[int]]:
    """Start, odd stride and the stride's inverse for the walk of each bin over all bins."""
    rng = random.Random(29)
    starts = [rng.randrange(BINS) for _ in range(BINS)]
    strides = [rng.randrange(1, BINS, 2) for _ in range(BINS)]
    return starts, strides, [pow(s, -1, BINS) for s in strides]


def _constant(values: list) -> Column:
    return F.array(*map(F.lit, values))


def _named(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: an array of one element lends it a name."""
    return F.transform(F.array(value), use)[0]


def _bins(text: Column) -> Column:
    """The least hash of each of the 256 bins, in order; bins without a shingle hold their largest value.

    Every shingle is hashed once: the upper byte is its bin, the rest competes within it. Hashes and one
    placeholder per bin are sorted, and the first of each bin stays.
    """
    words = F.array_remove(F.split(F.btrim(text, F.lit(BLANKS)), BLANK_RUN), "")
    fillers = _constant([((b - BINS // 2) << 56) | _EMPTY for b in range(BINS)])

    def shingles(h: Column) -> Column:
        # Behind the end there are nulls, which don't count; the runs that reach there are cut off.
        whole = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WORDS)]))
        return F.slice(whole, 1, F.least(F.greatest(F.size(h) - WORDS, F.lit(0)) + 1, F.size(h)))

    def firsts(s: Column) -> Column:
        # The first, and those whose upper byte is not that of the one before.
        return F.filter(s, lambda x, i: F.shiftright(F.coalesce(x.bitwiseXOR(F.get(s, i - 1)), F.lit(-1)), 56) != 0)

    hashed = _named(F.transform(words, lambda w: F.xxhash64(w)), shingles)
    return _named(F.sort_array(F.concat(hashed, fillers)), firsts)


def _low_bits(bins: Column) -> Column:
    """The low-order bits of every bin, empty bins filled by optimal densification; null where all are empty.

    Bin i walks over the bins start(i), start(i) + stride(i), ... with random start and odd stride, an order of
    all bins that is its own; the first full one lends its value. So two texts that agree on full bins
    agree on the filled ones. The first steps are looked up; where few bins are full, the place of each full
    bin in the walk is computed instead and the first is taken.
    """
    starts, strides, inverses = _walks()
    steps = [_constant([(a + s * j) % BINS for a, s in zip(starts, strides, strict=True)]) for j in range(6)]

    low = F.lit((1 << FIELD) - 1).cast("long")

    def fill(bits: Column) -> Column:
        full = F.filter(F.transform(bits, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())

        def filled(places: Column) -> Column:
            def value(x: Column, i: Column) -> Column:
                start, stride = F.get(_constant(starts), i), F.get(_constant(strides), i)
                inverse = F.get(_constant(inverses), i)
                first = F.array_min(F.transform(places, lambda b: F.pmod((b - start) * inverse, F.lit(BINS))))
                found = F.get(bits, F.pmod(start + stride * first, F.lit(BINS)))
                whole = F.coalesce(x, *[F.get(bits, F.get(step, i)) for step in steps], found)
                # Mixed with the bin, or all bins that borrow one value would agree by chance together.
                return F.when(F.size(places) > 0, F.xxhash64(whole, i).bitwiseAND(low).cast("int"))

            return F.transform(bits, value)

        return _named(full, filled)

    return _named(F.transform(bins, lambda x: F.when(x.bitwiseAND(F.lit(_EMPTY)) != _EMPTY, x)), fill)


def fingerprint(text: Column) -> Column:
    """256 hex digits, four bits of each bin; a text without words has all bits set."""
    digits = _constant(list("0123456789abcdef"))
    return F.array_join(
        F.transform(_low_bits(_bins(text)), lambda x: F.coalesce(F.get(digits, x), F.lit("f"))), ""
    )


def likeness(left: Column, right: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    Four bits agree by chance in one of sixteen cases; the share of equal fields is corrected for that bias.
    """

    def longs(digits: Column) -> Column:
        return F.transform(
            _constant(list(range(1, BINS, 8))), lambda k: F.conv(F.substring(digits, k, F.lit(8)), 16, 10).cast("long")
        )

    def unlike(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x11111111).cast("long"))
        return F.bit_count(x)

    total = F.aggregate(F.zip_with(longs(left), longs(right), unlike), F.lit(0), lambda acc, x: acc + x)
    chance = 1 / (1 << FIELD)
    share = 1 - total / BINS
    return F.greatest(F.lit(0.0), (share - chance) / (1 - chance))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and two likenesses.

    The edited text has its last quarter of code points (rounded down) replaced by as many from the start of
    the next document by ascending doc_id, or all it has; after the last comes the first.

    Shingles are five words in a row, words being runs without blanks as they are. Returns doc_id, n_chars,
    edited_sha256, fingerprint and edited_fingerprint (see ``fingerprint``), near_edited, near_next.

    * Null text counts as empty. Texts without words are alike (1.0) and unlike all others but by chance; a
      text of fewer than five words is one shingle.
    * A null doc_id comes last. Rows of one doc_id are ordered by their text; rows equal in doc_id and text
      are one document when the next is looked for, and each is a row of the result. A single document follows itself; an empty table gives no rows.
    * Other columns are not read.

    Only (id, text hash, length) rows are ranked to find each document's successor. The texts are shuffled
    once, by id; from there the next document's start, a quarter of a text at most, goes to the document
    that needs it. Every text is fingerprinted once as it is and once edited; the next document's fingerprint
    comes from the written result.
    """
    prepare(docs.sparkSession)
    key = F.xxhash64("text")
    docs = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_hash", key)
    names = docs.select("doc_id", "_hash", F.char_length("text").cast("long").alias("n"))
    names = names.groupBy("doc_id", "_hash").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    names = write_and_read(names, "names")
    repeated = bool(names.filter("times > 1").head(1))
    if repeated:
        docs = docs.dropDuplicates(["doc_id", "_hash"])
    numbered = names.withColumns({"_null": F.col("doc_id").isNull(), "_all": F.lit(0)})
    numbered = ranked(numbered, ["_all"], ["_null", "doc_id", "_hash"]).select(
        "doc_id", "_hash", "n", "times", "_rank"
    )
    numbered = write_and_read(numbered, "numbered")
    count = numbered.count()
    # To each document goes the one before it, and how much of its start that one needs.
    before = numbered.select(
        (F.col("_rank") % count + 1).alias("_rank"),
        F.col("doc_id").alias("_to"),
        F.col("_hash").alias("_to_hash"),
        F.col("_rank").alias("_to_rank"),
        F.floor(F.col("n") / 4).cast("int").alias("_need"),
    )
    wanted = numbered.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_id_hash"), "_rank").join(before, "_rank")
    wanted = write_and_read(wanted.drop("_rank"), "wanted")
    texts = docs.join(wanted, same([F.col("doc_id"), F.col("_hash")], [F.col("_id"), F.col("_id_hash")]))
    starts = texts.select(
        "_to", "_to_hash", F.col("_to_rank").alias("_rank"), F.substring("text", F.lit(1), F.col("_need")).alias("_start")
    )
    # Joined by id again, so the shuffled texts serve both joins.
    both = docs.join(starts, same([F.col("doc_id"), F.col("_hash")], [F.col("_to"), F.col("_to_hash")]))
    length = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), length - F.floor(length / 4).cast("int")), F.col("_start"))
    both = both.select("doc_id", "_rank", "text", length.cast("long").alias("n_chars"), edited.alias("edited"))
    made = both.select(
        "doc_id",
        "_rank",
        "n_chars",
        sha256_hex(F.col("edited")).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
    )
    made = write_and_read(made, "fingerprints")
    following = made.select((F.when(F.col("_rank") == 1, count).otherwise(F.col("_rank") - 1)).alias("_rank"), F.col("fingerprint").alias("_next"))
    both = made.join(following, "_rank")
    if repeated:
        both = both.join(numbered.select("_rank", "times"), "_rank")
        both = both.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))
