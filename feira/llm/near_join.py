"""N-gram Jaccard join: MinHash bands find pairs of texts, full shingle sets verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import prepare, ranked, table
from feira.llm.components import components, extended
from feira.session import write_and_read

THRESHOLD = 0.8
RECALL = 0.999
ROWS = 8
BITS = 1024  # bits that a text's shingles set, to rule pairs out
PIVOTS = 2  # more texts of a bucket's largest class that the others are compared with before all are
BLOCK = 128  # texts of a class that are compared with as many others at once
COLUMNS = 4096  # shingles that are counted at once
CACHED = 32 << 20  # bytes of texts and shingle sets that a verifying task keeps


def band_count(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed so that a pair at the threshold shares one with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _signer(bands: int, rows: int, shingle_words: int):
    @F.pandas_udf("digest binary, bands array<long>, bits array<long>, count long")
    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        from feira.llm.shingles import band_hashes, bitmap, minhash, shingles, words

        for batch in texts:
            out = []
            for text in batch:
                tokens = words(text)
                grams = shingles(tokens, shingle_words)
                digest = xxhash.xxh3_128_digest(b" ".join(tokens))
                out.append((digest, band_hashes(minhash(grams, bands * rows), bands), bitmap(grams, BITS), len(grams)))
            yield pd.DataFrame(out, columns=["digest", "bands", "bits", "count"])

    return sign


def _verifier(shingle_words: int):
    @F.pandas_udf("double")
    def verify(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from feira.llm.shingles import shingles, similarity, words

        known, size = {}, 0

        def shingle_set(text):
            nonlocal size
            if text not in known:
                if size > CACHED:
                    known.clear()
                    size = 0
                known[text] = shingles(words(text), shingle_words)
                size += len(text or "") * 4 + known[text].nbytes
            return known[text]

        for left, right in pairs:
            yield pd.Series([similarity(shingle_set(a), shingle_set(b)) for a, b in zip(left, right, strict=True)])

    return verify


def _linker(threshold: float, shingle_words: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        """(node, n_links, linked, similarity) of the texts of one block or of two, which have a side each."""
        from feira.llm.shingles import shingles, words

        sets = [shingles(words(text), shingle_words) for text in rows.text]
        sizes = np.array([len(s) for s in sets])
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[place] > 1  # a shingle of one text only is common to none
        number = (np.cumsum(times > 1) - 1)[place[shared]]
        order = np.argsort(number, kind="stable")
        number, owner = number[order], np.repeat(np.arange(len(sets)), sizes)[shared][order]
        common = np.zeros((len(sets), len(sets)))
        for at in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
            low, high = np.searchsorted(number, [at, at + COLUMNS])
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[owner[low:high], number[low:high] - at] = 1
            common += has @ has.T
        similarity = common / np.maximum(sizes[:, None] + sizes - common, 1)
        side, node = rows.side.to_numpy(), rows.node.to_numpy()
        others = side[:, None] != side if side.any() else ~np.eye(len(sets), dtype=bool)
        similarity[~(others & (similarity >= threshold))] = -1
        best = similarity.max(axis=1)
        linked = np.where(similarity == best[:, None], node, np.iinfo(np.int64).max).min(axis=1)
        out = pd.DataFrame({"node": node, "n_links": (similarity >= 0).sum(axis=1), "linked": linked, "similarity": best})
        return out[out.n_links > 0]

    return links


def possible(threshold: float, left: str = "", right: str = "other_") -> Column:
    """Whether two shingle sets can reach the similarity, from their sizes and the bits that they set; never wrongly false.

    A bit that only one set has set stands for a shingle at least that the other lacks.
    """
    alone = [F.lit(0), F.lit(0)]
    for i in range(BITS // 64):
        x, y = F.col(f"{left}bits")[i], F.col(f"{right}bits")[i]
        alone = [alone[0] + F.bit_count(x.bitwiseAND(F.bitwise_not(y))), alone[1] + F.bit_count(y.bitwiseAND(F.bitwise_not(x)))]
    m, n = F.col(f"{left}count"), F.col(f"{right}count")
    return F.least(m - alone[0], n - alone[1]) * (1 + threshold) >= (m + n) * threshold - 1e-6


class NearJoin:
    """The join over one table; its parts are written to the shared folder as they are needed."""

    def __init__(
        self,
        docs: DataFrame,
        threshold: float = THRESHOLD,
        recall: float = RECALL,
        rows: int = ROWS,
        shingle_words: int = 5,
    ):
        prepare(docs.sparkSession)
        self.threshold, self.shingle_words = threshold, shingle_words
        bands = band_count(threshold, recall, rows)
        # The caller's row travels as one column, so its names meet none of the join's.
        signed = docs.select(F.struct("*").alias("doc"), _signer(bands, rows, shingle_words)("text").alias("signed"))
        signed = signed.select("doc", "signed.*").withColumn("row", F.monotonically_increasing_id())
        # Hashed once and written: later steps read the columns they need, and row numbers stay fixed.
        self.signed = write_and_read(signed, "signed")
        self.texts = self._texts()
        self.links, self.classes = self._join()

    def _texts(self) -> DataFrame:
        """(text_digest, node): one row per different text; its node is the first of its rows by id."""
        first = F.min(F.struct(F.col("doc.doc_id").isNull(), "doc.doc_id", "row"))
        texts = self.signed.groupBy(F.col("digest").alias("text_digest")).agg(first["row"].alias("node"))
        return write_and_read(texts, "texts")

    def _members(self) -> DataFrame:
        """(bucket, node, leader) for the buckets with two texts at least.

        Buckets are first looked at by row, with a mark of its text, so that no row's bands are moved as a whole, and only
        rows that share a bucket with another text get their node. Two texts have one mark with a chance of 2 ** -64.

        The leader is the text with the least mark, so texts that share many buckets share one leader, and a
        group of n near copies has about n different pairs with leaders.
        """
        bucket = F.explode("bands").alias("bucket")
        marks = self.signed.select(F.xxhash64("digest").alias("mark"), bucket)
        marks = marks.groupBy("bucket").agg(F.min("mark").alias("mark"), F.max("mark").alias("most")).filter("mark <> most")
        marked = self.texts.select(F.xxhash64("text_digest").alias("mark"), F.col("node").alias("leader"))
        leaders = write_and_read(marks.join(marked, "mark").select("bucket", "leader"), "leaders")
        rows = write_and_read(self.signed.select("row", bucket).join(leaders, "bucket"), "bucketed-rows")
        named = self.signed.select("row", F.col("digest").alias("text_digest")).join(self.texts, "text_digest").select("row", "node")
        return write_and_read(rows.join(named, "row").select("bucket", "node", "leader").distinct(), "bucketed")

    def _join(self) -> tuple[DataFrame, DataFrame]:
        """Verified links, and the classes they make.

        A pair that shares a bucket is verified unless its texts are in one class already: first all with
        their bucket's leader, then those outside a bucket's largest class with other texts of that, and
        what is then still apart with all that is apart from it.
        """
        members = self._members()
        self.attributes = self._attributes(members)
        stars = _pairs(members.filter("node <> leader"), "node", "leader").distinct()
        links = self._verified(self._possible(stars))
        classes, apart = components(links), members.select("bucket", "node")
        for turn in range(PIVOTS + 1):
            apart = self._apart(apart, classes)
            if not apart.head(1):
                break
            more = self._verified(self._possible(self._with_pivots(apart, turn)) if turn < PIVOTS else self._all_apart(apart))
            links, classes = links.union(more), extended(classes, more.select("a", "b"))
        return links, classes

    def _apart(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """(bucket, node, component, main) for the buckets that hold several classes; main is the largest."""
        classed = members.select("bucket", "node").join(classes, "node", "left")
        classed = write_and_read(
            classed.select("bucket", "node", F.coalesce("component", "node").alias("component")), "classed"
        )
        counts = classed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        largest = F.max(F.struct("n", F.col("component").alias("main")))["main"].alias("main")
        mains = counts.groupBy("bucket").agg(largest, F.count("*").alias("classes")).filter("classes > 1")
        mains = write_and_read(mains.select("bucket", "main"), "main-classes")
        return write_and_read(classed.join(mains, "bucket"), "apart")

    def _with_pivots(self, apart: DataFrame, turn: int) -> DataFrame:
        """The texts outside a bucket's largest class, each with one of that."""
        pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node"))["node"].alias("pivot")
        pivots = write_and_read(apart.filter("component = main").groupBy("bucket").agg(pivot), "pivots")
        return _pairs(apart.filter("component <> main").join(pivots, "bucket"), "node", "pivot").distinct()

    def _attributes(self, members: DataFrame) -> DataFrame:
        """(node, bits, count) of the texts that can be in a pair: read from all once, not again for each set of pairs."""
        wanted = write_and_read(members.select("node").distinct(), "bucketed-texts")
        known = self.signed.select(F.col("row").alias("node"), "bits", "count").join(wanted, "node", "left_semi")
        return write_and_read(known, "attributes")

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and bits don't rule out."""
        pairs = write_and_read(pairs, "candidates")
        left = self.attributes.withColumnRenamed("node", "a")
        right = self.attributes.select(F.col("node").alias("b"), F.col("bits").alias("other_bits"), F.col("count").alias("other_count"))
        both = pairs.join(left, "a").join(right, "b")
        return both.filter(possible(self.threshold)).select("a", "b")

    def _all_apart(self, apart: DataFrame) -> DataFrame:
        """All pairs of a bucket's texts that are in different classes, but for those that sizes and bits rule out."""
        known = write_and_read(apart.join(self.attributes, "node"), "apart-known")
        rest = known.filter("component <> main").select(
            "bucket", *[F.col(c).alias(f"other_{c}") for c in ("node", "component", "bits", "count")]
        )
        rest = write_and_read(rest, "rest")
        pairs = known.join(
            rest,
            (known["bucket"] == rest["bucket"]) & (F.col("component") != F.col("other_component")) & possible(self.threshold),
        )
        return _pairs(pairs, "node", "other_node").distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs whose full shingle sets reach the threshold."""
        pairs = write_and_read(pairs, "pairs")
        # Written, so that Spark knows when they are few and then moves no text to meet them.
        wanted = write_and_read(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "wanted")
        texts = self.signed.select("row", F.col("doc.text").alias("text")).join(wanted, "row", "left_semi")
        texts = write_and_read(texts, "paired-texts")
        left = texts.select(F.col("row").alias("a"), F.col("text").alias("left"))
        right = texts.select(F.col("row").alias("b"), F.col("text").alias("right"))
        both = pairs.join(left, "a").join(right, "b")
        found = both.select("a", "b", _verifier(self.shingle_words)("left", "right").alias("similarity"))
        return write_and_read(found.filter(F.col("similarity") >= self.threshold), "verified")

    def nodes(self) -> DataFrame:
        """(text_digest, node, class): the class of each text."""
        nodes = self.texts.join(self.classes, "node", "left")
        return write_and_read(nodes.select("text_digest", "node", F.coalesce("component", "node").alias("class")), "text-classes")

    def linked(self) -> DataFrame:
        """(node, n_links, linked, similarity): how many other texts a text is linked to, and the most similar of them.

        Linked texts are in one class, so all pairs of a class are compared, whether verified before or not. They are
        so in blocks of texts that follow one another by the size of their sets: a task holds two blocks at a time, and
        blocks whose sizes are too far apart don't meet. A class of n texts moves up to n * n / BLOCK rows.
        """
        texts = self.signed.select(F.col("row").alias("node"), "count", F.col("doc.text").alias("text"))
        sizes = ranked(self.classes.join(texts.select("node", "count"), "node"), ["component"], ["count", "node"])
        sizes = sizes.withColumn("block", F.expr(f"(_rank - 1) div {BLOCK}"))
        placed = write_and_read(sizes.select("component", "block", "node", "count"), "blocks")
        blocks = placed.groupBy("component", "block").agg(F.min("count").alias("least"), F.max("count").alias("most"))
        blocks = write_and_read(blocks, "block-sizes")
        larger = blocks.select("component", F.col("block").alias("other"), F.col("least").alias("other_least"))
        near = (F.col("other") >= F.col("block")) & (F.col("most") >= F.col("other_least") * self.threshold - 1e-6)
        met = blocks.join(larger, "component").filter(near).select("component", "block", "other")
        sides = F.array(
            F.struct(F.lit(0).alias("side"), F.col("block").alias("own")),
            F.struct(F.lit(1).alias("side"), F.col("other").alias("own")),
        )
        sides = F.when(F.col("block") == F.col("other"), F.slice(sides, 1, 1)).otherwise(sides)
        met = met.select("*", F.inline(sides)).select("component", F.col("block").alias("first"), F.col("other").alias("second"), "side", F.col("own").alias("block"))
        wanted = placed.join(met, ["component", "block"]).select("component", "first", "second", "side", "node")
        rows = write_and_read(wanted, "blocks-met").join(texts.select("node", "text"), "node")
        found = rows.groupBy("component", "first", "second").applyInPandas(
            _linker(self.threshold, self.shingle_words), "node long, n_links long, linked long, similarity double"
        )
        best = F.max(F.struct("similarity", (-F.col("linked")).alias("rank"))).alias("best")
        found = found.groupBy("node").agg(F.sum("n_links").alias("n_links"), best)
        return write_and_read(found.select("node", "n_links", (-F.col("best.rank")).alias("linked"), "best.similarity"), "linked")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links, linked_id, similarity, n_copies, is_first) for every row of ``docs``.

    Two texts are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more;
    rows joined by equal words or by links, directly or through others, are one class. ``class_id`` is the
    least doc_id of the class (null where it has none). ``n_links`` counts the different texts that the row's text is
    linked to. ``linked_id`` is the least doc_id of the most similar of them, and ``similarity``
    theirs; both are null for a text without links. ``n_copies`` counts the other rows with the same words,
    and ``is_first`` marks one row of each class: that with the least id, then text. Words are runs without
    blanks, A-Z lower-cased.

    * Null text counts as empty. Texts without words are copies of each other; fewer than five words are
      one shingle. Long texts are compared whole.
    * Rows with a null id come after all others in their class. Repeated rows are copies, one is first.
    * An empty table gives no rows. Columns other than doc_id and text are not read.

    Equal texts are collapsed first, so copies are never paired. Classes are found first: there a pair whose texts
    other links have joined already is passed over. Then all pairs within a class are compared, so no link between
    texts of a class is left out. A pair of 0.8 shares a bucket with a probability of 0.999, a more similar one nearly always.
    """
    join = NearJoin(docs.select("doc_id", "text"), **options)
    nodes, linked = join.nodes(), join.linked()
    rows = join.signed.select("digest", "row", F.col("doc.doc_id").alias("doc_id"))
    rows = write_and_read(rows.join(nodes, rows["digest"] == nodes["text_digest"]), "classed-rows")
    first = rows.groupBy("class").agg(_first().alias("first"))
    first = write_and_read(first.select("class", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first")), "class-firsts")
    ids = rows.groupBy(F.col("node").alias("text_node")).agg(F.min("doc_id").alias("text_id"), (F.count("*") - 1).alias("n_copies"))
    ids = write_and_read(ids, "text-ids")
    own = ids.select(F.col("text_node").alias("node"), "n_copies")
    other = ids.select(F.col("text_node").alias("linked"), F.col("text_id").alias("linked_id"))
    # What is looked up for a text is looked up once for all its rows.
    texts = nodes.join(own, "node").join(linked, "node", "left").join(other, "linked", "left").join(first, "class")
    n_links = F.coalesce("n_links", F.lit(0)).alias("n_links")
    texts = write_and_read(texts.select("node", "class_id", n_links, "linked_id", "similarity", "n_copies", "first"), "text-results")
    out = rows.select("node", "row", "doc_id").join(texts, "node")
    return out.select("doc_id", "class_id", "n_links", "linked_id", "similarity", "n_copies", (F.col("row") == F.col("first")).alias("is_first"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are first in their class, all columns kept, whatever their names; see ``near_duplicates``."""
    join = NearJoin(docs, **options)
    nodes = join.nodes().select("text_digest", "class")
    rows = join.signed.select("digest", "row", F.col("doc.doc_id").alias("doc_id"))
    rows = rows.join(nodes, rows["digest"] == nodes["text_digest"])
    first = rows.groupBy("class").agg(_first()["row"].alias("row")).select("row")
    # The rows that go are mostly fewer than those that stay, and few enough to be sent to the texts.
    others = write_and_read(rows.select("row").join(first, "row", "left_anti"), "others")
    return join.signed.join(others, "row", "left_anti").select("doc.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "linked_id", "similarity", "n_copies")
