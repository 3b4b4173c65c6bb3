"""Best-fit packing: token pieces of documents into sequences of a fixed capacity."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import chain
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import prepare, ranked, table
from feira.session import write_and_read

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0  # the id that ends every document
CACHED = 160 << 20  # bytes of one generation of known words
MARKS = ".,;:!?"  # ASCII marks that end words
ENTRY = 160  # bytes that a known word takes besides its own and its ids'
GROUPED = 1 << 20  # characters of texts whose new words are encoded together
CONTENT = {"ids": "ids array<int>", "crc32": "ids_crc32 long"}


class WordIds:
    """Token ids of texts, word by word, so that a word met before costs one look-up.

    Text is cut at ASCII blanks. A tokenizer that drops blanks, folds letters one by one and lets no token
    span a blank gives the words' ids in a row; one that keeps blanks encodes whole texts instead. Where it
    folds A-Z, words are looked up folded; where marks at a word's end are tokens of their own, the word
    without them is. New words are encoded together. Words are kept in two generations of bounded size: when the young one is full
    it becomes the old one, and only words met again stay.
    """

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached, self.size, self.young, self.old = cached, 0, {}, {}
        encoded = [self._whole(t) for t in ("one two", "one", "two")]
        self.by_words = encoded[0] == encoded[1] + encoded[2]
        self.folds = self._whole(ascii_uppercase) == self._whole(ascii_lowercase)
        self.parts = self._whole(f"two{MARKS}") == encoded[2] + self._whole(MARKS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        if self.size > self.cached:
            self.old, self.young, self.size = self.young, {}, 0
        new, marked = set(), []
        for word in words:
            if word not in self.young:
                ids = self.old.get(word)
                if ids is not None:
                    self._keep(word, ids)
                    continue
                stem = word.rstrip(MARKS.encode()) if self.parts else word
                if stem and stem != word and stem[-1:].isalnum():
                    marked.append((word, stem))
                    stems = (stem, word[len(stem) :])
                else:
                    stems = (word,)
                new.update(s for s in stems if s not in self.young and s not in self.old)
        self._encode(sorted(new))
        for word, stem in marked:
            self._keep(word, self._known(stem) + self._known(word[len(stem) :]))

    def _known(self, word: bytes) -> bytes:
        return self.young.get(word) or self.old[word]

    def _encode(self, new: list[bytes]) -> None:
        if not new:
            return
        texts = [w.decode("utf-8", "surrogatepass") for w in new]
        encoding = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        begins = np.fromiter((b for b, _ in encoding.offsets), np.int64)
        cuts = [0, *(np.searchsorted(begins, ends) * 4).tolist()]
        ids = np.array(encoding.ids, "<u4").tobytes()
        for k, word in enumerate(new):
            self._keep(word, ids[cuts[k] : cuts[k + 1]])

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.young[word] = ids
        self.size += len(word) + len(ids) + ENTRY

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text and the end id; null is an empty text."""
        end = np.uint32(END).tobytes()
        if not self.by_words:
            for text in texts:
                yield np.frombuffer(self._whole(text or "") + end, "<u4")
            return
        whole = ((text or "").encode("utf-8", "surrogatepass") for text in texts)
        split = [(text.lower() if self.folds else text).split() for text in whole]  # A-Z only, in bytes
        self._learn(set(chain.from_iterable(split)))
        for words in split:
            yield np.frombuffer(b"".join(map(self.young.__getitem__, words)) + end, "<u4")


@functools.cache
def _word_ids(path: str) -> WordIds:
    """One per worker process: words are kept from task to task."""
    return WordIds(path)


def _groups(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    """Texts together, up to some size, so that their new words are encoded at once."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= GROUPED:
            yield group
            group, size = [], 0
    if group:
        yield group


def tokenizer_path(path: str | None) -> str:
    """``path``, or the public tokenizer's own place on the machine that asks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return path


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, content: str = "ids") -> DataFrame:
    """(doc_id, piece, start, length and ids or ids_crc32) of every document of ``docs`` (doc_id, text).

    A document is its token ids and the end id. One longer than ``capacity`` is cut into pieces of that
    length, the last may be shorter; ``start`` counts the document's ids before the piece. ``ids_crc32`` is
    the CRC-32 of the ids as little-endian 32-bit numbers. Texts are read once and not shuffled.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(tokenizer_path(path))
        for batch in batches:
            row, numbers, starts, lengths, made = [], [], [], [], []
            texts = (text.as_py() for text in batch.column(1))
            for at, ids in enumerate(chain.from_iterable(map(words.of, _groups(texts)))):
                for number, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    row.append(at)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(len(part))
                    made.append(part.astype(np.int32) if content == "ids" else zlib.crc32(part.astype("<u4").tobytes()))
            kind = pa.list_(pa.int32()) if content == "ids" else pa.int64()
            columns = [pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())]
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *columns, pa.array(made, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", CONTENT[content].split()[0]])

    schema = f"doc_id {id_type.simpleString()}, piece int, start long, length long, {CONTENT[content]}"
    return docs.mapInArrow(cut, schema)


class OpenBins:
    """Runs of open bins by remaining capacity, under a segment tree that finds the tightest fit."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)
        self.runs = [[] for _ in range(capacity + 1)]

    def _mark(self, remaining: int) -> None:
        at = remaining + self.size
        self.open[at] = bool(self.runs[remaining])
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def push(self, remaining: int, first: int, count: int) -> None:
        if remaining and count:
            self.runs[remaining].append((first, count))
            self._mark(remaining)

    def pop(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop()
        self._mark(remaining)
        return run

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that holds ``length``."""
        at = length + self.size
        while not self.open[at]:
            while at % 2:  # a right child: nothing larger under its parent
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


RUN = ["length", "first", "each", "bin", "offset"]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for ``counts`` pieces of each length, as runs (length, first, each, bin, offset).

    Pieces of one length are numbered from 0. Those from ``first`` on fill the bins from ``bin`` on, ``each``
    of them a bin, from ``offset`` on. The result is that of placing piece by piece, the longest first, each
    in the tightest open bin: after a piece the same bin is the tightest again as long as another fits, and
    bins with equal room are alike. So a step serves a run of bins, and the number of steps depends on the
    capacity only: a length opens at most two groups and splits one, and a group that takes pieces loses at
    least half of its room.
    """
    bins, free, runs = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                wanted = -(-left // (capacity // length))
                bins.push(capacity, free, wanted)
                free += wanted
                continue
            start, count = bins.pop(room)
            each = min(room // length, left)
            used = min(count, left // each)
            runs.append((length, first, each, start, capacity - room))
            bins.push(room, start + used, count - used)
            bins.push(room - each * length, start, used)
            first += used * each
            left -= used * each
    return runs


KEY_BITS = 48  # pieces of one length are numbered below 2 ** 48


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, length and any more) with ``sequence_id`` and ``offset``.

    All parts of all documents share one best-fit packing. It depends on the numbers of parts of each length
    only: at most ``capacity`` rows reach the driver, and the plan that is broadcast has at most some ten
    runs for each length. Parts are numbered within their length by distributed ranks, so a length that most
    parts have is spread over many tasks.

    * Null and empty texts are the end id alone; a document's pieces may go to different sequences.
    * Repeated rows and null ids are documents of their own. Ties are numbered in any order.
    * An empty table has no sequences. Of the documents only doc_id and text are read, so other columns' names do not matter.
    """
    parts = write_and_read(parts, "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = np.array(sorted(best_fit(counts, capacity)), np.int64).reshape(-1, len(RUN))
    plan = parts.sparkSession.sparkContext.broadcast((runs, (runs[:, 0] << KEY_BITS) + runs[:, 1]))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        runs, keys = plan.value
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        run = runs[np.searchsorted(keys, (length << KEY_BITS) + number, side="right") - 1]
        nth, each = number - run[:, 1], run[:, 2]
        return pd.DataFrame({"sequence_id": run[:, 3] + nth // each, "offset": run[:, 4] + nth % each * length})

    names = parts.columns
    numbered = ranked(parts, ["length"], ["doc_id", "piece"])
    numbered = numbered.select(*names, placed("length", F.col("_rank") - 1).alias("place"))
    return numbered.select(*names, "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the packed sequences themselves, for parts that carry their ``ids``."""
    members = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(members.alias("parts"))
    return rows.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.transform("parts.ids", F.size).alias("lengths"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pack(pieces(docs, content="crc32")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
