"""Benchmark decontamination: CGK walks and sampled LSH over windows find places, edit distance verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import prepare, shielded, table

EDIT_SHARE = 0.1  # edits allowed, as a share of the item's length
BLOCK_CHARS = 200_000  # benchmark text that is held in a task at once; more is gone through in blocks
RECALL = 0.98  # share of passages at the limit of edits whose place is to be found, for each shape of window
TRIALS = 24  # edited copies of an item from which collisions are measured
MOST_REPEATS = 12
GATHERED = 1 << 20  # characters of texts that are gone through together
STRETCH = 1 << 15  # places that walk together, so that they stay in the processor's cache
MOST_HITS = 1 << 22  # windows met in a stretch of text before it is halved
MARKS = 20  # bits of a hash that choose its place in the table that turns most places away


@dataclass(frozen=True)
class Shape:
    """Windows for the items from ``chars`` characters on: steps of the walk, samples of a hash, distance of windows."""

    chars: int
    steps: int
    samples: int
    stride: int


# A walk moves on by half a character a step. Long items have many windows, of which some are nearly whole
# whatever the edits are; a short item is found by short windows only. Shorter items allow no edit.
SHAPES = (Shape(96, 28, 12, 4), Shape(24, 14, 6, 1), Shape(10, 8, 4, 1))

_RNG = np.random.Generator(np.random.PCG64(9))
# A random word for each character, the same for items and documents: what is hashed of it, and in the bit of
# each step whether the walk moves on.
WORDS = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32)
# For each shape the steps whose characters each repeat hashes.
SAMPLES = {s: [np.sort(_RNG.choice(s.steps, s.samples, replace=False)) for _ in range(MOST_REPEATS)] for s in SHAPES}
_FACTOR = np.uint32(0x9E3779B1)

_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_FOLD_POINTS = {c: 32 if c <= 13 else c + 32 for c in [*range(9, 14), *range(65, 91)]}


def folded(text: str | None) -> np.ndarray:
    """A byte for each code point, to find places by: A-Z lower-cased, blanks all alike, others mixed into a byte."""
    try:
        raw = (text or "").encode("latin-1")
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = (points ^ (points >> 8) ^ (points >> 16)).astype(np.uint8).tobytes()
    return np.frombuffer(raw.translate(_FOLD), np.uint8)


def plain(text: str) -> str:
    """The text that is verified: A-Z lower-cased, blanks all alike, every other code point as it is."""
    return text.translate(_FOLD_POINTS)


def embedded(words: np.ndarray, first: int, last: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The CGK walks from the places ``first`` to ``last``, step by step: (words met, places reached).

    A walk repeats or leaves a character as a random bit for the step and the character says, so two walks
    that an edit has set apart meet again. ``words`` must go on for ``steps`` characters after the last place.
    """
    at = np.arange(first, last)
    for step in range(steps):
        met = words.take(at)
        at += (met >> np.uint32(step)) & np.uint32(1)
        yield met, at


def hashes(words: np.ndarray, first: int, last: int, wanted: dict[Shape, int]) -> tuple[dict[Shape, list[np.ndarray]], dict[Shape, np.ndarray]]:
    """For each shape the hashes of its repeats' sampled characters, and the places where its walks end."""
    out = {s: [np.full(last - first, r + 1, np.uint32) for r in range(n)] for s, n in wanted.items()}
    users = {}
    for shape, repeats in wanted.items():
        for r in range(repeats):
            for step in SAMPLES[shape][r].tolist():
                users.setdefault(step, []).append(out[shape][r])
    ends = {}
    for step, (met, at) in enumerate(embedded(words, first, last, max(s.steps for s in wanted))):
        for total in users.get(step, ()):
            total *= _FACTOR
            total += met
        for shape in wanted:
            if shape.steps == step + 1:
                ends[shape] = at.copy()
    for totals in out.values():
        for total in totals:
            total ^= total >> np.uint32(15)
            total *= _FACTOR
    return out, ends


def _words(codes: np.ndarray) -> np.ndarray:
    """The characters' words, and some more for the walks that leave the text."""
    return WORDS.take(np.concatenate([codes, np.zeros(SHAPES[0].steps + 1, np.uint8)]))


def _slots(found: np.ndarray) -> np.ndarray:
    return found >> np.uint32(32 - MARKS)


def distance(item: list[int], region: list[int], most: int) -> tuple[int, int] | None:
    """(edit distance, end) of the item's best match anywhere in the region; None beyond ``most`` edits.

    The columns of the table are bit vectors, so a step costs a few operations on one long integer.
    """
    m = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(region):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diagonal | up) & full, diagonal & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


@dataclass(frozen=True)
class Table:
    """Hashes of the items' windows for one shape: for each repeat the sorted hashes, their windows, and marks."""

    shape: Shape
    repeats: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    owner: np.ndarray  # of each window
    offset: np.ndarray

    def hits(self, made: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of the hashes that a window has, for each repeat."""
        places, windows = [], []
        for found, (known, window, marks) in zip(made, self.repeats, strict=True):
            maybe = np.flatnonzero(marks.take(_slots(found)))
            first = np.searchsorted(known, found[maybe], "left")
            count = np.searchsorted(known, found[maybe], "right") - first
            places.append(np.repeat(maybe, count))
            windows.append(window[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)])
        return np.concatenate(places), np.concatenate(windows)


@dataclass(frozen=True)
class Block:
    """Items with the windows they are found by."""

    ids: list[int]
    texts: list[str]  # as they are verified
    limits: list[int]
    needed: np.ndarray  # hits of its windows that a match is expected to show at least
    tables: list[Table]
    short: list[int]
    grams: list[np.ndarray]


def spoiled(codes: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with as many edits at random places: characters replaced, dropped or put in."""
    out = codes.tolist()
    for _ in range(edits):
        at = int(rng.integers(len(out)))
        out[at : at + int(rng.integers(2))] = [[], [113], [122]][int(rng.integers(3))]
    return np.array(out, np.uint8)


def _table(shape: Shape, repeats: int, codes: list[np.ndarray], members: list[int]) -> Table:
    made, owner, offset = [[] for _ in range(repeats)], [], []
    for i in members:
        found, ends = hashes(_words(codes[i]), 0, len(codes[i]), {shape: repeats})
        # A window that leaves its item would depend on what follows it.
        starts = np.flatnonzero(ends[shape] <= len(codes[i]))[:: shape.stride]
        owner.append(np.full(len(starts), i))
        offset.append(starts)
        for r in range(repeats):
            made[r].append(found[shape][r][starts])
    known = []
    for parts in made:
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        marks = np.zeros(1 << MARKS, bool)
        marks[_slots(values)] = True
        known.append((values[order], order, marks))
    return Table(shape, known, np.concatenate(owner), np.concatenate(offset))


def _measured(table: Table, codes: list[np.ndarray], limits: list[int], members: list[int], trials: int) -> dict[int, np.ndarray]:
    """For each item how many hits its windows get, in agreeing places, from copies at the limit of edits."""
    rng, out = np.random.Generator(np.random.PCG64(5)), {}
    for i in members:
        most = []
        for _ in range(trials):
            copy = spoiled(codes[i], limits[i], rng)
            found, _ = hashes(_words(copy), 0, len(copy), {table.shape: len(table.repeats)})
            at, window = table.hits(found[table.shape])
            begin = np.sort((at - table.offset[window])[table.owner[window] == i])
            reach = np.searchsorted(begin, begin + limits[i], "right") - np.arange(len(begin))
            most.append(int(reach.max(initial=0)))
        out[i] = np.sort(most)
    return out


def build_block(items: list[tuple[int, str]], edit_share: float, recall: float = RECALL) -> Block:
    """Windows for the items, as many repeats of them as the wanted recall takes, and the hits to be expected.

    Both follow from a measurement: copies of each item are spoiled by as many edits as are allowed.
    """
    codes = [folded(text) for _, text in items]
    limits = [int(len(c) * edit_share) for c in codes]
    needed, tables, left = np.ones(len(codes), np.int64), [], list(range(len(codes)))
    for shape in SHAPES:
        members = [i for i in left if len(codes[i]) >= shape.chars and limits[i]]
        left = [i for i in left if i not in set(members)]
        if not members:
            continue
        repeats = 2
        while True:
            table = _table(shape, repeats, codes, members)
            measured = _measured(table, codes, limits, members, TRIALS)
            lost = np.mean([m[0] == 0 if len(members) * TRIALS < 200 else np.mean(m == 0) for m in measured.values()])
            if lost <= 1 - recall or repeats == MOST_REPEATS:
                break
            repeats = min(MOST_REPEATS, repeats * 2)
        for i, hit in measured.items():
            needed[i] = max(1, int(hit[0] * 0.6))  # well below the fewest seen
        tables.append(table)
    grams = [np.unique(_grams(c)) for c in codes]
    return Block([i for i, _ in items], [plain(t) for _, t in items], limits, needed, tables, left, grams)


def _places(row: np.ndarray, ends: np.ndarray, block: Block) -> Iterator[tuple[int, int, int]]:
    """(text, item, begin) where as many windows of the item are met in the text as a match is expected to meet.

    Windows of a match are met where its begin puts them, but for the edits before them; so their begins differ
    by no more than the edits allowed. A stretch overlaps the next by more than the longest match. One with
    very many hits is halved as long as it is much longer than that.
    """
    if not block.tables or not len(row):
        return
    limits = np.array(block.limits)
    wanted = {t.shape: len(t.repeats) for t in block.tables}
    longest = max(len(block.texts[i]) + block.limits[i] for t in block.tables for i in set(t.owner.tolist()))
    words = _words(row)
    work = [(base, min(base + GATHERED, len(row))) for base in range(0, len(row), GATHERED)]
    while work:
        low, high = work.pop()
        met: dict[Shape, list] = {t.shape: [] for t in block.tables}
        total, end = 0, min(high + longest, len(row))
        for first in range(low, end, STRETCH):
            made, _ = hashes(words, first, min(first + STRETCH, end), wanted)
            for table in block.tables:
                at, window = table.hits(made[table.shape])
                met[table.shape].append((at + first, window))
                total += len(at)
            if total > MOST_HITS and high - low > 4 * longest:
                break
        if total > MOST_HITS and high - low > 4 * longest:
            work += [(low, (low + high) // 2), ((low + high) // 2, high)]
            continue
        for table in block.tables:
            at, window = (np.concatenate(x) for x in zip(*met[table.shape], strict=True))
            if not len(at):
                continue
            text, owner, offset = np.searchsorted(ends, at, "right"), table.owner[window], table.offset[window]
            span = high - low + 4 * longest
            base = int(text.min())
            key = (owner * (int(text.max()) - base + 1) + text - base) * span + (at - offset - low + longest)
            order = np.argsort(key, kind="stable")
            key, owner, text = key[order], owner[order], text[order]
            last = np.arange(len(key)) + block.needed[owner] - 1
            good = np.flatnonzero(last < len(key))
            good = good[key[last[good]] - key[good] <= limits[owner[good]]]
            begin = key[good] % span + low - longest
            starts = np.concatenate([[0], ends])[text[good]]
            yield from zip(text[good].tolist(), owner[good].tolist(), (begin - starts).tolist(), strict=True)


def find(texts: list[str | None], block: Block) -> list[list[tuple[int, int, int, int]]]:
    """For each text the (item id, start, end, edits) of the items in it, the best match of each.

    Whole texts are read. They are laid end to end and gone through together.
    """
    codes = [folded(t) for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    row = np.concatenate(codes) if codes else np.zeros(0, np.uint8)
    spots: dict[tuple[int, int], set[int]] = {}
    for text, i, begin in _places(row, ends, block):
        spots.setdefault((text, i), set()).add(begin)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for (text, i), begins in spots.items():
        if best := _verify(texts[text], codes[text], block, i, sorted(begins)):
            out[text].append(best)
    for i in block.short:
        item = block.texts[i]
        wanted = folded(item).tobytes()
        for text, c in enumerate(codes):
            if wanted in c.tobytes() and (at := plain(texts[text]).find(item)) >= 0:
                out[text].append((block.ids[i], at, at + len(item), 0))
    return [sorted(x) for x in out]


def _grams(codes: np.ndarray) -> np.ndarray:
    wide = codes.astype(np.uint32)
    return wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24 if len(codes) > 3 else wide[:0]


def _verify(text: str, codes: np.ndarray, block: Block, i: int, begins: list[int]) -> tuple[int, int, int, int] | None:
    """The item's best match near the places, over code points."""
    item, most = block.texts[i], block.limits[i]
    points = [ord(c) for c in item]
    best, tried = None, -(1 << 60)
    apart = len(item) // 4
    for begin in begins:
        # Places near the last one tried lie in its region: a match begins up to ``most`` before or after its place.
        if begin < tried + apart:
            continue
        tried = begin
        low, high = max(0, begin - most), max(0, begin + apart + len(item) + 2 * most)
        # An edit changes four 4-grams at most, so a match shares all the others; most candidates end here.
        # Equal characters have equal bytes, so the bytes share as many at least.
        grams, own = _grams(codes[low:high]), block.grams[i]
        if len(own) and len(grams):
            common = int((own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams).sum())
            if common < len(item) - 3 - 4 * most:
                continue
        region = plain(text[low:high])
        at = region.find(item)  # an exact copy needs no table
        if at >= 0:
            return block.ids[i], low + at, low + at + len(item), 0
        there = [ord(c) for c in region]
        found = distance(points, there, most)
        if found and (best is None or found[0] < best[3]):
            end = found[1]
            head = distance(points[::-1], there[:end][::-1], most)
            best = (block.ids[i], low + end - (head or found)[1], low + end, found[0])
    return best


def _blocks(benchmark: DataFrame, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``most_chars`` characters, by id; one block is in the driver at a time."""
    rows = benchmark.filter(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text").distinct()
    part, chars = [], 0
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        part.append((item_id, text))
        chars += len(text)
        if chars >= most_chars:
            yield part
            part, chars = [], 0
    if part:
        yield part


def leaks(
    docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): benchmark items that documents contain, up to a few edits.

    An item is in a text where a passage of it is within ``edit_share`` of the item's length in edits
    (Levenshtein, over code points, A-Z lower-cased, blanks alike). ``start`` and ``end`` are code points.

    Items are the queries and every document is gone through for them, in blocks of items of bounded size.
    Random walks embed the windows of an item and the text from every place on, so that edits become
    differences in some places of the walks; hashes of sampled places, in several repeats, find the windows
    that a text shares with an item. Their number is derived, for each shape of window, from the collisions
    that copies of the items show at the limit of edits. Where enough windows of an item are met, in places
    that agree but for the edits, the whole item is verified exactly. So no passage is wrongly
    reported, and one at the limit is missed in about two cases of a hundred at most.

    * Null and empty texts hold nothing; items without id or text are passed over. Items shorter than 10
      characters allow no edit and count where they occur as they are. Texts of any length are read whole.
    * Repeated documents are found each, an item at most once in a document row. No documents or
      no items give no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:bigint>>"
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, end long, edits long")
    out = None
    for items in _blocks(benchmark, block_chars):
        found = docs.withColumn("_found", _finder(docs.sparkSession, items, edit_share, kind)("text"))
        found = found.select("doc_id", F.inline("_found"))
        out = found if out is None else out.union(found)
    return empty if out is None else out


def _finder(spark: SparkSession, items: list[tuple[int, str]], edit_share: float, kind: str):
    block = spark.sparkContext.broadcast(build_block(items, edit_share))
    names = ("item_id", "start", "end", "edits")

    @F.pandas_udf(kind)
    def finder(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = find(list(batch), block.value)
            yield pd.Series([[dict(zip(names, f, strict=True)) for f in row] for row in found])

    return finder


@shielded
def clean(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item of the benchmark; see ``leaks``. All columns are kept."""
    prepare(docs.sparkSession)
    kind = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:bigint>>"
    for items in _blocks(benchmark, BLOCK_CHARS):
        found = docs.withColumn("_found", _finder(docs.sparkSession, items, edit_share, kind)("text"))
        docs = found.filter(F.size("_found") == 0).drop("_found")
    return docs


def query(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
