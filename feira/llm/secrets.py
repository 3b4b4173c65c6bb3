"""Secret scans: nested encodings are unwrapped until nothing new turns up, and every layer is scanned."""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import string
import zlib
from collections import deque
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import prepare, sha256_hex, shielded, table

KINDS = ("assign", "access", "hex")
# What counts as a secret.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]+(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
LEAST_RUN = 16
GZIP = b"\x1f\x8b\x08"
XZ = b"\xfd7zXZ\x00"
# Other headers that can be told from what is around them: zlib at its usual levels, bz2, xz.
PACKED = re.compile(rb"\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError)
# Bytes that runs of any encoding are made of, line breaks of wrapped base64 included.
RUN = (string.ascii_letters + string.digits + "+/_-=%\\{}.:\"'\r\n").encode()
PIECE = 4 << 20  # bytes of a decompressed layer that are scanned at once
OVERLAP = 64 << 10

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the secrets as they stand; leftmost and non-overlapping for each kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST_VALUE:
            found.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_order)


class Layer:
    """A text and, for each of its characters, the span of the outermost text that it came from."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    def outer(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


class Packed:
    """Bytes of a layer that are still to be opened, with the same spans for each."""

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray):
        self.raw, self.starts, self.ends = raw, starts, ends


def _spread(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """The layer with stretches (start, end, replacement) replaced; a replacement maps to its whole stretch."""
    parts, starts, ends, at = [], [], [], 0
    for start, end, text in pieces:
        parts += [layer.text[at:start], text]
        low, high = layer.outer(start, end)
        starts += [layer.starts[at:start], np.full(len(text), low)]
        ends += [layer.ends[at:start], np.full(len(text), high)]
        at = end
    parts.append(layer.text[at:])
    return Layer("".join(parts), np.concatenate([*starts, layer.starts[at:]]), np.concatenate([*ends, layer.ends[at:]]))


def _percent(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    pieces = []
    for m in PERCENT.finditer(layer.text):
        # Each decoded character takes the escapes of its own bytes.
        raw, at = unquote_to_bytes(m[0]), 0
        text = raw.decode("utf-8", "replace")
        if "\ufffd" in text:
            pieces.append((m.start(), m.end(), text))
            continue
        for c in text:
            n = len(c.encode("utf-8"))
            pieces.append((m.start() + 3 * at, m.start() + 3 * (at + n), c))
            at += n
    if pieces:
        yield _spread(layer, pieces)


def _escapes(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text:
        return
    pieces = []
    for m in ESCAPED.finditer(layer.text):
        point = int(m[0][2:].strip("{}"), 16)
        last = pieces[-1] if pieces else None
        if 0xDC00 <= point < 0xE000 and last and last[1] == m.start() and 0xD800 <= ord(last[2]) < 0xDC00:
            point = 0x10000 + ((ord(last[2]) - 0xD800) << 10) + point - 0xDC00
            pieces[-1] = (last[0], m.end(), chr(point))
        elif point < 0x110000:
            pieces.append((m.start(), m.end(), chr(point)))
    if pieces:
        yield _spread(layer, pieces)


def _compressed(raw: bytes) -> bool:
    return raw[:2] == GZIP[:2] or _bare_zlib(raw) or PACKED.match(raw) is not None


def _bare_zlib(raw: bytes) -> bool:
    return raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] << 8 | raw[1]) % 31 == 0


class _Zlib:
    """zlib's decompressor with the manners of those of bz2 and lzma."""

    def __init__(self, bits: int):
        self.engine, self.tail = zlib.decompressobj(bits), b""

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.engine.decompress(self.tail + data, most)
        self.tail = self.engine.unconsumed_tail
        return out

    @property
    def eof(self) -> bool:
        return self.engine.eof

    @property
    def unused_data(self) -> bytes:
        return self.engine.unused_data

    @property
    def needs_input(self) -> bool:
        return not self.tail


def _engine(raw: bytes):
    if raw.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if raw.startswith(XZ):
        return lzma.LZMADecompressor()
    return _Zlib(47 if _compressed(raw) else -15)


def _begins(raw: bytes) -> list[int]:
    """Places from which compressed data can be opened; all gzip members after the first come with it."""
    begins = [0] if _bare_zlib(raw) else []
    if (at := raw.find(GZIP)) >= 0:
        begins.append(at)
    for m in PACKED.finditer(raw):
        # A block of bz2 or xz gives nothing before it is whole.
        if m.start() not in begins and (_output(raw[m.start() : m.start() + 4096]) or _output(raw[m.start() :])):
            begins.append(m.start())
    return begins if 0 in begins or not _deflated(raw) else [0, *begins]


def _output(raw: bytes) -> bytes:
    """The first bytes that come out, none where the data are broken."""
    return next(_outputs(raw), b"")


def _outputs(raw: bytes) -> Iterator[bytes]:
    """What comes out of the first member, bit by bit, up to where it ends or is broken."""
    engine, feed = _engine(raw), raw
    try:
        while not engine.eof:
            out = engine.decompress(feed, 1 << 16)
            feed = b""
            if out:
                yield out
            elif engine.needs_input:
                return
    except BROKEN:
        return


def _deflated(raw: bytes) -> bool:
    """Deflate data without a header tell nothing of themselves: they count if anything that comes out is of interest."""
    if _compressed(raw):
        return False
    held = b""
    for out in _outputs(raw):
        held = held[-OVERLAP:] + out
        if _promising(held.decode("latin-1")):
            return True
    return False


def _cut(held: bytes) -> int:
    """Where the piece after this one begins: not within a run that may be encoded, and some way back at least."""
    return min(len(held.rstrip(RUN)), len(held) - OVERLAP)


def _inflated(raw: bytes) -> Iterator[bytes]:
    """Decompressed bytes of all members, then what follows them, in pieces that overlap.

    A run that may be encoded is never cut, however long. Beyond that memory stays bounded however much
    comes out, unless that is compressed again: such bytes come in one piece.
    """
    engine, held, feed, inner = _engine(raw), b"", raw, None
    member, parts = raw, []
    try:
        while True:
            out = engine.decompress(feed, PIECE)
            feed = b""
            if inner is None and len(held) + len(out) > 2:
                inner = _compressed(held + out)
            if inner:
                parts.append(out)
            else:
                held += out
                if len(held) >= PIECE and (cut := _cut(held)) > 0:
                    yield held
                    held = held[cut:]
            if engine.eof:
                member = feed = engine.unused_data.lstrip(b"\0")
                if not _compressed(feed):
                    if feed:
                        yield feed
                    break
                engine = _engine(feed)
            elif engine.needs_input and len(out) < PIECE:
                break
    except BROKEN:
        # What was taken for a member is none, or is broken: go on with the next.
        if (at := member.find(GZIP, 1)) >= 0:
            yield member[at:]
    if whole := held + b"".join(parts):
        yield whole


def _promising(text: str) -> bool:
    """Whether a text holds a secret or anything that could be unwrapped."""
    return any(p.search(text) for p in (ASSIGN, ACCESS, HEX, ENCODED, WRAPPED, PERCENT, ESCAPED))


def _open(packed: Packed) -> Iterator[Layer | Packed]:
    """What comes out of the bytes when they are inflated, and the bytes as a text, which may be lossy."""
    raw, starts, ends = packed.raw, packed.starts, packed.ends
    for begin in _begins(raw):
        low, high = int(starts[begin:].min()), int(ends[begin:].max())
        for piece in _inflated(raw[begin:]):
            yield Packed(piece, np.full(len(piece), low), np.full(len(piece), high))
    if not _promising(raw.decode("latin-1")):
        return
    if raw.isascii():
        yield Layer(raw.decode("ascii"), starts, ends)
        return
    # Bytes that are no text stand for themselves, one character each.
    text = raw.decode("utf-8", "surrogateescape")
    first = np.cumsum([0, *[len(c.encode("utf-8", "surrogateescape")) for c in text[:-1]]])
    yield Layer(text, np.minimum.reduceat(starts, first), np.maximum.reduceat(ends, first))


def _base64(layer: Layer) -> Iterator[Packed]:
    for m in ENCODED.finditer(layer.text):
        yield from _decoded(layer, np.arange(m.start(), m.start() + len(m[0].rstrip("="))))
    if "\n" not in layer.text:
        return
    for m in WRAPPED.finditer(layer.text):
        lines = [np.arange(x.start(), x.end()) for x in LINE.finditer(layer.text, m.start(), m.end())]
        if sum(map(len, lines)) < LEAST_RUN:
            continue
        yield from _decoded(layer, np.concatenate(lines))
        # Words may stand in the lines before and after: lines of one width and a shorter last one are also read alone.
        widths, at = [len(x) for x in lines], 0
        while at < len(lines) - 1:
            end = at + 1
            while end < len(lines) and widths[end] == widths[at]:
                end += 1
            last = end + (end < len(lines) and widths[end] < widths[at])
            if last - at > 1 and last - at < len(lines) and widths[at] >= LEAST_RUN:
                yield from _decoded(layer, np.concatenate(lines[at:last]))
            at = end


def _decoded(layer: Layer, places: np.ndarray) -> Iterator[Packed]:
    """The characters at these places as base64, from each of the first four: letters before it may be no part of it."""
    run = "".join(map(layer.text.__getitem__, places)) if places[-1] - places[0] >= len(places) else layer.text[places[0] : places[-1] + 1]
    run = run.replace("-", "+").replace("_", "/")
    for phase in range(4):
        n = len(run) - phase
        n -= n % 4 == 1
        if n < 2:
            continue
        try:
            raw = base64.b64decode(run[phase : phase + n] + "=" * (-n % 4))
        except (binascii.Error, ValueError):
            continue
        if not (GZIP in raw or _compressed(raw) or _promising(raw.decode("latin-1")) or PACKED.search(raw) or _deflated(raw)):
            continue
        # Three bytes come from four letters.
        fours = np.arange(0, n, 4)
        here = places[phase : phase + n]
        starts = np.repeat(np.minimum.reduceat(layer.starts[here], fours), 3)[: len(raw)]
        ends = np.repeat(np.maximum.reduceat(layer.ends[here], fours), 3)[: len(raw)]
        yield Packed(raw, starts, ends)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text; spans are code points of the text, end exclusive.

    A worklist holds layers that are still to be looked at, from the text itself. Each is scanned and then
    unwrapped in every way: runs of percent escapes, Unicode escapes, base64 (either alphabet, wrapped lines joined,
    from each of a run's first four letters). Decoded bytes go on the worklist too: gzip, zlib, bz2 or xz data in them and deflate data without a
    header at their start are inflated, all members, and come back as bytes; and they are read as a text, even where parts are none. A layer seen before, with the same text at the same place, is not taken up again, so
    data that decode to themselves end; there is no limit to the depth. A secret found in a layer is mapped to
    the stretch of the text that it came from.
    """
    text = text or ""
    base = base_spans(text)
    spans = set(base)
    if not ("%" in text or "\\" in text or ENCODED.search(text) or "\n" in text and WRAPPED.search(text)):
        return base, sorted(spans, key=_order)
    here = np.arange(len(text))
    work, seen, opened = deque([Layer(text, here, here + 1)]), set(), set()
    while work:
        layer = work.popleft()
        if isinstance(layer, Packed):
            key = (xxhash.xxh3_128_digest(layer.raw), int(layer.starts[0]), int(layer.ends[-1]))
            if key not in opened:
                opened.add(key)
                work.extend(_open(layer))
            continue
        if not layer.text:
            continue
        key = (xxhash.xxh3_128_digest(layer.text.encode("utf-8", "surrogatepass")), int(layer.starts[0]), int(layer.ends[-1]))
        if key in seen:
            continue
        seen.add(key)
        if len(seen) > 1:
            for kind, start, end in base_spans(layer.text):
                spans.add((kind, *layer.outer(start, end)))
        for unwrap in (_percent, _escapes, _base64):
            work.extend(unwrap(layer))
    return base, sorted(spans, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=_order))


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


@shielded
def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (kind, start, end): what ``scan`` finds in ``text``.

    Null text counts as empty and has none. Every row is scanned by itself and whole, however long, repeated
    rows too; nothing is shuffled. An empty table gives no rows. Other columns are passed on; columns called base and spans are replaced.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf(f"base {_SPANS}, spans {_SPANS}")
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            both = [scan(t) for t in batch]
            rows = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in part] for part in pair] for pair in both]
            yield pd.DataFrame(rows, columns=["base", "spans"])

    docs = docs.drop("base", "spans")
    return docs.withColumn("_scanned", scanned("text")).select(*docs.columns, "_scanned.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text"))

    def text(column: str):
        # Both arrays come in order: by start, then kind.
        piece = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(piece, ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [number(kind) for kind in KINDS]
    return found.select("doc_id", *kinds, sha256_hex(text("base")).alias("base_sha256"), text("spans").alias("spans"))
