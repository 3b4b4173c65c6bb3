"""Hashed word shingles and MinHash values of one text, in numpy."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

WORDS = 5


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII blanks, A-Z lower-cased, in UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _factors(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(tokens: list[bytes], n: int = WORDS) -> np.ndarray:
    """The set of ``n``-word shingles as distinct 64-bit hashes; fewer words make one shingle, none no shingle."""
    h = hashed(tokens)
    n = min(n, len(h))
    if not n:
        return h
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i, f in enumerate(_factors(n)):
        total += h[i : len(h) - n + 1 + i] * f
    return np.unique(mixed(total))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; of two empty sets 1."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


@functools.cache
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    return rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def minhash(shingle_set: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """``k`` MinHash values; a long set is gone through in blocks, so memory doesn't grow with the text."""
    a, b = _permutations(k)
    short = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), block):
        part = short[at : at + block, None] * a
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    return least.astype(np.uint64)


def bitmap(shingle_set: np.ndarray, bits: int) -> np.ndarray:
    """The bits that the shingles set, 64 to a number."""
    flags = np.zeros(bits, bool)
    flags[(shingle_set >> np.uint64(7)) % np.uint64(bits)] = True
    return np.packbits(flags).view(np.int64)


def band_hashes(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash per band of MinHash values; the band's number is part of it."""
    rows = len(values) // bands
    total = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for value, f in zip(values.reshape(bands, rows).T, _factors(rows), strict=True):
        total = mixed(total + value * f)
    return total.view(np.int64)
