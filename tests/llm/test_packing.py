"""Packing against the tokenizer on whole texts, and against best fit piece by piece."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feira.llm import packing

from .test_operators import rows_of


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path(None))


@pytest.fixture(scope="module")
def words():
    """So small a cache that words are forgotten and learnt again all the time."""
    return packing.WordIds(packing.tokenizer_path(None), cached=2000)


ODD = [" ", "\t", "\n", "\r\n", " ", " ", "\x1c", "'s", "'LL", "é", "é", "́", "ΑΣ", "İ", "ß", "日本", "👍🏽", "12", "<|endoftext|>", "<|startoftext|> ", "a", "Bc", "!?", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=6)), max_size=20), max_size=4))
def test_words_one_by_one_give_the_ids_of_the_text(tokenizer, words, many):
    texts = ["".join(parts) for parts in many] + [None]
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert words.by_words
    assert [ids.tolist() for ids in words.of(texts)] == want


def test_a_tokenizer_that_keeps_blanks_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    words, plain = packing.WordIds(path), Tokenizer.from_file(path)
    assert not words.by_words
    assert next(words.of(["one  two\n three"])).tolist() == [*plain.encode("one  two\n three", add_special_tokens=False).ids, 0]


def plain_best_fit(lengths, capacity):
    """Bins by best-fit decreasing, one piece after another."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= length]
        if fits:
            room[room.index(min(fits))] -= length
        else:
            room.append(capacity - length)
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_runs_place_every_piece_as_best_fit_does(case):
    capacity, lengths = case
    counts = Counter(lengths)
    runs = sorted(packing.best_fit(counts, capacity))
    bins = defaultdict(list)
    for k, (length, first, each, start, offset) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
        for number in range(first, end):
            nth = number - first
            bins[start + nth // each].append((offset + nth % each * length, length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(x[1] for x in m) for m in bins.values()) == plain_best_fit(lengths, capacity)


def test_the_plan_is_bounded_by_the_capacity():
    rng = random.Random(1)
    some = {length: rng.randrange(1, 10) for length in range(1, 2049)}
    many = {length: rng.randrange(1, 10**9) for length in range(1, 2049)}
    assert len(packing.best_fit(some)) < 20 * 2048
    assert len(packing.best_fit(many)) < 20 * 2048


def test_pack_matches_the_tokenizer(spark, docs, tokenizer, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.query(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in rows_of(docs, "doc_id", "text"):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for members in used.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) == len(plain_best_fit([w[3] for w in want], 2048))


def test_sequences_hold_the_ids(docs, tokenizer):
    packed = packing.pack(packing.pieces(docs, capacity=64), capacity=64)
    packed = packing.write_and_read(packed, "packed")
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert list(whole[r.sequence_id].ids[r.offset : r.offset + r.length]) == list(r.ids)
    assert sum(sum(r.lengths) for r in whole.values()) == sum(r.length for r in packed.collect())


def test_nothing_to_pack(empty):
    assert packing.pack(packing.pieces(empty)).count() == 0
