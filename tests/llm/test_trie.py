"""The trie against a dictionary of prefixes, with shards so small that most nodes span several."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from feira.llm import trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    original = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            original[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in original.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
        ends[rebuilt[c]].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, who in members.items():
        own = (len(who) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += own
    return [
        (who[0], len(path), members[path[:-1]][0] if path else None, len(who), kids.get(path, 0), leaves[path], saved[path],
         hashlib.sha256(",".join(map(str, ends.get(path, []))).encode()).hexdigest())
        for path, who in members.items()
    ]


def talk(seed, n=400, hot=300):
    """Conversations that share beginnings, one that many repeat, turnless ones once rebuilt, some far over 64 turns long."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        length = rng.choice([1, 1, 2, 3, 5, 8, 9, 12])
        rows += [(c * 3, t, rng.choice(["user", "user", "assistant", None]), rng.choice(["hi", "ok", "é yes", "", None])) for t in range(length)]
    rows += [(10_000 + c, t, "user", "the same again") for c in range(hot) for t in range(9)]
    rows += [(c, t, "user", f"turn {t if t < limit else c}") for c, limit in ((90_001, 90), (90_002, 130), (90_003, 200)) for t in range(200)]
    rows += [(70_001, None, "user", "null turn"), (70_001, 0, None, None), (70_001, 3, "a", "b"), (70_001, 3, "a", "b")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def table_of(spark, rows):
    rows = [(*r, "x", "y", "z") for r in rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string, key string, kind string")


@pytest.mark.parametrize(("shard_turns", "gathered"), [(150, 2), (150, 512), (10**6, 512)])
def test_nodes_match_a_dictionary_of_prefixes(spark, shard_turns, gathered):
    rows = talk(1)
    lists = trie.with_heads(trie.turn_lists(table_of(spark, rows)))
    got = [tuple(r[n] for n in NAMES) for r in trie.prefix_trie(lists, shard_turns, gathered).collect()]
    assert sorted(got, key=repr) == sorted(by_hand(rows), key=repr)


def test_query_on_odd_rows_and_none(spark, tmp_path):
    rows = talk(2, n=30, hot=5)
    table_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r[n] for n in NAMES) for r in trie.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(by_hand(rows), key=repr)
    none = trie.prefix_trie(trie.with_heads(trie.turn_lists(table_of(spark, rows).limit(0))))
    assert none.columns == NAMES and none.count() == 0


def test_a_list_of_ids_that_spans_shards_is_hashed_whole(spark):
    """One conversation that half of all repeat: its ids come from several shards and several pieces."""
    rows = [(c * 5, 0, "user", "hot") for c in range(12_000)] + [(c * 5, 0, "user", str(c)) for c in range(12_000, 20_000)]
    lists = trie.turn_lists(table_of(spark, rows))
    (hot,) = trie.prefix_trie(lists, shard_turns=3000).filter("n_convs = 12000").collect()
    assert hot.ends_sha256 == hashlib.sha256(",".join(str(c * 5) for c in range(12_000)).encode()).hexdigest()
    assert (hot.conv_id, hot.saved_tokens) == (0, 3 * 11_999)
