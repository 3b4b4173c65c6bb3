"""Prefix trie of conversations: range shards of padded turn-id matrices, boundary nodes recombined."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import crc32_sql, prepare, sha256_hex, table, text_or_empty
from feira.session import write_and_read

DONOR_EVERY = 5
HEADS = 9  # a conversation takes 0 to 8 turns of another
SHARD_TURNS = 500_000  # turns a shard holds about
WIDTH = 64  # turns in a matrix
CELLS = 4_000_000  # cells of a matrix
GATHERED = 512  # shards whose boundaries are recombined at a time
CHUNK = 4096  # ids in one piece of a list that spans shards
NOBODY = np.iinfo(np.int64).max
PARTS = ("n", "least", "kids", "leaves", "saved")
LONGS = ("level", "shard", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id", "piece")
TEXTS = ("kind", "ends", "key", "parent_key")
LISTS = ("ids", "sizes", *PARTS)
OUT = pa.schema(
    [(c, pa.int64()) for c in LONGS] + [(c, pa.string()) for c in TEXTS] + [(c, pa.list_(pa.int64())) for c in LISTS]
)
DDL = ", ".join([f"{c} long" for c in LONGS] + [f"{c} string" for c in TEXTS] + [f"{c} array<long>" for c in LISTS])


# -- one shard, in numpy -------------------------------------------------------------------------------


def dense(ids: np.ndarray) -> np.ndarray:
    """Turn ids (two numbers each) as places in their order."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    ranked = ids[order]
    change = np.zeros(len(ids), np.int64)
    change[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(change)
    return out


def depths(lens: np.ndarray, at: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth the rows that reach it, in the order of their turns, and which of them start a node.

    Rows are padded to matrices of up to 64 turns and sorted; a row starts a node at each depth from the
    first column on in which it differs from the row before. Only rows with more turns go on to the next
    matrix, in which the groups found so far come first, so memory does not grow with the longest row.
    """
    every = np.arange(len(lens))
    yield every, every == 0
    group, done, longest = np.zeros(len(lens), np.int64), 0, int(lens.max(initial=0))
    while done < longest:
        active = np.flatnonzero(lens > done)
        width = int(max(1, min(WIDTH, CELLS // len(active), longest - done)))
        reach = np.minimum(lens[active] - done, width)
        column = np.arange(width)
        have = column < reach[:, None]
        matrix = np.full((len(active), width), -1, np.int64)
        matrix[have] = ids[(at[active, None] + done + column)[have]]
        order = np.lexsort((*matrix.T[::-1], group[active]))
        rows, matrix, reach = active[order], matrix[order], reach[order]
        change = np.ones(matrix.shape, bool)
        change[1:] = matrix[1:] != matrix[:-1]
        change[1:, 0] |= group[rows[1:]] != group[rows[:-1]]
        np.logical_or.accumulate(change, axis=1, out=change)
        for j in range(width):
            there = reach > j
            yield rows[there], change[there, j]
        group[rows] = np.cumsum(change[:, -1])
        done += width


@dataclass
class Layer:
    """The nodes of one depth in order; sums are over what is complete below them."""

    first: np.ndarray
    parent: np.ndarray
    size: np.ndarray
    n: np.ndarray
    least: np.ndarray
    kids: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    ended: np.ndarray  # rows that end here, by node, then id
    ended_node: np.ndarray
    closed: np.ndarray


@dataclass
class Rows:
    """Sequences with what is known of each of their prefixes, flat."""

    lens: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    parts: dict[str, np.ndarray]  # one value for each depth from 0 on

    def __post_init__(self):
        self.at = np.cumsum(self.lens) - self.lens


def conversations(conv_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Rows:
    none = np.zeros(len(ids) + len(lens), np.int64)
    parts = {"n": none + 1, "least": np.repeat(conv_ids, lens + 1), "kids": none, "leaves": none, "saved": none}
    return Rows(lens, ids, sizes, parts)


def layers(rows: Rows) -> list[Layer]:
    out, node = [], np.zeros(len(rows.lens), np.int64)
    for depth, (there, start) in enumerate(depths(rows.lens, rows.at, dense(rows.ids))):
        starts = np.flatnonzero(start)
        first = there[starts]
        own = rows.at[there] + there + depth
        sums = {p: np.add.reduceat(rows.parts[p][own], starts) for p in PARTS if p != "least"}
        least = np.minimum.reduceat(rows.parts["least"][own], starts)
        size = rows.sizes[rows.at[first] + depth - 1] if depth else np.zeros(1, np.int64)
        parent = node[first]
        node[there] = np.cumsum(start) - 1
        ended = there[rows.lens[there] == depth]
        ended = ended[np.lexsort((rows.parts["least"][rows.at[ended] + ended], node[ended]))]
        counts = [sums["n"], least, sums["kids"], sums["leaves"], sums["saved"]]
        out.append(Layer(first, parent, size, *counts, ended, node[ended], np.ones(len(first), bool)))
    return out


def _outer_path(found: list[Layer], last: bool) -> list[int]:
    """The nodes, one a depth, on the way to the first or last sequence."""
    path = [0]
    for depth in range(len(found) - 1):
        here = path[-1]
        if not last and (found[depth].ended_node == here).any():
            break
        parents = found[depth + 1].parent
        child = np.searchsorted(parents, here, "right") - 1 if last else np.searchsorted(parents, here)
        if not 0 <= child < len(parents) or parents[child] != here:
            break
        path.append(int(child))
    return path


def sum_up(found: list[Layer], open_paths: list[list[int]]) -> None:
    """Counts of children, leaves and saved bytes, from the deepest nodes up; open nodes get what is closed below them."""
    for path in open_paths:
        for depth, node in enumerate(path):
            found[depth].closed[node] = False
    for depth in range(len(found) - 1, -1, -1):
        here = found[depth]
        if depth + 1 < len(found):
            below = found[depth + 1]
            parent = below.parent[below.closed]
            np.add.at(here.kids, parent, 1)
            np.add.at(here.leaves, parent, below.leaves[below.closed])
            np.add.at(here.saved, parent, below.saved[below.closed])
        here.leaves[here.closed & (here.kids == 0)] = 1
        here.saved[here.closed] += ((here.n - 1) * here.size)[here.closed]


def _path_keys(rows: Rows, found: list[Layer], wanted: list[np.ndarray]) -> list[dict[int, str]]:
    """A digest of their turn ids for the wanted nodes of each depth; a node's parent is wanted, too."""
    keys, hashers = [], []
    for depth, nodes in enumerate(wanted):
        made = {}
        for node in map(int, nodes):
            if depth:
                hasher = hashers[-1][int(found[depth].parent[node])].copy()
                hasher.update(rows.ids[rows.at[found[depth].first[node]] + depth - 1].tobytes())
            else:
                hasher = hashlib.sha256()
            made[node] = hasher
        hashers.append(made)
        keys.append({node: hasher.hexdigest() for node, hasher in made.items()})
    return keys


def _id_list(rows: Rows, ended: np.ndarray) -> str:
    return ",".join(map(str, rows.parts["least"][rows.at[ended] + ended].tolist()))


def _record(kind: str, **columns) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values() if not isinstance(c, int))
    columns = {k: [v] * n if isinstance(v, int) else v for k, v in columns.items()} | {"kind": [kind] * n}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in OUT], schema=OUT)


def folded(rows: Rows, level: int, shard: int, final: bool) -> Iterator[pa.RecordBatch]:
    """All that a shard knows: its closed nodes, and of those that reach over its ends what is to be recombined.

    * ``node``: a complete node; if its parent is open, ``parent_key`` instead of the parent's id.
    * ``open``: the key of a node on the way to the shard's first or last sequence; other shards may hold more of it.
    * ``piece``: ids of the conversations that end at an open node, in order.
    * ``strand``: the first or last sequence with the sums of the open nodes on its way.
    """
    found = layers(rows)
    paths = [] if final else [_outer_path(found, last=False), _outer_path(found, last=True)]
    sum_up(found, paths)
    base = level == 0
    wanted = [np.flatnonzero(~f.closed) if base else np.arange(len(f.first)) for f in found]
    keys = _path_keys(rows, found, [w for w in wanted if len(w)])
    keys += [{}] * (len(found) - len(keys))
    for depth, here in enumerate(found):
        closed = np.flatnonzero(here.closed)
        parent_conv, parent_key = [None] * len(closed), [None] * len(closed)
        if depth:
            up = found[depth - 1]
            for k, p in enumerate(here.parent[closed].tolist()):
                if up.closed[p]:
                    parent_conv[k] = int(up.least[p])
                else:
                    parent_key[k] = keys[depth - 1][p]
        ends = [None] * len(closed)
        bounds = np.searchsorted(here.ended_node, np.arange(len(here.first) + 1))
        if base:
            for k, node in enumerate(closed.tolist()):
                ended = here.ended[bounds[node] : bounds[node + 1]]
                ends[k] = hashlib.sha256(_id_list(rows, ended).encode()).hexdigest()
        if len(closed):
            yield _record(
                "node", level=level, shard=shard, depth=depth, conv_id=here.least[closed], n_convs=here.n[closed],
                n_children=here.kids[closed], n_leaves=here.leaves[closed], saved_tokens=here.saved[closed], ends=ends,
                parent_conv_id=parent_conv, parent_key=parent_key, key=[None if base else keys[depth][n] for n in closed.tolist()],
            )
        for node in np.flatnonzero(~here.closed).tolist():
            yield _record("open", level=level, shard=shard, key=[keys[depth][node]])
            if base:
                ended = here.ended[bounds[node] : bounds[node + 1]]
                for piece, start in enumerate(range(0, len(ended), CHUNK)):
                    text = _id_list(rows, ended[start : start + CHUNK])
                    yield _record("piece", shard=shard, piece=piece, key=[keys[depth][node]], ends=[text])
    for side, path in enumerate(paths):
        if side and path == paths[0]:
            continue
        # The first strand has told of the nodes that both go through.
        shared = next(d for d, node in enumerate(path) if paths[0][d : d + 1] != [node]) if side else 0
        r = found[len(path) - 1].first[path[-1]]
        turns = slice(rows.at[r], rows.at[r] + len(path) - 1)
        values = {p: np.array([getattr(found[d], p)[node] for d, node in enumerate(path)], np.int64) for p in PARTS}
        for p in PARTS:
            values[p][:shared] = NOBODY if p == "least" else 0
        lists = {"ids": rows.ids[turns].ravel(), "sizes": rows.sizes[turns]} | values
        yield _record("strand", shard=shard, **{k: [v] for k, v in lists.items()})


def _flat(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _lens(sizes) -> np.ndarray:
    return np.array(pc.list_value_length(sizes).to_numpy(zero_copy_only=False), np.int64)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = list(batches)
    if sum(b.num_rows for b in batches):
        rows = pa.Table.from_batches(batches)
        ids, sizes = _flat(rows["ids"]).reshape(-1, 2), _flat(rows["sizes"])
        found = conversations(rows["conv_id"].to_numpy().astype(np.int64), _lens(rows["sizes"]), ids, sizes)
        yield from folded(found, 0, TaskContext.get().partitionId(), final=False)


def _gather(level: int, gathered: int, final: bool):
    def gather(strands: pa.Table) -> pa.Table:
        parts = {p: _flat(strands[p]) for p in PARTS}
        rows = Rows(_lens(strands["sizes"]), _flat(strands["ids"]).reshape(-1, 2), _flat(strands["sizes"]), parts)
        group = strands["shard"][0].as_py() // gathered
        return pa.Table.from_batches(list(folded(rows, level, group, final)), OUT)

    return gather


# -- on Spark ------------------------------------------------------------------------------------------


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as an array of (a, b, size): 123 bits of digest, text bytes."""
    role, text = text_or_empty("role"), text_or_empty("text")
    hashed = sha256_hex(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    number = lambda at, n: F.conv(F.substring(hashed, at, n), 16, 10).cast("long")
    a = number(1, 15)
    b = F.shiftleft(number(16, 15), 3).bitwiseXOR(number(31, 1))
    turn = F.struct("turn", a.alias("a"), b.alias("b"), F.octet_length(text).cast("long").alias("size"))
    listed = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kept = F.transform("turns", lambda t: F.struct(*[t[c].alias(c) for c in ("a", "b", "size")]))
    return listed.select("conv_id", kept.alias("turns"))


def with_heads(lists: DataFrame) -> DataFrame:
    """Every conversation c as the first h turns of conversation c - c % 5, then its own after the first h."""
    lists = write_and_read(lists, "turn-lists")
    head = F.slice("turns", 1, HEADS - 1).alias("head")
    donors = lists.filter(F.col("conv_id") % DONOR_EVERY == 0).select(F.col("conv_id").alias("donor"), head)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    donor = F.col("conv_id") - F.col("conv_id") % DONOR_EVERY
    none = F.slice("turns", 1, 0)
    taken = F.slice(F.coalesce("head", none), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return lists.join(donors, donor == F.col("donor"), "left").select("conv_id", F.concat(taken, own).alias("turns"))


def _hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of sorted pieces (key, ends): a list is hashed piece by piece and never held whole."""
    key, hasher = None, None
    for batch in batches:
        keys, ends = [], []
        for k, text in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if k != key:
                if hasher:
                    keys.append(key)
                    ends.append(hasher.hexdigest())
                key, hasher = k, hashlib.sha256(text.encode())
            else:
                hasher.update(b"," + text.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "ends_sha256": pa.array(ends, pa.string())})
    if hasher:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [hasher.hexdigest()]})


def prefix_trie(lists: DataFrame, shard_turns: int = SHARD_TURNS, gathered: int = GATHERED) -> DataFrame:
    """The nodes of the trie over conversations ``lists`` (conv_id, turns of (a, b, size)); see ``query`` for the columns.

    Conversations are range-partitioned by their turn ids, then conv_id, so a node's members are neighbours
    and equal conversations, however many, spread over shards. Each shard finds its nodes in padded matrices
    and sums every depth; nodes on the way to its first and last conversation may go on in the next shard.
    Their sums, two rows a shard, are recombined in the same way, 512 shards at a time, until none is open.
    Lists of ids that span shards are hashed piece after piece.

    * An empty conversation belongs to the root alone. No conversations give no root.
    * A conversation's turn ids (24 bytes a turn) are one row; texts are never moved.
    """
    spark = prepare(lists.sparkSession)
    flat = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"])))
    rows = write_and_read(lists.select("conv_id", flat.alias("ids"), F.col("turns.size").alias("sizes")), "trie-rows")
    turns = rows.agg(F.sum(F.size("sizes") + 1)).head()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    dealt = rows.repartitionByRange(shards, "ids", "conv_id")
    told = [write_and_read(dealt.mapInArrow(_shard, DDL), "trie-shards")]
    while True:
        strands = told[-1].filter("kind = 'strand'").select("shard", *LISTS)
        last = strands.agg(F.max("shard")).head()[0]
        if last is None:
            break
        near = strands.groupBy(F.expr(f"shard div {gathered}"))
        near = near.applyInArrow(_gather(len(told), gathered, final=last < gathered), DDL)
        told.append(write_and_read(near, "trie-boundaries"))
    every = told[0]
    for more in told[1:]:
        every = every.union(more)
    nodes = every.filter("kind = 'node'")
    # A shard's nodes look up their open parents among that shard's own few, so the root is no hot key.
    ids = told[0].select("key", "conv_id").limit(0)
    for more in told[1:]:
        ids = ids.union(more.filter("kind = 'node'").select("key", "conv_id"))
    ids = write_and_read(ids.select(F.col("key").alias("of"), F.col("conv_id").alias("found")), "trie-open")
    opened = every.filter("kind = 'open'").select("level", "shard", F.col("key").alias("parent_key"))
    opened = opened.join(ids, F.col("parent_key") == F.col("of")).drop("of")
    pieces = told[0].filter("kind = 'piece'").select("key", "shard", "piece", "ends")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "shard", "piece").select("key", "ends")
    lists_hashed = pieces.mapInArrow(_hashed_lists, "key string, ends_sha256 string")
    kept = ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "key", "parent_conv_id")
    nodes = nodes.select("level", "shard", "parent_key", *kept)
    within = nodes.filter("parent_key is null").select(*kept)
    across = nodes.filter("parent_key is not null").join(opened, ["level", "shard", "parent_key"], "left")
    across = across.withColumn("parent_conv_id", F.col("found")).select(*kept)
    both = within.union(across)
    done = both.filter("key is null").withColumn("ends_sha256", F.col("ends"))
    spanning = both.filter("key is not null").join(lists_hashed, "key", "left")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    none = sha256_hex(F.lit(""))
    return done.select(*names, "ends_sha256").union(spanning.select(*names, F.coalesce("ends_sha256", none)))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """A row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    * Rows without a conv_id belong to no conversation and are passed over. Null role or text counts as empty.
    * Turns ascend, null first; equal ones by a digest of role and text. Repeated rows are turns of their own.
    * An empty table has no nodes. Other columns are not read.
    """
    return prefix_trie(with_heads(turn_lists(table(spark, folder, "conversations"))))


ORACLE = f"""WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql('conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
    SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h
    UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
m AS (
    SELECT conv_id, row_number() OVER w AS depth, list(ROW(role, text)) OVER w AS path, strlen(text) AS size
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
    UNION ALL SELECT conv_id, 0, [], 0 FROM c),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (
    SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM m GROUP BY path, depth),
k AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
s AS (
    SELECT m.path, CAST(sum(CASE WHEN k.path IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
        CAST(sum((b.n_convs - 1) * b.size) AS BIGINT) AS saved
    FROM n b LEFT JOIN k ON k.path = b.path JOIN m ON m.conv_id = b.conv_id AND m.depth <= b.depth GROUP BY m.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves,
    s.saved AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN n p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]"""
