"""Merkle manifest of a table: a tree per group of rows, logs of its nodes in postorder, proofs read from the logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import ascii_lower, crc32_sql, prepare, ranked, sha256_hex, table
from feira.session import write_and_read

ARITY = 8
LEVELS = 3  # levels that one builder completes; a block of nodes is ARITY ** LEVELS
BLOCK = ARITY**LEVELS
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

SEGMENT = "tree long, block long, n long, m long, height int, log string"
PATHS = "tree long, i long, path string, subroot string, root string"
PROOF = ["doc_id", "leaf", "subroot", "root", "path", "folded"]


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode("ascii")).hexdigest()


def height_of(m: int) -> int:
    """Levels above ``m`` nodes until one is left."""
    height = 0
    while ARITY**height < m:
        height += 1
    return height


def appended_before(i: int) -> int:
    """Nodes that a log holds when leaf ``i`` is appended: the leaves before it and all nodes these complete."""
    total = 0
    while i:
        total += i
        i //= ARITY
    return total


def position(level: int, index: int, m: int) -> int:
    """Place of a node in the postorder log of a tree of ``m`` leaves.

    A node is complete with the last leaf below it, after its own descendants on that leaf's way up.
    """
    last = min((index + 1) * ARITY**level, m) - 1
    return appended_before(last) + level


def build(leaves: list[str], height: int) -> list[str]:
    """The log of the aligned tree over ``leaves``: every node is appended when its last child is."""
    log, runs = [], [[] for _ in range(height + 1)]

    def append(level: int, node: str) -> None:
        log.append(node)
        runs[level].append(node)
        if level < height and len(runs[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        append(level + 1, digest("".join(run)))

    for leaf in leaves:
        append(0, leaf)
    for level in range(height):
        if runs[level]:
            close(level)
    return log


def local_path(log: str, i: int, m: int, height: int) -> list[tuple[str, str]]:
    """(siblings to the left, siblings to the right) of leaf ``i`` and its ancestors, read from a segment's log."""
    path, width = [], m
    for level in range(height):
        run = i // ARITY * ARITY
        left = [position(level, j, m) for j in range(run, i)]
        right = [position(level, j, m) for j in range(i + 1, min(run + ARITY, width))]
        path.append(tuple("".join(log[HEX * p : HEX * p + HEX] for p in side) for side in (left, right)))
        i, width = i // ARITY, -(-width // ARITY)
    return path


def packed(path: list[tuple[str, str]]) -> str:
    return ",".join(f"{left}:{right}" for left, right in path)


def folded(leaf: str, path: str) -> str:
    """The root that ``leaf`` leads to with the siblings of ``path``."""
    for step in filter(None, path.split(",")):
        left, right = step.split(":")
        leaf = digest(left + leaf + right)
    return leaf


def _chained(*paths: str) -> str:
    return ",".join(filter(None, paths))


def _segment(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("i")
    n, m = int(rows["n"].iloc[0]), len(rows)
    height = LEVELS if n > BLOCK else height_of(n)
    log = "".join(build(rows["digest"].tolist(), height))
    first = rows.iloc[0]
    return pd.DataFrame([(first["tree"], first["i"] // BLOCK, n, m, height, log)], columns=["tree", "block", "n", "m", "height", "log"])


def _block() -> Column:
    return F.expr(f"i div {BLOCK}")


def logs(nodes: DataFrame) -> list[DataFrame]:
    """Log segments over ``nodes`` (tree, i, n, digest), the lowest tier first; n is the tree's number of nodes.

    A builder takes one aligned block of 512 nodes and writes the three levels above it; its last node is a
    node of the next tier. Tiers are added until the largest tree has one segment, so there is one round
    for each three levels. Only that tree's size reaches the driver.
    """
    tiers = []
    while True:
        segments = nodes.groupBy("tree", _block()).applyInPandas(_segment, SEGMENT)
        segments = write_and_read(segments, "merkle-log")
        tiers.append(segments)
        most = segments.agg(F.max("n")).head()[0]
        if most is None or most <= BLOCK:
            return tiers
        nodes = segments.select(
            "tree", F.col("block").alias("i"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), _top().alias("digest")
        )


def _top() -> Column:
    return F.substring("log", -HEX, HEX)


def _paths_below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for s in batch.itertuples():
            paths = [_chained(packed(local_path(s.log, i, s.m, s.height)), s.path) for i in range(s.m)]
            at = range(s.block * BLOCK, s.block * BLOCK + s.m)
            yield pd.DataFrame({"tree": s.tree, "i": at, "path": paths, "subroot": s.subroot, "root": s.root})


def _with_paths(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """Segments with the path of their last node."""
    above = paths.select(F.col("tree").alias("_tree"), F.col("i").alias("_i"), "path", "subroot", "root")
    return segments.join(above, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_i"))).drop("_tree", "_i")


def encoded(columns: list[Column]) -> Column:
    """The text a leaf is hashed from: each value's length in UTF-8 bytes, a colon and the value, or ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.concat(
        *[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    )


class Manifest:
    """The tree over all rows of a table, written to the shared folder as logs of its nodes.

    Rows of each ``group`` value ascend by ``order`` (null first), then by leaf digest, and are the leaves of
    that group's tree. While a tree has several nodes, every eight consecutive ones become their digest (the
    last run may be shorter, even one). The groups' roots, null first, then by UTF-8 bytes, are the leaves of
    one more tree of the same kind.

    ``extra`` names digests that are carried beside the leaves (``leaf`` is the own one).

    * A null value is hashed as ``-``; a null group is a group of its own; an empty text is ``0:``.
    * Repeated rows are equal leaves, each with its own place and proof.
    * A very long text is hashed where it is read and never moved: only digests are shuffled.
    * A group with most rows is split into blocks like any other. An empty table has no leaves and no root.
    * Columns that are not named are not read, so their names do not matter.
    """

    def __init__(
        self,
        docs: DataFrame,
        columns: tuple[str, ...] = COLUMNS,
        group: str = "lang",
        order: str = "doc_id",
        extra: dict[str, Column] | None = None,
    ):
        prepare(docs.sparkSession)
        more = [c.alias(f"extra_{name}") for name, c in (extra or {}).items()]
        leaf = sha256_hex(encoded([F.col(c) for c in columns])).alias("digest")
        leaves = docs.select(F.col(order).alias("id"), F.col(group).alias("lang"), leaf, *more)
        leaves = write_and_read(leaves, "merkle-leaves")  # texts are hashed once, not again for range bounds
        sizes = leaves.groupBy("lang").agg(F.count("*").alias("n"))
        self.trees = ranked(sizes, [], ["lang"]).select("lang", "n", (F.col("_rank") - 1).alias("tree"))
        self.trees = write_and_read(self.trees, "merkle-trees")
        placed = ranked(leaves, ["lang"], ["id", "digest"], extra=self.trees)
        self.leaves = write_and_read(placed.withColumn("i", F.col("_rank") - 1).drop("_rank", "lang"), "merkle-placed")
        self.tiers = logs(self.leaves.select("tree", "i", "n", "digest"))
        tops = self.tiers[-1].select(F.col("tree").alias("i"), _top().alias("digest"))
        total = self.trees.agg(F.count("*")).head()[0]
        self.root_tiers = logs(tops.select(F.lit(0).cast("long").alias("tree"), "i", F.lit(total).alias("n"), "digest"))

    def log(self) -> DataFrame:
        """(lang, level, index, position, digest): every node of the groups' trees, at its place in the tree's postorder."""
        rows = None
        for tier, segments in enumerate(self.tiers):
            part = segments.mapInPandas(_log_rows(tier), "tree long, level int, index long, digest string")
            rows = part if rows is None else rows.union(part)
        trees = self.trees.select("lang", "n", F.col("tree").alias("_tree"))
        rows = rows.join(trees, F.col("tree") == F.col("_tree"))
        last = F.least((F.col("index") + 1) * F.pow(F.lit(ARITY), "level").cast("long"), F.col("n")) - 1
        rows = rows.withColumn("last", last)
        before = " + ".join(f"last div {ARITY**k}" for k in range(21))  # appended_before
        return rows.select("lang", "level", "index", F.expr(f"{before} + level").alias("position"), "digest")

    def paths(self) -> DataFrame:
        """The lowest segments with the path of their last node, the group's root and the table's root."""
        none = self.root_tiers[-1].select(
            F.col("tree"), F.col("block").alias("i"), F.lit("").alias("path"), F.lit("").alias("subroot"), _top().alias("root")
        )
        paths = none
        for segments in reversed(self.root_tiers):
            paths = _with_paths(segments, paths).mapInPandas(_paths_below, PATHS)
        # A leaf of the last tree is a group's root; its path goes on below that group's topmost segment.
        tops = self.tiers[-1].select(F.col("tree").alias("_tree"), _top().alias("top"))
        paths = paths.join(tops, F.col("i") == F.col("_tree")).select(
            F.col("i").alias("tree"), F.lit(0).cast("long").alias("i"), "path", F.col("top").alias("subroot"), "root"
        )
        for segments in reversed(self.tiers[1:]):
            paths = _with_paths(segments, paths).mapInPandas(_paths_below, PATHS)
        return _with_paths(self.tiers[0], paths)

    def proofs(self, fold: str = "digest") -> DataFrame:
        """(doc_id, leaf, subroot, root, path, folded) for every row.

        ``path`` lists a step a level, ``left:right``, the digests beside the node, joined by commas;
        ``folded`` is the root that the digest column ``fold`` leads to with that path.
        """
        kind = dict(self.leaves.dtypes)["id"]

        def extract(rows: pa.Table, segment: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.table([rows["id"], *[pa.array([], pa.string())] * 5], names=PROOF)
            s = segment.to_pylist()[0]
            paths = [
                _chained(packed(local_path(s["log"], i % BLOCK, s["m"], s["height"])), s["path"])
                for i in rows["i"].to_pylist()
            ]
            roots = [folded(leaf, path) for leaf, path in zip(rows["start"].to_pylist(), paths, strict=True)]
            tops = [pa.array([s[name]] * rows.num_rows, pa.string()) for name in ("subroot", "root")]
            columns = [rows["id"], rows["digest"], *tops, pa.array(paths, pa.string()), pa.array(roots, pa.string())]
            return pa.table(columns, names=PROOF)

        rows = self.leaves.select("tree", "i", "id", "digest", F.col(fold).alias("start"))
        left = rows.withColumn("block", _block()).groupBy("tree", "block")
        right = self.paths().groupBy("tree", "block")
        schema = f"doc_id {kind}, " + ", ".join(f"{name} string" for name in PROOF[1:])
        return left.cogroup(right).applyInArrow(extract, schema)


def _log_rows(tier: int):
    below = LEVELS * tier

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples():
                out, width = [], s.m
                for level in range(s.height + 1):
                    if level or not tier:  # a segment's lowest nodes are the last nodes of the tier below
                        for i in range(width):
                            at = HEX * position(level, i, s.m)
                            index = s.block * (BLOCK // ARITY**level) + i
                            out.append((s.tree, below + level, index, s.log[at : at + HEX]))
                    width = -(-width // ARITY)
                yield pd.DataFrame(out, columns=["tree", "level", "index", "digest"])

    return rows


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(changed, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    other = sha256_hex(encoded([F.col(c) for c in COLUMNS[:-1]] + [text]))
    proofs = Manifest(docs, extra={"other": other}).proofs(fold="extra_other")
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        sha256_hex(F.translate("path", ":,", "")).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _oracle(levels: int = 8) -> str:
    """Both trees level by level: enough levels for 8 ** ``levels`` rows a group and as many groups."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    hashed = "sha256(" + " || ".join(field.format(c) for c in COLUMNS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = "sha256(" + " || ".join([*(field.format(c) for c in COLUMNS[:-1]), field.format(lower)]) + ")"
    parts = [
        f"""leaves AS (SELECT doc_id, lang, {hashed} AS leaf,
            CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {changed} ELSE {hashed} END AS start FROM documents)""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves)",
        "a0 AS (SELECT lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS m FROM placed)",
    ]

    def climb(name: str, tree: str) -> None:
        for level in range(levels):
            around = "string_agg(h, '') OVER (PARTITION BY {tree}i // 8 ORDER BY i ROWS BETWEEN {frame})"
            key = f"{tree}, " if tree else ""
            left = around.format(tree=key, frame="UNBOUNDED PRECEDING AND 1 PRECEDING")
            right = around.format(tree=key, frame="1 FOLLOWING AND UNBOUNDED FOLLOWING")
            parts.append(f"{name}p{level} AS (SELECT *, coalesce({left}, '') AS l, coalesce({right}, '') AS r FROM {name}{level})")
            parts.append(
                f"""{name}{level + 1} AS (SELECT {key}i, h, count(*) OVER ({f'PARTITION BY {tree}' if tree else ''}) AS m FROM (
                SELECT {key}i // 8 AS i, CASE WHEN min(m) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
                FROM {name}{level} GROUP BY {key}i // 8))"""
            )

    climb("a", "lang")
    parts.append(
        f"""b0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS m FROM a{levels})"""
    )
    climb("b", "")
    state = "f0 AS (SELECT doc_id, lang, leaf, i, start AS f, '' AS proof FROM placed)"
    parts.append(state)
    at = 0
    for name in "ab":
        for level in range(levels):
            same = "n.i = f.i" + (" AND n.lang IS NOT DISTINCT FROM f.lang" if name == "a" else "")
            parts.append(
                f"""f{at + 1} AS (SELECT f.doc_id, f.lang, f.leaf, f.i // 8 AS i, f.proof || n.l || n.r AS proof,
                CASE WHEN n.m = 1 THEN f.f ELSE sha256(n.l || f.f || n.r) END AS f
                FROM f{at} f JOIN {name}p{level} n ON {same})"""
            )
            at += 1
        if name == "a":
            parts.append(
                f"""f{at + 1} AS (SELECT f.doc_id, f.lang, f.leaf, b.i, f.proof, f.f FROM f{at} f
                JOIN b0 b ON b.lang IS NOT DISTINCT FROM f.lang)"""
            )
            at += 1
    return f"""WITH {', '.join(parts)}
    SELECT f.doc_id, f.leaf, s.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.f AS folded_root, f.f = t.h AS verified
    FROM f{at} f JOIN b0 s ON s.lang IS NOT DISTINCT FROM f.lang JOIN b{levels} t ON t.i = 0"""


ORACLE = _oracle()
