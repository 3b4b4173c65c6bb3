"""The manifest against a tree built by hand, its logs against a recursive postorder."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from feira.llm import merkle

from .test_operators import rows_of


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    out = ""
    for value in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]):
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(out)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def proof(levels, i):
    steps = []
    for below in levels[:-1]:
        run = below[i // 8 * 8 : i // 8 * 8 + 8]
        steps.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return steps


def fold(digest, steps):
    for left, right in steps:
        digest = sha("".join([*left, digest, *right]))
    return digest


def by_hand(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r["lang"] == g), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in members]) for g, members in groups.items()}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            steps = proof(trees[g], i) + proof(top, k)
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                changed["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            end = fold(leaf(changed), steps)
            hashed = sha("".join("".join(a + b) for a, b in steps))
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], hashed, end, end == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, i string, digest string"


@pytest.fixture(scope="module")
def many(spark):
    """Groups of 1, 8, 9, 520 and 4,200 rows and twelve more; nulls, repeated rows, columns with inner names."""
    sizes = {None: 8, "": 1, "a": 9, "é": 520, "hot": 4200} | {f"z{k}": k + 1 for k in range(12)}
    rows, n = [], 0
    for lang, size in sizes.items():
        for k in range(size):
            n += 1
            text = None if k % 7 == 3 else "" if k % 7 == 4 else f"Text {n % 50} Ünï"
            rows.append((n * 37 % 10007, None if k % 5 else f"s{k % 3}", lang, n if k % 4 else None, text, "x", "y", "z"))
    rows += [rows[-1], (None, None, "hot", None, None, "x", "y", "z"), (None, None, "hot", 1, "Null id", "x", "y", "z")]
    rows.append((1, "long", "a", 1, "Very long " * 50000, "x", "y", "z"))
    return spark.createDataFrame(rows, SCHEMA)


def test_manifest_matches_a_tree_built_by_hand(spark, many, tmp_path):
    many.write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = rows_of(merkle.query(spark, str(tmp_path)), *names)
    want = by_hand([r.asDict() for r in many.collect()])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_logs_are_in_postorder(many):
    log = merkle.Manifest(many.filter("lang in ('a', 'hot')")).log()
    for lang in ("a", "hot"):
        rows = rows_of(log.filter(F.col("lang") == lang).orderBy("position"), "position", "level", "index", "digest")
        assert [r[0] for r in rows] == list(range(len(rows)))
        levels = tree([r[3] for r in sorted(rows, key=lambda r: r[2]) if r[1] == 0])

        def walk(level, i, levels=levels):
            if level:
                for j in range(8 * i, min(8 * i + 8, len(levels[level - 1]))):
                    yield from walk(level - 1, j)
            yield (level, i, levels[level][i])

        assert [r[1:] for r in rows] == list(walk(len(levels) - 1, 0))


def test_one_row_and_no_rows(spark, many):
    one = merkle.Manifest(many.filter("lang = ''")).proofs().collect()
    assert len(one) == 1 and one[0].path == "" and one[0].leaf == one[0].subroot == one[0].root == one[0].folded
    assert merkle.Manifest(many.limit(0)).proofs().count() == 0


def test_closed_form_positions_are_places_in_the_built_log():
    for m in [*range(1, 80), 511, 512, 513, 600]:
        leaves = [sha(str(i)) for i in range(m)]
        log, levels = merkle.build(leaves, merkle.height_of(m)), tree(leaves)
        for level, nodes in enumerate(levels):
            assert [log[merkle.position(level, i, m)] for i in range(len(nodes))] == nodes
