"""The pipeline against its stages worked out by hand, on odd rows and without labels."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from feira.llm import decontaminate, line_dedup, mixing

from .conftest import prose
from .test_operators import grams, jaccard, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_row` string"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus():
    """Clean documents, exact and near copies, shared lines, a benchmark passage, empty, null and repeated rows."""
    rng, rows = random.Random(3), []
    for i in range(60):
        rows.append((i, "\n".join(prose(1000 + 5 * i + k, 25) for k in range(4)), "en", f"s{i % 3}", None, "x"))
    rows += [(100 + i, rows[i][1], "en", "s1", None, "x") for i in range(5)]
    rows += [(200 + i, rows[10 + i][1] + " and a little more", "en", None, None, "x") for i in range(5)]
    rows += [(300 + i, f"{prose(5000 + i, 40)}\nThe same  line everywhere \n{prose(6000 + i, 30)}", "en", "s2", 7, "x") for i in range(14)]
    rows += [(400 + i, f"{prose(7000 + i, 40)} {prose(8000, 30)} {prose(7100 + i, 20)}", "en", "s0", 7, "x") for i in range(3)]
    rows += [(500, "", "en", "s0", 0, "x"), (501, None, None, None, None, None), (502, prose(1, 50), "en", "s0", 1, "x")]
    rows += [rows[-1], (None, prose(2, 60), "en", "s0", 1, "x")]
    rng.shuffle(rows)
    return rows


def folder(spark, path, rows, labels=(), benchmark=()):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def less_lines(rows):
    keys = lambda text: [x.strip(" \t\n\x0b\f\r").lower() for x in (text or "").split("\n")]
    found = defaultdict(set)
    for r in rows:
        for key in filter(None, keys(r[1])):
            found[key].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        text = "\n".join(x for x, key in zip(lines, keys(r[1]), strict=True) if len(found[key]) < 10)
        out.append((r[0], text, *r[2:4], len(text), r[5]))
    return out


def classes(rows):
    label, sets = list(range(len(rows))), [grams(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    groups = defaultdict(list)
    for x, r in zip(label, rows, strict=True):
        groups[x].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def holds(text, item):
    points = lambda x: [ord(c) for c in decontaminate.plain(x)]
    return decontaminate.distance(points(item), points(text or ""), len(item) // 10) is not None


def test_the_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "decontamination", "mixing"]


def test_without_labels_the_pipeline_matches_its_stages_by_hand(spark, corpus, tmp_path):
    """Nothing can be fitted, so no document is rejected; each further stage works on all that the one before kept."""
    item = prose(8000, 30)
    at = folder(spark, tmp_path, corpus, benchmark=[(1, item), (None, "x" * 40), (2, None)])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = STAGES["quality"](spark, docs, at)
    assert Counter(map(tuple, kept.collect())) == Counter(corpus)
    lines = STAGES["line_dedup"](spark, kept, at)
    by_hand = less_lines(corpus)
    assert Counter(map(tuple, lines.collect())) == Counter(by_hand) and lines.columns == docs.columns
    assert not any("same  line" in r[1] for r in by_hand)
    one_each = STAGES["near_copies"](spark, lines, at)
    by_hand = classes(by_hand)
    assert Counter(rows_of(one_each, "doc_id")) == Counter((r[0],) for r in by_hand) and one_each.columns == docs.columns
    clean = STAGES["decontamination"](spark, one_each, at)
    by_hand = [r for r in by_hand if not holds(r[1], item)]
    assert Counter(rows_of(clean, "doc_id", "text", "_row")) == Counter((r[0], r[1], r[5]) for r in by_hand)
    assert clean.columns == docs.columns and one_each.count() - clean.count() == 3
    mixed = STAGES["mixing"](spark, clean, at)
    size = defaultdict(int)
    for r in by_hand:
        size[r[3]] += len(r[1].split())
    goals = {r.source: r.target for r in mixing.mix(clean).select("source", "target").distinct().collect()}
    taken = defaultdict(int)
    for r in mixed.collect():
        assert 1 <= r.copy <= 3
        taken[r.source] += len(r.text.split())
    longest = max(len(r[1].split()) for r in by_hand)
    for source, words in size.items():
        assert abs(taken[source] - goals[source]) <= 2 * longest
    whole = corpus_pipeline.run(spark, at)
    assert whole.columns == [*docs.columns, "copy"]
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, mixed.collect()))


def test_where_all_is_labelled_the_labelled_serve_as_unlabelled(spark, tmp_path):
    """Otherwise nothing could be fitted and every document would stay."""
    rng = random.Random(1)
    good = [(i, prose(i, 60 + i % 40), "en", "s", 1, "x") for i in range(150)]
    bad = [(1000 + i, " ".join(rng.choice("#$%&@!") * rng.randrange(1, 9) for _ in range(40)), "en", "s", 1, "x") for i in range(150)]
    at = folder(spark, tmp_path, good + bad, [(r[0], int(r[0] < 1000), 0) for r in good + bad])
    kept = {r[0] for r in rows_of(STAGES["quality"](spark, spark.read.parquet(f"{at}/documents.parquet"), at), "doc_id")}
    assert len(kept & {r[0] for r in good}) > 100 and len(kept & {r[0] for r in bad}) < 30


def test_an_empty_corpus_gives_an_empty_mix(spark, tmp_path):
    at = folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, at).count() == 0


INNER = ["_row", "_pos", "_key", "_id", "_id_row", "_dropped", "_n", "_part", "_place", "_base", "_base_part", "_rank", "_shuffled", "_text", "_empty", "_found", "caller0_row"]


@pytest.mark.parametrize("name", ["line_dedup", "mix", "clean"])
def test_callers_columns_of_any_name_pass_through(spark, name):
    bench = spark.createDataFrame([(1, prose(3, 40))], "item_id long, text string")
    operator = {"line_dedup": line_dedup.line_dedup, "mix": mixing.mix, "clean": lambda d: decontaminate.clean(d, bench)}[name]
    rows = [(i, prose(i, 30 + i), f"s{i % 2}", *[f"{c}{i}" for c in INNER]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in INNER))
    out = operator(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(tuple, out.select(*docs.columns).collect())) == rows
