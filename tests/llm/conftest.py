"""Small tables with the odd cases that every operator has to bear."""

import random

import pytest

WORDS = "red blue green old new big small long short round flat warm cold wet dry loud calm fast slow kind".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Plain, equal, near, empty, null, very long and repeated rows; null ids; columns with clashing names."""
    base = prose(1, 120)
    rows = [
        (1, base, "a"),
        (2, base, "a"),
        (3, base + " and one more ending", "b"),
        (4, prose(2, 90), "b"),
        (5, prose(3, 90), None),
        (6, "", "c"),
        (7, None, "c"),
        (8, "too short", "c"),
        (9, "\n".join(prose(9 + i % 50, 30) for i in range(3000)), "a"),
        (9, "\n".join(prose(9 + i % 50, 30) for i in range(3000)), "a"),
        (None, prose(4, 60), "b"),
        (None, None, None),
    ]
    # The extra columns bear names that operators use for their results or inside.
    extra = ["size", "score", "copies", "n_lines", "spans", "_rank", "digest", "component", "label", "bag"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
