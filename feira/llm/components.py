"""Connected components of a table of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.session import write_and_read


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b); a component is named by its least node.

    In every round a node points to the least of itself and its neighbours, and then to where that one points. Nodes
    are merged with what they point to, links are renamed, and those inside a merged node go, so what is
    left shrinks by more than half a round. Rounds are written to the shared folder; joins have plain
    shuffles on both sides, so a node with very many links is split. Only whether links are left
    reaches the driver.
    """
    rest = write_and_read(_between(links, "a", "b"), "links")
    names = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    names = write_and_read(names.withColumn("component", F.col("node")), "components")
    while rest.head(1):
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("to"))
        near = near.select("from", F.least("from", "to").alias("to"))
        further = near.select(F.col("from").alias("_from"), F.col("to").alias("_to"))
        near = near.join(further, F.col("to") == F.col("_from")).select("from", F.col("_to").alias("to"))
        near = write_and_read(near, "pointers")
        moved = names.join(near, F.col("component") == F.col("from"), "left")
        names = write_and_read(moved.select("node", F.coalesce("to", "component").alias("component")), "components")
        a = near.select(F.col("from").alias("a"), F.col("to").alias("_a"))
        b = near.select(F.col("from").alias("b"), F.col("to").alias("_b"))
        rest = write_and_read(_between(rest.join(a, "a").join(b, "b"), "_a", "_b"), "links")
    return names


def extended(names: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``names`` (node, component) with more links (a, b), whose nodes may be new.

    Links are first renamed to the components they join, so only what they change is gone through again.
    """
    a = names.select(F.col("node").alias("a"), F.col("component").alias("_a"))
    b = names.select(F.col("node").alias("b"), F.col("component").alias("_b"))
    renamed = links.join(a, "a", "left").join(b, "b", "left")
    merged = components(renamed.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    moved = merged.select(F.col("node").alias("from"), F.col("component").alias("to"))
    known = names.join(moved, F.col("component") == F.col("from"), "left")
    known = known.select("node", F.coalesce("to", "component").alias("component"))
    return write_and_read(known.union(merged.join(names, "node", "left_anti")), "components")


def _between(links: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links between different nodes, the lesser first."""
    ordered = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ordered.filter("a <> b").distinct()
