"""Connected components of a graph given by links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.tables import keep


def _jump(parents: DataFrame, label: str) -> DataFrame:
    """(node, parent) with every parent a root: parents of parents until none has another."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
        parents = keep(
            parents.join(above, "parent").select("node", F.col("_above").alias("parent"), F.col("parent").alias("_was")),
            label,
        )
        if parents.filter(F.col("parent") != F.col("_was")).isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the root is the smallest node of its component.

    Each round points every node to its smallest neighbour (or itself), follows the pointers to
    their roots, and goes on with the links between roots. A component's nodes at least halve in
    each round and the smallest stays its own root. All steps are joins of written tables; a
    node with very many links is a skewed key that adaptive execution splits.

    Null ends and links from a node to itself link nothing. No links give no rows.
    """
    pairs = keep(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        label,
    )
    roots = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("_low"))
        parents = keep(lowest.select(F.col("a").alias("node"), F.least("a", "_low").alias("parent")), label)
        parents = _jump(parents, label)
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            onward = parents.select(F.col("node").alias("root"), "parent")
            roots = keep(
                roots.join(onward, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), label
            )
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        half = keep(pairs.join(left, "a").select("_a", "b"), label)
        between = half.join(right, "b").filter(F.col("_a") != F.col("_b"))
        pairs = keep(
            between.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), label
        )
    return roots if roots is not None else pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
