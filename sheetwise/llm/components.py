"""Connected components of a graph given by its links, by rounds of contraction.

Each round hooks every node to its smallest neighbour if that is smaller, follows these pointers to
the end, replaces the ends of all links by their roots, and drops links within a root. Neighbours
are compared by hash aggregation, so a node with very many links is combined inside each task
first; joins on a hot node are skew joins that the planner can split. Every round is written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import stored


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``(node, parent)`` to nodes that have no parent; depth halves with each jump."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = stored(
            parents.join(up, "parent", "left").select(
                "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
            ),
            "roots",
        )
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for all ends of ``links(a, b)``; the root is the same for linked nodes."""
    links = stored(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    labels = None
    while not links.isEmpty():
        # links run from the smaller to the larger end, so every b hooks to its smallest a
        roots = _roots(stored(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents"))
        fresh = links.select(F.col("a").alias("node")).distinct().join(roots, "node", "left_anti")
        rooted = roots.select("node", F.col("parent").alias("root")).unionByName(fresh.select("node", F.col("node").alias("root")))
        if labels is None:
            labels = stored(rooted, "labels")
        else:
            up = roots.select(F.col("node").alias("root"), F.col("parent").alias("above"))
            labels = stored(
                labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels"
            )
        a = roots.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        b = roots.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        moved = links.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
        )
        links = stored(
            moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "links",
        )
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
