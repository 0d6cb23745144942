"""Connected components of an edge table by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledger_spark.session import written


def _flat(parents: DataFrame) -> DataFrame:
    """`parents` (node, label, no larger than node) with each label replaced by the root above it; paths halve in each step."""
    while True:
        inner = parents.where("label <> node").select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(parents.join(inner, "label", "left").select(
            "node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")), "labels")
        parents = after.select("node", "label")
        if after.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of `edges` (a, b, both long): the smallest node reachable.

    Each node points to the least of its neighbours and itself.  These pointers form trees, which are flattened and
    contracted to their roots, the least nodes of each.  A tree has two nodes or more, so each contraction at least
    halves the nodes that still have edges, whatever the diameter, and it goes on until no edges are left.  Each
    step is written to the shared folder.  Self-loops and repeated edges do no harm; rows with a null end are left
    out; no edges give no rows.
    """
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = written(edges.where("a is not null and b is not null and a <> b").select(least, most).distinct(), "edges")
    levels: list[DataFrame] = []
    while not levels or not links.isEmpty():
        both = links.union(links.select(F.col("b"), F.col("a")))
        level = _flat(written(both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.col("node")).alias("label")), "labels"))
        levels.append(level)
        ends = links
        for end in ("a", "b"):
            root = level.select(F.col("node").alias(end), F.col("label").alias("root"))
            ends = ends.join(root, end).drop(end).withColumnRenamed("root", end)
        links = written(ends.where("a <> b").select(least, most).distinct(), "edges")
    labels = levels.pop()
    while levels:
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = written(levels.pop().join(above, "label", "left").select(
            "node", F.coalesce("next", "label").alias("label")), "labels")
    return labels
