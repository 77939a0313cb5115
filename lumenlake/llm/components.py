"""Connected components of a stored edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import stored


def _jump(parents: DataFrame) -> DataFrame:
    """Follows parents to their roots; each round doubles the distance covered."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        moved = parents.join(up, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
        )
        moved = stored(moved, "components-jump")
        parents = moved.select("node", "parent")
        if moved.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: longs) to (node, root), where root is the smallest node of the component.

    Each round lets every node point to its smallest smaller neighbour, follows the pointers to
    the roots, and relabels the edges with them. The joins read stored tables on both sides, so
    adaptive execution can split a root that many nodes share. Nodes without an edge to another
    are not returned.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-edges")
    labels = None
    while not edges.isEmpty():
        roots = _jump(stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "components-parents"))
        if labels is None:
            ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            labels = stored(ends.join(roots, "node", "left").select("node", F.coalesce("parent", "node").alias("root")), "components-labels")
        else:
            up = roots.select(F.col("node").alias("root"), F.col("parent").alias("above"))
            labels = stored(labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "components-labels")
        for side in ("a", "b"):
            up = roots.select(F.col("node").alias(side), F.col("parent").alias("above"))
            edges = stored(edges.join(up, side, "left").withColumn(side, F.coalesce("above", side)).drop("above"), "components-relabelled")
        edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-edges")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return labels
