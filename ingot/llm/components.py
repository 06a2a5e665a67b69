"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingot.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """Per node of ``edges`` (a, b): node, root; nodes have one root if and only if they are connected.

    Each round lets every node take the smallest of itself and its neighbours as its label, and goes on
    with the edges between different labels. A hub costs no more than its edges: minima
    are taken before the shuffle, and the labels' side of a join has one row per node.
    """
    edges = materialise(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    labels = []
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        step = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
        labels.append(step)
        ends = edges.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b")
        edges = ends.filter(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = materialise(edges)
        if not edges.limit(1).count():
            break
    roots = labels[0].withColumnRenamed("label", "root")
    for later in labels[1:]:
        roots = roots.join(later.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialise(roots)
