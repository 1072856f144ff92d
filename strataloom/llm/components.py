"""Connected components by contraction, with nothing but joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """(id, comp) of each node in edges (a, b): comp is the smallest id that the node reaches.

    Each round every node points to its smallest neighbour, pointers are followed twice, and edges are drawn again
    between the nodes pointed to. Chains halve at least, stars end at once. A hub's edges are reduced to one row a task
    before they are shuffled. No edges give no rows; loops and repeated edges do no harm.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = written(left.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    labels = nodes.withColumn("comp", F.col("id"))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "pointers")
        for _ in range(2):
            then = to.select(F.col("a").alias("p"), F.col("p").alias("q"))
            to = to.join(then, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        to = written(to, "pointers")
        labels = written(labels.join(to, labels.comp == to.a, "left").select("id", F.coalesce("p", "comp").alias("comp")), "labels")
        ends = lambda side: to.select(F.col("a").alias(side), F.col("p").alias(f"p_{side}"))  # noqa: B023, E731
        moved = left.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
        left = written(moved.select(F.coalesce("p_a", "a").alias("a"), F.coalesce("p_b", "b").alias("b")).where("a <> b").distinct(), "edges")
    return labels
