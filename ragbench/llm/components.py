"""Connected components of a link table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragbench.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node of a link.

    Each round takes, for every node, the least of its label, its neighbours' labels and its label's label, so
    paths shorten by half. Rounds are written to the shared folder. A hub is one join key with many rows on one
    side, which a sort-merge join splits; minima are combined before the shuffle.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y")
    edges = stored(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stored(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.hint("merge"), edges["x"] == labels["node"]).select(F.col("y").alias("node"), "label")
        up = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
        jump = up.join(labels.hint("merge"), up["l"] == labels["node"]).select(F.col("n").alias("node"), "label")
        own = labels.select("node", "label", F.col("label").alias("old"))
        new = stored(
            own.unionByName(near.unionByName(jump), allowMissingColumns=True).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")),
            "labels",
        )
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return labels
