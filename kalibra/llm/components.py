"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)`` that reaches a smaller one; ``label`` is the smallest.

    Each round every node takes its smallest smaller neighbour as parent, parents are followed to their roots,
    and the edges between roots go on. The number of roots with edges at least halves per round; nothing but
    counts reaches the driver.
    """
    labels = None
    rest = edges.select("a", "b")
    while True:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = materialise(both.groupBy("a").agg(F.min("b").alias("label")).where("label < a").withColumnRenamed("a", "node"), "parents")
        while True:
            above = parents.select(F.col("node").alias("label"), F.col("label").alias("higher"))
            jumped = materialise(
                parents.join(above, "label", "left").select("node", F.coalesce("higher", "label").alias("label"), F.col("higher").isNotNull().alias("moved")), "parents"
            )
            moved = jumped.where("moved").limit(1).count()
            parents = jumped.select("node", "label")
            if not moved:
                break
        if labels is None:
            labels = parents
        else:
            onward = parents.select(F.col("node").alias("label"), F.col("label").alias("higher"))
            labels = labels.join(onward, "label", "left").select("node", F.coalesce("higher", "label").alias("label")).unionByName(parents)
        ends = []
        for side in ("a", "b"):
            rest = rest.join(parents.select(F.col("node").alias(side), F.col("label").alias(f"{side}_root")), side, "left")
            ends.append(F.coalesce(f"{side}_root", side))
        rest = materialise(rest.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).where("a < b").distinct(), "edges")
        if not rest.limit(1).count():
            return materialise(labels, "labels")
