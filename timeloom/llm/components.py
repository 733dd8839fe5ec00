"""Connected components of a table of edges, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.plans.session import release, stage


def connected(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges`` (a, b) reaches: columns node, component.

    Every round a node takes the smallest label among those of its neighbours and of the node that its own
    label names, so the number of rounds grows with the logarithm of the longest path.  A round is one join
    and one grouping: a node's own label comes along as one more row, since the driver holds plans, stages
    and tasks of all rounds.  Each round is written to the shared folder.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        own = labels.select(F.col("node").alias("a"), F.col("component").alias("b"), F.col("component").alias("own"))
        looks = both.select("a", "b", F.lit(None).alias("own")).union(own)
        far = labels.select(F.col("node").alias("b"), F.col("component").alias("far"))
        new = looks.join(far, "b").groupBy(F.col("a").alias("node")).agg(
            F.min("far").alias("component"), F.max("own").alias("own"))
        new = stage(new.select("node", "component", (F.col("component") != F.col("own")).alias("moved")), "labels")
        release(labels)
        labels = new
        if not new.where("moved").take(1):
            release(both)
            return new.select("node", "component")
