"""Connected components of a distributed graph: every vertex gets the least vertex it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) for each vertex of links (x, y: longs). Each round takes the least label among a vertex and its
    neighbours, then the label of that label, so labels travel over twice as long paths each time. Labels are written
    after each round; only whether there was a change comes to the driver. No links: no rows."""
    both = links.where("x <> y").select("x", "y")
    edges = scratch.stage(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = scratch.stage(edges.groupBy(F.col("x").alias("v")).agg(F.least("v", F.min("y")).alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["y"] == labels["v"]).groupBy("x").agg(F.min("root").alias("near"))
        least = labels.join(near, labels["v"] == near["x"]).select("v", F.col("root").alias("was"), F.least("root", "near").alias("to"))
        of = labels.select(F.col("v").alias("to"), F.col("root").alias("further"))
        new = scratch.stage(least.join(of, "to").select("v", F.least("to", "further").alias("root"), "was"), "labels")
        changed = new.where("root <> was").limit(1).count()
        scratch.drop(labels)
        if not changed:
            scratch.drop(edges)
            return new.select("v", "root")
        labels = new
