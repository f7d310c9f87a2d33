"""Connected components of a graph of links, kept distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; component is the smallest node reached.

    Each round hangs every node under the first of its neighbours and itself in
    the order of a hash, takes one more step up, and joins the ends of the links
    to their new nodes. Links within one node vanish. In a random order a fixed
    share of the nodes vanishes each round, long chains included. A hub's links
    are summed map-side, so a hot hub needs no task of its own.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    steps = []
    while True:
        edges = cut(ends.where("a != b").distinct())
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        own, low = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("x")), F.min(F.struct(F.xxhash64("other").alias("h"), F.col("other").alias("x")))
        up = both.groupBy("node").agg(low.alias("low")).select("node", F.least(own, F.col("low"))["x"].alias("up"))
        top = up.join(up.toDF("k", "top"), F.col("up") == F.col("k"), "left").select("node", F.coalesce("top", "up").alias("up"))
        steps.append(cut(top))
        ends = edges.join(steps[-1].toDF("a", "x"), "a").join(steps[-1].toDF("b", "y"), "b")
        ends = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if not steps:
        return edges.toDF("node", "component")
    labels = steps[0].toDF("node", "root")
    for step in steps[1:]:
        labels = labels.join(step.toDF("k", "to"), F.col("root") == F.col("k"), "left").select("node", F.coalesce("to", "root").alias("root"))
    labels = cut(labels)
    lowest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return cut(labels.join(lowest, "root").select("node", "component"))
