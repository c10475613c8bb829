"""Connected components of a graph of any size, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component), component the smallest node reachable.

    Every round hooks each node to its smallest neighbour, follows that twice,
    and replaces the edges by those between the nodes reached, which are far
    fewer; the rounds end when none is left. Both sides of every join are
    written tables, so a node with very many edges is split among tasks. Null
    ends are ignored, loops make their node known. No edges give no rows.
    """
    e = edges.where("a is not null and b is not null").select("a", "b")
    hooks: list[DataFrame] = []
    while True:
        both = e.union(e.select("b", "a")).toDF("node", "other")
        parent = stage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("p")), "parents")
        for _ in range(2):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("node", F.col("pp").alias("p"))
        parent = stage(parent, "parents")
        hooks.append(parent)
        a, b = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        e = e.join(a, "a").join(b, "b").where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
        e = stage(e.distinct(), "edges")
        if e.isEmpty():
            break
    found = hooks.pop()
    while hooks:
        lower = hooks.pop()
        found = lower.join(found.toDF("p", "c"), "p", "left").select("node", F.coalesce("c", "p").alias("p"))
    return found.toDF("node", "component")
