"""Connected components of edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import written

#: Rounds, each of which at least halves the nodes that still have edges, and jumps, each of which halves the paths; more cannot be needed.
MOST_ROUNDS = 64


def _roots(parents: DataFrame) -> DataFrame:
    """(g, u, p) with ``p`` replaced by the end of the path of parents, which is its own parent."""
    for _ in range(MOST_ROUNDS):
        above = parents.select("g", F.col("u").alias("p"), F.col("p").alias("far"))
        jumped = written(parents.join(above, ["g", "p"]).select("g", "u", F.col("far").alias("p"), (F.col("far") != F.col("p")).alias("moved")))
        parents = jumped.select("g", "u", "p")
        if jumped.filter("moved").isEmpty():
            return parents
    raise RuntimeError(f"paths did not end in {MOST_ROUNDS} jumps")


def components(edges: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, node, root): the smallest node that undirected edges connect a node with, inside its group.

    In each round every node goes to its smallest neighbour, and on to the end
    of that path; the ends are the nodes of the next round, joined by the edges
    that are left between different ones.  Ends have no smaller neighbour, so at
    most half of the nodes stay and edges inside a part vanish early.  Where no
    edge is left, the steps are joined from the last to the first, so that most
    rows are joined on many different ends.  All joins are on (group, node) and
    are written out: neither a group nor a component has to fit into a task.
    An edge with a null end or group joins nothing.
    """
    one = edges.select(F.col(group).alias("g"), F.col(a).alias("u"), F.col(b).alias("v")).filter("g is not null and u is not null and v is not null")
    both = written(one.unionByName(one.select("g", F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    steps: list[DataFrame] = []
    for _ in range(MOST_ROUNDS):
        step = _roots(both.groupBy("g", "u").agg(F.least(F.col("u"), F.min("v")).alias("p")))
        steps.append(step)
        from_u, from_v = step.select("g", "u", F.col("p").alias("pu")), step.select("g", F.col("u").alias("v"), F.col("p").alias("pv"))
        both = written(both.join(from_u, ["g", "u"]).join(from_v, ["g", "v"]).filter("pu <> pv").select("g", F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
        if both.isEmpty():
            root = steps.pop()
            while steps:
                later = root.select("g", F.col("u").alias("p"), F.col("p").alias("root"))
                root = written(steps.pop().join(later, ["g", "p"], "left").select("g", "u", F.coalesce("root", "p").alias("p")))
            return root.select(F.col("g").alias(group), F.col("u").alias("node"), F.col("p").alias("root"))
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
