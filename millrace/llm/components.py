"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graphs


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of an edge; edges with a null end join nothing.

    Edges are contracted round by round, so rounds do not grow with the length
    of a chain of copies, and are written as tables to the shared folder.
    """
    rows = edges.select(F.lit(0).alias("g"), F.col(a).alias("u"), F.col(b).alias("v"))
    return graphs.components(rows, "g", "u", "v").select("node", "root")
