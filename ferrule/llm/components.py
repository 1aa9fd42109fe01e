"""Connected components of an undirected graph, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import written
from ferrule.plans.store import discard


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge in ``edges`` (a, b: long); root is the least node it reaches.

    Each round points every node to its least neighbour, follows these pointers to their ends by doubling, and joins
    each tree into one node. At least half of the nodes that still have edges go in a round. Minima are pre-aggregated,
    so a node with very many edges is no burden to one task; each step is written, so it isn't done again, and is deleted
    when the next one is.
    """
    found: DataFrame | None = None
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = pointers = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "pointers")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            moved = written(up.join(above, "root", "left").select("node", "root", F.coalesce("top", "root").alias("top")), "pointers")
            discard(pointers)
            pointers, up = moved, moved.select("node", F.col("top").alias("root"))
            if moved.where("root <> top").isEmpty():
                break
        later = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        before, found = found, written(up if found is None else found.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        if before is not None:
            discard(before)
        a, b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = edges.join(a, "a").join(b, "b").where("ra <> rb")
        rest = written(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(edges, pointers)
        edges = rest
    if found is None:
        return written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
    discard(edges)
    return found
