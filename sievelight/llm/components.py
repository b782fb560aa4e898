"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for every id in edges ``u, v``.

    In each round every vertex is replaced by its smallest neighbour or itself;
    loops and repeated edges vanish. A component's smallest vertex never moves,
    so what remains of it in the end is that vertex. Each round at least halves
    the vertices that still have edges.
    """
    edges = staged(edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    found: DataFrame | None = None
    last: DataFrame | None = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("to")), "cc-step")
        if found is None:
            found = step.select(F.col("u").alias("id"), F.col("to").alias("component"))
        else:
            moved = step.select(F.col("u").alias("component"), "to")
            found = found.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        found = staged(found, "cc-found")
        discard(last)
        last = found
        a = step.select("u", F.col("to").alias("a"))
        b = step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        next_edges = edges.join(a, "u").join(b, "v").where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        smaller = staged(next_edges, "cc-edges")
        discard(edges, step)
        edges = smaller
        if edges.isEmpty():
            discard(edges)
            return found
