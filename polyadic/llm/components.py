"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_scratch, write_scratch

#: A node with more neighbours than this, or than a HUBS-th of all edges, is a hub; so there are 2 * HUBS hubs at most.
HUB_EDGES, HUBS = 200, 10_000
#: So few edges are one task's work, without exchanges and hubs.
ONE_TASK = 50_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, large: bool, hub_edges: int | None) -> DataFrame:
    """Hang neighbours on the smallest one; sums before it joins, and broadcasts the few hubs' rows.

    Without ``hub_edges`` all is one task.
    """
    if hub_edges is None:
        pairs = pairs.coalesce(1)
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
    if hub_edges is None:
        joined = pairs.join(least.select("u", "m"), "u")
    else:
        hubs = F.broadcast(least.where(F.col("c") > hub_edges).select("u", "m"))
        rest = pairs.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("c") <= hub_edges).select("u", "m"), "u")
        joined = rest.unionByName(pairs.join(hubs, "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m <> u").select("u", F.col("m").alias("v")))
    return (out.coalesce(1) if hub_edges is None else out).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge goes from a node that has no other one to a root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("goes")), F.struct(F.col("v").alias("x"), F.lit(0).alias("goes")))).alias("end")).select("end.x", "end.goes")
    counts = ends.groupBy("x").agg(F.sum("goes").alias("goes"), F.min("goes").alias("least"))
    return counts.where("goes > 1 or (goes = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is its smallest reachable node.

    Each round is written to the shared folder, so lineage stays short; rounds go on until nothing
    changes any more.  Self-links and repeated edges are harmless; no edges give no rows.  The result
    is a written intermediate.
    """
    current = write_scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    rows = current.count()  # rounds never add edges beyond the vertices' number
    few = rows <= ONE_TASK
    hub_edges = None if few else max(HUB_EDGES, rows // HUBS)
    while rows and not _settled(current.coalesce(1) if few else current):
        after = write_scratch(_star(_star(_both(current), True, hub_edges), False, hub_edges), "edges")
        drop_scratch(current)
        current = after
    forest = current.coalesce(1) if few else current
    roots = forest.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = write_scratch(forest.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    drop_scratch(current)
    return out
