"""Orders of a symmetric pattern's indices that bring its cells near the diagonal.

Reverse Cuthill-McKee, a level of all components at a time: levels are frontier joins, and a level's
vertices are placed by their least placed neighbour of the level before, their degree and their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyadic.iterate import cut, looked_up, written
from polyadic.operators.graph import _both, components, vertices
from polyadic.operators.lines import places
from polyadic.tensor import Tensor


def _steps(both: DataFrame, frontier: DataFrame, rows: int) -> DataFrame:
    """The edges (src, dst) that leave a frontier (id) of so many ``rows``, with its columns: edges stream past its table and are not sorted."""
    return both.join(looked_up(frontier.withColumnRenamed("id", "src"), rows), "src")


def _with(found: DataFrame, frontier: DataFrame, level: int) -> DataFrame:
    """All levels with a new one; written now and then, so that the plan of many levels stays short."""
    out = found.unionByName(frontier)
    return out if level % 8 else cut(out)


def _levels(both: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, component, level) around one start for each component; neighbours are in a level, the one before or the next."""
    found = frontier = recent = cut(starts.select("id", "component", F.lit(0).alias("level")))
    level, rows, before = 0, frontier.count(), 0
    while True:
        level += 1
        new = _steps(both, frontier.select("id", "component"), rows).select(F.col("dst").alias("id"), "component").distinct()
        last, frontier = frontier, cut(new.join(looked_up(recent.select("id"), rows + before), "id", "left_anti").withColumn("level", F.lit(level)))
        before, rows = rows, frontier.count()
        if not rows:
            return found
        found, recent = _with(found, frontier, level), last.unionByName(frontier)


def _ends(levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, depth, id): how many levels there are, and the vertex of least degree in the last."""
    last = F.struct(-F.col("level"), F.col("degree"), F.col("id"))
    return levels.join(nodes.select("id", "degree"), "id").groupBy("component").agg(F.max("level").alias("depth"), F.min_by("id", last).alias("id"))


def peripheral_starts(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, id): a vertex far from others, found by moving to the far end for as long as levels get more.

    ``nodes`` is (id, component, degree); the first start is the vertex of least degree.
    """
    starts = nodes.groupBy("component").agg(F.min_by("id", F.struct("degree", "id")).alias("id"))
    ends = cut(_ends(_levels(both, starts), nodes))
    while True:
        further = cut(_ends(_levels(both, ends), nodes))
        told = further.select("component", F.col("depth").alias("__d"), F.col("id").alias("__e"))
        moved = cut(starts.withColumnRenamed("id", "__s").join(ends, "component").join(told, "component"))
        grew = F.col("__d") > F.col("depth")
        starts = moved.select("component", F.when(grew, F.col("id")).otherwise(F.col("__s")).alias("id"))
        if moved.where(grew).isEmpty():
            return starts
        # A component that did not grow is tried again from the same end, which changes nothing.
        ends = moved.select("component", F.greatest("depth", "__d").alias("depth"), F.when(grew, F.col("__e")).otherwise(F.col("id")).alias("id"))


def reverse_cuthill_mckee(edges: DataFrame) -> DataFrame:
    """(id, place): every vertex of (src, dst) in reverse Cuthill-McKee order, places from 0.

    Edges count in both directions and once; loops do not count, but their vertices are placed.
    Components follow each other by their smallest vertex, the largest of these first.  No edges
    give no rows.
    """
    edges = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    # By where they lead to, so that what a task finds is nearly distinct before it is shuffled.
    both = written(_both(edges).where("src <> dst").repartition("dst").sortWithinPartitions("dst", "src"), "both")
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    known = vertices(edges).join(components(both), "id", "left").join(degree, "id", "left")
    nodes = cut(known.select("id", F.coalesce("component", "id").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")))
    frontier = places(peripheral_starts(both, nodes), [F.col("component")]).withColumn("level", F.lit(0))
    found = frontier = recent = cut(frontier.select("id", "component", "level", "place"))
    level, rows, before = 0, frontier.count(), 0
    while True:
        level += 1
        near = _steps(both, frontier.select("id", "component", "place"), rows).groupBy(F.col("dst").alias("id"), "component").agg(F.min("place").alias("parent"))
        new = near.join(looked_up(recent.select("id"), rows + before), "id", "left_anti").join(nodes.select("id", "degree"), "id")
        new = places(new, [F.col("component"), F.col("parent"), F.col("degree"), F.col("id")])
        last, frontier = frontier, cut(new.select("id", "component", F.lit(level).alias("level"), "place"))
        before, rows = rows, frontier.count()
        if not rows:
            break
        found, recent = _with(found, frontier, level), last.unionByName(frontier)
    order = [F.col(c).desc() for c in ("component", "level", "place")]
    return places(found.withColumnRenamed("place", "__q").select("id", "component", "level", "__q"), [*order[:2], F.col("__q").desc()]).select("id", "place")


def reordered(t: Tensor, order: DataFrame) -> Tensor:
    """A square matrix under an order (id, place) of its indices: rows and columns move alike.

    An index that the order does not have must have no cells; its rows would be lost, so this raises.
    """
    if len(t.axes) != 2 or t.shape[0] != t.shape[1]:
        raise ValueError("a square matrix is needed")
    i, j = t.axes
    if t.df.select(F.explode(F.array(i, j)).alias("id")).join(order, "id", "left_anti").take(1):
        raise ValueError("an index with cells has no place in the order")
    moved = t.df.join(order.select(F.col("id").alias(i), F.col("place").alias("__i")), i).join(order.select(F.col("id").alias(j), F.col("place").alias("__j")), j)
    return Tensor(moved.select(F.col("__i").alias(i), F.col("__j").alias(j), "v"), t.axes, t.shape)


def bandwidth(edges: DataFrame, order: DataFrame | None = None) -> int:
    """The largest distance of an edge's ends, by number or by place."""
    if order is not None:
        edges = edges.join(order.select(F.col("id").alias("src"), F.col("place").alias("__s")), "src").join(order.select(F.col("id").alias("dst"), F.col("place").alias("__t")), "dst").select(F.col("__s").alias("src"), F.col("__t").alias("dst"))
    return edges.agg(F.max(F.abs(F.col("src") - F.col("dst")))).first()[0] or 0
