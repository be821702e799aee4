"""Graph algorithms on edge frames (src, dst, w): rounds of joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyadic.iterate import cut


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every vertex."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def bfs(edges: DataFrame, source: int) -> DataFrame:
    """(id, level) of the vertices that directed edges reach."""
    edges = cut(edges.select("src", "dst").distinct())
    start = edges.sparkSession.range(source, source + 1).select("id", F.lit(0).alias("level"))
    found = frontier = start
    level = 0
    while True:
        level += 1
        new = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = cut(new.join(found, "id", "left_anti").select("id", F.lit(level).alias("level")))
        if frontier.isEmpty():
            return found
        found = cut(found.union(frontier))


def _contracted(edges: DataFrame, stop_at_odd: bool = False) -> DataFrame | None:
    """(id, component, odd): the smallest connected vertex, and whether the found path to it has an odd length.

    Each round hooks every vertex to its smallest neighbour, follows the hooks to their ends and puts
    these in the place of the links' ends; links inside a vertex go, so that the links get fewer from
    round to round.  Lookups stream the links past a hash table of vertices, which
    keeps links out of sorts.  With ``stop_at_odd`` the result is None as soon as a cycle is odd.
    """
    links = cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).cast("byte").alias("q")))
    labels = None

    def found(rows: DataFrame, key: str, hooks: DataFrame, odd: str) -> DataFrame:
        """``rows`` with what hooks say of ``key``: its place taken by the new end, ``odd`` turned by the path's parity."""
        return rows.join(hooks.select(F.col("id").alias(key), F.col("m").alias("__m"), F.col("p").alias("__p")).hint("shuffle_hash"), key).withColumn(key, F.col("__m")).withColumn(odd, F.col(odd).bitwiseXOR(F.col("__p"))).drop("__m", "__p")

    while True:
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("m"), "q"), F.struct(F.col("v").alias("id"), F.col("u").alias("m"), "q"))).alias("e")).select("e.*").where("id is not null")
        least = ends.groupBy("id").agg(F.min("m").alias("m"), F.min_by("q", "m").alias("p"))
        lower = F.coalesce(F.col("m") < F.col("id"), F.lit(False))
        hooks = cut(least.select("id", F.when(lower, F.col("m")).otherwise(F.col("id")).alias("m"), F.when(lower, F.col("p")).otherwise(F.lit(0)).cast("byte").alias("p")))
        while True:  # to the end of every chain of hooks, twice as far each time
            further = cut(found(hooks.withColumn("__o", F.col("m")), "m", hooks, "p").select("id", "m", "p", "__o"))
            hooks = further.select("id", "m", "p")
            if further.where("m <> __o").isEmpty():
                break
        if labels is None:
            labels = hooks.select("id", F.col("m").alias("component"), F.col("p").alias("odd"))
        else:
            on = hooks.select(F.col("id").alias("component"), F.col("m").alias("__m"), F.col("p").alias("__p"))
            labels = cut(labels.join(on, "component", "left").select("id", F.coalesce("__m", "component").alias("component"), F.col("odd").bitwiseXOR(F.coalesce("__p", F.lit(0).cast("byte"))).alias("odd")))
        moved = found(found(links, "u", hooks, "q"), "v", hooks, "q")
        links = cut(moved.where("u <> v or q = 1" if stop_at_odd else "u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "q").distinct())
        if stop_at_odd and not links.where("u = v").isEmpty():
            return None
        if links.isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex connected by edges of either direction."""
    return _contracted(edges).select("id", "component")


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 100) -> DataFrame:
    """(id, rank): unweighted out-degrees, dangling mass spread evenly, until the L1 change is below ``tolerance``."""
    links = cut(edges.select("src", "dst"))
    shares = cut(links.groupBy("src").agg(F.count("*").alias("n")))
    nodes = cut(vertices(edges))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(max_rounds):
        given = ranks.join(shares, ranks["id"] == shares["src"], "left").select("id", "rank", "n")
        dangling = given.where("n is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = given.join(links, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        new = ranks.join(sent, ranks["id"] == sent["dst"], "left").select("id", (F.lit((1 - damping) / n + damping * dangling / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        new = cut(new)
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.select("id", "rank")
        if change < tolerance:
            return ranks
    raise RuntimeError(f"no convergence after {max_rounds} rounds: ranks still change by {change:g}")


def shortest_paths(edges: DataFrame, source: int) -> DataFrame:
    """(id, distance) from a vertex, by relaxing all edges (Bellman-Ford); a negative cycle is an error."""
    edges = cut(edges.groupBy("src", "dst").agg(F.min("w").alias("w")))
    n = vertices(edges).count()
    known = edges.sparkSession.range(source, source + 1).select("id", F.lit(0.0).alias("distance"))
    for _ in range(n + 1):
        reached = known.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("distance"))
        new = cut(known.union(reached).groupBy("id").agg(F.min("distance").alias("distance")))
        if new.join(known, ["id", "distance"], "left_anti").isEmpty():
            return new
        known = new
    raise ValueError("a negative cycle can be reached")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, all connected; edges are first turned from lower to higher degree."""
    both = _both(edges).where("src <> dst")
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    ranked = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    forward = cut(ranked.where((F.col("d") < F.col("e")) | ((F.col("d") == F.col("e")) & (F.col("src") < F.col("dst")))).select("src", "dst"))
    one, two = forward.select("src", F.col("dst").alias("x")), forward.select("src", F.col("dst").alias("y"))
    wedges = one.join(two, "src").where("x <> y")
    closed = wedges.join(forward.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"], "left_semi")
    corners = F.sort_array(F.array("src", "x", "y"))
    return closed.select(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"))


def bipartite(edges: DataFrame) -> bool:
    """Whether no cycle is odd: links that are put together keep the parity of their path, and none may join a vertex to itself by an odd one."""
    return _contracted(edges.where("src is not null and dst is not null"), stop_at_odd=True) is not None


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of a minimum spanning forest by Boruvka rounds; ties by the edge's ends."""
    edges = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.min("w").alias("w")))
    label = cut(vertices(edges).withColumn("component", F.col("id")))
    chosen = edges.limit(0)
    while True:
        ends = edges.join(label.select(F.col("id").alias("src"), F.col("component").alias("ca")), "src").join(label.select(F.col("id").alias("dst"), F.col("component").alias("cb")), "dst").where("ca <> cb")
        sides = ends.select(F.col("ca").alias("c"), "w", "src", "dst").union(ends.select("cb", "w", "src", "dst"))
        best = cut(sides.groupBy("c").agg(F.min(F.struct("w", "src", "dst")).alias("e")).select("e.src", "e.dst", "e.w").distinct())
        if best.isEmpty():
            return chosen
        chosen = cut(chosen.unionByName(best))
        joined = components(chosen)
        label = cut(label.select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def independent_set(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(id) of a maximal independent set, by rounds of local minima of seeded hashes (Luby)."""
    both = cut(_both(edges).where("src <> dst"))
    live = cut(vertices(edges))
    chosen = live.limit(0)
    round_ = 0
    while not live.isEmpty():
        round_ += 1
        key = F.struct(F.xxhash64("id", F.lit(seed + round_)), "id")
        keyed = live.withColumn("k", key)
        near = both.join(keyed.select(F.col("id").alias("src")), "src").join(keyed.select(F.col("id").alias("dst"), F.col("k").alias("o")), "dst")
        least = near.groupBy("src").agg(F.min("o").alias("o"))
        local = cut(keyed.join(least.withColumnRenamed("src", "id"), "id", "left").where("o is null or k < o").select("id"))
        chosen = cut(chosen.union(local))
        gone = local.union(both.join(local.withColumnRenamed("id", "src"), "src").select("dst"))
        live = cut(live.join(gone.distinct(), "id", "left_anti"))
    return chosen


def topological_levels(edges: DataFrame) -> DataFrame:
    """(id, level): longest path from a source; a cycle is an error, and no edges give no rows."""
    edges = cut(edges.select("src", "dst").distinct())
    left = cut(vertices(edges))
    done, level, live = None, 0, edges
    while not left.isEmpty():
        ready = cut(left.join(live.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(level).alias("level")))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        done = ready if done is None else cut(done.union(ready))
        left = cut(left.join(ready, "id", "left_anti"))
        live = cut(live.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return left.select("id", F.lit(0).alias("level")) if done is None else done


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex that can be reached and can reach back.

    Forward colouring: each vertex takes the largest vertex that reaches it; what reaches that one
    back through its own colour is its component.  Components found go, until no vertex is left.
    """
    live = cut(edges.where("src <> dst").select("src", "dst").distinct())
    left, found = cut(vertices(edges)), None
    while not left.isEmpty():
        colour = left.withColumn("c", F.col("id"))
        while True:
            came = live.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("c").alias("m")).withColumnRenamed("dst", "id")
            new = cut(colour.join(came, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")))
            colour = new.select("id", "c")
            if new.where("c <> old").isEmpty():
                break
        ends = live.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst")
        same = cut(ends.where("a = b").select("src", "dst"))
        done = frontier = colour.where("id = c")
        while not frontier.isEmpty():
            back = same.join(frontier, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "c").distinct()
            frontier = cut(back.join(done, "id", "left_anti"))
            done = cut(done.union(frontier))
        found = done if found is None else cut(found.union(done))
        left = cut(left.join(done, "id", "left_anti"))
        live = cut(live.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
    if found is None:
        return left.select("id", F.col("id").alias("component"))
    names = found.groupBy("c").agg(F.min("id").alias("component"))
    return found.join(names, "c").select("id", "component")


def has_cycle(edges: DataFrame) -> bool:
    """Whether directed edges close a cycle: what stays when vertices without predecessors go, again and again."""
    live = cut(edges.select("src", "dst").distinct())
    while not live.isEmpty():
        entered = live.select(F.col("dst").alias("src")).distinct()
        rest = cut(live.join(entered, "src", "left_semi"))
        if rest.count() == live.count():
            return True
        live = rest
    return False


def colouring(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(id, colour) with different colours at the ends of each edge: maximal independent sets, one after the other.

    A vertex has a colour below its degree plus 1, for each set that it is not in has a neighbour of it.
    """
    both = cut(_both(edges).where("src <> dst"))
    left, out, colour = cut(vertices(edges)), None, 0
    while not left.isEmpty():
        alone = left.join(both.select(F.col("src").alias("id")), "id", "left_anti")
        chosen = cut(alone.union(independent_set(both, seed + colour)).select("id", F.lit(colour).alias("colour")))
        out = chosen if out is None else cut(out.union(chosen))
        left = cut(left.join(chosen, "id", "left_anti"))
        both = cut(both.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
        colour += 1
    return left.select("id", F.lit(0).alias("colour")) if out is None else out
