"""Embedding near-dedup with one HNSW graph per shard."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hnsw import Graph
from .scratch import write_scratch

#: Vectors in a shard at most, and shards at least once there are enough vectors.
SHARD_ROWS, SHARDS, SPLIT_ROWS = 100_000, 4, 4_096
#: Queries of a task whose links are also looked for by brute force, and the mean share to be found of a query's.
AUDIT_QUERIES, RECALL, FIRST_BEAM = 128, 0.99, 32
#: Beyond this beam the shard is scanned instead.
LAST_BEAM = 256
#: Queries compared with a whole shard at a time.
SCANNED = 64
LOG = logging.getLogger(__name__)


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else tiny or huge components lose their squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("rep")
    x = _unit(frame["embedding"])
    graph = Graph(x, seed=7)
    return pd.DataFrame({"dim": [int(frame["dim"].iloc[0])], "shard": [int(frame["shard"].iloc[0])], "graph": [graph.dump()], "exact": [x.tobytes()], "reps": [frame["rep"].to_numpy(np.int64).tobytes()], "copies": [frame["copies"].to_numpy(np.int64).tobytes()]})


def _recalls(true: list[np.ndarray], got: Iterable[np.ndarray]) -> list[float]:
    """The share found of each query's links, of queries that have some."""
    return [len(np.intersect1d(a, b)) / len(a) for a, b in zip(true, got, strict=True) if len(a)]


def _enough(shares: list[float]) -> bool:
    """Whether queries find RECALL of their links on the mean, and none with links finds none, so that no large group outvotes the rest."""
    return not shares or (min(shares) > 0 and float(np.mean(shares)) >= RECALL)


def _spread(x: np.ndarray, threshold: float) -> np.ndarray:
    """Places of up to AUDIT_QUERIES rows, taken where the fewest others are near, so that a large group cannot fill the audit."""
    pool = np.unique(np.linspace(0, len(x) - 1, min(16 * AUDIT_QUERIES, len(x))).astype(int))
    near = (x[pool] @ x[pool].T >= threshold).sum(axis=1)
    return np.sort(pool[np.argsort(near, kind="stable")[:AUDIT_QUERIES]])


def _probes(exact: np.ndarray, threshold: float) -> np.ndarray:
    """Stored vectors turned by known angles, so that each has a link whatever the data: cosines from just above the threshold to 0.999."""
    rng = np.random.default_rng(11)
    base = exact[_spread(exact, threshold)]
    away = rng.standard_normal(base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    length = np.linalg.norm(away, axis=1, keepdims=True)
    away = np.divide(away, length, out=np.zeros_like(away), where=length > 1e-9)  # nothing to turn to in one dimension
    low = min(threshold + 0.001, 0.999)
    cosine = np.linspace(low, max(low, 0.999), len(base))[:, None]
    turned = cosine * base + np.sqrt(1 - cosine**2) * away
    return turned / np.linalg.norm(turned, axis=1, keepdims=True)


def _unite(parent: np.ndarray, nodes: np.ndarray) -> None:
    """Put nodes into one set: all of them and their roots point to the smallest root."""
    roots = parent[nodes]
    while True:
        above = parent[roots]
        if (above == roots).all():
            break
        roots = above
    least = roots.min()
    parent[roots] = least
    parent[nodes] = least


def _search(threshold: float):
    def links_of(graph: Graph | None, exact: np.ndarray, q: np.ndarray, beam: int) -> Iterator[np.ndarray]:
        """Each query's links, some queries at a time."""
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            found: list[np.ndarray | None] = [None] * len(part)
            if graph is not None:
                found = graph.within(part.astype(np.float32), threshold - 1e-4, FIRST_BEAM)
                lone = [k for k, f in enumerate(found) if f is not None]  # the others are among many, and scanned
                if lone and beam > FIRST_BEAM:
                    for k, f in zip(lone, graph.within(part[lone].astype(np.float32), threshold - 1e-4, beam), strict=True):
                        found[k] = f
            scanned = [k for k, f in enumerate(found) if f is None]
            hits: dict[int, np.ndarray] = {}
            for k, f in enumerate(found):
                if f is not None:
                    yield f[exact[f] @ part[k] >= threshold]
                    continue
                if k not in hits:
                    some = [j for j in scanned if j >= k][:SCANNED]
                    hits = dict(zip(some, (np.flatnonzero(row >= threshold) for row in part[some] @ exact.T), strict=True))
                yield hits.pop(k)

    def search(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(index):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        row = index.iloc[0]
        reps, copies = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["copies"], np.int64)
        exact = np.frombuffer(row["exact"], np.float64).reshape(len(reps), -1)
        graph = Graph.load(row["graph"])
        queries = queries.sort_values("rep")
        q, ids = _unit(queries["embedding"]), queries["rep"].to_numpy(np.int64)
        # Widen the beam until brute-force audits pass, of some queries and of probes that have links by construction.
        some = np.unique(np.linspace(0, len(q) - 1, min(AUDIT_QUERIES, len(q))).astype(int))
        true = [np.flatnonzero((row >= threshold) & (reps != me)) for row, me in zip(q[some] @ exact.T, ids[some], strict=True)]
        probes = _probes(exact, threshold)
        known = [np.flatnonzero(row >= threshold) for row in probes @ exact.T]
        beam = FIRST_BEAM
        while graph is not None:
            recalls = _recalls(known, links_of(graph, exact, probes, beam))
            if _enough(recalls) and _enough(_recalls(true, links_of(graph, exact, q[some], beam))):
                LOG.info("shard %s: beam %d, %d probes, least recall %.3f, mean %.4f", row.get("shard"), beam, len(recalls), min(recalls), float(np.mean(recalls)))
                break
            beam *= 2
            if beam > LAST_BEAM:
                LOG.info("shard %s: audits fail at a beam of %d; scanned", row.get("shard"), LAST_BEAM)
                graph = None
        # Nodes of the graph come first, then queries; a query that is a node of the graph is that node.
        place = np.searchsorted(reps, reps)
        own = np.minimum(np.searchsorted(reps, ids), len(reps) - 1)
        me = np.where(reps[own] == ids, own, len(reps) + np.arange(len(ids)))
        parent = np.arange(len(reps) + len(ids))
        links, touched = np.zeros(len(parent), np.int64), np.zeros(len(parent), bool)
        for k, found in enumerate(links_of(graph, exact, q, beam)):
            others = found[reps[found] != ids[k]]
            if len(others):
                links[me[k]] = copies[others].sum()
                nodes = np.append(place[others], me[k])
                touched[nodes] = True
                _unite(parent, nodes)
        nodes = np.flatnonzero(touched)
        roots = parent[nodes]
        while (parent[roots] != roots).any():
            roots = parent[roots]
        names = np.concatenate((reps, ids))
        return pd.DataFrame({"node": names[nodes], "links": links[nodes], "root": names[roots]}, dtype="int64")

    return search


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Two vectors link when their cosine, in double precision, is ``threshold`` or more; n_links counts
    the other rows linked directly, component_id is the smallest identifier reachable, and kept says
    whether that is the row itself.  Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, and vectors of different lengths do not link.  Equal vectors are
    searched once.  Rows that repeat an identifier count as other rows.  Links other than between
    equal vectors are those found by the graphs.  Every task audits its recall by brute force, on some
    of its queries and on turned copies of stored vectors, which have links by construction; it
    widens its beam, and at last scans the shard, until both pass, and logs what it measured.  A
    query among more than some hundred near copies is compared with its whole shard instead of
    walking through them.  Cosines exactly at the threshold link; an empty table gives no rows.  Columns
    other than the two named are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("embedding"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = rows.where(F.coalesce(sound, F.lit(False)) & F.col("vec").isNotNull())
    reps = write_scratch(good.groupBy("embedding").agg(F.min("vec").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")), "vectors")
    n = reps.count()
    shards = 1 if n < SPLIT_ROWS else max(SHARDS, -(-n // shard_rows))
    block_rows = min(shard_rows, max(2_048, n // 8))
    blocks = max(1, n // block_rows)
    index = write_scratch(
        reps.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, graph binary, exact binary, reps binary, copies binary"), "graphs"
    )
    queries = reps.select("dim", "rep", "embedding", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = queries.groupBy("dim", "shard", "block").cogroup(graphs.groupBy("dim", "shard", "block")).applyInPandas(_search(threshold), "node long, links long, root long")
    found = write_scratch(found, "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    judged = reps.join(counts.withColumnRenamed("node", "rep"), "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    judged = judged.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.withColumn("key", F.when(F.coalesce(sound, F.lit(False)) & F.col("vec").isNotNull(), F.col("embedding")))
    out = out.join(judged.withColumnRenamed("embedding", "key"), "key", "left")
    return out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec").alias("component_id"), (F.col("vec") == F.coalesce("component_id", "vec")).alias("kept"))
