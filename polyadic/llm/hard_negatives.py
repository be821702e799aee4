"""Hard-negative mining by a Voronoi-partitioned, distributed nearest-neighbour join.

Inner products become distances: every candidate gets one more component, the root of M^2 - |x|^2
with M the largest norm, and every anchor a 0 there, so that |a - x|^2 = |a|^2 + M^2 - 2 a.x.  Pivots
cut that space into cells.  From the distances of a cell's candidates to its pivot, and those of the
anchors, the triangle inequality tells which candidates can matter to a group of anchors; only these
are sent to it, in chunks, and compared exactly.  A first join finds the positives, whose scores then
bound what a second join has to look at for negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop_scratch, write_scratch

#: Candidates for each pivot, and pivots at least and at most.
PIVOT_ROWS, LEAST_PIVOTS, MOST_PIVOTS = 2_000, 4, 256
#: Anchors of a group, and candidates of a chunk, about.
GROUP_ANCHORS, CHUNK_ROWS = 512, 20_000
_EXACT = 2.0**53


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with 0."""
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], dtype=object) @ np.array([[int(x) for x in row] for row in b], dtype=object).T
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 2**63:
        raise OverflowError("a score passes 64 bits")
    return exact.astype(np.int64)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most**2 - (x * x).sum(axis=1), 0.0))


def _to_pivots(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points (with their extra component) to all pivots."""
    points = np.column_stack((x, extra))
    squares = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def _first(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` best: higher scores first, ties by smaller identifier."""
    if len(scores) > 4 * count:
        bar = np.partition(scores, len(scores) - count)[len(scores) - count]
        some = np.flatnonzero(scores >= bar)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:count]


def _best(frame: DataFrame, by: list[str], count: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec")
    return frame.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)


def _groups(pivots: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """The group of each pivot: neighbouring pivots go together until they have enough anchors."""
    out, left, number = np.full(len(pivots), -1), set(range(len(pivots))), 0
    while left:
        k, held = min(left), 0
        while left:
            out[k], held = number, held + int(anchors[k])
            left.discard(k)
            if held >= GROUP_ANCHORS or not left:
                break
            rest = sorted(left)
            k = rest[int(((pivots[rest] - pivots[k]) ** 2).sum(axis=1).argmin())]
        number += 1
    return out


class _Join:
    """The candidates and anchors of one job, dealt to cells and groups."""

    def __init__(self, rows: DataFrame, is_anchor: Column, copies: int, seed: int = 7):
        spark = rows.sparkSession
        # Of rows with one vector and label, only the first ones can be among the first of any list.
        w = Window.partitionBy("q", "label").orderBy("vec")
        once = rows.dropDuplicates(["vec", "label", "q"])
        candidates = write_scratch(once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= copies).drop("place").withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x))), "candidates")
        anchors = write_scratch(once.where(is_anchor).withColumn("anchor", F.xxhash64("vec", "label", "q")), "anchors")
        stats = candidates.agg(F.count("*").alias("n"), F.max("norm").alias("most"), F.max(F.size("q")).alias("width")).first()
        self.n, self.most, self.width = stats["n"], float(stats["most"] or 0.0), int(stats["width"] or 0)
        if self.most > 1e100:
            raise OverflowError("scores would pass 64 bits")
        count = max(LEAST_PIVOTS, min(MOST_PIVOTS, self.n // PIVOT_ROWS))
        picked = candidates.orderBy(F.xxhash64("vec", F.lit(seed))).select("q").limit(count).toPandas()
        x = _matrix(picked["q"], self.width)
        self.pivots = np.column_stack((x, _lifted(x, self.most))) if len(x) else np.zeros((1, self.width + 1))
        self.slack = 1e-6 * (1.0 + 2.0 * self.most)
        self.candidates = write_scratch(candidates.mapInPandas(self._assign(True), "vec long, label long, q array<double>, cell int, radius double"), "cells")
        placed = anchors.mapInPandas(self._assign(False), "anchor long, vec long, label long, q array<double>, cell int, radius double")
        placed = write_scratch(placed, "placed")
        held = np.zeros(len(self.pivots), dtype=np.int64)
        for r in placed.groupBy("cell").count().collect():  # a row for each pivot
            held[r["cell"]] = r["count"]
        group = _groups(self.pivots, held)
        within = {int(g): int(-(-held[group == g].sum() // GROUP_ANCHORS)) or 1 for g in np.unique(group)}
        first = dict(zip(within, np.cumsum([0, *within.values()])[:-1].tolist()))
        table = F.broadcast(spark.createDataFrame([(k, first[int(g)], within[int(g)]) for k, g in enumerate(group)], "cell int, first int, parts int"))
        self.anchors = write_scratch(placed.join(table, "cell").withColumn("grp", (F.col("first") + F.pmod(F.xxhash64("anchor", F.lit(1)), F.col("parts"))).cast("int")).drop("first", "parts"), "anchors")
        drop_scratch(candidates, anchors, placed)

    def _assign(self, lifted: bool):
        pivots, most, width = self.pivots, self.most, self.width

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = _matrix(f["q"], width)
                    d = _to_pivots(x, _lifted(x, most) if lifted else np.zeros(len(x)), pivots)
                    cell = d.argmin(axis=1).astype(np.int32)
                    names = (["anchor"] if "anchor" in f else []) + ["vec", "label", "q"]
                    yield f[names].assign(cell=cell, radius=d[np.arange(len(x)), cell])

        return assign

    def reach(self, nearest: int) -> DataFrame:
        """(anchor, far): a distance within which each anchor has ``nearest`` candidates of its own label.

        The sum of an anchor's distance to a pivot and a candidate's is one; each cell tells its
        smallest ones.  Infinite if there are fewer.
        """
        w = Window.partitionBy("label", "cell").orderBy("radius")
        small = self.candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= nearest)
        cells = small.groupBy("label").agg(F.collect_list(F.struct("cell", "radius")).alias("near"))  # a bounded list: pivots times nearest
        pivots, width, wanted = self.pivots, self.width, nearest

        def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = _matrix(f["q"], width)
                    d = _to_pivots(x, np.zeros(len(x)), pivots)
                    far = []
                    for row, near in zip(d, f["near"]):
                        sums = np.sort([row[c["cell"]] + c["radius"] for c in near]) if near is not None else []
                        far.append(float(sums[wanted - 1]) if len(sums) >= wanted else np.inf)
                    yield pd.DataFrame({"anchor": f["anchor"], "far": far})

        return self.anchors.join(cells, "label", "left").select("anchor", "q", "near").mapInPandas(bound, "anchor long, far double")

    def windows(self, needs: DataFrame, same_label: bool) -> DataFrame:
        """(grp, cell, label, low, high): radii of the candidates that anchors of a group may need.

        ``needs`` has (anchor, least, most): the distances between which an anchor's candidates lie,
        null for no bound.  Labels are null where those of all anchors' labels are wanted.
        """
        pivots, width, slack = self.pivots, self.width, self.slack

        def wide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                x = _matrix(f["q"], width)
                d = _to_pivots(x, np.zeros(len(x)), pivots)
                least, most = (f[c].to_numpy(dtype=float, na_value=v)[:, None] for c, v in (("least", 0.0), ("most", np.inf)))
                low = np.maximum(np.maximum(d - most, least - d), 0.0) - slack
                high = d + most + slack
                cell = np.tile(np.arange(len(pivots), dtype=np.int32), len(f))
                each = pd.DataFrame({"grp": np.repeat(f["grp"].to_numpy(), len(pivots)), "label": np.repeat(f["label"].to_numpy(), len(pivots)), "cell": cell, "low": low.ravel(), "high": high.ravel()})
                yield each.groupby(["grp", "label", "cell"], as_index=False).agg({"low": "min", "high": "max"})

        every = self.anchors.join(needs, "anchor").select("grp", "label", "q", "least", "most").mapInPandas(wide, "grp int, label long, cell int, low double, high double")
        key = ["grp", "cell", "label"] if same_label else ["grp", "cell"]
        return every.groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def compare(self, windows: DataFrame, anchors: DataFrame, local, schema: str) -> DataFrame:
        """``local`` on each group of anchors and chunk of the candidates that may matter to it."""
        on = ["cell", "label"] if "label" in windows.columns else ["cell"]
        chunks = max(1, -(-self.n // CHUNK_ROWS))
        sent = self.candidates.join(windows, on).where("radius between low and high")
        sent = sent.select("grp", F.pmod(F.xxhash64("vec", F.lit(5)), F.lit(chunks)).cast("int").alias("chunk"), F.struct("vec", "label", "q").alias("c"))
        dealt = anchors.join(self.anchors.select("anchor", "grp", "vec", "label", "q"), "anchor").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        return dealt.groupBy("grp", "chunk").cogroup(sent.select("grp", "chunk", "c.*").groupBy("grp", "chunk")).applyInPandas(local, schema)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors become whole numbers, floor(scale * x); a score is an inner product, exact, with higher
    ones first and ties by smaller identifier.  For each row that ``anchors`` (a condition on the
    columns) selects, the first ``positives`` other rows of its label are its positives, and for each
    of these the first ``negatives`` rows of other labels with low * positive <= 100 * negative <=
    high * positive are returned.  Rows with a null identifier, label or vector or with null or
    non-finite components take no part.  Rows that repeat identifier, label and vector count once;
    rows of the anchor's own identifier are not other rows.  Of vectors of several lengths, shorter
    ones are filled with 0.  An anchor without positives or negatives gives no rows, and neither does
    an empty table.  Scores beyond 64 bits raise OverflowError.  Further columns are not returned.
    """
    if not 0 <= low <= high:
        raise ValueError("need 0 <= low <= high")
    q = F.col(vector_col)
    sound = q.isNotNull() & F.forall(q, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda y: F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  (larger doubles are whole)
    rows = vectors.where(F.coalesce(sound, F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("long").alias("label"), F.transform(q, lambda x: whole(x.cast("double") * scale)).alias("q"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    join = _Join(rows, F.col("is_anchor"), max(positives, negatives) + 1)
    width, most = join.width, join.most

    def best_positives(group: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(group) and len(some):
            x, ids, labels = _matrix(some["q"], width), some["vec"].to_numpy(), some["label"].to_numpy()
            for at in range(0, len(group), 256):
                part = group.iloc[at : at + 256]
                scores = _products(_matrix(part["q"], width), x)
                for row, anchor, me, label in zip(scores, part["anchor"], part["vec"], part["label"]):
                    others = np.flatnonzero((labels == label) & (ids != me))
                    out += [(anchor, int(ids[k]), int(row[k])) for k in others[_first(ids[others], row[others], positives)]]
        return pd.DataFrame(out, columns=["anchor", "vec", "score"]).astype("int64")

    # The anchor itself may be among its nearest, hence one more.
    needs = join.reach(positives + 1).select("anchor", F.lit(None).cast("double").alias("least"), F.col("far").alias("most"))
    found = join.compare(join.windows(needs, True), join.anchors.select("anchor"), best_positives, "anchor long, vec long, score long")
    chosen = write_scratch(_best(found, ["anchor"], positives).select("anchor", F.col("vec").alias("positive"), "score"), "positives")

    # Scores from low % of the smallest positive to high % of the largest; a negative one has no negatives.
    wanted = chosen.where("score >= 0").groupBy("anchor").agg(F.min("score").alias("smallest"), F.max("score").alias("largest"), F.array_sort(F.collect_set("score")).alias("levels"))
    squares = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x) + most**2
    away = lambda score: F.sqrt(F.greatest(squares - 2 * score, F.lit(0.0)))
    bands = wanted.join(join.anchors.select("anchor", "q"), "anchor")
    needs = bands.select("anchor", away(F.col("largest").cast("double") * high / 100.0).alias("least"), away(F.col("smallest").cast("double") * low / 100.0).alias("most"))

    def best_negatives(group: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(group) and len(some):
            x, ids, labels = _matrix(some["q"], width), some["vec"].to_numpy(), some["label"].to_numpy()
            for at in range(0, len(group), 256):
                part = group.iloc[at : at + 256]
                scores = _products(_matrix(part["q"], width), x)
                for row, anchor, label, levels in zip(scores, part["anchor"], part["label"], part["levels"]):
                    others = np.flatnonzero(labels != label)
                    here = row[others]
                    for p in map(int, levels):
                        least, largest = -(-low * p // 100), high * p // 100
                        band = others[(here >= least) & (here <= largest)]
                        out += [(anchor, p, int(ids[k]), int(row[k])) for k in band[_first(ids[band], row[band], negatives)]]
        return pd.DataFrame(out, columns=["anchor", "level", "vec", "score"]).astype("int64")

    found = join.compare(join.windows(needs, False), wanted.select("anchor", "levels"), best_negatives, "anchor long, level long, vec long, score long")
    ranked = _best(found, ["anchor", "level"], negatives)
    out = chosen.join(ranked.select("anchor", F.col("level").alias("score"), F.col("vec").alias("negative"), F.col("score").alias("reached"), "place"), ["anchor", "score"])
    out = out.join(join.anchors.select("anchor", F.col("vec").alias("me")), "anchor")
    return out.select(F.col("me").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("negative").alias("negative_id"), F.col("score").alias("positive_score"), F.col("reached").alias("negative_score"))
