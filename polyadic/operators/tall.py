"""QR and SVD of matrices with many rows and few columns, by a tree of small QR factorisations.

Strips of rows are factorised where they are; their triangles are stacked a few at a time and
factorised again, in rounds, until one is left.  Going back from it gives Q.  Nothing is squared, so
singular values down to rounding of the largest come out right, and dependent columns are no error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from polyadic.blocks import SCHEMA, BlockMatrix, batch_blocks, block_batch, to_blocks, to_cells
from polyadic.iterate import cut
from polyadic.tensor import Tensor

#: Columns at most: a triangle of so many sides is made by one task and read by the driver.
MOST_COLUMNS = 2048
#: Triangles that are stacked at once, and rows of a strip for each column.
FAN, ROWS_A_COLUMN = 8, 4


def _full(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q and a square R, also of fewer rows than columns (filled with rows of 0)."""
    n = x.shape[1]
    return np.linalg.qr(np.vstack((x, np.zeros((n - len(x), n)))) if len(x) < n else x)


def strips(x: Tensor) -> BlockMatrix:
    """A matrix's rows in strips that hold all columns."""
    if x.shape[1] > MOST_COLUMNS:
        raise ValueError(f"{x.shape[1]} columns are too many for one task; the limit is {MOST_COLUMNS}")
    return to_blocks(x, (max(256, ROWS_A_COLUMN * x.shape[1]), x.shape[1]))


def _triangles(a: BlockMatrix):
    """The tree's levels: frames of triangles with their node, the last with one only; all written."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, x in zip(batch["bi"].to_pylist(), batch_blocks(batch), strict=True):
                yield block_batch([(bi, 0, _full(x)[1])])

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((bi, x) for batch in batches for bi, x in zip(batch["bi"].to_pylist(), batch_blocks(batch), strict=True)), key=lambda r: r[0])
        yield block_batch([(rows[0][0] // FAN, 0, _full(np.vstack([x for _, x in rows]))[1])])

    # Strips are numbered without gaps first, so that the tree is even.
    from polyadic.tensor import positions

    places = cut(positions(a.df.select("bi"), "bi", "node"))
    levels = [cut(a.df.mapInArrow(local, SCHEMA).join(places, "bi").select(F.col("node").alias("bi"), "bj", "h", "data"))]
    count = places.count()
    while count > 1:
        levels.append(cut(levels[-1].groupBy(F.floor(F.col("bi") / FAN).alias("parent")).applyInArrow(stacked, SCHEMA)))
        count = -(-count // FAN)
    return places, levels


def _top(levels: list, n: int) -> np.ndarray:
    """The last triangle, diagonal not negative; zeros for an empty matrix."""
    row = levels[-1].first()
    if row is None:
        return np.zeros((n, n))
    r = np.array(row["data"]).reshape(n, n)
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def triangle(a: BlockMatrix) -> np.ndarray:
    """R alone, with a diagonal that is not negative."""
    return _top(_triangles(a)[1], a.shape[1])


def block_qr(a: BlockMatrix) -> tuple[BlockMatrix, np.ndarray]:
    """Q, in strips like those of ``a``, and R with a diagonal that is not negative."""
    n = a.shape[1]
    places, levels = _triangles(a)
    r = _top(levels, n)
    top = levels[-1].first()
    sign = np.eye(n) if top is None else np.diag(np.where(np.diag(np.array(top["data"]).reshape(n, n)) < 0, -1.0, 1.0))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A node's children's triangles and its own turn give each child's turn."""
        rows, turn = [], None
        for batch in batches:
            turn = next(batch_blocks(batch, "turn", "n")) if len(batch) and turn is None else turn
            rows += [(bi, x) for bi, x in zip(batch["bi"].to_pylist(), batch_blocks(batch), strict=True)]
        rows.sort(key=lambda t: t[0])
        q = _full(np.vstack([x for _, x in rows]))[0] @ turn
        yield block_batch([(bi, 0, q[k * n : (k + 1) * n]) for k, (bi, _) in enumerate(rows)])

    spark = a.df.sparkSession
    turns = spark.createDataFrame([(0, 0, n, sign.ravel().tolist())], SCHEMA)
    for level in reversed(levels[:-1]):
        below = level.withColumn("parent", F.floor(F.col("bi") / FAN)).join(turns.select(F.col("bi").alias("parent"), F.col("h").alias("n"), F.col("data").alias("turn")), "parent")
        turns = cut(below.groupBy("parent").applyInArrow(down, SCHEMA))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, x, turn in zip(batch["bi"].to_pylist(), batch_blocks(batch), batch_blocks(batch, "turn", "n"), strict=True):
                yield block_batch([(bi, 0, (_full(x)[0] @ turn)[: len(x)])])

    each = a.df.join(places, "bi").join(turns.select(F.col("bi").alias("node"), F.col("h").alias("n"), F.col("data").alias("turn")), "node")
    return a.with_df(each.select("bi", "bj", "h", "data", "n", "turn").mapInArrow(finish, SCHEMA)), r


def qr(x: Tensor) -> tuple[Tensor, np.ndarray]:
    """Q (a frame) and R of a matrix with few columns, dependent or not; R's diagonal is not negative.

    Rows in strips without any cell are 0 in Q as well.
    """
    q, r = block_qr(strips(x))
    return to_cells(q, x.axes), r


def svd(x: Tensor, rank: int | None = None) -> tuple[Tensor, np.ndarray, np.ndarray]:
    """U (a frame [row, k]), singular values and V of a matrix with few columns.

    Vectors of singular values below rounding (the largest one times the longest side times 2.2e-16)
    are still orthogonal, but arbitrary.  Each vector's largest entry in V is positive.
    """
    q, r = block_qr(strips(x))
    u, s, v = np.linalg.svd(r)
    keep = rank or len(s)
    u, s, v = u[:, :keep], s[:keep], v[:keep].T
    sign = np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    u, v = u * sign, v * sign

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield block_batch([(bi, 0, y @ u) for bi, y in zip(batch["bi"].to_pylist(), batch_blocks(batch), strict=True)])

    out = BlockMatrix(q.df.mapInArrow(turned, SCHEMA), (x.shape[0], keep), (q.sides[0], keep))
    return to_cells(out, (x.axes[0], "k")), s, v


def rank(r: np.ndarray) -> int:
    """The numerical rank of a matrix by its triangle."""
    s = np.linalg.svd(r, compute_uv=False)
    return int((s > max(r.shape) * np.finfo(float).eps * s.max(initial=0.0)).sum())


def right_vectors(x: Tensor, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors and all singular values of a matrix with few columns."""
    _, s, v = np.linalg.svd(triangle(strips(x)))
    v = v[:count].T
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0), s
