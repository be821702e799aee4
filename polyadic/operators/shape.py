"""Shape and index operations: arithmetic on index columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyadic.tensor import Tensor


def _index(t: Tensor, changes: dict[str, Column], shape: Sequence[int] | None = None) -> Tensor:
    cells = t.df.select(*(changes[a].cast("long").alias(a) if a in changes else F.col(a) for a in t.axes), "v")
    return Tensor(cells, t.axes, tuple(shape or t.shape))


def _resized(t: Tensor, axis: str, size: int) -> tuple[int, ...]:
    return tuple(size if a == axis else s for a, s in zip(t.axes, t.shape, strict=True))


def permute(t: Tensor, axes: Sequence[str]) -> Tensor:
    if sorted(axes) != sorted(t.axes):
        raise ValueError("not a permutation of the axes")
    return Tensor(t.df.select(*axes, "v"), tuple(axes), tuple(t.size_of(a) for a in axes))


def flat_index(t: Tensor, axes: Sequence[str] | None = None) -> Column:
    """Row-major position."""
    out = F.lit(0).cast("long")
    for a in axes or t.axes:
        out = out * t.size_of(a) + F.col(a)
    return out


def reshape(t: Tensor, axes: Sequence[str], shape: Sequence[int]) -> Tensor:
    """The same cells in row-major order under another shape."""
    if np.prod(shape, dtype=np.int64) != np.prod(t.shape, dtype=np.int64):
        raise ValueError("the sizes differ")
    cells = t.df.select(flat_index(t).alias("__f"), "v")
    columns, stride = [], 1
    for a, size in reversed(list(zip(axes, shape, strict=True))):
        columns.append((F.floor(F.col("__f") / stride) % size).cast("long").alias(a))
        stride *= size
    return Tensor(cells.select(*reversed(columns), "v"), tuple(axes), tuple(shape))


def unfold(t: Tensor, axis: str) -> Tensor:
    """Matrix with ``axis`` as rows and the other axes, in order, as columns."""
    rest = t.others(axis)
    n = int(np.prod([t.size_of(a) for a in rest], dtype=np.int64))
    return Tensor(t.df.select(F.col(axis).alias("row"), flat_index(t, rest).alias("col"), "v"), ("row", "col"), (t.size_of(axis), n))


def fold(m: Tensor, axis: str, axes: Sequence[str], shape: Sequence[int]) -> Tensor:
    """The inverse of unfold()."""
    k = list(axes).index(axis)
    order = [axis, *(a for a in axes if a != axis)]
    return permute(reshape(m, order, [shape[k], *(s for j, s in enumerate(shape) if j != k)]), axes)


def flip(t: Tensor, axis: str) -> Tensor:
    return _index(t, {axis: t.size_of(axis) - 1 - F.col(axis)})


def roll(t: Tensor, axis: str, shift: int) -> Tensor:
    return _index(t, {axis: F.pmod(F.col(axis) + shift, F.lit(t.size_of(axis)))})


def cut(t: Tensor, axis: str, start: int, stop: int, step: int = 1) -> Tensor:
    """Slice [start, stop) by step along an axis."""
    inside = (F.col(axis) >= start) & (F.col(axis) < stop) & ((F.col(axis) - start) % step == 0)
    return _index(t.with_df(t.df.where(inside)), {axis: F.floor((F.col(axis) - start) / step)}, _resized(t, axis, max(0, -(-(stop - start) // step))))


def pad(t: Tensor, axis: str, before: int, after: int, mode: str = "constant", value: float = 0.0) -> Tensor:
    """NumPy's constant, edge, reflect and wrap padding along an axis: each cell is dealt to all places that show it."""
    n = t.size_of(axis)
    total = before + n + after
    if mode == "constant":
        out = _index(t, {axis: F.col(axis) + before}, _resized(t, axis, total))
        if value:
            full = out.dense().df
            ring = (F.col(axis) < before) | (F.col(axis) >= before + n)
            out = out.with_df(full.withColumn("v", F.when(ring, F.lit(float(value))).otherwise(F.col("v"))))
        return out
    place = np.arange(total) - before
    period = max(2 * (n - 1), 1)
    source = {"edge": np.clip(place, 0, n - 1), "wrap": place % n, "reflect": np.where(place % period < n, place % period, period - place % period) if n > 1 else 0 * place}[mode]
    to = t.df.sparkSession.createDataFrame([(int(s), k) for k, s in enumerate(source)], f"{axis} long, __to long")
    cells = t.df.join(F.broadcast(to) if total <= 1_000_000 else to, axis).select(*(F.col("__to").alias(a) if a == axis else F.col(a) for a in t.axes), "v")
    return Tensor(cells, t.axes, _resized(t, axis, total))


def tile(t: Tensor, axis: str, times: int) -> Tensor:
    n = t.size_of(axis)
    cells = t.df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return _index(Tensor(cells, t.axes, t.shape), {axis: F.col("__k") * n + F.col(axis)}, _resized(t, axis, n * times))


def repeat(t: Tensor, axis: str, times: int) -> Tensor:
    cells = t.df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return _index(Tensor(cells, t.axes, t.shape), {axis: F.col(axis) * times + F.col("__k")}, _resized(t, axis, t.size_of(axis) * times))


def concat(tensors: Sequence[Tensor], axis: str) -> Tensor:
    first, at, out = tensors[0], 0, None
    for t in tensors:
        t = t.renamed(first.axes)
        part = t.df.withColumn(axis, F.col(axis) + at)
        out = part if out is None else out.unionByName(part)
        at += t.size_of(axis)
    return Tensor(out, first.axes, _resized(first, axis, at))


def stack(tensors: Sequence[Tensor], name: str = "stack") -> Tensor:
    """Tensors of one shape along a new first axis."""
    first, out = tensors[0], None
    for k, t in enumerate(tensors):
        part = t.renamed(first.axes).df.withColumn(name, F.lit(k).cast("long")).select(name, *first.axes, "v")
        out = part if out is None else out.unionByName(part)
    return Tensor(out, (name, *first.axes), (len(tensors), *first.shape))


def squeeze(t: Tensor, axis: str) -> Tensor:
    if t.size_of(axis) != 1:
        raise ValueError("only an axis of size 1 can go")
    keep = t.others(axis)
    return Tensor(t.df.select(*keep, "v"), keep, tuple(t.size_of(a) for a in keep))


def expand(t: Tensor, name: str, size: int = 1) -> Tensor:
    """A new first axis along which the cells repeat."""
    cells = t.df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return Tensor(cells.select(name, *t.axes, "v"), (name, *t.axes), (size, *t.shape))


def diagonal(t: Tensor, offset: int = 0) -> Tensor:
    i, j = t.axes
    size = max(0, min(t.shape[0] + min(offset, 0), t.shape[1] - max(offset, 0)))
    cells = t.df.where(F.col(j) - F.col(i) == offset).select((F.col(i) + min(offset, 0)).alias(i), "v")
    return Tensor(cells, (i,), (size,))


def triangle(t: Tensor, upper: bool = True, offset: int = 0) -> Tensor:
    i, j = t.axes
    kept = F.col(j) - F.col(i) >= offset if upper else F.col(j) - F.col(i) <= offset
    return t.with_df(t.df.where(kept))


def gather(t: Tensor, axis: str, index: DataFrame) -> Tensor:
    """Cells at given places of an axis; ``index`` has (position, source) with positions from 0."""
    n = index.count()
    cells = t.df.join(index.withColumnRenamed("source", axis), axis).select(*(F.col("position").alias(a) if a == axis else F.col(a) for a in t.axes), "v")
    return Tensor(cells, t.axes, _resized(t, axis, n))


def scatter(t: Tensor, source: Tensor, mode: str = "add") -> Tensor:
    """Put ``source`` cells (which may repeat an index) into ``t``: replace, add, max or min.

    Of repeated indices, replace takes the largest value.
    """
    axes = list(t.axes)
    f = {"add": F.sum, "replace": F.max, "max": F.max, "min": F.min}[mode]
    new = source.renamed(t.axes).df.groupBy(*axes).agg(f("v").alias("__w"))
    both = t.df.join(new, axes, "full")
    v, w = F.coalesce("v", F.lit(0.0)), F.col("__w")
    put = {"add": v + w, "replace": w, "max": F.greatest(v, w), "min": F.least(v, w)}[mode]
    return t.with_df(both.withColumn("v", F.when(w.isNull(), v).otherwise(put)))


def mask_select(t: Tensor, mask: Tensor) -> Tensor:
    """The cells where ``mask`` is not 0, in row-major order, as a vector."""
    from polyadic.tensor import positions

    chosen = t.dense().df.join(mask.renamed(t.axes).df.where("v <> 0").select(*t.axes), list(t.axes), "left_semi").select(flat_index(t).alias("__f"), "v")
    placed = chosen.join(positions(chosen, "__f"), "__f").select(F.col("position").alias("i"), "v")
    return Tensor(placed, ("i",), (chosen.count(),))


def one_hot(t: Tensor, classes: int, name: str = "cls") -> Tensor:
    """A new last axis that is 1 at each cell's value."""
    cells = t.dense().df.where((F.col("v") >= 0) & (F.col("v") < classes)).select(*t.axes, F.col("v").cast("long").alias(name), F.lit(1.0).alias("v"))
    return Tensor(cells, (*t.axes, name), (*t.shape, classes))


def split(t: Tensor, axis: str, sizes: Sequence[int]) -> list[Tensor]:
    """Parts of given sizes along an axis."""
    if sum(sizes) != t.size_of(axis):
        raise ValueError("the sizes must add up to the axis")
    ends = np.cumsum(sizes).tolist()
    return [cut(t, axis, end - size, end) for size, end in zip(sizes, ends, strict=True)]


def gather_cells(t: Tensor, index: DataFrame) -> Tensor:
    """The cells at index tuples, as a vector; ``index`` has ``position`` (from 0) and a column for each axis."""
    n = index.count()
    return Tensor(t.df.join(index, list(t.axes)).select(F.col("position").alias("i"), "v"), ("i",), (n,))


def _sources(t: Tensor, axis: str, size: int, mode: str) -> DataFrame:
    """(axis, __to, __w): which old places make each new one along an axis, and their weights."""
    old = t.size_of(axis)
    to = t.df.sparkSession.range(size).withColumnRenamed("id", "__to")
    if mode == "nearest":
        return to.select(F.least(F.floor((F.col("__to") + 0.5) * old / size), F.lit(old - 1)).alias(axis), "__to", F.lit(1.0).alias("__w"))
    at = F.col("__to") * (old - 1) / max(size - 1, 1)
    low = F.floor(at)
    both = F.array(F.struct(low.alias("p"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("p"), (at - low).alias("w")))
    return to.select("__to", F.explode(both).alias("e")).where("e.w > 0").select(F.col("e.p").alias(axis), "__to", F.col("e.w").alias("__w"))


def resize(t: Tensor, sizes: dict[str, int], mode: str = "nearest") -> Tensor:
    """Other sizes of some axes: the nearest old centre, or linear between corners that stay corners.

    One axis after the other; each is one join with a table of places and a grouped sum.
    """
    if mode not in ("nearest", "linear"):
        raise ValueError("mode must be nearest or linear")
    for axis, size in sizes.items():
        placed = t.df.join(_sources(t, axis, size, mode), axis).drop(axis).withColumnRenamed("__to", axis)
        cells = placed.withColumn("v", F.col("v") * F.col("__w")).groupBy(*t.axes).agg(F.sum("v").alias("v"))
        t = Tensor(cells, t.axes, _resized(t, axis, size))
    return t


def patches(t: Tensor, sizes: Sequence[int], strides: Sequence[int]) -> Tensor:
    """Windows over all axes: each axis numbers the windows, and new last axes the places in them."""
    from polyadic.operators.windows import sliding

    axes = t.axes
    for axis, size, stride in zip(axes, sizes, strides, strict=True):
        t = sliding(t, axis, size, stride)
        t = t.renamed((*t.axes[:-1], f"{axis}_in"))
    return t
