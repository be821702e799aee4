"""Cumulative, ordering, normalising and sliding operations along axes.

A line of up to ``lines.CHUNK`` cells is one window; longer ones, such as long vectors, go by chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Window
from pyspark.sql import functions as F

from polyadic.operators import lines
from polyadic.tensor import Tensor


def _along(t: Tensor, axis: str):
    return Window.partitionBy(*t.others(axis)).orderBy(axis)


def cumulative(t: Tensor, axis: str, op: str = "sum") -> Tensor:
    """Running sum, product, minimum or maximum along an axis."""
    f = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max}[op]
    if t.size_of(axis) > lines.CHUNK:
        return lines.scan(t.dense(), axis, op, lines.CHUNK)
    w = _along(t, axis).rowsBetween(Window.unboundedPreceding, 0)
    return t.with_df(t.dense().df.withColumn("v", f("v").over(w)))


def diff(t: Tensor, axis: str) -> Tensor:
    """Differences of neighbours; the axis is one shorter."""
    if t.size_of(axis) > lines.CHUNK:
        return lines.differences(t, axis)
    out = t.dense().df.withColumn("v", F.lead("v").over(_along(t, axis)) - F.col("v")).where("v is not null")
    return Tensor(out.select(*t.axes, "v"), t.axes, tuple(s - (a == axis) for a, s in zip(t.axes, t.shape, strict=True)))


def sort(t: Tensor, axis: str, descending: bool = False, positions: bool = False) -> Tensor:
    """Cells in order along an axis, or with ``positions`` where each came from; ties by position."""
    order = F.col("v").desc() if descending else F.col("v").asc()
    w = Window.partitionBy(*t.others(axis)).orderBy(order, axis)
    if t.size_of(axis) > lines.CHUNK:
        ranked = lines.ranked(t.dense(), axis, descending, "__k")
    else:
        ranked = t.dense().df.withColumn("__k", (F.row_number().over(w) - 1).cast("long"))
    value = F.col(axis).cast("double") if positions else F.col("v")
    return t.with_df(ranked.select(*(F.col("__k").alias(a) if a == axis else a for a in t.axes), value.alias("v")))


def softmax(t: Tensor, axis: str, log: bool = False) -> Tensor:
    if t.size_of(axis) > lines.CHUNK:
        by, n = t.others(axis), lines.count(t, axis)
        shifted = lines.with_totals(t.dense().df, by, n, __m=F.max("v")).withColumn("__s", F.col("v") - F.col("__m"))
        shifted = lines.with_totals(shifted.select(*t.axes, "__s"), by, n, __t=F.sum(F.exp("__s")))
        total = F.col("__t")
    else:
        w = Window.partitionBy(*t.others(axis))
        shifted = t.dense().df.withColumn("__s", F.col("v") - F.max("v").over(w))
        total = F.sum(F.exp("__s")).over(w)
    return t.with_df(shifted.withColumn("v", F.col("__s") - F.ln(total) if log else F.exp("__s") / total))


def normalise(t: Tensor, over: Sequence[str], epsilon: float = 1e-5) -> Tensor:
    """Layer norm: zero mean and unit variance (by n) over the axes ``over``; batch norm has the first axis there."""
    by = t.others(*over)
    if lines.cells(t, over) > lines.CHUNK:
        both = lines.with_totals(t.dense().df, by, lines.count(t, *over), __a=F.avg("v"), __q=F.var_pop("v"))
        return t.with_df(both.withColumn("v", (F.col("v") - F.col("__a")) / F.sqrt(F.col("__q") + epsilon)))
    w = Window.partitionBy(*by)
    return t.with_df(t.dense().df.withColumn("v", (F.col("v") - F.avg("v").over(w)) / F.sqrt(F.var_pop("v").over(w) + epsilon)))


def _placed(t: Tensor, sizes: dict[str, int], strides: dict[str, int], dilation: int = 1):
    """Cells dealt to the windows that hold them: window axes as ``axis``, offsets as ``axis__o``."""
    df, shape = t.df, list(t.shape)
    for axis, size in sizes.items():
        stride, k = strides.get(axis, 1), t.axes.index(axis)
        shape[k] = (t.shape[k] - (dilation * (size - 1) + 1)) // stride + 1
        df = df.withColumn(f"{axis}__o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
        at = F.col(axis) - F.col(f"{axis}__o") * dilation
        df = df.where((at >= 0) & (at % stride == 0) & (at < shape[k] * stride)).withColumn(axis, F.floor(at / stride).cast("long"))
    return df, tuple(shape)


def sliding(t: Tensor, axis: str, size: int, stride: int = 1) -> Tensor:
    """Windows along an axis: the axis numbers the windows, a new last axis the places in them."""
    df, shape = _placed(t, {axis: size}, {axis: stride})
    out = df.withColumnRenamed(f"{axis}__o", "offset")
    return Tensor(out.select(*t.axes, "offset", "v"), (*t.axes, "offset"), (*shape, size))


def pool(t: Tensor, sizes: dict[str, int], op: str = "max", strides: dict[str, int] | None = None) -> Tensor:
    """Maximum, minimum or average over windows; the stride is the window's size unless given."""
    df, shape = _placed(t.dense(), sizes, strides or sizes)
    f = {"max": F.max, "min": F.min, "avg": F.avg}[op]
    return Tensor(df.groupBy(*t.axes).agg(f("v").alias("v")), t.axes, shape)


def correlate(t: Tensor, kernel: Tensor, axes: Sequence[str], stride: int = 1, dilation: int = 1) -> Tensor:
    """Convolution as cross-correlation (the kernel is not flipped) over ``axes``, which name the kernel's axes in order.

    Windows come from index arithmetic and meet the kernel by an equi-join on the offsets.
    """
    df, shape = _placed(t, dict(zip(axes, kernel.shape, strict=True)), dict.fromkeys(axes, stride), dilation)
    weights = kernel.renamed([f"{a}__o" for a in axes]).df.withColumnRenamed("v", "__w")
    out = df.join(weights, [f"{a}__o" for a in axes]).groupBy(*t.axes).agg(F.sum(F.col("v") * F.col("__w")).alias("v"))
    return Tensor(out, t.axes, shape)


def correlate_channels(t: Tensor, kernel: Tensor, spatial: Sequence[str], channel: str, out_channel: str = "out", stride: int = 1, dilation: int = 1) -> Tensor:
    """Convolution over channels: ``kernel`` is [out, in, offsets...], and the channel axis becomes ``out_channel``."""
    df, shape = _placed(t, dict(zip(spatial, kernel.shape[2:], strict=True)), dict.fromkeys(spatial, stride), dilation)
    on = [channel, *(f"{a}__o" for a in spatial)]
    weights = kernel.renamed([out_channel, *on]).df.withColumnRenamed("v", "__w")
    keep = [out_channel if a == channel else a for a in t.axes]
    out = df.join(weights, on).groupBy(*keep).agg(F.sum(F.col("v") * F.col("__w")).alias("v"))
    return Tensor(out.select(*keep, "v"), tuple(keep), tuple(kernel.shape[0] if a == channel else s for a, s in zip(t.axes, shape, strict=True)))
