"""Element-wise operations on tensors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyadic.functions.numeric import BINARY, COMPARE, UNARY
from polyadic.tensor import Tensor

#: Functions that give other than 0 for 0, and so need every cell as a row.
_FILLS = frozenset("exp exp2 log log2 log10 cos acos cosh acosh recip sigmoid softplus hard_sigmoid".split())


#: Operations that give other than 0 for two zeros.
_FILLS_TWO = frozenset("div pow modulo".split())


def unary(t: Tensor, name: str, stored_only: bool = False) -> Tensor:
    """Apply a function of UNARY to every cell, or with ``stored_only`` to the cells that have rows."""
    source = t if stored_only or name not in _FILLS else t.dense()
    return t.with_df(source.df.withColumn("v", UNARY[name](F.col("v"))))


def scalar(t: Tensor, name: str, value: float) -> Tensor:
    """Combine every cell with a number by an operation of BINARY."""
    return t.with_df(t.dense().df.withColumn("v", BINARY[name](F.col("v"), F.lit(float(value)))))


def clip(t: Tensor, low: float, high: float) -> Tensor:
    v = F.col("v")
    source = t if low <= 0 <= high else t.dense()
    return t.with_df(source.df.withColumn("v", F.when(v < low, F.lit(float(low))).when(v > high, F.lit(float(high))).otherwise(v)))


def _aligned(a: Tensor, b: Tensor) -> tuple[list[str], list[str], tuple[int, ...]]:
    """Join columns of NumPy-style broadcasting: trailing axes meet, size 1 stretches."""
    extra = len(a.axes) - len(b.axes)
    if extra < 0:
        raise ValueError("the first operand must have as many axes as the second or more")
    on, shape = [], list(a.shape)
    for k, (axis, size) in enumerate(zip(b.axes, b.shape, strict=True)):
        mine = a.shape[extra + k]
        if size == mine:
            on.append((a.axes[extra + k], axis))
        elif size != 1:
            raise ValueError(f"sizes {mine} and {size} do not broadcast")
    return [x for x, _ in on], [y for _, y in on], tuple(shape)


def binary(a: Tensor, b: Tensor, name: str, how: str = "outer") -> Tensor:
    """Combine two tensors by an operation of BINARY; the second one is broadcast to the first.

    ``how`` is "outer" (missing cells are 0; cells stored in neither are left out where the operation
    gives 0 for them, and are rows where it does not), "inner" (cells stored in both) or "dense"
    (every cell).
    """
    if how == "outer" and name in _FILLS_TWO:
        how = "dense"
    on, theirs, shape = _aligned(a, b)
    other = b.df.select(*(F.col(y).alias(x) for x, y in zip(on, theirs, strict=True)), F.col("v").alias("__w"))
    full = len(on) == len(a.axes)
    if how == "dense" or (how == "outer" and not full):
        mine, kind = a.dense().df, "left"
    else:
        mine, kind = a.df, {"outer": "full", "inner": "inner"}[how]
    both = mine.join(other, on, kind) if on else mine.crossJoin(other)
    x, y = F.coalesce("v", F.lit(0.0)), F.coalesce("__w", F.lit(0.0))
    return Tensor(both.select(*a.axes, BINARY[name](x, y).alias("v")), a.axes, shape)


def compare(a: Tensor, b: Tensor | float, name: str) -> Tensor:
    """1 where the comparison of COMPARE holds, else 0, for every cell."""
    if not isinstance(b, Tensor):
        return a.with_df(a.dense().df.withColumn("v", COMPARE[name](F.col("v"), F.lit(float(b))).cast("double")))
    mine, other = a.dense().df, b.dense().renamed(a.axes).df.withColumnRenamed("v", "__w")
    return a.with_df(mine.join(other, list(a.axes)).withColumn("v", COMPARE[name](F.col("v"), F.col("__w")).cast("double")))


def where(condition: Tensor, a: Tensor, b: Tensor) -> Tensor:
    """Cells of ``a`` where ``condition`` is not 0, else of ``b``; all three have one shape."""
    axes = list(a.axes)
    c = condition.renamed(a.axes).df.where("v <> 0").select(*axes)
    return a.with_df(a.df.join(c, axes, "left_semi").unionByName(b.renamed(a.axes).df.join(c, axes, "left_anti")))


def mapped(t: Tensor, function: Column) -> Tensor:
    """A Column expression of ``v`` and the axes for every cell that has a row."""
    return t.with_df(t.df.withColumn("v", function))
