"""Gradients of tensor expressions, as tensor expressions, and what is done to gradients before a step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Window
from pyspark.sql import functions as F

from polyadic.functions.numeric import safe_div
from polyadic.operators import lines
from polyadic.plans.einsum import einsum, parse_spec
from polyadic.tensor import Tensor


def einsum_vjp(spec: str, tensors: Sequence[Tensor], gradient: Tensor) -> list[Tensor]:
    """For each operand of an einsum, the gradient that the output's gradient gives.

    Each adjoint is itself an einsum; an index that only one operand has is spread over its size.
    """
    inputs, out = parse_spec(spec)
    grads = []
    for k, letters in enumerate(inputs):
        if len(set(letters)) != len(letters):
            raise ValueError("repeated indices within an operand are not supported here")
        others = [(s, t) for j, (s, t) in enumerate(zip(inputs, tensors, strict=True)) if j != k]
        known = set(out).union(*(s for s, _ in others))
        missing = [i for i in letters if i not in known]
        specs, frames = [out, *(s for s, _ in others)], [gradient, *(t for _, t in others)]
        spark = gradient.df.sparkSession
        for i in missing:
            size = tensors[k].shape[letters.index(i)]
            specs.append(i)
            frames.append(Tensor(spark.range(size).select(F.col("id").alias("i"), F.lit(1.0).alias("v")), ("i",), (size,)))
        grads.append(einsum(",".join(specs) + "->" + letters, *frames).renamed(tensors[k].axes))
    return grads


#: Derivatives by the input ``v`` of functions of UNARY.
DERIVATIVES = {
    "neg": lambda: F.lit(-1.0),
    "exp": lambda: F.exp("v"),
    "log": lambda: safe_div(F.lit(1.0), F.col("v")),
    "sin": lambda: F.cos("v"),
    "cos": lambda: -F.sin("v"),
    "sqrt": lambda: safe_div(F.lit(0.5), F.sqrt("v")),
    "sqr": lambda: 2.0 * F.col("v"),
    "recip": lambda: safe_div(F.lit(-1.0), F.col("v") * F.col("v")),
    "tanh": lambda: 1.0 - F.tanh("v") * F.tanh("v"),
    "sigmoid": lambda: F.exp(-F.abs("v")) / ((1.0 + F.exp(-F.abs("v"))) * (1.0 + F.exp(-F.abs("v")))),
    "relu": lambda: F.when(F.col("v") > 0, 1.0).otherwise(0.0),
    "softplus": lambda: 1.0 / (1.0 + F.exp(-F.col("v"))),
}


def unary_vjp(x: Tensor, name: str, gradient: Tensor) -> Tensor:
    """Gradient through an element-wise function."""
    g = gradient.renamed(x.axes).df.withColumnRenamed("v", "__g")
    return x.with_df(x.dense().df.join(g, list(x.axes)).withColumn("v", DERIVATIVES[name]() * F.col("__g")))


def reduction_vjp(x: Tensor, axes: Sequence[str], op: str, gradient: Tensor) -> Tensor:
    """Gradient through a sum, mean, maximum or minimum over axes; equal extremes share it."""
    keep = list(x.others(*axes))
    g = gradient.df.withColumnRenamed("v", "__g")
    full = x.dense().df
    both = full.join(g, keep) if keep else full.crossJoin(g)
    if op in ("sum", "mean"):
        n = 1
        for a in axes:
            n *= x.size_of(a)
        return x.with_df(both.withColumn("v", F.col("__g") / (n if op == "mean" else 1)))
    extreme = F.max if op == "max" else F.min
    if lines.cells(x, axes) > lines.CHUNK:
        n = lines.count(x, *axes)
        ties = lines.with_totals(both, keep, n, __b=extreme("v")).select(*x.axes, "v", "__g", "__b")
        ties = lines.with_totals(ties, keep, n, __n=F.sum((F.col("v") == F.col("__b")).cast("double")))
        return x.with_df(ties.withColumn("v", F.when(F.col("v") == F.col("__b"), F.col("__g") / F.col("__n")).otherwise(0.0)))
    w = Window.partitionBy(*keep)
    best = extreme("v").over(w)
    ties = both.withColumn("__b", best).withColumn("__n", F.sum((F.col("v") == F.col("__b")).cast("double")).over(w))
    return x.with_df(ties.withColumn("v", F.when(F.col("v") == F.col("__b"), F.col("__g") / F.col("__n")).otherwise(0.0)))


def clip_by_norm(g: Tensor, limit: float) -> Tensor:
    """The gradient scaled down to a Euclidean norm of ``limit`` at most."""
    size = g.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("__n"))
    return g.with_df(g.df.crossJoin(size).withColumn("v", F.col("v") * F.least(F.lit(1.0), limit / F.col("__n"))))


def top_k(g: Tensor, k: int) -> Tensor:
    """The k cells of largest modulus; ties by index."""
    return g.with_df(g.df.orderBy(F.abs("v").desc(), *g.axes).limit(k))
