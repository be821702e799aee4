"""Reverse-mode differentiation: values record how they were made, and backward() turns that into gradients.

Values are tensors, so each recorded step and its adjoint is a join, a grouped sum or column arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import functions as F

from polyadic.iterate import cut
from polyadic.operators import ad, elementwise, reduce
from polyadic.operators.shape import flat_index
from polyadic.operators.sparse import add as added
from polyadic.plans.einsum import einsum as einsum_of
from polyadic.tensor import Tensor

Adjoint = Callable[[Tensor], Tensor]


@dataclass(frozen=True, eq=False)
class Node:
    """A value and, for each value it was made from, the map from its gradient to that one's."""

    value: Tensor
    parents: tuple[tuple[Node, Adjoint], ...] = ()


def leaf(t: Tensor) -> Node:
    return Node(t)


def _scaled(t: Tensor, factor: float) -> Tensor:
    return t.with_df(t.df.withColumn("v", F.col("v") * factor))


def add(a: Node, b: Node, alpha: float = 1.0, beta: float = 1.0) -> Node:
    """alpha a + beta b, of one shape."""
    other = b.value.axes
    return Node(added(a.value, b.value, alpha, beta), ((a, lambda g: _scaled(g, alpha)), (b, lambda g: _scaled(g, beta).renamed(other))))


def scale(a: Node, factor: float) -> Node:
    return Node(_scaled(a.value, factor), ((a, lambda g: _scaled(g, factor)),))


def einsum(spec: str, *nodes: Node) -> Node:
    """Products and sums of any kind: matrix products, element-wise products, traces over two operands."""
    values = [n.value for n in nodes]

    def adjoint(k: int) -> Adjoint:
        return lambda g: ad.einsum_vjp(spec, values, g)[k]

    return Node(einsum_of(spec, *values), tuple((n, adjoint(k)) for k, n in enumerate(nodes)))


def unary(a: Node, name: str) -> Node:
    """A function of ad.DERIVATIVES for every cell."""
    return Node(elementwise.unary(a.value, name), ((a, lambda g: ad.unary_vjp(a.value, name, g)),))


def reduced(a: Node, axes: Sequence[str], op: str = "sum") -> Node:
    """Sum, mean, maximum or minimum over axes."""
    return Node(reduce.reduce(a.value, list(axes), op), ((a, lambda g: ad.reduction_vjp(a.value, axes, op, g.dense() if g.axes else g)),))


def _order(node: Node, seen: dict[int, Node]) -> None:
    if id(node) not in seen:
        for parent, _ in node.parents:
            _order(parent, seen)
        seen[id(node)] = node


def backward(result: Node, *of: Node) -> list[Tensor]:
    """Gradients of a result without axes with respect to some nodes; a node that it doesn't need has zeros."""
    if result.value.axes:
        raise ValueError("only a result without axes has a gradient")
    seen: dict[int, Node] = {}
    _order(result, seen)
    spark = result.value.df.sparkSession
    found = {id(result): Tensor(spark.range(1).select(F.lit(1.0).alias("v")), (), ())}
    for key, node in reversed(list(seen.items())):
        gradient = found.get(key)
        for parent, adjoint in node.parents if gradient is not None else ():
            part = adjoint(gradient)
            part = part.renamed(parent.value.axes)
            before = found.get(id(parent))
            total = part if before is None else added(before, part)
            found[id(parent)] = total.with_df(cut(total.df))
    return [found[id(n)] if id(n) in found else n.value.with_df(n.value.df.limit(0)) for n in of]


def _number(node: Node) -> float:
    return float(node.value.df.first()[0] or 0.0)


def _direction(x: Tensor, seed: int) -> Tensor:
    """Cells of -1 and 1 by a hash of their place."""
    full = x.dense()
    sign = F.when(F.xxhash64(flat_index(x) if x.axes else F.lit(0), F.lit(seed)) % 2 == 0, 1.0).otherwise(-1.0)
    return x.with_df(full.df.withColumn("v", sign))


def _moved(x: Tensor, d: Tensor, step: float) -> Tensor:
    return x.with_df(cut(added(x, d, 1.0, step).df))


def gradient_error(f: Callable[[Node], Node], x: Tensor, step: float = 1e-5, seed: int = 0) -> float:
    """|slope - expected| / max(1, |slope|) along a seeded direction: central differences against backward()."""
    d = _direction(x, seed)
    at = leaf(x)
    (g,) = backward(f(at), at)
    letters = "abcdefgh"[: len(x.axes)]
    expected = float(einsum_of(f"{letters},{letters}->", g, d).df.first()[0] or 0.0)
    slope = (_number(f(leaf(_moved(x, d, step)))) - _number(f(leaf(_moved(x, d, -step))))) / (2 * step)
    return abs(slope - expected) / max(1.0, abs(slope))


def hessian_product(f: Callable[[Node], Node], x: Tensor, d: Tensor, step: float = 1e-4) -> Tensor:
    """The Hessian at x times d, by central differences of gradients."""
    sides = []
    for sign in (1.0, -1.0):
        at = leaf(_moved(x, d, sign * step))
        sides.append(backward(f(at), at)[0])
    return added(*sides, 0.5 / step, -0.5 / step)
