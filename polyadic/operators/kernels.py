"""Multilinear kernels, all through joins and grouped sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from string import ascii_lowercase

from pyspark.sql import functions as F

from polyadic.plans.einsum import einsum
from polyadic.tensor import Tensor


def hadamard(a: Tensor, b: Tensor) -> Tensor:
    """Element-wise product of two tensors of one shape."""
    letters = ascii_lowercase[: len(a.axes)]
    return einsum(f"{letters},{letters}->{letters}", a, b).renamed(a.axes)


def outer(*vectors: Tensor, names: Sequence[str] = ()) -> Tensor:
    """Outer product: the axes of all operands one after another."""
    at, parts = 0, []
    for t in vectors:
        parts.append(ascii_lowercase[at : at + len(t.axes)])
        at += len(t.axes)
    out = einsum(",".join(parts) + "->" + "".join(parts), *vectors)
    return out.renamed(names) if names else out


def kronecker(a: Tensor, b: Tensor) -> Tensor:
    """Kronecker product of two matrices."""
    (m, n), (p, q) = a.shape, b.shape
    x = a.renamed(("a0", "a1")).df.withColumnRenamed("v", "x")
    y = b.renamed(("b0", "b1")).df.withColumnRenamed("v", "y")
    cells = x.crossJoin(y).select((F.col("a0") * p + F.col("b0")).alias("i"), (F.col("a1") * q + F.col("b1")).alias("j"), (F.col("x") * F.col("y")).alias("v"))
    return Tensor(cells, ("i", "j"), (m * p, n * q))


def khatri_rao(a: Tensor, b: Tensor) -> Tensor:
    """Column-wise Kronecker product: row i_a * J + i_b."""
    (i, r), (j, s) = a.shape, b.shape
    if r != s:
        raise ValueError("both matrices need as many columns")
    x = a.renamed(("a0", "r")).df.withColumnRenamed("v", "x")
    y = b.renamed(("b0", "r")).df.withColumnRenamed("v", "y")
    cells = x.join(y, "r").select((F.col("a0") * j + F.col("b0")).alias("i"), "r", (F.col("x") * F.col("y")).alias("v"))
    return Tensor(cells, ("i", "r"), (i * j, r))


def nmode_product(x: Tensor, u: Tensor, mode: int) -> Tensor:
    """Multiply mode ``mode`` by the matrix ``u`` [m, n]."""
    letters = ascii_lowercase[: len(x.axes)]
    new = ascii_lowercase[len(letters)]
    out = letters.replace(letters[mode], new)
    return einsum(f"{letters},{new}{letters[mode]}->{out}", x, u).renamed(x.axes)


def nmode_products(x: Tensor, factors: dict[int, Tensor]) -> Tensor:
    """Several mode products, planned together."""
    letters = ascii_lowercase[: len(x.axes)]
    spec, out, tensors = [letters], letters, [x]
    for k, (mode, u) in enumerate(factors.items()):
        new = ascii_lowercase[len(letters) + k]
        spec.append(new + letters[mode])
        out = out.replace(letters[mode], new)
        tensors.append(u)
    return einsum(",".join(spec) + "->" + out, *tensors).renamed(x.axes)


def contract(a: Tensor, b: Tensor, axes_a: Sequence[int], axes_b: Sequence[int]) -> Tensor:
    """Tensor-tensor product over pairs of axes; free axes of ``a``, then of ``b``."""
    la = ascii_lowercase[: len(a.axes)]
    lb = list(ascii_lowercase[len(la) : len(la) + len(b.axes)])
    for i, j in zip(axes_a, axes_b, strict=True):
        lb[j] = la[i]
    out = [c for k, c in enumerate(la) if k not in axes_a] + [c for k, c in enumerate(lb) if k not in axes_b]
    return einsum(f"{la},{''.join(lb)}->{''.join(out)}", a, b)


def mttkrp(x: Tensor, factors: Sequence[Tensor], mode: int) -> Tensor:
    """Matricised tensor times Khatri-Rao product of the other modes' factors, never formed."""
    letters = ascii_lowercase[: len(x.axes)]
    others = [k for k in range(len(letters)) if k != mode]
    spec = ",".join([letters] + [letters[k] + "z" for k in others])
    return einsum(f"{spec}->{letters[mode]}z", x, *(factors[k] for k in others)).renamed((x.axes[mode], "r"))


def cp_reconstruct(factors: Sequence[Tensor], weights: Tensor | None = None, names: Sequence[str] = ()) -> Tensor:
    """Sum of the outer products of factor columns."""
    letters = ascii_lowercase[: len(factors)]
    spec = ",".join([c + "z" for c in letters] + (["z"] if weights else []))
    out = einsum(f"{spec}->{letters}", *factors, *([weights] if weights else []))
    return out.renamed(names) if names else out


def tucker_reconstruct(core: Tensor, factors: Sequence[Tensor]) -> Tensor:
    """The core times each factor [n, r] in its mode."""
    return nmode_products(core, dict(enumerate(factors)))


def inner(a: Tensor, b: Tensor) -> Tensor:
    """Sum of products over all cells, as a tensor without axes."""
    letters = ascii_lowercase[: len(a.axes)]
    return einsum(f"{letters},{letters}->", a, b)


def trace(a: Tensor) -> Tensor:
    return einsum("aa->", a)


def gram(u: Tensor) -> Tensor:
    """U'U of a matrix."""
    return einsum("ia,ib->ab", u, u)


def gram_hadamard(factors: Sequence[Tensor]) -> Tensor:
    """Element-wise product of the factors' Gram matrices."""
    return reduce(hadamard, map(gram, factors))
