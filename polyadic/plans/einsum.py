"""Einsum: a spec is parsed, an order of pairwise contractions chosen, and each step is a join and a sum."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyadic.tensor import Tensor


def parse_spec(spec: str) -> tuple[list[str], str]:
    """Index strings of the inputs and of the output.

    Without ``->`` the output has all indices in order of appearance, so nothing is summed.
    """
    if not re.fullmatch(r"[a-z]*(,[a-z]*)*(->[a-z]*)?", spec := spec.replace(" ", "")) or not spec:
        raise ValueError(f"bad einsum spec {spec!r}")
    left, arrow, out = spec.partition("->")
    inputs = left.split(",")
    if not arrow:
        out = "".join(dict.fromkeys(left.replace(",", "")))
    if len(set(out)) != len(out) or not set(out) <= set(left):
        raise ValueError("output indices must be distinct and appear in the inputs")
    return inputs, out


def _cost(indices: set[str], sizes: dict[str, int]) -> float:
    return reduce(lambda c, i: c * sizes[i], indices, 1.0)


def contraction_order(inputs: list[set[str]], out: set[str], sizes: dict[str, int]) -> list[tuple[int, int]]:
    """Pairs of operand numbers to contract, results numbered on; exact for up to 8 operands, else greedy."""

    def left(parts: frozenset[int]) -> set[str]:
        """Indices that the product of some inputs still needs."""
        rest = out.union(*(inputs[k] for k in range(len(inputs)) if k not in parts))
        return set().union(*(inputs[k] for k in parts)) & rest

    n = len(inputs)
    if n <= 8:
        best: dict[frozenset[int], tuple[float, tuple | None]] = {frozenset([k]): (0.0, None) for k in range(n)}
        for size in range(2, n + 1):
            for whole in map(frozenset, combinations(range(n), size)):
                first = min(whole)
                for k in range(size - 1):
                    for rest in combinations(sorted(whole - {first}), k):
                        a = frozenset((first, *rest))
                        b = whole - a
                        cost = best[a][0] + best[b][0] + _cost(left(a) | left(b), sizes)
                        if whole not in best or cost < best[whole][0]:
                            best[whole] = (cost, (a, b))
        steps: list[tuple[int, int]] = []

        def walk(parts: frozenset[int]) -> int:
            split = best[parts][1]
            if split is None:
                return min(parts)
            pair = (walk(split[0]), walk(split[1]))
            steps.append(pair)
            return n + len(steps) - 1

        if n:
            walk(frozenset(range(n)))
        return steps
    live = {k: frozenset([k]) for k in range(n)}
    steps = []
    while len(live) > 1:
        a, b = min(combinations(sorted(live), 2), key=lambda p: (not left(live[p[0]]) & left(live[p[1]]), _cost(left(live[p[0]] | live[p[1]]), sizes), _cost(left(live[p[0]]) | left(live[p[1]]), sizes)))
        steps.append((a, b))
        live[n + len(steps) - 1] = live.pop(a) | live.pop(b)
    return steps


def _summed(df: DataFrame, have: list[str], keep: list[str]) -> DataFrame:
    if set(have) == set(keep):
        return df.select(*keep, "v")
    return df.groupBy(*keep).agg(F.sum("v").alias("v"))


def einsum(spec: str, *tensors: Tensor, mask: DataFrame | None = None) -> Tensor:
    """Any einsum: batch, repeated and summed indices, any output order.

    ``mask`` is a frame of output index tuples (columns named by the output's letters); only those
    cells are computed: it filters the inputs by semi-joins before anything is multiplied.
    """
    inputs, out = parse_spec(spec)
    if len(inputs) != len(tensors):
        raise ValueError(f"{len(inputs)} operands in the spec, {len(tensors)} given")
    sizes: dict[str, int] = {}
    frames: list[tuple[DataFrame, list[str]]] = []
    for letters, t in zip(inputs, tensors, strict=True):
        if len(letters) != len(t.axes):
            raise ValueError(f"{letters!r} does not fit {len(t.axes)} axes")
        for i, size in zip(letters, t.shape, strict=True):
            if sizes.setdefault(i, size) != size:
                raise ValueError(f"index {i} has sizes {sizes[i]} and {size}")
        df, first = t.df, {}
        for i, axis in zip(letters, t.axes, strict=True):
            if i in first:  # a repeated index keeps the diagonal
                df = df.where(F.col(axis) == F.col(first[i]))
            first.setdefault(i, axis)
        df = df.select(*(F.col(axis).alias(i) for i, axis in first.items()), "v")
        if mask is not None and (shared := [i for i in first if i in out]):
            df = df.join(mask.select(*shared).distinct(), shared, "left_semi")
        frames.append((df, list(first)))
    if mask is not None and len(frames) == 1 and not out:
        raise ValueError("a mask needs an output index")

    parts: list[set[str]] = [set(have) for _, have in frames]
    steps = contraction_order(parts, set(out), sizes)
    live = dict(enumerate(frames))
    # Sum at once over what only one operand has.
    for k, (df, have) in list(live.items()):
        rest = set(out).union(*(live[j][1] for j in live if j != k))
        live[k] = (_summed(df, have, keep := [i for i in have if i in rest]), keep)
    for number, (a, b) in enumerate(steps, start=len(frames)):
        (x, xi), (y, yi) = live.pop(a), live.pop(b)
        shared = [i for i in xi if i in yi]
        x, y = x.withColumnRenamed("v", "__x"), y.withColumnRenamed("v", "__y")
        both = x.join(y, shared) if shared else x.crossJoin(y)
        have = list(dict.fromkeys(xi + yi))
        rest = set(out).union(*(have_j for _, have_j in live.values())) if live else set(out)
        keep = [i for i in have if i in rest]
        both = both.select(*have, (F.col("__x") * F.col("__y")).alias("v"))
        if mask is not None and not live and out:
            both = both.join(mask.select(*out), list(out), "left_semi")
        live[number] = (_summed(both, have, keep), keep)
    df, have = next(iter(live.values()))
    df = _summed(df, have, list(out))
    if not out:
        df = df.select(F.coalesce("v", F.lit(0.0)).alias("v"))
    return Tensor(df.select(*out, "v"), tuple(out), tuple(sizes[i] for i in out))
