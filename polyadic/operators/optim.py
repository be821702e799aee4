"""Optimisers and learning rates: a step is one join of parameters, gradient and state, and column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyadic.iterate import cut
from polyadic.tensor import Tensor

Step = Callable[[dict[str, Column], int], dict[str, Column]]


@dataclass(frozen=True)
class Optimiser:
    """A rule from ``v``, ``g`` and the state's columns to their next values, and the state itself."""

    names: tuple[str, ...]
    rule: Step
    state: Mapping[str, Tensor] = field(default_factory=dict)
    steps: int = 0

    def step(self, x: Tensor, gradient: Tensor) -> tuple[Tensor, Optimiser]:
        """Parameters after one step, and the optimiser with its state after it; a missing cell is 0."""
        axes, both = list(x.axes), x.df
        for name, t in {"g": gradient, **self.state}.items():
            both = both.join(t.renamed(x.axes).df.withColumnRenamed("v", name), axes, "full") if axes else both.crossJoin(t.df.withColumnRenamed("v", name))
        known = {n: F.coalesce(F.col(n), F.lit(0.0)) if n in self.state or n in "vg" else F.lit(0.0) for n in ("v", "g", *self.names)}
        new = self.rule(known, self.steps + 1)
        both = cut(both.select(*axes, *(new[n].cast("double").alias(n) for n in ("v", *self.names))))
        state = {n: x.with_df(both.select(*axes, F.col(n).alias("v"))) for n in self.names}
        return x.with_df(both), Optimiser(self.names, self.rule, state, self.steps + 1)


def sgd(rate: float, momentum: float = 0.0, nesterov: bool = False, decay: float = 0.0) -> Optimiser:
    """Gradient descent with weight decay, and momentum of the classical or Nesterov's kind."""

    def rule(c: dict[str, Column], step: int) -> dict[str, Column]:
        g = c["g"] + decay * c["v"]
        if not momentum:
            return {"v": c["v"] - rate * g}
        m = momentum * c["m"] + g
        return {"v": c["v"] - rate * (g + momentum * m if nesterov else m), "m": m}

    return Optimiser(("m",) if momentum else (), rule)


def adam(rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8, decay: float = 0.0, decoupled: bool = False) -> Optimiser:
    """Adam; with ``decoupled`` the decay acts on the parameters and not on the gradient (AdamW)."""

    def rule(c: dict[str, Column], step: int) -> dict[str, Column]:
        g = c["g"] if decoupled else c["g"] + decay * c["v"]
        m, s = beta1 * c["m"] + (1 - beta1) * g, beta2 * c["s"] + (1 - beta2) * g * g
        move = m / (1 - beta1**step) / (F.sqrt(s / (1 - beta2**step)) + epsilon)
        return {"v": c["v"] * (1 - rate * decay if decoupled else 1.0) - rate * move, "m": m, "s": s}

    return Optimiser(("m", "s"), rule)


def radam(rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8) -> Optimiser:
    """Rectified Adam (Liu et al., 2020): the adaptive part acts once its variance is bounded."""
    longest = 2 / (1 - beta2) - 1

    def rule(c: dict[str, Column], step: int) -> dict[str, Column]:
        m, s = beta1 * c["m"] + (1 - beta1) * c["g"], beta2 * c["s"] + (1 - beta2) * c["g"] * c["g"]
        length = longest - 2 * step * beta2**step / (1 - beta2**step)
        move = m / (1 - beta1**step)
        if length > 4:
            r = math.sqrt((length - 4) * (length - 2) * longest / ((longest - 4) * (longest - 2) * length))
            move = move * r / (F.sqrt(s / (1 - beta2**step)) + epsilon)
        return {"v": c["v"] - rate * move, "m": m, "s": s}

    return Optimiser(("m", "s"), rule)


def rmsprop(rate: float = 1e-2, alpha: float = 0.99, epsilon: float = 1e-8) -> Optimiser:
    def rule(c: dict[str, Column], step: int) -> dict[str, Column]:
        s = alpha * c["s"] + (1 - alpha) * c["g"] * c["g"]
        return {"v": c["v"] - rate * c["g"] / (F.sqrt(s) + epsilon), "s": s}

    return Optimiser(("s",), rule)


def adagrad(rate: float = 1e-2, epsilon: float = 1e-8) -> Optimiser:
    def rule(c: dict[str, Column], step: int) -> dict[str, Column]:
        s = c["s"] + c["g"] * c["g"]
        return {"v": c["v"] - rate * c["g"] / (F.sqrt(s) + epsilon), "s": s}

    return Optimiser(("s",), rule)


def rate_at(step: int, base: float, kind: str, total: int | None = None, warmup: int = 0, gamma: float = 0.1, every: int = 1) -> float:
    """Learning rates: constant, step, exponential, linear or cosine (these two over ``total`` steps), after a linear warm-up."""
    if kind in ("linear", "cosine") and total is None:
        raise ValueError(f"a {kind} rate needs the total number of steps")
    if step < warmup:
        return base * (step + 1) / warmup
    since = step - warmup
    done = min(1.0, since / max(1, (total or 0) - warmup))
    return base * {"constant": 1.0, "step": gamma ** (since // every), "exponential": gamma**since, "linear": 1.0 - done, "cosine": 0.5 * (1 + math.cos(math.pi * done))}[kind]


def plateau_rate(losses: list[float], base: float, factor: float = 0.5, patience: int = 3) -> float:
    """``base`` cut by ``factor`` whenever the loss has not improved for more than ``patience`` steps."""
    best, waited, rate = math.inf, 0, base
    for loss in losses:
        best, waited = (loss, 0) if loss < best else (best, waited + 1)
        if waited > patience:
            rate, waited = rate * factor, 0
    return rate
