"""Discrete Fourier and cosine transforms along axes: each line of the axis is one small group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyadic.tensor import Tensor

#: Longest line that one task takes as a whole.
LONGEST = 1 << 24


def _lines(t: Tensor, imag: Tensor | None, axis: str, size: int, transform: Callable[[np.ndarray], np.ndarray]) -> tuple[Tensor, Tensor]:
    """Transform every line along ``axis``; lines without a stored cell stay without rows."""
    n, axes, keep = t.size_of(axis), list(t.axes), list(t.others(axis))
    if max(n, size) > LONGEST:
        raise ValueError(f"a line of {max(n, size)} cells is too long for one task")
    cells = t.df.select(*t.axes, F.col("v").alias("re"), F.lit(0.0).alias("im"))
    if imag is not None:
        cells = cells.unionByName(imag.renamed(t.axes).df.select(*t.axes, F.lit(0.0).alias("re"), F.col("v").alias("im")))

    def line(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n, dtype=np.complex128)
        np.add.at(x, frame[axis].to_numpy(), frame["re"].to_numpy() + 1j * frame["im"].to_numpy())
        y = np.asarray(transform(x), dtype=np.complex128)
        out = {a: np.full(size, frame[a].iloc[0]) for a in keep} | {axis: np.arange(size), "re": y.real, "im": y.imag}
        return pd.DataFrame(out)[[*axes, "re", "im"]]

    schema = ", ".join(f"`{a}` long" for a in t.axes) + ", re double, im double"
    out: DataFrame = cells.groupBy(*keep).applyInPandas(line, schema)
    shape = tuple(size if a == axis else s for a, s in zip(t.axes, t.shape, strict=True))
    return tuple(Tensor(out.select(*t.axes, F.col(c).alias("v")), t.axes, shape) for c in ("re", "im"))


def fft(t: Tensor, axis: str, imag: Tensor | None = None) -> tuple[Tensor, Tensor]:
    """Real and imaginary parts of the transform along ``axis``."""
    return _lines(t, imag, axis, t.size_of(axis), np.fft.fft)


def ifft(t: Tensor, axis: str, imag: Tensor | None = None) -> tuple[Tensor, Tensor]:
    return _lines(t, imag, axis, t.size_of(axis), np.fft.ifft)


def rfft(t: Tensor, axis: str) -> tuple[Tensor, Tensor]:
    """The half of the transform that a real line needs: n // 2 + 1 cells."""
    return _lines(t, None, axis, t.size_of(axis) // 2 + 1, lambda x: np.fft.rfft(x.real))


def irfft(re: Tensor, im: Tensor, axis: str, n: int) -> Tensor:
    return _lines(re, im, axis, n, lambda x: np.fft.irfft(x, n))[0]


def fftn(t: Tensor, axes: Sequence[str], imag: Tensor | None = None) -> tuple[Tensor, Tensor]:
    """The transform along several axes, one after the other."""
    for axis in axes:
        t, imag = fft(t, axis, imag)
    return t, imag


def ifftn(t: Tensor, axes: Sequence[str], imag: Tensor | None = None) -> tuple[Tensor, Tensor]:
    for axis in axes:
        t, imag = ifft(t, axis, imag)
    return t, imag


def dct(t: Tensor, axis: str) -> Tensor:
    """The cosine transform of type II: 2 sum x[j] cos(pi k (2 j + 1) / 2 n)."""
    n = t.size_of(axis)

    def transform(x: np.ndarray) -> np.ndarray:
        # Even cells, then odd ones backwards: one Fourier transform of the same length.
        y = np.fft.fft(np.concatenate((x[::2], x[1::2][::-1])))
        return 2 * (y * np.exp(-0.5j * np.pi * np.arange(n) / n)).real

    return _lines(t, None, axis, n, transform)[0]


def hilbert(t: Tensor, axis: str) -> tuple[Tensor, Tensor]:
    """The analytic signal of real lines: negative frequencies are dropped, positive ones doubled."""
    n = t.size_of(axis)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return _lines(t, None, axis, n, lambda x: np.fft.ifft(np.fft.fft(x) * gain))
