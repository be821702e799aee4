"""Distributed CP factors against plain NumPy sweeps from the same start."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyadic.operators import factors
from polyadic.tensor import Tensor, from_numpy


def array(frame, n, rank):
    out = np.zeros((n, rank))
    for r in frame.collect():
        out[r["i"]] = r["u"]
    return out


def begin(shape, rank):
    return [0.25 + ((np.arange(n)[:, None] * 7919 + (np.arange(rank) + 1) * 104729 * (k + 1)) % 1009) / 1009.0 for k, n in enumerate(shape)]


def model(us):
    return np.einsum("ir,jr,kr->ijk", *us)


def test_sweeps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 5, 4))
    x[2] = 0  # an index without cells
    us = begin(x.shape, 3)
    for _ in range(2):
        for k, spec in enumerate(("ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr")):
            others = [u for q, u in enumerate(us) if q != k]
            us[k] = np.einsum(spec, x, *others) @ np.linalg.inv(np.prod([u.T @ u for u in others], axis=0))
    got = factors.cp_als_frames(from_numpy(spark, x, ("i", "j", "k")), 3, rounds=2, tolerance=0)
    for k, n in enumerate(x.shape):
        assert np.allclose(array(got.factors[k], n, 3), us[k], atol=1e-8)
    assert got.stopped == "rounds" and abs(got.fit - (1 - np.linalg.norm(x - model(us)) / np.linalg.norm(x))) < 1e-8
    cells = factors.cp_cells(from_numpy(spark, np.ones(x.shape), ("i", "j", "k")).df, ("i", "j", "k"), got.factors)
    back = np.zeros(x.shape)
    for r in cells.collect():
        back[r["i"], r["j"], r["k"]] = r["model"]
    assert np.allclose(back, model(us), atol=1e-8)


def test_completion(spark):
    rng = np.random.default_rng(5)
    x = model([rng.random((n, 2)) + 0.5 for n in (6, 5, 4)])
    known = rng.random(x.shape) < 0.8
    us = begin(x.shape, 2)
    for k in range(3):
        spread = [us[q].reshape([x.shape[q] if a == q else 1 for a in range(3)] + [2]) for q in range(3) if q != k]
        w = [np.moveaxis(np.broadcast_to(u, (*x.shape, 2)), k, 0) for u in spread]
        w, m, v = w[0] * w[1], np.moveaxis(known, k, 0), np.moveaxis(x, k, 0)
        us[k] = np.array([np.linalg.solve(a[b].T @ a[b] + 1e-6 * np.eye(2), a[b].T @ c[b]) for a, b, c in zip(w, m, v, strict=True)])
    t = from_numpy(spark, x, ("i", "j", "k"))
    cells = from_numpy(spark, known.astype(float), ("i", "j", "k")).df.drop("v")
    got = factors.cp_complete_frames(t.with_df(t.df.join(cells, ["i", "j", "k"])), 2, rounds=1)
    for k, n in enumerate(x.shape):
        assert np.allclose(array(got.factors[k], n, 2), us[k], atol=1e-8)


def test_constraints_and_refusals(spark):
    rng = np.random.default_rng(6)
    t = from_numpy(spark, rng.random((4, 3, 3)), ("i", "j", "k"))
    got = factors.cp_als_frames(t, 2, rounds=3, tolerance=0, nonnegative=True)
    assert got.fits == sorted(got.fits)  # multiplicative updates never lose
    assert factors.as_cells(got.factors).where("v < 0").count() == 0
    sparse = factors.cp_als_frames(t, 2, rounds=1, sparsity=1e6)
    assert factors.as_cells(sparse.factors).where("v <> 0").count() == 0
    empty = Tensor(t.df.where(F.lit(False)), t.axes, t.shape)
    assert factors.cp_als_frames(empty, 2, rounds=1).fit == 1.0
    for bad in (dict(rank=0), dict(rank=999)):
        with pytest.raises(ValueError):
            factors.cp_als_frames(t, **bad)
    with pytest.raises(ValueError):
        factors.cp_als_frames(t.with_df(t.df.withColumn("v", -F.col("v"))), 1, nonnegative=True)
    with pytest.raises(ValueError):
        factors.cp_complete_frames(t, 1, ridge=0.0)
