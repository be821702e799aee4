"""Block frames and the tree QR against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyadic import blocks
from polyadic.operators import tall
from polyadic.plans.einsum import einsum
from polyadic.tensor import Tensor, from_numpy


def back(b):
    return blocks.to_cells(b).to_numpy()


@pytest.mark.parametrize("sides", [(3, 4), (50, 50), (1, 1)])
def test_block_products(spark, sides):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(7, 10)), rng.normal(size=(10, 5))
    x[:3, :4] = 0  # a block that is not stored
    a = blocks.to_blocks(from_numpy(spark, x, ("i", "j")), sides)
    b = blocks.to_blocks(from_numpy(spark, y, ("i", "j")), (sides[1], 2))
    assert np.allclose(back(a), x) and np.allclose(back(blocks.transposed(a)), x.T)
    assert np.allclose(back(blocks.multiply(a, b)), x @ y)
    assert np.allclose(back(blocks.gram(a)), x.T @ x)
    assert np.allclose(back(blocks.added(a, blocks.scaled(a, 2.0))), 3 * x)
    with pytest.raises(ValueError):
        blocks.multiply(a, a)


def test_covariance_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6)) + 1e6
    x[:, 2] = 5.0
    for a in (blocks.to_blocks(from_numpy(spark, x, ("i", "j")), (8, 4)), blocks.from_vectors(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3), F.col("x"), 6, side=16)):
        got = back(blocks.covariance(a))
        assert np.allclose(got, np.cov(x.T), atol=1e-9)
        got = back(blocks.covariance(a, correlation=True))
        with np.errstate(all="ignore"):
            want = np.corrcoef(x.T)
        want[2], want[:, 2] = np.nan, np.nan
        assert np.allclose(got, want, equal_nan=True)
    with pytest.raises(Exception, match="components"):
        blocks.gram(blocks.from_vectors(spark.createDataFrame([([1.0],)], "x array<double>"), F.col("x"), 6)).df.collect()


def test_einsum_blocks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3, 4, 5)), rng.normal(size=(5, 3, 2))
    a, b = from_numpy(spark, x, ("p", "q", "w")), from_numpy(spark, y, ("s", "t", "u"))
    got = blocks.einsum_blocks("abc,cad->db", a, b, side=2)
    assert got.axes == ("d", "b") and got.shape == (2, 4)
    assert np.allclose(got.to_numpy(), np.einsum("abc,cad->db", x, y)) and np.allclose(got.to_numpy(), einsum("abc,cad->db", a, b).to_numpy())
    factors = [rng.normal(size=(n, 2)) for n in x.shape]
    frames = [from_numpy(spark, u, (f"i{k}", "r")) for k, u in enumerate(factors)]
    for mode in range(3):
        spec = ",".join(["abc", *("abc"[k] + "z" for k in range(3) if k != mode)])
        want = np.einsum(f"{spec}->{'abc'[mode]}z", x, *(u for k, u in enumerate(factors) if k != mode))
        assert np.allclose(blocks.mttkrp_blocks(a, frames, mode, side=3).to_numpy(), want)
    for spec in ("ab,ab->ab", "aa,ab->b", "ab,cd->abcd", "abc,cd->ad"):
        with pytest.raises(ValueError):
            blocks.einsum_blocks(spec, *(from_numpy(spark, np.ones((2,) * len(s)), tuple(f"x{k}" for k in range(len(s)))) for s in spec.split("->")[0].split(",")))


def test_tree_qr(spark, monkeypatch):
    monkeypatch.setattr(tall, "strips", lambda x: blocks.to_blocks(x, (7, x.shape[1])))
    monkeypatch.setattr(tall, "FAN", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 5))
    q, r = tall.qr(from_numpy(spark, x, ("i", "j")))
    q = q.to_numpy()
    assert np.allclose(q @ r, x) and np.allclose(q.T @ q, np.eye(5)) and np.allclose(r, np.triu(r)) and (np.diag(r) >= 0).all()
    # Dependent columns: still orthogonal, and the rank is told.
    x[:, 3] = x[:, 0] - 2 * x[:, 1]
    q, r = tall.qr(from_numpy(spark, x, ("i", "j")))
    q = q.to_numpy()
    assert tall.rank(r) == 4 and np.allclose(q @ r, x) and np.allclose(q.T @ q, np.eye(5))


def test_small_singular_values(spark):
    rng = np.random.default_rng(5)
    u, v = np.linalg.qr(rng.normal(size=(600, 4)))[0], np.linalg.qr(rng.normal(size=(4, 4)))[0]
    s = np.array([1.0, 1e-4, 1e-8, 1e-12])
    x = from_numpy(spark, u * s @ v.T, ("i", "j"))
    got_u, got_s, got_v = tall.svd(x)
    assert np.allclose(got_s, s, rtol=1e-3, atol=0)  # squares would lose all below 1e-8
    assert np.allclose(got_u.to_numpy() * got_s @ got_v.T, u * s @ v.T, atol=1e-15)
    vectors, values = tall.right_vectors(x, 2)
    assert np.allclose(vectors, got_v[:, :2]) and np.allclose(values, got_s)


def test_wide_and_empty(spark):
    x = np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])
    u, s, v = tall.svd(from_numpy(spark, x, ("i", "j")))
    assert np.allclose(u.to_numpy() * s @ v.T, x)
    q, r = tall.qr(from_numpy(spark, np.zeros((4, 2)), ("i", "j")))
    assert not r.any() and tall.rank(r) == 0 and q.df.count() == 0
    with pytest.raises(ValueError):
        tall.strips(from_numpy(spark, np.ones((1, 3000)), ("i", "j")))


def test_few_cells_make_no_dense_blocks(spark, monkeypatch):
    """A matrix with a cell in a hundred goes by pairs of cells, a full one by blocks; the results are those of NumPy."""
    from polyadic import blocks as b

    taken = []
    plain = b.einsum_blocks
    monkeypatch.setattr(b, "einsum_blocks", lambda *args: taken.append(1) or plain(*args))
    x = np.zeros((40, 50))
    x[np.arange(20), np.arange(20) * 2] = np.arange(1.0, 21)
    for array, blocks_taken in ((x, 0), (np.arange(1.0, 2001).reshape(40, 50), 1)):
        t = from_numpy(spark, array, ("p", "s"))
        assert b.cell_pairs("pi,pj->ij", t, t) == int(((array != 0).sum(axis=1) ** 2).sum())
        assert np.array_equal(b.einsum_by_density("pi,pj->ij", t, t).to_numpy(), array.T @ array)
        assert len(taken) == blocks_taken


@pytest.mark.parametrize("part_cells", [1 << 20, 50])
def test_sparse_gram_shuffles_no_pairs(spark, monkeypatch, part_cells):
    """Before, each pair of a sample's cells was a row of a join that was shuffled to be summed."""
    from polyadic.operators import covariances as cov

    for name, value in (("LEAST_SIDE", 3), ("MOST_SIDE", 3), ("CHUNK_CELLS", 20), ("SENT_CELLS", 15), ("PART_CELLS", part_cells)):
        monkeypatch.setattr(cov, name, value)
    monkeypatch.setattr(blocks, "PAIR_COST", 0)
    rng = np.random.default_rng(6)
    x = np.where(rng.random((150, 8)) < 0.1, rng.integers(1, 9, size=(150, 8)), 0).astype(float)
    x[3] = 2  # a sample that all columns have
    x[:, 6] = 0  # a column that meets nothing
    x[10], x[11] = 0, 0
    x[10, [0, 7]], x[11, [0, 7]] = (1, 1), (1, -1)
    t = from_numpy(spark, x, ("p", "s"))
    got = blocks.einsum_by_density("pi,pj->ij", t, t)
    assert got.axes == ("i", "j") and "Join" not in got.df._jdf.queryExecution().toString()
    rows = {(r.i, r.j): r.v for r in got.df.collect()}
    there = (x != 0).astype(int)
    assert set(rows) == set(map(tuple, np.argwhere(there.T @ there))) and got.df.count() == len(rows)
    assert all(v == (x.T @ x)[k] for k, v in rows.items())
    # Cells beyond the shape or without a column, as pairs of cells have them.
    odd = Tensor(spark.createDataFrame([(0, -4, 2.0), (0, 30, 3.0), (1, None, 5.0), (None, 1, 7.0), (1, 2, 4.0)], "p long, s long, v double"), ("p", "s"), (2, 8))
    for some in (odd, odd.with_df(odd.df.where("s is not null"))):
        want = {tuple(r) for r in einsum("pi,pj->ij", some, some).df.collect()}
        assert {tuple(r) for r in blocks.einsum_by_density("pi,pj->ij", some, some).df.collect()} == want
