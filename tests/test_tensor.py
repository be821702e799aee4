import numpy as np
import pytest
from pyspark.sql import functions as F

from polyadic.operators import ad, decomp, elementwise, graph, kernels, linalg, optim, reduce, shape, sparse, windows
from polyadic.plans.einsum import contraction_order, einsum, parse_spec
from polyadic.sources import files
from polyadic.tensor import Tensor, from_numpy, positions

RAMP = np.arange(24.0).reshape(2, 3, 4)


@pytest.fixture(scope="module")
def ramp(spark):
    return from_numpy(spark, RAMP, ("a", "b", "c"))


@pytest.mark.parametrize("spec,shapes", [("ij,jk->ik", [(2, 3), (3, 4)]), ("bij,bjk->bik", [(2, 3, 2), (2, 2, 3)]), ("ij,ij->ij", [(3, 2), (3, 2)]), ("ii->i", [(3, 3)]), ("ij->ji", [(2, 3)]), ("ij->", [(2, 3)]), ("ij,jk,jl->ikl", [(2, 3), (3, 2), (3, 2)]), ("ij,jk,kl->li", [(2, 3), (3, 2), (2, 4)]), ("i,j->ij", [(2,), (3,)])])
def test_einsum(spark, spec, shapes):
    rng = np.random.default_rng(0)
    arrays = [rng.integers(-3, 4, s).astype(float) for s in shapes]
    tensors = [from_numpy(spark, a, [f"x{k}" for k in range(a.ndim)]) for a in arrays]
    np.testing.assert_allclose(einsum(spec, *tensors).to_numpy(), np.einsum(spec, *arrays))


def test_einsum_errors_and_mask(spark):
    with pytest.raises(ValueError):
        parse_spec("ij->k")
    assert parse_spec("ij,jk") == (["ij", "jk"], "ijk")
    assert len(contraction_order([{"a", "b"}] * 10, {"a"}, {"a": 2, "b": 2})) == 9
    a = np.arange(1.0, 10).reshape(3, 3)
    t = from_numpy(spark, a, ("i", "j"))
    mask = spark.createDataFrame([(0, 2), (1, 1)], "i long, j long")
    want = np.zeros((3, 3))
    want[0, 2], want[1, 1] = (a @ a)[0, 2], (a @ a)[1, 1]
    np.testing.assert_allclose(einsum("ik,kj->ij", t, t, mask=mask).to_numpy(), want)


def test_kernels(spark, ramp):
    rng = np.random.default_rng(1)
    us = [rng.random((n, 2)) for n in RAMP.shape]
    fs = [from_numpy(spark, u, (f"i{k}", "r")) for k, u in enumerate(us)]
    np.testing.assert_allclose(kernels.mttkrp(ramp, fs, 1).to_numpy(), np.einsum("abc,ar,cr->br", RAMP, us[0], us[2]))
    np.testing.assert_allclose(kernels.cp_reconstruct(fs).to_numpy(), np.einsum("ar,br,cr->abc", *us))
    np.testing.assert_allclose(kernels.kronecker(fs[0], fs[1]).to_numpy(), np.kron(us[0], us[1]))
    kr = np.einsum("ir,jr->ijr", us[0], us[1]).reshape(-1, 2)
    np.testing.assert_allclose(kernels.khatri_rao(fs[0], fs[1]).to_numpy(), kr)
    np.testing.assert_allclose(kernels.nmode_product(ramp, from_numpy(spark, us[1].T, ("m", "n")), 1).to_numpy(), np.einsum("abc,br->arc", RAMP, us[1]))


@pytest.mark.parametrize("op,want", [("sum", np.sum), ("mean", np.mean), ("var", np.var), ("max", np.max), ("median", np.median), ("prod", np.prod)])
def test_reductions(ramp, op, want):
    np.testing.assert_allclose(reduce.reduce(ramp, ["a", "c"], op).to_numpy(), want(RAMP, axis=(0, 2)))


def test_reduction_details(spark, ramp):
    np.testing.assert_allclose(reduce.arg_extreme(ramp, "c", largest=False).to_numpy(), RAMP.argmin(axis=2))
    np.testing.assert_allclose(reduce.quantile(ramp, ["b", "c"], 0.3).to_numpy(), np.quantile(RAMP, 0.3, axis=(1, 2)))
    np.testing.assert_allclose(reduce.variance(ramp, ["c"], ddof=1).to_numpy(), RAMP.var(axis=2, ddof=1))
    with pytest.raises(ValueError):
        reduce.reduce(ramp, [], "sum")
    m = np.array([[1.0, 2], [3, 4], [5, 7]])
    t = from_numpy(spark, m, ("i", "j"))
    np.testing.assert_allclose(reduce.covariance_matrix(t).to_numpy(), np.cov(m, rowvar=False))
    np.testing.assert_allclose(reduce.covariance_matrix(t, correlation=True).to_numpy(), np.corrcoef(m, rowvar=False))
    negative = from_numpy(spark, np.array([[-1.0, -2.0], [-3.0, 0.0]]), ("i", "j"))
    np.testing.assert_allclose(reduce.sparse_extreme(negative, "j").to_numpy(), [-1.0, 0.0])


def test_windows(spark, ramp):
    np.testing.assert_allclose(windows.cumulative(ramp, "c").to_numpy(), RAMP.cumsum(axis=2))
    np.testing.assert_allclose(windows.diff(ramp, "b").to_numpy(), np.diff(RAMP, axis=1))
    e = np.exp(RAMP - RAMP.max(axis=2, keepdims=True))
    np.testing.assert_allclose(windows.softmax(ramp, "c").to_numpy(), e / e.sum(axis=2, keepdims=True))
    np.testing.assert_allclose(windows.pool(ramp, {"b": 3, "c": 2}, "avg").to_numpy(), RAMP.reshape(2, 1, 3, 2, 2).mean(axis=(2, 4)))
    np.testing.assert_allclose(windows.sliding(ramp, "c", 2, 2).to_numpy(), np.lib.stride_tricks.sliding_window_view(RAMP, 2, axis=2)[:, :, ::2])
    k = from_numpy(spark, np.array([1.0, 0.0, -2.0]), ("o",))
    np.testing.assert_allclose(windows.correlate(ramp, k, ["c"]).to_numpy(), RAMP[:, :, :2] - 2 * RAMP[:, :, 2:])
    np.testing.assert_allclose(windows.sort(ramp, "c", descending=True).to_numpy(), -np.sort(-RAMP, axis=2))


def test_shapes(spark, ramp):
    np.testing.assert_allclose(shape.permute(ramp, ("c", "a", "b")).to_numpy(), RAMP.transpose(2, 0, 1))
    np.testing.assert_allclose(shape.reshape(ramp, ("x", "y"), (6, 4)).to_numpy(), RAMP.reshape(6, 4))
    np.testing.assert_allclose(shape.unfold(ramp, "b").to_numpy(), np.moveaxis(RAMP, 1, 0).reshape(3, -1))
    np.testing.assert_allclose(shape.fold(shape.unfold(ramp, "b"), "b", ramp.axes, ramp.shape).to_numpy(), RAMP)
    np.testing.assert_allclose(shape.roll(shape.flip(ramp, "c"), "b", -1).to_numpy(), np.roll(RAMP[:, :, ::-1], -1, axis=1))
    for mode in ("edge", "reflect", "wrap"):
        np.testing.assert_allclose(shape.pad(ramp, "c", 2, 3, mode).to_numpy(), np.pad(RAMP, ((0, 0), (0, 0), (2, 3)), mode=mode))
    np.testing.assert_allclose(shape.pad(ramp, "c", 1, 1, value=7.0).to_numpy(), np.pad(RAMP, ((0, 0), (0, 0), (1, 1)), constant_values=7.0))
    np.testing.assert_allclose(shape.tile(ramp, "b", 2).to_numpy(), np.tile(RAMP, (1, 2, 1)))
    np.testing.assert_allclose(shape.repeat(ramp, "b", 2).to_numpy(), RAMP.repeat(2, axis=1))
    np.testing.assert_allclose(shape.cut(ramp, "c", 1, 4, 2).to_numpy(), RAMP[:, :, 1:4:2])
    np.testing.assert_allclose(shape.stack([ramp, ramp]).to_numpy(), np.stack([RAMP, RAMP]))
    m = from_numpy(spark, RAMP[0], ("i", "j"))
    np.testing.assert_allclose(shape.diagonal(m, 1).to_numpy(), np.diag(RAMP[0], 1))
    np.testing.assert_allclose(shape.mask_select(m, elementwise.compare(m, 4.0, "gt")).to_numpy(), RAMP[0][RAMP[0] > 4])
    put = spark.createDataFrame([(0, 1, 5.0), (0, 1, 9.0)], "i long, j long, v double")
    want = RAMP[0].copy()
    want[0, 1] = 9
    np.testing.assert_allclose(shape.scatter(m, Tensor(put, ("i", "j"), m.shape), "replace").to_numpy(), want)


def test_elementwise(spark, ramp):
    np.testing.assert_allclose(elementwise.unary(ramp, "exp").to_numpy(), np.exp(RAMP))
    with np.errstate(divide="ignore"):
        np.testing.assert_allclose(elementwise.unary(ramp, "log").to_numpy(), np.log(RAMP))
        np.testing.assert_allclose(elementwise.scalar(ramp, "div", 0.0).df.where("v = double('Infinity')").count(), 23)
    row = from_numpy(spark, np.arange(1.0, 5), ("k",))
    np.testing.assert_allclose(elementwise.binary(ramp, row, "div").to_numpy(), RAMP / np.arange(1.0, 5))
    np.testing.assert_allclose(elementwise.clip(ramp, 3, 9).to_numpy(), RAMP.clip(3, 9))


def test_sparse_duplicates(spark):
    rows = spark.createDataFrame([(0, 0, -48.5), (0, 0, 0.0), (2, 7, 1.0), (2, 7, 2.0), (5, 5, 0.0), (5, 5, 0.0)], "i long, j long, v double")
    t = sparse.deduplicated(Tensor(rows, ("i", "j"), (8, 8)))
    assert sorted(map(tuple, t.df.collect())) == [(0, 0, -48.5), (2, 7, 3.0), (5, 5, 0.0)]
    assert sparse.dropped(t).df.count() == 2
    assert sparse.add(t, t, 1.0, -1.0).df.count() == 0


def test_graphs(spark):
    path = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, w double")
    assert sorted(map(tuple, graph.bfs(path, 0).collect())) == [(0, 0), (1, 1), (2, 2)]
    assert sorted(map(tuple, graph.topological_levels(path).collect())) == [(0, 0), (1, 1), (2, 2)]
    assert graph.bipartite(path)
    ring = spark.createDataFrame([(0, 1, 3.0), (1, 2, 1.0), (2, 0, 2.0), (7, 8, -1.0)], "src long, dst long, w double")
    assert not graph.bipartite(ring)
    assert sorted(map(tuple, graph.components(ring).collect())) == [(0, 0), (1, 0), (2, 0), (7, 7), (8, 7)]
    assert sorted(map(tuple, graph.triangles(ring).collect())) == [(0, 1, 2)]
    assert sorted(map(tuple, graph.spanning_forest(ring).collect())) == [(0, 2, 2.0), (1, 2, 1.0), (7, 8, -1.0)]
    assert sorted(map(tuple, graph.shortest_paths(ring, 0).collect())) == [(0, 0.0), (1, 3.0), (2, 4.0)]
    chosen = {r["id"] for r in graph.independent_set(ring).collect()}
    assert len(chosen & {0, 1, 2}) == 1 and len(chosen & {7, 8}) == 1
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(ring).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6
    with pytest.raises(ValueError):
        graph.topological_levels(ring)
    with pytest.raises(ValueError):
        graph.shortest_paths(spark.createDataFrame([(0, 1, -1.0), (1, 0, 0.0)], "src long, dst long, w double"), 0)


def test_linalg(spark):
    rng = np.random.default_rng(3)
    m = rng.random((6, 4))
    spd = m.T @ m + np.eye(4)
    b = rng.random(4)
    x = linalg.conjugate_gradient(from_numpy(spark, spd, ("i", "j")), from_numpy(spark, b, ("i",)), jacobi=True)
    np.testing.assert_allclose(x.to_numpy(), np.linalg.solve(spd, b), atol=1e-8)
    u, s, v = linalg.svd(from_numpy(spark, m, ("i", "j")))
    np.testing.assert_allclose(s, np.linalg.svd(m, compute_uv=False), atol=1e-8)
    np.testing.assert_allclose(u.to_numpy() * s @ v.T, m, atol=1e-8)
    q, r = linalg.tall_qr(from_numpy(spark, m, ("i", "j")))
    np.testing.assert_allclose(q.to_numpy() @ r, m, atol=1e-8)


def test_decompositions(spark):
    a, b, c = (np.arange(1.0, n + 1) for n in (4, 3, 5))
    rank1 = np.einsum("a,b,c->abc", a, b, c)
    x = from_numpy(spark, rank1, ("a", "b", "c"))
    assert decomp.cp_als(x, 1, rounds=3).fit > 1 - 1e-6
    np.testing.assert_allclose(decomp.tucker(x, (1, 1, 1)).reconstruct(), rank1, rtol=1e-6)
    noisy = rank1 + np.random.default_rng(0).random(rank1.shape)
    t = from_numpy(spark, noisy, ("a", "b", "c"))
    cores = decomp.tt_svd(t)
    np.testing.assert_allclose(decomp.tt_reconstruct(cores), noisy, rtol=1e-6)
    np.testing.assert_allclose(decomp.tt_reconstruct(decomp.tt_round(cores)), noisy, rtol=1e-6)
    with pytest.raises(ValueError):
        decomp.cp_als(x, 9)


def test_gradients(spark):
    rng = np.random.default_rng(5)
    a, b, g = rng.random((2, 3)), rng.random((3, 2)), rng.random((2, 2))
    ts = [from_numpy(spark, v, ("i", "j")) for v in (a, b, g)]
    da, db = ad.einsum_vjp("ij,jk->ik", ts[:2], ts[2])
    np.testing.assert_allclose(da.to_numpy(), g @ b.T)
    np.testing.assert_allclose(db.to_numpy(), a.T @ g)
    (ds,) = ad.einsum_vjp("ij->i", ts[:1], from_numpy(spark, np.array([1.0, 2.0]), ("i",)))
    np.testing.assert_allclose(ds.to_numpy(), [[1, 1, 1], [2, 2, 2]])
    np.testing.assert_allclose(ad.unary_vjp(ts[0], "tanh", ts[0]).to_numpy(), (1 - np.tanh(a) ** 2) * a)
    np.testing.assert_allclose(optim.sgd(0.1).step(ts[0], ts[0])[0].to_numpy(), 0.9 * a)


def test_files(spark, tmp_path):
    t = from_numpy(spark, RAMP, ("a", "b", "c"))
    files.write_tensor(t, str(tmp_path / "t"), partition_by="a")
    np.testing.assert_allclose(files.read_tensor(spark, str(tmp_path / "t")).to_numpy(), RAMP)
    (tmp_path / "x.bin").write_bytes(files.to_bytes(RAMP, b"ABCD"))
    cells = files.read_binary(spark, str(tmp_path / "x.bin"), b"ABCD").orderBy("position").toPandas()
    np.testing.assert_allclose(cells["v"], RAMP.ravel())
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 3\n1 1 2.5\n3 1 -1\n2 2 4\n")
    np.testing.assert_allclose(files.read_matrix_market(spark, str(tmp_path / "m.mtx")).to_numpy(), [[2.5, 0, -1], [0, 4, 0], [-1, 0, 0]])


def test_positions_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k % 7, float(k)) for k in range(50)], "k long, x double")
    assert sorted(map(tuple, positions(rows, "k").collect())) == [(k, k) for k in range(7)]
    from polyadic.streaming.accumulate import running_tensor

    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running_tensor(stream, {"i": F.col("k")}, F.col("x")).writeStream.outputMode("complete").format("memory").queryName("running").start()
    try:
        q.processAllAvailable()
        got = {r["i"]: r["v"] for r in spark.table("running").collect()}
    finally:
        q.stop()
    assert got == {k: float(sum(x for x in range(50) if x % 7 == k)) for k in range(7)}
