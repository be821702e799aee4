import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from polyadic.iterate import cut
from polyadic.operators import decomp, graph, linalg, shape, sparse, tape
from polyadic.sources import files
from polyadic.tensor import from_numpy


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")


def test_strong_components_and_cycles(spark):
    edges = _edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (4, 6)])
    got = {r["id"]: r["component"] for r in graph.strong_components(edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    assert graph.has_cycle(edges)
    assert graph.has_cycle(_edges(spark, [(5, 5)]))
    assert not graph.has_cycle(_edges(spark, [(0, 1), (1, 2), (0, 2)]))
    empty = _edges(spark, [])
    assert not graph.has_cycle(empty) and graph.strong_components(empty).count() == 0 and graph.colouring(empty).count() == 0


def test_colouring(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (4, 4)]
    got = {r["id"]: r["colour"] for r in graph.colouring(_edges(spark, pairs)).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and all(got[a] != got[b] for a, b in pairs if a != b) and max(got.values()) <= 3


def test_resize_split_patches(spark):
    x = np.arange(12.0).reshape(3, 4) + 1
    t = from_numpy(spark, x, ("i", "j"))
    rows, columns = (((np.arange(5) + 0.5) * 3 / 5).astype(int), ((np.arange(2) + 0.5) * 4 / 2).astype(int))
    assert np.array_equal(shape.resize(t, {"i": 5, "j": 2}).to_numpy(), x[rows][:, columns])
    at = np.arange(7) * 3 / 6
    want = np.array([np.interp(at, np.arange(4), r) for r in x])
    assert np.allclose(shape.resize(t, {"j": 7}, "linear").to_numpy(), want)
    assert [p.shape for p in shape.split(t, "j", [1, 3])] == [(3, 1), (3, 3)]
    assert np.array_equal(shape.split(t, "j", [1, 3])[1].to_numpy(), x[:, 1:])
    with pytest.raises(ValueError):
        shape.split(t, "j", [1, 1])
    got = shape.patches(t, (2, 2), (1, 2)).to_numpy()
    assert np.array_equal(got, np.lib.stride_tricks.sliding_window_view(x, (2, 2))[:, ::2])


def test_structure(spark):
    a = from_numpy(spark, np.array([[4.0, 1, 0], [1, 4, 1], [0, 1, 4]]), ("i", "j"))
    assert sparse.is_banded(a, 1, 1).first()[0] and not sparse.is_banded(a, 0, 1).first()[0]
    assert sparse.is_dominant(a).first()[0]
    assert not sparse.is_dominant(from_numpy(spark, np.array([[1.0, 1.0], [0.0, 2.0]]), ("i", "j"))).first()[0]
    assert not sparse.is_dominant(from_numpy(spark, np.array([[1.0, 0.0], [0.0, 0.0]]), ("i", "j"))).first()[0]


def test_tensor_train_algebra(spark):
    rng = np.random.default_rng(3)
    a = [rng.random(s) for s in ((1, 2, 2), (2, 3, 3), (3, 2, 1))]
    b = [rng.random(s) for s in ((1, 2, 1), (1, 3, 2), (2, 2, 1))]
    x, y = decomp.tt_reconstruct(a), decomp.tt_reconstruct(b)
    assert np.allclose(decomp.tt_reconstruct(decomp.tt_add(a, b)), x + y)
    assert np.isclose(decomp.tt_dot(a, b), (x * y).sum()) and np.isclose(decomp.tt_norm(a), np.linalg.norm(x))
    m = [rng.random(s) for s in ((1, 2, 2, 2), (2, 4, 3, 2), (2, 2, 2, 1))]
    full = np.einsum("anib,bmjc,cokd->nmoijk", *m)
    assert np.allclose(decomp.tt_reconstruct(decomp.tt_matvec(m, a)), np.einsum("nmoijk,ijk->nmo", full, x))


def test_eigenvalues(spark):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((4, 4)))[0]
    m = q @ np.diag([9.0, 5.0, 3.0, 1.0]) @ q.T
    a = from_numpy(spark, m, ("i", "j"))
    assert np.allclose(linalg.lanczos(a, 2), [9.0, 5.0])


def test_tape(spark):
    x = from_numpy(spark, np.array([[0.5, 1.0], [2.0, 0.25]]), ("i", "j"))

    def f(n):
        return tape.einsum("ij,ij->", tape.unary(tape.einsum("ij,jk->ik", n, n), "tanh"), n)

    assert tape.gradient_error(f, x) < 1e-6
    cube = tape.hessian_product(lambda n: tape.einsum("ij,ij,ij->", n, n, n), x, x).to_numpy()
    assert np.allclose(cube, 6 * x.to_numpy() ** 2, atol=1e-5)
    with pytest.raises(ValueError):
        tape.backward(tape.leaf(x))


def test_matrix_market_of_many_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((40, 30)) < 0.3, rng.integers(1, 9, (40, 30)), 0).astype(float)
    t = from_numpy(spark, x, ("i", "j"))
    files.write_matrix_market(t.with_df(t.df.repartition(3)), str(tmp_path / "m"))
    got = files.read_matrix_market(spark, str(tmp_path / "m"))
    assert got.shape == (40, 30) and np.array_equal(got.to_numpy(), x)


def _even_trade(folder):
    """Tables of two nations that trade alike, so that no trade is above 1.3 times the mean."""
    for name, rows in {
        "customer": "(0, 0), (1, 1)) t(c_custkey, c_nationkey)",
        "supplier": "(0, 0), (1, 1)) t(s_suppkey, s_nationkey)",
        "orders": "(0, 0), (1, 1)) t(o_orderkey, o_custkey)",
        "lineitem": "(0, 0, 5.0), (0, 1, 5.0), (1, 0, 5.0), (1, 1, 5.0)) t(l_orderkey, l_suppkey, l_quantity)",
    }.items():
        duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) TO '{folder}/{name}.parquet'")


def _by_sql(folder, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(entry.oracle_sql()[name]).fetchall()


def test_topological_levels_without_heavy_trade(spark, tmp_path):
    _even_trade(tmp_path)
    assert graph.topological_levels(_edges(spark, [])).collect() == []
    got = entry.queries()["graph_topological_levels"](spark, str(tmp_path))
    assert got.collect() == _by_sql(tmp_path, "graph_topological_levels") == []


def test_no_cycle_without_heavy_trade(spark, tmp_path):
    _even_trade(tmp_path)
    got = entry.queries()["graph_has_cycle"](spark, str(tmp_path)).collect()
    assert got == _by_sql(tmp_path, "graph_has_cycle") == [(False, False)]


def test_components_and_two_sides(spark):
    """Three parts with links between their two sides only, numbers mixed; then a link that closes an odd cycle, and a loop."""
    rng = np.random.default_rng(4)
    number = rng.permutation(30).tolist()
    pairs = [(i, i // 10 * 10 + int(rng.integers(0, i % 10)) // 2 * 2 + 1 - i % 2) for i in range(30) if i % 10 > 1]
    pairs += [(i + 1, i) for i in (0, 10, 20)]
    edges = _edges(spark, [(number[a], number[b]) for a, b in pairs])
    want = {number[i]: min(number[i // 10 * 10 : i // 10 * 10 + 10]) for i in range(30)}
    assert {r["id"]: r["component"] for r in graph.components(edges.union(_edges(spark, [(99, 99)]))).collect()} == want | {99: 99}
    assert graph.bipartite(edges)
    assert not graph.bipartite(edges.union(_edges(spark, [(number[20], number[28])])))


def test_links_are_put_together(spark, monkeypatch):
    """A path of 33 vertices takes a few rounds, and no copy of the graph with every vertex twice."""
    written = []
    monkeypatch.setattr(graph, "cut", lambda df: written.append(cut(df)) or written[-1])
    edges = _edges(spark, [(k, k + 1) for k in range(32)])
    assert graph.bipartite(edges) and len(written) < 25
    assert max(df.count() for df in written) <= 33
