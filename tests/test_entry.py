import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["einsum_regions", "einsum_gram", "kernel_mttkrp", "reduce_argmax", "sparse_add"])
def test_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(map(tuple, got[sorted(got)].to_numpy().tolist())) == sorted(map(tuple, want[sorted(want)].to_numpy().tolist()))


def test_whole_graph(spark):
    """Every customer with an order and every supplier with an item is there, whatever the quantities."""
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    edges = con.execute("SELECT DISTINCT o_custkey * 2, l_suppkey * 2 + 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()
    got = entry.queries()["graph_degrees_all"](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()["graph_degrees_all"]).df()
    assert sorted(map(tuple, got[sorted(got)].to_numpy().tolist())) == sorted(map(tuple, want[sorted(want)].to_numpy().tolist()))
    assert got["out_degree"].sum() == got["in_degree"].sum() == len(edges)
    assert set(got["id"]) == {v for e in edges for v in e}
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        u, v = find(a), find(b)
        root[max(u, v)] = min(u, v)
    found = entry.queries()["graph_components_all"](spark, SF).collect()
    assert sorted((r["id"], r["component"]) for r in found) == sorted((v, find(v)) for v in root)
