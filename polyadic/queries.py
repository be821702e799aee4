"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyadic import blocks
from polyadic.blocks import einsum_by_density
from polyadic.functions.numeric import UNARY
from polyadic.iterate import cut, written
from polyadic.operators import ad, decomp, elementwise, fourier, graph, kernels, krylov, linalg, lines, optim, reduce, shape, sparse, windows
from polyadic.plans.einsum import einsum
from polyadic.tensor import Tensor, from_numpy, from_table, positions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> Tensor:
    """q[s, f, y]: quantity by supplier nation, return flag and ship year."""
    rows = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate", "l_quantity")
    rows = rows.join(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return from_table(rows, {"s": F.col("s_nationkey"), "f": flag, "y": F.year("l_shipdate") - 1992}, F.col("l_quantity"), (25, 3, 10))


def regions(spark: SparkSession, sf_dir: str) -> Tensor:
    """w[n, r]: 1 where a nation is in a region."""
    return from_table(_read(spark, sf_dir, "nation"), {"n": F.col("n_nationkey"), "r": F.col("n_regionkey")}, F.lit(1.0), (25, 5))


def purchases(spark: SparkSession, sf_dir: str) -> Tensor:
    """p[p, s]: quantity by part and supplier, from 0."""
    rows = _read(spark, sf_dir, "lineitem")
    parts, suppliers = _read(spark, sf_dir, "part").count(), _read(spark, sf_dir, "supplier").count()
    return from_table(rows, {"p": F.col("l_partkey"), "s": F.col("l_suppkey")}, F.col("l_quantity"), (parts, suppliers))


def nations(spark: SparkSession, sf_dir: str) -> Tensor:
    """a[i, j]: orders' customers' nations to their items' suppliers' nations, by quantity."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    rows = rows.join(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rows = rows.join(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = rows.join(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return from_table(rows, {"i": F.col("c_nationkey"), "j": F.col("s_nationkey")}, F.col("l_quantity"), (25, 25))


def vectors(spark: SparkSession, sf_dir: str) -> Tensor:
    """e[v, d]: embeddings by place of their id and component."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "x"))
    n = _read(spark, sf_dir, "embeddings").count()
    return Tensor(rows.select(F.col("vec_id").alias("e"), F.col("d").cast("long").alias("d"), F.col("x").cast("double").alias("v")), ("e", "d"), (n, 64))


_CUBE = """q AS (SELECT CAST(s_nationkey AS BIGINT) AS s, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS f,
    CAST(year(l_shipdate) - 1992 AS BIGINT) AS y, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""
_FULL = f"""{_CUBE}, d AS (SELECT s, f, y, coalesce(v, 0) AS v FROM (SELECT CAST(a.range AS BIGINT) AS s, CAST(b.range AS BIGINT) AS f, CAST(c.range AS BIGINT) AS y
    FROM range(25) a, range(3) b, range(10) c) LEFT JOIN q USING (s, f, y))"""
_PARTS = "p AS (SELECT l_partkey AS p, l_suppkey AS s, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"
_NATIONS = """a AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
_REGIONS = "w AS (SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation)"


@_query(f"WITH {_CUBE}, {_REGIONS} SELECT r, f, y, sum(v) AS v FROM q JOIN w ON s = n GROUP BY r, f, y")
def einsum_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by region: einsum('nfy,nr->rfy')."""
    return einsum("nfy,nr->rfy", cube(spark, sf_dir), regions(spark, sf_dir)).df


@_query(f"WITH {_PARTS} SELECT a.s AS i, b.s AS j, sum(a.v * b.v) AS v FROM p a JOIN p b ON a.p = b.p GROUP BY 1, 2")
def einsum_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier similarities: einsum('pi,pj->ij'), by dense blocks or, if few cells are stored, by tiles of pairs of suppliers."""
    p = purchases(spark, sf_dir)
    p = p.with_df(written(p.df, "purchases"))
    return einsum_by_density("pi,pj->ij", p, p).df


@_query(f"WITH {_NATIONS}, {_REGIONS} SELECT x.r AS a, y.r AS b, sum(v) AS v FROM a JOIN w x ON i = x.n JOIN w y ON j = y.n GROUP BY 1, 2")
def einsum_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to region: einsum('ia,ij,jb->ab'), three operands planned."""
    w = regions(spark, sf_dir)
    return einsum("ia,ij,jb->ab", w, nations(spark, sf_dir), w).df


@_query(f"WITH {_NATIONS} SELECT x.i, x.j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.i = y.i GROUP BY 1, 2")
def einsum_kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is both shared and kept: einsum('ij,ik->ij')."""
    a = nations(spark, sf_dir)
    return einsum("ij,ik->ij", a, a).df


@_query(f"WITH {_NATIONS} SELECT i, v FROM a WHERE i = j")
def einsum_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """einsum('ii->i')."""
    return einsum("ii->i", nations(spark, sf_dir)).df


@_query(f"WITH {_NATIONS} SELECT sum(v) AS v FROM a WHERE i = j")
def einsum_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.trace(nations(spark, sf_dir)).df


@_query(f"WITH {_NATIONS}, m AS (SELECT i, j FROM a WHERE i < 5 AND j < 5) SELECT x.i, y.j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.i JOIN m ON m.i = x.i AND m.j = y.j GROUP BY 1, 2")
def einsum_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps between nations, only for the cells of a mask."""
    a = nations(spark, sf_dir)
    out = einsum("ik,kj->ij", a, a, mask=a.df.where("i < 5 AND j < 5").select("i", "j"))
    return out.df


@_query(f"WITH {_CUBE} SELECT s, f, y, v * v AS v FROM q")
def kernel_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    return kernels.hadamard(q, q).df


@_query(f"WITH {_CUBE}, a AS (SELECT s, sum(v) AS v FROM q GROUP BY s), b AS (SELECT y, sum(v) AS v FROM q GROUP BY y) SELECT s, y, a.v * b.v AS v FROM a, b")
def kernel_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    return kernels.outer(reduce.reduce(q, ["f", "y"], "sum"), reduce.reduce(q, ["s", "f"], "sum"), names=("s", "y")).df


@_query(f"WITH {_REGIONS}, {_CUBE}, m AS (SELECT f, y, sum(v) AS v FROM q GROUP BY f, y) SELECT n * 3 + f AS i, r * 10 + y AS j, v FROM w, m")
def kernel_kronecker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.kronecker(regions(spark, sf_dir), reduce.reduce(cube(spark, sf_dir), ["s"], "sum")).df


@_query(f"WITH {_CUBE}, a AS (SELECT s, y, sum(v) AS v FROM q GROUP BY s, y), b AS (SELECT f, y, sum(v) AS v FROM q GROUP BY f, y) SELECT s * 3 + f AS i, a.y AS r, a.v * b.v AS v FROM a JOIN b ON a.y = b.y")
def kernel_khatri_rao(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    return kernels.khatri_rao(reduce.reduce(q, ["f"], "sum"), reduce.reduce(q, ["s"], "sum")).df


@_query(f"WITH {_CUBE}, {_REGIONS} SELECT r AS s, f, y, sum(v) AS v FROM q JOIN w ON s = n GROUP BY 1, 2, 3")
def kernel_nmode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.nmode_product(cube(spark, sf_dir), sparse.transposed(regions(spark, sf_dir)), 0).df


@_query(f"WITH {_CUBE}, b AS (SELECT f, y AS r, sum(v) AS v FROM q GROUP BY 1, 2), c AS (SELECT y, y AS r, sum(v) AS v FROM q GROUP BY 1, 2) SELECT s, b.r, sum(q.v * b.v * c.v) AS v FROM q JOIN b ON q.f = b.f JOIN c ON q.y = c.y AND b.r = c.r GROUP BY 1, 2")
def kernel_mttkrp(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    b = reduce.reduce(q, ["s"], "sum")
    c = einsum("sfy->y", q)
    c = Tensor(c.df.select("y", F.col("y").alias("r"), "v"), ("y", "r"), (10, 10))
    return kernels.mttkrp(q, [regions(spark, sf_dir), b, c], 0).df


@_query(f"WITH {_CUBE} SELECT x.s AS a, y.s AS d, sum(x.v * y.v) AS v FROM q x JOIN q y ON x.f = y.f AND x.y = y.y GROUP BY 1, 2")
def kernel_tensor_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    return kernels.contract(q, q, [1, 2], [1, 2]).df


_REDUCE = {"sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "var": "var_pop(v)", "std": "stddev_pop(v)", "median": "median(v)", "norm_l2": "sqrt(sum(v * v))", "norm_linf": "max(abs(v))", "count_nonzero": "CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS DOUBLE)", "all": "CAST(min(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS DOUBLE)", "any": "CAST(max(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS DOUBLE)", "kurtosis": "kurtosis_pop(v)"}


@_query(f"WITH {_FULL} SELECT s, " + ", ".join(f"round({sql}, 4) AS {op}" for op, sql in _REDUCE.items()) + " FROM d GROUP BY s")
def reduce_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reductions over two axes, in one pass."""
    q = cube(spark, sf_dir).dense()
    return q.df.groupBy("s").agg(*(F.round(reduce.AGGREGATES[op]().cast("double"), 4).alias(op) for op in _REDUCE))


@_query(f"WITH {_FULL} SELECT f, round(quantile_cont(v, 0.3), 6) AS v FROM d GROUP BY f")
def reduce_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reduce.quantile(cube(spark, sf_dir), ["s", "y"], 0.3)
    return out.df.select("f", F.round("v", 6).alias("v"))


@_query(f"WITH {_FULL} SELECT s, f, CAST(y AS DOUBLE) AS v FROM (SELECT *, row_number() OVER (PARTITION BY s, f ORDER BY v DESC, y) AS k FROM d) WHERE k = 1")
def reduce_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.arg_extreme(cube(spark, sf_dir), "y").df


@_query(f"WITH {_FULL} SELECT v, count(*) AS n FROM d GROUP BY v")
def reduce_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.unique(cube(spark, sf_dir))


@_query(f"WITH {_FULL} SELECT CAST(least(floor(v / 100), 9) AS BIGINT) AS bin, count(*) AS n FROM d WHERE v <= 1000 GROUP BY 1")
def reduce_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.histogram(cube(spark, sf_dir), 0.0, 1000.0, 10)


_EMB = "e AS (SELECT vec_id AS e, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@_query(f"WITH {_EMB} SELECT a.d AS a, b.d AS b, round(covar_samp(a.v, b.v), 9) + 0.0 AS v FROM e a JOIN e b ON a.e = b.e GROUP BY 1, 2")
def stat_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of the embeddings' components, by strips of rows."""
    rows = blocks.from_vectors(_read(spark, sf_dir, "embeddings"), F.col("embedding"), 64)
    out = blocks.to_cells(blocks.covariance(rows), ("a", "b"))
    return out.df.select("a", "b", (F.round("v", 9) + 0.0).alias("v"))


@_query(f"WITH {_EMB} SELECT a.d AS a, b.d AS b, round(corr(a.v, b.v), 8) + 0.0 AS v FROM e a JOIN e b ON a.e = b.e GROUP BY 1, 2")
def stat_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reduce.covariance_matrix(vectors(spark, sf_dir), correlation=True)
    return out.df.select("a", "b", (F.round("v", 8) + 0.0).alias("v"))


@_query(f"WITH {_FULL} SELECT s, f, y, sum(v) OVER (PARTITION BY s, f ORDER BY y) AS v FROM d")
def window_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cumulative(cube(spark, sf_dir), "y").df


@_query(f"WITH {_FULL} SELECT s, f, y, v FROM (SELECT s, f, y, lead(v) OVER (PARTITION BY s, f ORDER BY y) - v AS v FROM d) WHERE v IS NOT NULL")
def window_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.diff(cube(spark, sf_dir), "y").df


@_query(f"WITH {_FULL} SELECT s, f, row_number() OVER (PARTITION BY s, f ORDER BY v, y) - 1 AS y, v FROM d")
def window_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sort(cube(spark, sf_dir), "y").df


@_query(f"WITH {_FULL} SELECT s, f, row_number() OVER (PARTITION BY s, f ORDER BY v, y) - 1 AS y, CAST(y AS DOUBLE) AS v FROM d")
def window_argsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sort(cube(spark, sf_dir), "y", positions=True).df


@_query(f"WITH {_FULL}, m AS (SELECT s, f, y, v / 1000 - max(v / 1000) OVER (PARTITION BY s, f) AS x FROM d) SELECT s, f, y, round(exp(x) / sum(exp(x)) OVER (PARTITION BY s, f), 9) AS v FROM m")
def window_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    out = windows.softmax(elementwise.mapped(q, F.col("v") / 1000), "y")
    return out.df.select("s", "f", "y", F.round("v", 9).alias("v"))


@_query(f"WITH {_FULL} SELECT s, f, y, round((v - avg(v) OVER (PARTITION BY s)) / sqrt(var_pop(v) OVER (PARTITION BY s) + 1e-5), 6) + 0.0 AS v FROM d")
def window_layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.normalise(cube(spark, sf_dir), ["f", "y"])
    return out.df.select("s", "f", "y", (F.round("v", 6) + 0.0).alias("v"))


@_query(f"WITH {_CUBE}, o AS (SELECT CAST(range AS BIGINT) AS o FROM range(3)) SELECT s, f, y - o AS y, o AS \"offset\", v FROM q, o WHERE y - o >= 0 AND y - o < 8")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(cube(spark, sf_dir), "y", 3).df


@_query(f"WITH {_FULL} SELECT CAST(s // 5 AS BIGINT) AS s, f, CAST(y // 2 AS BIGINT) AS y, max(v) AS v FROM d GROUP BY 1, 2, 3")
def window_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pool(cube(spark, sf_dir), {"s": 5, "y": 2}, "max").df


@_query(f"WITH {_CUBE}, k(o, w) AS (VALUES (0, 1.0), (1, -2.0), (2, 1.0)) SELECT s, f, CAST(y - o AS BIGINT) AS y, CAST(sum(v * w) AS DOUBLE) AS v FROM q, k WHERE y - o >= 0 AND y - o < 8 GROUP BY 1, 2, 3")
def window_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    kernel = from_numpy(spark, np.array([1.0, -2.0, 1.0]), ("o",))
    return windows.correlate(cube(spark, sf_dir), kernel, ["y"]).df


_SCALED = "v / 9973 - 0.05123"
_FUNCTIONS = {
    "neg": "-x", "abs": "abs(x)", "exp": "exp(x)", "sin": "sin(x)", "cos": "cos(x)", "tanh": "tanh(x)", "sqr": "x * x", "cbrt": "cbrt(x)", "sign": "CAST(sign(x) AS DOUBLE)", "floor": "floor(x)", "ceil": "ceil(x)",
    "sigmoid": "1 / (1 + exp(-x))", "relu": "CASE WHEN x > 0 THEN x ELSE 0.0 END", "gelu": "0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x)))", "elu": "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END",
    "softplus": "greatest(x, 0) + ln(1 + exp(-abs(x)))", "softsign": "x / (1 + abs(x))", "swish": "x / (1 + exp(-x))", "log": "CASE WHEN x > 0 THEN ln(x) ELSE 0.0 END", "sqrt": "CASE WHEN x > 0 THEN sqrt(x) ELSE 0.0 END",
}


@_query(f"WITH {_FULL}, t AS (SELECT s, f, y, {_SCALED} AS x FROM d) SELECT s, f, y, " + ", ".join(f"round({sql}, 7) + 0.0 AS f_{n}" for n, sql in _FUNCTIONS.items()) + " FROM t")
def elementwise_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unary functions of every cell, side by side."""
    q = elementwise.mapped(cube(spark, sf_dir).dense(), F.col("v") / 9973 - 0.05123)
    x = F.col("v")
    outs = {n: F.when(x > 0, UNARY[n](x)).otherwise(0.0) if n in ("log", "sqrt") else UNARY[n](x) for n in _FUNCTIONS}
    return q.df.select("s", "f", "y", *((F.round(c, 7) + 0.0).alias(f"f_{n}") for n, c in outs.items()))


@_query(f"WITH {_FULL}, b AS (SELECT f, y, sum(v) AS w FROM d GROUP BY f, y) SELECT s, d.f, d.y, round(CASE WHEN w = 0 THEN 0 ELSE v / w END, 9) AS v FROM d JOIN b ON d.f = b.f AND d.y = b.y")
def elementwise_broadcast_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the nations: the cube over its sum, broadcast along the first axis."""
    q = cube(spark, sf_dir)
    out = elementwise.binary(q, reduce.reduce(q, ["s"], "sum"), "div", how="dense")
    return out.df.select("s", "f", "y", F.round(F.nanvl("v", F.lit(0.0)), 9).alias("v"))


@_query(f"WITH {_FULL} SELECT s, f, y, greatest(least(v, 500), 100) AS v FROM d")
def elementwise_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.clip(cube(spark, sf_dir), 100.0, 500.0).df


@_query(f"WITH {_FULL} SELECT s, f, y, CASE WHEN v > 300 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM d")
def elementwise_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.compare(cube(spark, sf_dir), 300.0, "gt").df


@_query(f"WITH {_FULL} SELECT s, f, y, CASE WHEN v > 300 THEN v ELSE -v END AS v FROM d WHERE v <> 0")
def elementwise_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    return elementwise.where(elementwise.compare(q, 300.0, "gt"), q, elementwise.unary(q, "neg")).df


@_query(f"WITH {_CUBE} SELECT CAST((s * 30 + f * 10 + y) // 50 AS BIGINT) AS a, CAST((s * 30 + f * 10 + y) % 50 AS BIGINT) AS b, v FROM q")
def shape_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.reshape(cube(spark, sf_dir), ("a", "b"), (15, 50)).df


@_query(f"WITH {_CUBE} SELECT f AS row, s * 10 + y AS col, v FROM q")
def shape_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.unfold(cube(spark, sf_dir), "f").df


@_query(f"WITH {_CUBE} SELECT s, f, y, v FROM q")
def shape_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold() of unfold() is the tensor."""
    q = cube(spark, sf_dir)
    return shape.fold(shape.unfold(q, "f"), "f", q.axes, q.shape).df


@_query(f"WITH {_CUBE} SELECT s, f, CAST((9 - y + 3) % 10 AS BIGINT) AS y, v FROM q")
def shape_flip_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.roll(shape.flip(cube(spark, sf_dir), "y"), "y", 3).df


@_query(f"WITH {_CUBE}, m(y, t) AS (VALUES (2, 0), (1, 1), (0, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 7), (6, 8), (7, 9), (8, 10), (9, 11), (8, 12)) SELECT s, f, CAST(t AS BIGINT) AS y, v FROM q JOIN m USING (y)")
def shape_pad_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.pad(cube(spark, sf_dir), "y", 2, 1, "reflect").df


@_query(f"WITH {_CUBE} SELECT s, f, y + 10 * k AS y, v FROM q, (SELECT CAST(range AS BIGINT) AS k FROM range(2))")
def shape_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.tile(cube(spark, sf_dir), "y", 2).df


@_query(f"WITH {_CUBE} SELECT s, f, y, v FROM q UNION ALL SELECT s + 25, f, y, v * 2 FROM q")
def shape_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    return shape.concat([q, elementwise.mapped(q, F.col("v") * 2)], "s").df


@_query(f"WITH {_CUBE} SELECT s, f, CAST((y - 1) // 2 AS BIGINT) AS y, v FROM q WHERE y >= 1 AND y < 8 AND (y - 1) % 2 = 0")
def shape_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.cut(cube(spark, sf_dir), "y", 1, 8, 2).df


@_query(f"WITH {_NATIONS} SELECT i, j, v FROM a WHERE j - i >= 1")
def shape_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.triangle(nations(spark, sf_dir), upper=True, offset=1).df


@_query(f"WITH {_CUBE}, g(k, y) AS (VALUES (0, 4), (1, 4), (2, 1)) SELECT s, f, CAST(k AS BIGINT) AS y, v FROM q JOIN g USING (y)")
def shape_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = spark.createDataFrame([(0, 4), (1, 4), (2, 1)], "position long, source long")
    return shape.gather(cube(spark, sf_dir), "y", index).df


@_query(f"WITH {_CUBE}, n AS (SELECT s, 0 AS f, y, v FROM q WHERE f = 1) SELECT s, CAST(f AS BIGINT) AS f, y, sum(v) AS v FROM (SELECT s, f, y, v FROM q UNION ALL SELECT * FROM n) GROUP BY 1, 2, 3")
def shape_scatter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    moved = q.with_df(q.df.where("f = 1").withColumn("f", F.lit(0).cast("long")))
    return shape.scatter(q, moved, "add").df


@_query(f"WITH {_FULL} SELECT row_number() OVER (ORDER BY s, f, y) - 1 AS i, v FROM d WHERE v > 300")
def shape_mask_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    return shape.mask_select(q, elementwise.compare(q, 300.0, "gt")).df


@_query("SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS position FROM (SELECT DISTINCT c_name FROM customer)")
def tensor_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0-based places of names in order."""
    return positions(_read(spark, sf_dir, "customer"), "c_name")


@_query(f"WITH {_NATIONS} SELECT i, j, 2 * v + 3 * coalesce(w, 0) AS v FROM (SELECT i, j, coalesce(x.v, 0) AS v, y.v AS w FROM a x FULL JOIN (SELECT j AS i, i AS j, v FROM a) y USING (i, j))")
def sparse_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir)
    return sparse.add(a, sparse.transposed(a), 2.0, 3.0).df


@_query(f"WITH {_PARTS}, x AS (SELECT s, sum(v) AS w FROM p GROUP BY s) SELECT p, sum(v * w) AS v FROM p JOIN x USING (s) GROUP BY p")
def sparse_spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = purchases(spark, sf_dir)
    return sparse.spmv(p, reduce.reduce(p, ["p"], "sum")).df


@_query(f"WITH {_NATIONS} SELECT x.i, y.j AS k, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.i GROUP BY 1, 2")
def sparse_spmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir)
    return sparse.spmm(a, a).df


@_query(f"WITH {_PARTS} SELECT round(sqrt(sum(v * v)), 6) AS frobenius, max(abs(v)) AS largest, count(*) AS stored, (SELECT max(t) FROM (SELECT sum(abs(v)) AS t FROM p GROUP BY p)) AS norm_inf, (SELECT max(t) FROM (SELECT sum(abs(v)) AS t FROM p GROUP BY s)) AS norm_one FROM p")
def sparse_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.norms(purchases(spark, sf_dir)).withColumn("frobenius", F.round("frobenius", 6))


@_query(f"WITH {_NATIONS}, b AS (SELECT i, j, v FROM a WHERE v > (SELECT avg(v) FROM a)) SELECT count(*) AS stored, count(*) / 625.0::DOUBLE AS density, max(greatest(x.j - x.i, 0)) AS upper_band, max(greatest(x.i - x.j, 0)) AS lower_band, min(CASE WHEN y.v IS NULL THEN 0 ELSE 1 END) AS pattern_symmetric, min(CASE WHEN y.v = x.v THEN 1 ELSE 0 END) AS symmetric FROM b x LEFT JOIN b y ON x.i = y.j AND x.j = y.i")
def sparse_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir)
    a = a.with_df(cut(a.df))  # the tables are joined once, for all that comes
    mean = a.df.agg(F.avg("v").alias("m"))
    return sparse.structure(a.with_df(a.df.crossJoin(mean).where("v > m")))


@_query(f"WITH {_PARTS}, n AS (SELECT count(*) AS n FROM supplier) SELECT p, CASE WHEN count(*) < any_value(n) THEN greatest(max(v), 0) ELSE max(v) END AS v FROM p, n GROUP BY p")
def sparse_row_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row maxima that know of implicit zeros."""
    return reduce.sparse_extreme(purchases(spark, sf_dir), "s").df


@_query(f"WITH {_NATIONS}, s AS (SELECT i, sum(v) AS t FROM a GROUP BY i) SELECT i, j, v FROM (SELECT i, j, sum(v) AS v FROM (SELECT i, i AS j, t AS v FROM s UNION ALL SELECT i, j, -v FROM a) GROUP BY 1, 2) WHERE v <> 0")
def sparse_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.laplacian(nations(spark, sf_dir)).df


@_query(f"WITH {_PARTS}, a AS (SELECT p, s FROM p WHERE v > 50), b AS (SELECT p, s FROM p WHERE s % 2 = 0) SELECT 'difference' AS kind, p, s FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'intersection', p, s FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def sparse_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = purchases(spark, sf_dir).df
    a, b = p.where("v > 50").select("p", "s"), p.where("s % 2 = 0").select("p", "s")
    return sparse.mask_difference(a, b).select(F.lit("difference").alias("kind"), "p", "s").union(sparse.mask_intersection(a, b).select(F.lit("intersection"), "p", "s"))


def sales_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst, w) from customers to the suppliers of their items, of all lineitem rows."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    count = rows.count()
    if count > 8 * lines.TASK_CELLS:  # tasks of a bounded number of rows
        parts = lines.tasks(spark, count)
        rows, orders = rows.repartition(parts, "l_orderkey"), orders.repartition(parts, "l_orderkey")
    return rows.join(orders, "l_orderkey").groupBy((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).agg(F.sum("l_quantity").alias("w"))


_GRAPH = "g AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@_query(f"WITH {_GRAPH} SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM g UNION ALL SELECT dst, 0, 1 FROM g) GROUP BY id")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(sales_graph(spark, sf_dir))


_COMPONENTS = f"WITH RECURSIVE {_GRAPH}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), c(id, r) AS (SELECT src, src FROM b UNION SELECT b.dst, c.r FROM c JOIN b ON b.src = c.id WHERE c.r < b.dst) SELECT id, min(r) AS component FROM c GROUP BY id"


@_query(_COMPONENTS)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(sales_graph(spark, sf_dir))


_ALL_SALES = "g AS (SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@_query(f"WITH {_ALL_SALES} SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM g UNION ALL SELECT dst, 0, 1 FROM g) GROUP BY id")
def graph_degrees_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees over all lineitem rows."""
    return graph.degrees(sales_graph(spark, sf_dir))


@_query(_COMPONENTS)
def graph_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over all lineitem rows."""
    return graph.components(sales_graph(spark, sf_dir))


@_query(f"WITH {_NATIONS}, b AS (SELECT DISTINCT least(i, j) AS x, greatest(i, j) AS y FROM a WHERE i <> j AND v > (SELECT avg(v) FROM a)) SELECT p.x AS a, p.y AS b, q.y AS c FROM b p JOIN b q ON p.y = q.x JOIN b r ON r.x = p.x AND r.y = q.y")
def graph_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir)
    dense = a.df.crossJoin(a.df.agg(F.avg("v").alias("m"))).where("v > m").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return graph.triangles(dense)


@_query(f"WITH RECURSIVE {_NATIONS}, b AS (SELECT i AS src, j AS dst FROM a WHERE v > (SELECT avg(v) * 1.3 FROM a)), r(id, level) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, level + 1 FROM r JOIN b ON src = id WHERE level < 25) SELECT id, min(level) AS level FROM r GROUP BY id")
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir)
    some = a.df.crossJoin(a.df.agg((F.avg("v") * 1.3).alias("m"))).where("v > m").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return graph.bfs(some, 0)


@_query(f"WITH RECURSIVE {_NATIONS}, b AS (SELECT i AS src, j AS dst, v AS w FROM a), r(id, d, n) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0 UNION SELECT dst, d + w, n + 1 FROM r JOIN b ON src = id WHERE n < 3) SELECT id, min(d) AS distance FROM r GROUP BY id")
def graph_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir)
    return graph.shortest_paths(a.df.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w")), 0)


def _pagerank_sql(rounds: int = 90) -> str:
    steps = "".join(f", r{k + 1} AS MATERIALIZED (SELECT e.dst AS id, 0.15 / (SELECT count(*) FROM r{k}) + 0.85 * sum(r.rank / d.n) AS rank FROM r{k} r JOIN e ON e.src = r.id JOIN d ON d.src = r.id GROUP BY 1)" for k in range(rounds))
    return f"""WITH {_NATIONS}, e AS MATERIALIZED (SELECT i AS src, j AS dst FROM a), d AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY 1),
        r0 AS MATERIALIZED (SELECT DISTINCT src AS id, 1.0::DOUBLE / (SELECT count(DISTINCT src) FROM e) AS rank FROM e){steps} SELECT id, round(rank, 8) AS rank FROM r{rounds}"""


@_query(_pagerank_sql())
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of nations; each one buys from and sells to others, so every vertex has edges both ways."""
    a = nations(spark, sf_dir)
    return graph.pagerank(a.df.select(F.col("i").alias("src"), F.col("j").alias("dst")), tolerance=1e-12).withColumn("rank", F.round("rank", 8))


def _forest_sql(doublings: int = 5) -> str:
    """Edges that no path of smaller edges bypasses: smallest largest edges of paths, by doubling."""
    steps = "".join(f", m{k + 1} AS MATERIALIZED (SELECT x, y, min(r) AS r FROM (SELECT p.x, q.y, greatest(p.r, q.r) AS r FROM m{k} p JOIN m{k} q ON p.y = q.x UNION ALL SELECT * FROM m{k}) GROUP BY 1, 2)" for k in range(doublings))
    return f"""WITH {_NATIONS}, u AS (SELECT least(i, j) AS src, greatest(i, j) AS dst, min(v) AS w FROM a WHERE i <> j GROUP BY 1, 2), e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w, src, dst) AS r FROM u),
        m0 AS MATERIALIZED (SELECT src AS x, dst AS y, r FROM e UNION ALL SELECT dst, src, r FROM e){steps} SELECT src, dst, w FROM e JOIN m{doublings} m ON m.x = e.src AND m.y = e.dst WHERE e.r <= m.r"""


@_query(_forest_sql())
def graph_spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir)
    return graph.spanning_forest(a.df.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w")))


@_query()
def linalg_conjugate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression of the components' sums on the embeddings' components."""
    e = vectors(spark, sf_dir)
    normal = sparse.add(kernels.gram(e).renamed(("i", "j")), from_numpy(spark, __import__("numpy").eye(64), ("i", "j")))
    x = linalg.conjugate_gradient(normal, einsum("ed->d", e), tolerance=1e-6, jacobi=True)
    return x.df.select("i", F.round("v", 6).alias("v"))


@_query()
def linalg_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading singular values of the embeddings."""
    _, s, _ = linalg.svd(vectors(spark, sf_dir), 8)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(s)], "k int, v double")


@_query()
def decomp_cp_als(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of CP models of the cube."""
    model = decomp.cp_als(cube(spark, sf_dir), 2, rounds=3, seed=1)
    return spark.createDataFrame([(k, round(f, 6)) for k, f in enumerate(model.fits)], "round int, fit double")


@_query()
def decomp_tucker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared norms of the core's slices."""
    model = decomp.tucker(cube(spark, sf_dir), (3, 2, 2))
    return spark.createDataFrame([(k, round(float((c**2).sum()), 2)) for k, c in enumerate(model.core)], "k int, v double")


@_query()
def decomp_tensor_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of a tensor train of the cube."""
    cores = decomp.tt_svd(cube(spark, sf_dir), tolerance=1e-6)
    return spark.createDataFrame([(k, *map(int, c.shape)) for k, c in enumerate(cores)], "k int, left int, n int, right int")


@_query(f"WITH {_NATIONS} SELECT i, j, 2 * v AS v FROM a")
def ad_einsum_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the sum of squares through einsum('ij,ij->')."""
    a = nations(spark, sf_dir)
    one = Tensor(spark.range(1).select(F.lit(1.0).alias("v")), (), ())
    x, y = ad.einsum_vjp("ij,ij->", [a, a], one)
    return sparse.add(x, y).df


@_query(f"WITH {_FULL} SELECT s, f, y, CASE WHEN v = max(v) OVER (PARTITION BY s, f) THEN 1.0::DOUBLE / sum(1) FILTER (v = m) OVER (PARTITION BY s, f) ELSE 0.0 END AS v FROM (SELECT *, max(v) OVER (PARTITION BY s, f) AS m FROM d)")
def ad_max_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    ones = elementwise.scalar(reduce.reduce(q, ["y"], "max"), "pow", 0.0)
    return ad.reduction_vjp(q, ["y"], "max", ones).df


def _system(spark: SparkSession, sf_dir: str, symmetric: bool) -> tuple[Tensor, Tensor]:
    """A diagonally heavy matrix from the nations' trade in units of its mean, and the trade's row sums."""
    a = nations(spark, sf_dir)
    a = a.with_df(cut(a.df))  # the tables are joined once, for all that comes
    mean = a.df.agg(F.sum("v") / 625).first()[0]
    a = a.with_df(a.df.withColumn("v", F.col("v") / mean))
    both = sparse.add(a, shape.permute(a, ("j", "i")).renamed(("i", "j"))) if symmetric else a
    heavy = sparse.add(both, from_numpy(spark, 60.0 * __import__("numpy").eye(25), ("i", "j")))
    return heavy, reduce.reduce(a, ["j"], "sum")


_ROW_SUMS = f"WITH {_NATIONS} SELECT i, round(sum(v) / (SELECT sum(v) / 625 FROM a), 4) AS v FROM a GROUP BY i"


def _image(a: Tensor, solution: krylov.Solution) -> DataFrame:
    """What the matrix makes of the solution: the right-hand side again."""
    return krylov.apply(a, solution.x).df.select("i", F.round("v", 4).alias("v"))


@_query(_ROW_SUMS)
def krylov_bicgstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _system(spark, sf_dir, symmetric=False)
    return _image(a, krylov.bicgstab(a, b, tolerance=1e-7, preconditioner=krylov.jacobi(a)))


@_query(_ROW_SUMS)
def krylov_gmres(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _system(spark, sf_dir, symmetric=False)
    return _image(a, krylov.gmres(a, b, tolerance=1e-7, restart=10))


@_query(_ROW_SUMS)
def krylov_minres(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _system(spark, sf_dir, symmetric=True)
    return _image(a, krylov.minres(a, b, tolerance=1e-7))


@_query(f"WITH {_FULL} SELECT s, f, CAST(k.range AS BIGINT) AS y, round(sum(v * cos(2 * pi() * k.range * y / 10)), 3) + 0.0 AS re, round(-sum(v * sin(2 * pi() * k.range * y / 10)), 3) + 0.0 AS im FROM d, range(10) k GROUP BY 1, 2, 3 HAVING max(v) > 0 OR min(v) < 0")
def fourier_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of the yearly quantities of each supplier nation and return flag."""
    re, im = fourier.fft(cube(spark, sf_dir), "y")
    both = re.df.withColumnRenamed("v", "re").join(im.df.withColumnRenamed("v", "im"), ["s", "f", "y"])
    return both.select("s", "f", "y", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


@_query("WITH e AS (SELECT vec_id AS e, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) SELECT a.d AS a, b.d AS b, round(corr(a.x::DOUBLE, b.x::DOUBLE), 6) + 0.0 AS v FROM e a JOIN e b USING (e) GROUP BY 1, 2")
def stat_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the embeddings' components."""
    return reduce.covariance_matrix(vectors(spark, sf_dir), correlation=True).df.select("a", "b", (F.round("v", 6) + 0.0).alias("v"))


@_query(
    f"""WITH {_PARTS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM part), m AS (SELECT range AS s, coalesce(t, 0) / n AS m FROM n, range((SELECT count(*) FROM supplier)) LEFT JOIN (SELECT s, sum(v) AS t FROM p GROUP BY 1) ON s = range),
    xy AS (SELECT x.s AS a, y.s AS b, sum(x.v * y.v) AS xy FROM p x JOIN p y USING (p) GROUP BY 1, 2)
    SELECT CAST(a.s AS BIGINT) AS a, CAST(b.s AS BIGINT) AS b, round((coalesce(xy, 0) - n * a.m * b.m) / (n - 1), 4) + 0.0 AS v FROM n, m a CROSS JOIN m b LEFT JOIN xy ON xy.a = a.s AND xy.b = b.s"""
)
def stat_sparse_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of the suppliers' quantities by part: a sparse matrix, of whose pairs many never meet."""
    return reduce.covariance_matrix(purchases(spark, sf_dir)).df.select("a", "b", (F.round("v", 4) + 0.0).alias("v"))


@_query("SELECT vec_id AS e, generate_subscripts(embedding, 1) - 1 AS d, round(unnest(embedding)::DOUBLE, 4) + 0.0 AS v FROM embeddings")
def linalg_svd_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U S V' of all singular triplets: the embeddings again."""
    x = vectors(spark, sf_dir)
    u, s, v = linalg.svd(x)
    back = einsum("ek,kd->ed", u, from_numpy(spark, (v * s).T, ("k", "d")))
    return back.df.toDF("e", "d", "v").select("e", "d", (F.round("v", 4) + 0.0).alias("v"))


@_query(f"WITH {_FULL} SELECT s, f, y, round(v, 3) + 0.0 AS v FROM d")
def decomp_tucker_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Tucker model of full ranks, multiplied out: the cube again."""
    back = decomp.tucker(cube(spark, sf_dir), (25, 3, 10)).reconstruct()
    return from_numpy(spark, back, ("s", "f", "y")).dense().df.select("s", "f", "y", (F.round("v", 3) + 0.0).alias("v"))


@_query(f"WITH {_FULL} SELECT s, f, y, round(v, 3) + 0.0 AS v FROM d")
def decomp_tensor_train_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tensor train of the cube, multiplied out: the cube again."""
    back = decomp.tt_reconstruct(decomp.tt_svd(cube(spark, sf_dir), tolerance=1e-8))
    return from_numpy(spark, back, ("s", "f", "y")).dense().df.select("s", "f", "y", (F.round("v", 3) + 0.0).alias("v"))


@_query(f"WITH {_FULL} SELECT s, f, CAST(sum(abs(v)) AS DOUBLE) AS l1, round(var_samp(v), 3) AS var_samp, round(stddev_samp(v), 4) AS std_samp FROM d GROUP BY 1, 2")
def reduce_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    out = None
    for name, op, digits in (("l1", "norm_l1", None), ("var_samp", "var_samp", 3), ("std_samp", "std_samp", 4)):
        part = reduce.reduce(q.dense(), ["y"], op).df
        part = part.select("s", "f", (F.col("v") if digits is None else F.round("v", digits)).alias(name))
        out = part if out is None else out.join(part, ["s", "f"])
    return out


@_query(f"WITH {_NATIONS}, x AS (SELECT i, j, v FROM a) SELECT i, j, round(v - 0.1 * v * 1.9 - 0.1 * ((v - 0.19 * v) * 1.9 + 0.81 * v), 4) AS v FROM x")
def optim_nesterov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Nesterov steps of rate 0.1 and momentum 0.9 on half the squared norm of the trade matrix."""
    x, rule = nations(spark, sf_dir), optim.sgd(0.1, 0.9, nesterov=True)
    for _ in range(2):
        x, rule = rule.step(x, x)
    return x.df.select("i", "j", F.round("v", 4).alias("v"))
