"""More queries and SQL: the remaining modes of windows, shapes, element-wise operations, masks, solvers, graphs and files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyadic.iterate import shared_folder, written
from polyadic.operators import ad, decomp, elementwise, factorization, graph, kernels, krylov, linalg, optim, reduce, shape, sparse, strips, tape, windows
from polyadic.plans.einsum import einsum
from polyadic.queries import _CUBE, _FULL, _GRAPH, _NATIONS, _PARTS, _query, _system, cube, nations, purchases, sales_graph, vectors
from polyadic.sources import files
from polyadic.tensor import Tensor, from_numpy


def _rounded(t: Tensor, digits: int) -> DataFrame:
    return t.df.select(*t.axes, (F.round("v", digits) + 0.0).alias("v"))


@_query(f"WITH {_FULL} SELECT s, f, y, product(CASE WHEN v > 300 THEN 2.0::DOUBLE ELSE 1.0 END) OVER (PARTITION BY s, f ORDER BY y) AS v FROM d")
def window_cumprod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running products of 2 for each large cell and 1 for each other one."""
    large = elementwise.scalar(elementwise.compare(cube(spark, sf_dir), 300.0, "gt"), "add", 1.0)
    return windows.cumulative(large, "y", "prod").df


@_query(f"WITH {_FULL} SELECT s, f, y, max(v) OVER w AS hi, min(v) OVER w AS lo FROM d WINDOW w AS (PARTITION BY s, f ORDER BY y)")
def window_cummax(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    low = windows.cumulative(q, "y", "min").df.withColumnRenamed("v", "lo")
    return windows.cumulative(q, "y", "max").df.withColumnRenamed("v", "hi").join(low, ["s", "f", "y"])


@_query(f"WITH {_FULL}, m AS (SELECT *, v / 1000 - max(v / 1000) OVER (PARTITION BY s, f) AS x FROM d) SELECT s, f, y, round(x - ln(sum(exp(x)) OVER (PARTITION BY s, f)), 6) + 0.0 AS v FROM m")
def window_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = elementwise.scalar(cube(spark, sf_dir), "div", 1000.0)
    return _rounded(windows.softmax(q, "y", log=True), 6)


@_query(f"WITH {_FULL} SELECT s, f, y, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 6) + 0.0 AS v FROM d WINDOW w AS (PARTITION BY f, y)")
def window_batch_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (flag, year) normalised over the nations."""
    return _rounded(windows.normalise(cube(spark, sf_dir), ["s"]), 6)


_KERNEL_2D = "k(ds, dy, w) AS (VALUES (0, 0, 1.0::DOUBLE), (0, 1, -2.0), (1, 0, 3.0), (1, 1, 1.0))"


@_query(f"WITH {_FULL}, {_KERNEL_2D} SELECT s - ds AS s, f, y - dy AS y, sum(v * w) AS v FROM d, k WHERE s - ds BETWEEN 0 AND 23 AND y - dy BETWEEN 0 AND 8 GROUP BY 1, 2, 3")
def window_convolution_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = from_numpy(spark, np.array([[1.0, -2.0], [3.0, 1.0]]), ("a", "b"))
    return windows.correlate(cube(spark, sf_dir).dense(), kernel, ["s", "y"]).df


@_query(f"WITH {_FULL} SELECT s, CAST(o.range AS BIGINT) AS out, y - k.range AS y, sum(v * (o.range * 6 + f * 2 + k.range + 1)) AS v FROM d, range(2) o, range(2) k WHERE y - k.range BETWEEN 0 AND 8 GROUP BY 1, 2, 3")
def window_convolution_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as input channels, two output channels."""
    kernel = from_numpy(spark, np.arange(1.0, 13.0).reshape(2, 3, 2), ("o", "c", "k"))
    return windows.correlate_channels(cube(spark, sf_dir).dense(), kernel, ["y"], "f").df


@_query(f"WITH {_FULL} SELECT s, f, CAST(y // 5 AS BIGINT) AS y, round(avg(v), 6) AS v FROM d GROUP BY 1, 2, 3")
def window_average_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.pool(cube(spark, sf_dir), {"y": 5}, "avg"), 6)


@_query(f"WITH {_NATIONS} SELECT i, j, v FROM a ORDER BY abs(v) DESC, i, j LIMIT 10")
def ad_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.top_k(nations(spark, sf_dir), 10).df


@_query(f"WITH {_NATIONS}, t AS (SELECT sqrt(sum(v * v)) AS n FROM a) SELECT i, j, round(v / n, 8) AS v FROM a, t")
def ad_clip_by_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ad.clip_by_norm(nations(spark, sf_dir), 1.0), 8)


@_query(f"WITH {_NATIONS} SELECT i, j, round(CASE WHEN v > 0 THEN 1 / v ELSE 0 END, 10) AS v FROM a")
def ad_log_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the sum of logarithms of the trade between nations, where there is any."""
    a = nations(spark, sf_dir)
    ones = a.with_df(a.df.withColumn("v", F.lit(1.0)))
    return _rounded(a.with_df(ad.unary_vjp(a, "log", ones).df.join(a.df.select("i", "j"), ["i", "j"], "left_semi")), 10)


@_query(f"WITH {_NATIONS} SELECT i, j FROM a WHERE i < 10 OR j < 5")
def sparse_mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir).df
    return sparse.mask_union(a.where("i < 10").select("i", "j"), a.where("j < 5").select("i", "j"))


@_query(f"WITH {_NATIONS} SELECT i, sum(v) AS v FROM a WHERE (i + j) % 3 = 0 GROUP BY 1")
def sparse_masked_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir)
    return reduce.reduce(sparse.masked(a, a.df.where("(i + j) % 3 = 0").select("i", "j")), ["j"], "sum").df


@_query(f"WITH {_NATIONS} SELECT i, j, v FROM a UNION ALL SELECT i + 25, j + 25, 2 * v FROM a")
def sparse_block_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir)
    return sparse.block_diagonal([a, a.with_df(a.df.withColumn("v", F.col("v") * 2))]).df


@_query(f"WITH {_NATIONS}, {_PARTS} SELECT p, s, v * (s + 1) AS v FROM p")
def sparse_scaled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = purchases(spark, sf_dir)
    n = p.shape[1]
    weights = Tensor(spark.range(n).select(F.col("id").alias("s"), (F.col("id") + 1.0).alias("v")), ("s",), (n,))
    return sparse.scaled_columns(p, weights).df


@_query(f"WITH {_NATIONS}, h AS (SELECT i, j, v + CASE WHEN i = j THEN 1e4 ELSE 0 END AS v FROM a WHERE abs(i - j) <= 2) SELECT max(abs(i - j)) <= 2 AS banded, (SELECT bool_and(2 * d > t) FROM (SELECT sum(CASE WHEN i = j THEN v ELSE 0 END) AS d, sum(abs(v)) AS t FROM h GROUP BY i)) AS dominant FROM h")
def sparse_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a banded trade matrix with a heavy diagonal is banded and diagonally dominant."""
    a = nations(spark, sf_dir)
    heavy = a.with_df(a.df.where("abs(i - j) <= 2").withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), 1e4).otherwise(0.0)))
    return sparse.is_banded(heavy, 2, 2).crossJoin(sparse.is_dominant(heavy))


@_query(f"WITH {_FULL} SELECT s, f, product(CASE WHEN v > 300 THEN 2.0::DOUBLE ELSE 1.0 END) AS prod, max(abs(v)) AS linf, CAST(count(*) FILTER (v <> 0) AS DOUBLE) AS nonzero FROM d GROUP BY 1, 2")
def reduce_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    large = elementwise.scalar(elementwise.compare(q, 300.0, "gt"), "add", 1.0)
    out = reduce.reduce(large, ["y"], "prod").df.withColumnRenamed("v", "prod")
    out = out.join(reduce.reduce(q.dense(), ["y"], "norm_linf").df.withColumnRenamed("v", "linf"), ["s", "f"])
    return out.join(reduce.reduce(q.dense(), ["y"], "count_nonzero").df.withColumnRenamed("v", "nonzero"), ["s", "f"])


@_query(f"""WITH {_FULL}, m AS (SELECT *, avg(v) OVER (PARTITION BY f, y) AS m FROM d), c AS (SELECT f, y, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4 FROM m GROUP BY 1, 2)
    SELECT f, y, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM c WHERE m2 > 0""")
def reduce_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    skew = reduce.reduce(q, ["s"], "skewness").df.select("f", "y", F.round("v", 6).alias("skewness"))
    return skew.join(reduce.reduce(q, ["s"], "kurtosis").df.select("f", "y", F.round("v", 6).alias("kurtosis")), ["f", "y"]).where("skewness is not null and not isnan(skewness)")


@_query(f"WITH {_FULL} SELECT s, f, round(sum(abs(v) ** 3) ** (1.0 / 3), 4) AS v, CAST(max(v) - min(v) AS DOUBLE) AS spread FROM d GROUP BY 1, 2")
def reduce_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3-norm, and a caller's own aggregate: the spread."""
    q = cube(spark, sf_dir)
    spread = reduce.reduce(q, ["y"], "spread", F.max("v") - F.min("v")).df.withColumnRenamed("v", "spread")
    return reduce.norm_lp(q, ["y"], 3.0).df.select("s", "f", F.round("v", 4).alias("v")).join(spread, ["s", "f"])


_PAD_SOURCE = {"edge": "least(greatest(t.range - 2, 0), 9)", "wrap": "(t.range + 8) % 10"}


def _padded(mode: str) -> str:
    return f"WITH {_FULL} SELECT s, f, CAST(t.range AS BIGINT) AS y, v FROM range(15) t JOIN d ON d.y = {_PAD_SOURCE[mode]} WHERE v <> 0"


@_query(_padded("edge"))
def shape_pad_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.pad(cube(spark, sf_dir), "y", 2, 3, "edge").df.where("v <> 0")


@_query(_padded("wrap"))
def shape_pad_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.pad(cube(spark, sf_dir), "y", 2, 3, "wrap").df.where("v <> 0")


@_query(f"WITH {_FULL} SELECT s, f, y + 2 AS y, v FROM d UNION ALL SELECT s, f, CAST(t.range AS BIGINT), 7.0 FROM (SELECT DISTINCT s, f FROM d), range(15) t WHERE t.range < 2 OR t.range >= 12")
def shape_pad_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.pad(cube(spark, sf_dir), "y", 2, 3, "constant", 7.0).df


@_query(f"WITH {_CUBE} SELECT s, f, y * 3 + k.range AS y, v FROM q, range(3) k")
def shape_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.repeat(cube(spark, sf_dir), "y", 3).df


@_query(f"WITH {_CUBE} SELECT 0::BIGINT AS stack, s, f, y, v FROM q UNION ALL SELECT 1, s, f, 9 - y, v FROM q")
def shape_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cube(spark, sf_dir)
    return shape.stack([q, shape.flip(q, "y")]).df


@_query(f"WITH {_NATIONS} SELECT CAST(k.range AS BIGINT) AS k, i, v FROM a, range(4) k WHERE j = 3")
def shape_squeeze_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column, as a vector, spread along a new axis."""
    return shape.expand(shape.squeeze(shape.cut(nations(spark, sf_dir), "j", 3, 4), "j"), "k", 4).df


@_query(f"WITH {_NATIONS}, c AS (SELECT i.range AS i, j.range AS j, CASE WHEN v > 500 THEN 2 WHEN v > 250 THEN 1 ELSE 0 END AS cls FROM range(25) i CROSS JOIN range(25) j LEFT JOIN a ON a.i = i.range AND a.j = j.range) SELECT i, j, CAST(cls AS BIGINT) AS cls, 1.0::DOUBLE AS v FROM c")
def shape_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size classes of the trade between nations."""
    a = nations(spark, sf_dir)
    classes = sparse.add(elementwise.compare(a, 500.0, "gt"), elementwise.compare(a, 250.0, "gt"))
    return shape.one_hot(classes, 3).df


@_query(f"""WITH {_NATIONS}, u AS (SELECT i, j, max(w) AS hi, min(w) AS lo FROM (SELECT i % 5 AS i, j, v * 3 AS w FROM a) GROUP BY 1, 2), b AS (SELECT coalesce(a.i, u.i) AS i, coalesce(a.j, u.j) AS j, coalesce(a.v, 0) AS v, hi, lo FROM a FULL JOIN u ON a.i = u.i AND a.j = u.j)
    SELECT i, j, coalesce(hi, v) AS replaced, CASE WHEN hi IS NULL THEN v ELSE greatest(v, hi) END AS highest, CASE WHEN lo IS NULL THEN v ELSE least(v, lo) END AS lowest FROM b""")
def shape_scatter_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nations(spark, sf_dir)
    source = Tensor(a.df.select((F.col("i") % 5).alias("i"), "j", (F.col("v") * 3).alias("v")), ("i", "j"), (5, 25))
    out = None
    for mode, name in (("replace", "replaced"), ("max", "highest"), ("min", "lowest")):
        part = shape.scatter(a, source, mode).df.withColumnRenamed("v", name)
        out = part if out is None else out.join(part, ["i", "j"])
    return out


@_query(f"WITH {_CUBE} SELECT s, f, y - 4 AS y, v, CAST(1 AS BIGINT) AS part FROM q WHERE y >= 4 AND y < 7 UNION ALL SELECT s, f, y, v, 0 FROM q WHERE y < 4 UNION ALL SELECT s, f, y - 7, v, 2 FROM q WHERE y >= 7")
def shape_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = shape.split(cube(spark, sf_dir), "y", [4, 3, 3])
    out = [p.df.withColumn("part", F.lit(k).cast("long")) for k, p in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query(f"WITH {_NATIONS} SELECT CAST(k.range AS BIGINT) AS i, v FROM range(100) k JOIN a ON a.i = (k.range * 7) % 25 AND a.j = (k.range * 3) % 5")
def shape_gather_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells at a list of index pairs, which repeat."""
    index = spark.range(100).select(F.col("id").alias("position"), (F.col("id") * 7 % 25).alias("i"), (F.col("id") * 3 % 5).alias("j"))
    return shape.gather_cells(nations(spark, sf_dir), index).df


@_query(f"WITH {_NATIONS} SELECT CAST(x.range AS BIGINT) AS i, CAST(y.range AS BIGINT) AS j, v FROM range(40) x, range(10) y, a WHERE i = floor((x.range + 0.5) * 25 / 40) AND j = floor((y.range + 0.5) * 25 / 10)")
def shape_resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.resize(nations(spark, sf_dir), {"i": 40, "j": 10}, "nearest").df


@_query(f"""WITH {_NATIONS}, x AS (SELECT range AS o, range * 24.0::DOUBLE / 48 AS p FROM range(49)), wi AS (SELECT o, floor(p) AS k, 1 - (p - floor(p)) AS w FROM x UNION ALL SELECT o, floor(p) + 1, p - floor(p) FROM x),
    z AS (SELECT range AS o, range * 24.0::DOUBLE / 12 AS p FROM range(13)), wj AS (SELECT o, floor(p) AS k, 1 - (p - floor(p)) AS w FROM z UNION ALL SELECT o, floor(p) + 1, p - floor(p) FROM z)
    SELECT CAST(wi.o AS BIGINT) AS i, CAST(wj.o AS BIGINT) AS j, round(sum(v * wi.w * wj.w), 4) AS v FROM a JOIN wi ON wi.k = a.i JOIN wj ON wj.k = a.j WHERE wi.w * wj.w > 0 GROUP BY 1, 2""")
def shape_resize_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shape.resize(nations(spark, sf_dir), {"i": 49, "j": 13}, "linear"), 4)


@_query(f"WITH {_NATIONS} SELECT CAST(i // 5 AS BIGINT) AS i, CAST(j // 5 AS BIGINT) AS j, CAST(i % 5 AS BIGINT) AS pi, CAST(j % 5 AS BIGINT) AS pj, v FROM a")
def shape_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.patches(nations(spark, sf_dir), (5, 5), (5, 5)).df.toDF("i", "j", "pi", "pj", "v")


_TWO = f"WITH {_NATIONS}, b AS (SELECT j AS i, i AS j, v AS w FROM a), c AS (SELECT i, j, coalesce(v, 0) AS v, coalesce(w, 0) AS w FROM a FULL JOIN b USING (i, j))"


@_query(f"{_TWO} SELECT i, j, v + w AS added, v - w AS less, v * w AS times, greatest(v, w) AS hi, least(v, w) AS lo FROM c")
def elementwise_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade matrix with its transpose, by five operations."""
    a = nations(spark, sf_dir)
    b, out = shape.permute(a, ("j", "i")).renamed(("i", "j")), None
    for op, name in (("add", "added"), ("sub", "less"), ("mul", "times"), ("maximum", "hi"), ("minimum", "lo")):
        part = elementwise.binary(a, b, op).df.withColumnRenamed("v", name)
        out = part if out is None else out.join(part, ["i", "j"])
    return out


@_query(f"WITH {_FULL} SELECT s, f, y, CASE WHEN v > 300 THEN 2.0::DOUBLE ELSE 0 END ** (CASE WHEN y % 2 = 0 THEN 3.0::DOUBLE ELSE 0 END) AS v FROM d")
def elementwise_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powers of a tensor with zero cells by one with zero cells; 0 to the power of 0 is 1."""
    base = elementwise.scalar(elementwise.compare(cube(spark, sf_dir), 300.0, "gt"), "mul", 2.0)
    even = from_numpy(spark, 3.0 * (np.arange(10) % 2 == 0), ("y",))
    return elementwise.binary(sparse.dropped(base), even, "pow").df


@_query(f"WITH {_FULL} SELECT s, f, y, v + 2 AS added, v - 2 AS less, v * 2 AS times, v / 2 AS halved, v % 7 AS rest FROM d")
def elementwise_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, out = cube(spark, sf_dir), None
    for op, x, name in (("add", 2, "added"), ("sub", 2, "less"), ("mul", 2, "times"), ("div", 2, "halved"), ("modulo", 7, "rest")):
        part = elementwise.scalar(q, op, x).df.withColumnRenamed("v", name)
        out = part if out is None else out.join(part, ["s", "f", "y"])
    return out


#: Function and DuckDB expression of x, a number from about -2 to 2.
_MORE_UNARY = {
    "expm1": "exp(x) - 1",
    "exp2": "pow(2.0, x)",
    "log1p": "CASE WHEN x > -1 THEN ln(1 + x) WHEN x = -1 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END",
    "tan": "tan(x)",
    "atan": "atan(x)",
    "sinh": "(exp(x) - exp(-x)) / 2",
    "cosh": "(exp(x) + exp(-x)) / 2",
    "asinh": "asinh(x)",
    "cbrt": "cbrt(x)",
    "selu": "1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END",
    "recip": "CASE WHEN x = 0 THEN 'inf'::DOUBLE ELSE 1 / x END",
    "floor": "floor(x)",
    "ceil": "ceil(x)",
    "trunc": "trunc(x)",
    "fract": "x - trunc(x)",
    "deg2rad": "radians(x)",
    "rad2deg": "degrees(x)",
    "leaky_relu": "CASE WHEN x > 0 THEN x ELSE 0.01 * x END",
    "softsign": "x / (1 + abs(x))",
    "swish": "x / (1 + exp(-x))",
    "mish": "x * tanh(ln(1 + exp(x)))",
    "hard_sigmoid": "least(greatest(x / 6 + 0.5, 0), 1)",
}


@_query(f"WITH {_FULL}, z AS (SELECT s, f, y, (v % 41 - 20) / 10 AS x FROM d) " + " UNION ALL ".join(f"SELECT s, f, y, '{name}' AS name, round({sql}, 6) + 0.0 AS v FROM z" for name, sql in _MORE_UNARY.items()))
def elementwise_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """22 functions of every cell, brought to -2 to 2."""
    q = cube(spark, sf_dir).dense()
    x, out = q.with_df(q.df.withColumn("v", (F.col("v") % 41 - 20) / 10)), None
    for name in _MORE_UNARY:
        part = elementwise.unary(x, name).df.select("s", "f", "y", F.lit(name).alias("name"), (F.round("v", 6) + 0.0).alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


_HEAVY = "b AS (SELECT i AS src, j AS dst FROM a WHERE v > (SELECT avg(v) * 1.3 FROM a))"


def _heavy(spark: SparkSession, sf_dir: str, below: bool = False) -> DataFrame:
    """Edges between nations with much trade; with ``below`` only from lower to higher numbers."""
    a = nations(spark, sf_dir)
    some = a.df.crossJoin(a.df.agg((F.avg("v") * 1.3).alias("m"))).where("v > m")
    return (some.where("i < j") if below else some).select(F.col("i").alias("src"), F.col("j").alias("dst"))


@_query(f"WITH RECURSIVE {_NATIONS}, {_HEAVY}, g AS (SELECT * FROM b WHERE src < dst), r(id, level) AS (SELECT src, 0::BIGINT FROM g UNION SELECT dst, level + 1 FROM r JOIN g ON src = id) SELECT v.id, coalesce(max(level), 0) AS level FROM (SELECT src AS id FROM g UNION SELECT dst FROM g) v LEFT JOIN r ON r.id = v.id GROUP BY 1")
def graph_topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological_levels(_heavy(spark, sf_dir, below=True)).select("id", F.col("level").cast("long").alias("level"))


@_query(f"WITH RECURSIVE {_NATIONS}, {_HEAVY}, r(x, y) AS (SELECT src, src FROM b UNION SELECT dst, dst FROM b UNION SELECT x, dst FROM r JOIN b ON src = y) SELECT p.x AS id, min(p.y) AS component FROM r p JOIN r q ON p.x = q.y AND p.y = q.x GROUP BY 1")
def graph_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(_heavy(spark, sf_dir))


@_query(f"WITH RECURSIVE {_NATIONS}, {_HEAVY}, r(x, y) AS (SELECT src, dst FROM b UNION SELECT x, dst FROM r JOIN b ON src = y) SELECT coalesce(bool_or(x = y), FALSE) AS cyclic, FALSE AS cyclic_upwards FROM r")
def graph_has_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.has_cycle(_heavy(spark, sf_dir)), graph.has_cycle(_heavy(spark, sf_dir, below=True))
    return spark.createDataFrame([found], "cyclic boolean, cyclic_upwards boolean")


@_query(f"WITH {_NATIONS}, {_HEAVY} SELECT id, 0::BIGINT AS clashes FROM (SELECT src AS id FROM b UNION SELECT dst FROM b)")
def graph_colouring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vertex the number of neighbours that have its colour."""
    edges = _heavy(spark, sf_dir)
    colours = graph.colouring(edges)
    near = edges.where("src <> dst").join(colours.toDF("src", "c"), "src").join(colours.toDF("dst", "d"), "dst")
    clashes = near.where("c = d").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("clashes"))
    return colours.join(clashes, "id", "left").select("id", F.coalesce("clashes", F.lit(0).cast("long")).alias("clashes"))


@_query(f"WITH {_NATIONS}, {_HEAVY} SELECT count(DISTINCT id) AS vertices, 0::BIGINT AS inside, 0::BIGINT AS apart FROM (SELECT src AS id FROM b UNION SELECT dst FROM b)")
def graph_independent_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices, edges inside the set, and vertices that are neither in it nor next to it."""
    edges = _heavy(spark, sf_dir)
    chosen = graph.independent_set(edges)
    both = edges.union(edges.select("dst", "src")).where("src <> dst")
    inside = both.join(chosen.toDF("src"), "src", "left_semi").join(chosen.toDF("dst"), "dst", "left_semi").agg(F.count("*").alias("inside"))
    covered = chosen.union(both.join(chosen.toDF("src"), "src", "left_semi").select("dst"))
    apart = graph.vertices(edges).join(covered.distinct(), "id", "left_anti").agg(F.count("*").alias("apart"))
    return graph.vertices(edges).agg(F.count("*").alias("vertices")).crossJoin(inside).crossJoin(apart)


@_query(f"WITH {_GRAPH}, {_NATIONS} SELECT (SELECT bool_and(src % 2 <> dst % 2) FROM g) AS sales, (SELECT count(*) = 0 FROM a x JOIN a y ON x.j = y.i JOIN a z ON y.j = z.i AND z.j = x.i) AS nations")
def graph_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers are two sides; the nations' trade has odd cycles."""
    trade = nations(spark, sf_dir).df.select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return spark.createDataFrame([(graph.bipartite(sales_graph(spark, sf_dir)), graph.bipartite(trade))], "sales boolean, nations boolean")


def _power_sql(rounds: int = 40) -> str:
    steps = "".join(f", x{k + 1} AS MATERIALIZED (SELECT i, v / sum(v) OVER () AS v FROM (SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x{k} x ON x.i = a.j GROUP BY 1))" for k in range(rounds))
    return f"WITH {_NATIONS}, x0 AS (SELECT CAST(range AS BIGINT) AS i, 1.0::DOUBLE AS v FROM range(25)){steps} SELECT i, round(v, 6) AS v FROM x{rounds}"


@_query(_power_sql())
def linalg_power_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading eigenvector of the trade between nations, with sum 1."""
    _, x = linalg.power_iteration(nations(spark, sf_dir), tolerance=1e-10)
    total = x.df.agg(F.sum("v")).first()[0]
    return x.df.select("i", F.round(F.col("v") / total, 6).alias("v"))


@_query("WITH e AS (SELECT unnest(embedding)::DOUBLE AS x, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i FROM embeddings) SELECT i, round(sum(x), 3) + 0.0 AS v FROM e GROUP BY 1")
def linalg_cg_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ridge system makes of its solution: its right-hand side, the components' sums."""
    e = vectors(spark, sf_dir)
    normal = sparse.add(kernels.gram(e).renamed(("i", "j")), from_numpy(spark, np.eye(64), ("i", "j")))
    x = linalg.conjugate_gradient(normal, reduce.reduce(e, ["e"], "sum"), tolerance=1e-7, jacobi=True)
    return _rounded(krylov.apply(normal, x), 3)


@_query("SELECT vec_id AS e, generate_subscripts(embedding, 1) - 1 AS d, round(unnest(embedding)::DOUBLE, 4) + 0.0 AS v FROM embeddings")
def linalg_qr_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q R: the embeddings again."""
    q, r = linalg.tall_qr(vectors(spark, sf_dir))
    back = kernels.nmode_product(q, from_numpy(spark, r.T, ("m", "n")), 1)
    return back.df.toDF("e", "d", "v").select("e", "d", (F.round("v", 4) + 0.0).alias("v"))


@_query("SELECT vec_id AS e, generate_subscripts(embedding, 1) - 1 AS d, round(unnest(embedding)::DOUBLE, 4) + 0.0 AS v FROM embeddings")
def linalg_randomized_svd_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U S V' of all triplets by random projections: the embeddings again."""
    u, s, v = linalg.randomized_svd(vectors(spark, sf_dir), 64)
    back = kernels.nmode_product(u, from_numpy(spark, v * s, ("m", "n")), 1)
    return back.df.toDF("e", "d", "v").select("e", "d", (F.round("v", 4) + 0.0).alias("v"))


_ROW_SUMS = f"WITH {_NATIONS} SELECT i, round(sum(v) / (SELECT sum(v) / 625 FROM a), 4) AS v FROM a GROUP BY i"


@_query(_ROW_SUMS)
def krylov_cgnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _system(spark, sf_dir, symmetric=False)
    return _rounded(krylov.apply(a, krylov.cgnr(a, b, tolerance=1e-7).x), 4)


@_query(_ROW_SUMS)
def krylov_cgne(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _system(spark, sf_dir, symmetric=False)
    return _rounded(krylov.apply(a, krylov.cgne(a, b, tolerance=1e-7).x), 4)


_MARGINS = f"""WITH {_FULL}, t AS (SELECT sum(v) AS t FROM d), ms AS (SELECT s, sum(v) / t AS a FROM d, t GROUP BY s, t), mf AS (SELECT f, sum(v) / t AS b FROM d, t GROUP BY f, t), my AS (SELECT y, sum(v) / t AS c FROM d, t GROUP BY y, t)
    SELECT s, f, y, round(1000 * a * b * c, 4) + 0.0 AS v FROM ms, mf, my"""


def _rank_one(spark: SparkSession, sf_dir: str) -> Tensor:
    """The product of the cube's three margins' shares, times 1000."""
    q = cube(spark, sf_dir)
    total = q.df.agg(F.sum("v")).first()[0]
    sides = [reduce.reduce(q, list(q.others(a)), "sum") for a in q.axes]
    x = kernels.outer(*(t.with_df(t.df.withColumn("v", F.col("v") / total)) for t in sides), names=q.axes)
    return x.with_df(x.df.withColumn("v", 1000.0 * F.col("v")))


def _cells(spark: SparkSession, array: np.ndarray) -> DataFrame:
    return _rounded(from_numpy(spark, array, ("s", "f", "y")).dense(), 4)


@_query(_MARGINS)
def decomp_cp_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CP model of a tensor of rank 1, multiplied out: the tensor again."""
    return _cells(spark, decomp.cp_als(_rank_one(spark, sf_dir), 1, rounds=20, tolerance=1e-14).reconstruct())


@_query(_MARGINS)
def decomp_cp_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of a tensor of rank 1, from four fifths of them."""
    x = _rank_one(spark, sf_dir).dense()
    known = x.with_df(x.df.where("(s + f + y) % 5 <> 0"))
    return _cells(spark, decomp.cp_completion(known, 1, rounds=12, ridge=0.0).reconstruct())


@_query(f"WITH {_FULL} SELECT s, f, y, round(v, 3) + 0.0 AS v FROM d")
def decomp_hooi_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Tucker model of full ranks after two sweeps, multiplied out: the cube again."""
    back = decomp.tucker(cube(spark, sf_dir), (25, 3, 10), rounds=2).reconstruct()
    return from_numpy(spark, back, ("s", "f", "y")).dense().df.select("s", "f", "y", (F.round("v", 3) + 0.0).alias("v"))


@_query(f"WITH {_FULL} SELECT s, f, y, round(2 * v, 3) + 0.0 AS v FROM d")
def decomp_tensor_train_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of a tensor train with itself, rounded back and multiplied out: twice the cube."""
    cores = decomp.tt_svd(cube(spark, sf_dir), tolerance=1e-8)
    back = decomp.tt_reconstruct(decomp.tt_round(decomp.tt_add(cores, cores)))
    return from_numpy(spark, back, ("s", "f", "y")).dense().df.select("s", "f", "y", (F.round("v", 3) + 0.0).alias("v"))


@_query(f"WITH {_FULL} SELECT round(sqrt(sum(v * v)), 2) AS norm, round(sum(v * v), 0) AS dot FROM d")
def decomp_tensor_train_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = decomp.tt_svd(cube(spark, sf_dir), tolerance=1e-8)
    return spark.createDataFrame([(round(decomp.tt_norm(cores), 2), round(decomp.tt_dot(cores, cores), 0))], "norm double, dot double")


@_query(f"WITH {_NATIONS} SELECT i, j, 0.5 * v AS v FROM a")
def optim_sgd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of rate 0.5 on half the squared norm of the trade matrix."""
    x = nations(spark, sf_dir)
    return optim.sgd(0.5).step(x, x)[0].df


@_query(f"WITH {_NATIONS}, g AS (SELECT i, j, v, v / 100 AS g FROM a), x AS (SELECT i, j, v, g, v - 0.1 * g / (sqrt(g * g) + 1e-8) AS x1 FROM g) SELECT i, j, round(x1, 5) AS v FROM x")
def optim_adam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adam's first step, which is the gradient's sign times the rate."""
    x = nations(spark, sf_dir)
    return _rounded(optim.adam(0.1).step(x, x.with_df(x.df.withColumn("v", F.col("v") / 100)))[0], 5)


@_query(f"WITH {_NATIONS} SELECT i, j, round(v - 0.1 * v / (sqrt(v * v) + 1e-8), 5) AS v FROM a")
def optim_adagrad(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = nations(spark, sf_dir)
    return _rounded(optim.adagrad(0.1).step(x, x)[0], 5)


@_query(f"WITH {_NATIONS} SELECT i, j, round(v - 0.1 * v / (sqrt(0.01 * v * v) + 1e-8), 5) AS v FROM a")
def optim_rmsprop(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = nations(spark, sf_dir)
    return _rounded(optim.rmsprop(0.1).step(x, x)[0], 5)


@_query(f"WITH {_PARTS} SELECT p, s, v FROM p")
def source_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tensor written as Parquet and read again."""
    path = shared_folder(spark, "parquet")
    files.write_tensor(purchases(spark, sf_dir), path)
    return files.read_tensor(spark, path).df


@_query(f"WITH {_PARTS} SELECT p, s, v FROM p")
def source_matrix_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix written in coordinate format and read again."""
    path = shared_folder(spark, "matrix")
    files.write_matrix_market(purchases(spark, sf_dir), path)
    return files.read_matrix_market(spark, path).renamed(("p", "s")).df


@_query(f"WITH {_NATIONS}, x AS (SELECT i, j, v / 100000 AS v FROM a), r AS (SELECT i, sum(v) AS r FROM x GROUP BY i) SELECT x.i, j, round(2 * exp(2 * r) + 2 * v, 5) AS v FROM x JOIN r USING (i)")
def ad_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the sum over rows of exp(2 * row sum), plus the sum of squares: sums, functions and products recorded."""
    a = nations(spark, sf_dir)
    x = tape.leaf(a.with_df(a.df.withColumn("v", F.col("v") / 100000)))
    rows = tape.unary(tape.scale(tape.reduced(x, ["j"]), 2.0), "exp")
    total = tape.add(tape.einsum("i->", rows), tape.einsum("ij,ij->", x, x))
    return _rounded(tape.backward(total, x)[0], 5)


_BIPARTITE = f"""{_PARTS}, n AS (SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM supplier) AS suppliers),
    o AS (SELECT p AS i, parts + s AS j, v FROM p, n UNION ALL SELECT parts + s, p, v FROM p, n),
    r AS (SELECT unnest(range(parts + suppliers)) AS i FROM n),
    g AS (SELECT i, i AS j, coalesce(t, 0) + 1.0::DOUBLE AS v FROM r LEFT JOIN (SELECT i, sum(v) AS t FROM o GROUP BY i) USING (i)),
    a AS (SELECT i, j, v FROM o WHERE v <> 0 UNION ALL SELECT i, j, v FROM g)"""


def _bipartite(spark: SparkSession, sf_dir: str) -> Tensor:
    """Parts and suppliers as one symmetric matrix of their quantities, with the rows' sums and 1 on the diagonal."""
    p = purchases(spark, sf_dir)
    parts, n = p.shape[0], sum(p.shape)
    one = p.df.select(F.col("p").alias("i"), (F.col("s") + parts).alias("j"), "v")
    off = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    ones = spark.range(n).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    diagonal = off.select("i", "v").unionByName(ones).groupBy("i").agg(F.sum("v").alias("v")).select("i", F.col("i").alias("j"), "v")
    return Tensor(off.unionByName(diagonal).where("v <> 0"), ("i", "j"), (n, n))


@_query(f"WITH {_BIPARTITE} SELECT i, j, round(v, 4) AS v FROM a")
def linalg_ilu_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L U of the incomplete factorisation of all parts' and suppliers' quantities, on the matrix's own cells: the matrix."""
    a = _bipartite(spark, sf_dir)
    a = a.with_df(written(a.df, "matrix"))
    low, up = factorization.ilu0(a)  # on the cells of a
    return _rounded(sparse.triangles_product(low, up), 4)


@_query("SELECT i, CAST(i % 7 + 1 AS DOUBLE) AS v FROM (SELECT unnest(range((SELECT count(*) FROM part) + (SELECT count(*) FROM supplier))) AS i)")
def linalg_ic_cg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parts' and suppliers' matrix makes of a solution by conjugate gradients under IC(0): the right-hand side."""
    a = _bipartite(spark, sf_dir)
    a = a.with_df(written(a.df, "matrix"))
    b = Tensor(spark.range(a.shape[0]).select(F.col("id").alias("i"), (F.col("id") % 7 + 1.0).alias("v")), ("i",), a.shape[:1])
    return _rounded(strips.ic_cg(a, b, tolerance=1e-5)[1], 3)
