"""Queries over all line items as one vector and as a graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyadic.iterate import cut, looked_up, written
from polyadic.operators import lines, reordering, windows
from polyadic.queries import _query, _read, sales_graph
from polyadic.tensor import Tensor


def item_vector(spark: SparkSession, sf_dir: str, column: str) -> Tensor:
    """x[i]: a column of lineitem in the order of orders and their lines; lines that repeat a number follow by value."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col(column).cast("double").alias("v"))
    n = rows.count()
    return Tensor(lines.places(rows, [F.col("l_orderkey"), F.col("l_linenumber"), F.col("v")], "i", rows=n).select("i", "v"), ("i",), (n,))


def _items(column: str) -> str:
    return f"x AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, {column}) - 1 AS i, {column}::DOUBLE AS v FROM lineitem)"


@_query(f"WITH {_items('l_quantity')} SELECT i, sum(v) OVER (ORDER BY i) AS v FROM x")
def vector_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running quantity over all line items."""
    return windows.cumulative(item_vector(spark, sf_dir, "l_quantity"), "i").df


@_query(f"WITH {_items('l_extendedprice')} SELECT i, max(v) OVER (ORDER BY i) AS v FROM x")
def vector_cummax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest price up to each line item."""
    return windows.cumulative(item_vector(spark, sf_dir, "l_extendedprice"), "i", "max").df


@_query(f"WITH {_items('l_quantity')} SELECT i, v FROM (SELECT i, lead(v) OVER (ORDER BY i) - v AS v FROM x) WHERE v IS NOT NULL")
def vector_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of quantity from each line item to the next."""
    return windows.diff(item_vector(spark, sf_dir, "l_quantity"), "i").df


@_query(f"WITH {_items('l_extendedprice')} SELECT row_number() OVER (ORDER BY v DESC, i) - 1 AS i, v FROM x")
def vector_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prices in descending order."""
    return windows.sort(item_vector(spark, sf_dir, "l_extendedprice"), "i", descending=True).df


@_query(f"WITH {_items('l_quantity')} SELECT row_number() OVER (ORDER BY v, i) - 1 AS i, i::DOUBLE AS v FROM x")
def vector_argsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line item stands by quantity; many tie, and go by position."""
    return windows.sort(item_vector(spark, sf_dir, "l_quantity"), "i", positions=True).df


@_query(f"WITH {_items('l_quantity')} SELECT i, round(v - (SELECT max(v) FROM x) - ln((SELECT sum(exp(w.v - m)) FROM x w, (SELECT max(v) AS m FROM x))), 7) AS v FROM x")
def vector_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of the softmax over all line items' quantities."""
    return windows.softmax(item_vector(spark, sf_dir, "l_quantity"), "i", log=True).df.select("i", F.round("v", 7).alias("v"))


@_query(f"WITH {_items('l_quantity')}, s AS (SELECT avg(v) AS a, var_pop(v) AS q FROM x) SELECT i, round((v - a) / sqrt(q + 1e-5), 7) + 0.0 AS v FROM x, s")
def vector_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quantities with zero mean and unit variance."""
    return windows.normalise(item_vector(spark, sf_dir, "l_quantity"), ["i"]).df.select("i", (F.round("v", 7) + 0.0).alias("v"))


@_query("""WITH g AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT src AS id FROM g UNION SELECT dst FROM g)
SELECT (SELECT count(*) FROM n) AS vertices, (SELECT count(*) FROM n) AS places, 0::BIGINT AS first, (SELECT count(*) - 1 FROM n) AS last, (SELECT count(*) FROM g) AS edges, TRUE AS narrower""")
def reorder_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of customers and suppliers in reverse Cuthill-McKee order: a permutation that loses no edge and narrows the band."""
    edges = written(sales_graph(spark, sf_dir).select("src", "dst").distinct(), "sales")
    order = cut(reordering.reverse_cuthill_mckee(edges))
    rows = order.count()
    at = lambda end, name: looked_up(order.select(F.col("id").alias(end), F.col("place").alias(name)), rows)
    both = edges.join(at("src", "s"), "src").join(at("dst", "t"), "dst")
    width = both.agg(F.count("*").alias("edges"), (F.max(F.abs(F.col("s") - F.col("t"))) < F.max(F.abs(F.col("src") - F.col("dst")))).alias("narrower"))
    row = order.agg(F.countDistinct("id").alias("vertices"), F.countDistinct("place").alias("places"), F.min("place").alias("first"), F.max("place").alias("last"))
    key = F.lit(0).alias("__k")
    return row.select("*", key).join(F.broadcast(width.select("*", key)), "__k").drop("__k")  # a row each
