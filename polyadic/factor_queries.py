"""Queries of CP models with distributed factors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyadic.operators import factors
from polyadic.queries import _query, _read
from polyadic.tensor import Tensor, from_table


def sales_cube(spark: SparkSession, sf_dir: str) -> Tensor:
    """x[p, s, y]: quantity by part, supplier and ship year."""
    parts, suppliers = _read(spark, sf_dir, "part").count(), _read(spark, sf_dir, "supplier").count()
    return from_table(_read(spark, sf_dir, "lineitem"), {"p": F.col("l_partkey"), "s": F.col("l_suppkey"), "y": F.year("l_shipdate") - 1992}, F.col("l_quantity"), (parts, suppliers, 10))


def _start(mode: int, count: str) -> str:
    a, b = (f"0.25 + ((i * 7919 + {(r + 1) * 104729 * (mode + 1)}) % 1009)::DOUBLE / 1009.0" for r in (0, 1))
    return f"SELECT i, {a} AS a, {b} AS b FROM (SELECT unnest(range(0, {count})) AS i)"


def _solved(name: str, axis: str, others: tuple[tuple[str, str], tuple[str, str]], extra: str = "") -> str:
    """SQL of one mode's rows: its products with two other factors times the inverse of their 2 x 2 matrix."""
    (u, at), (w, to) = others
    return f"""
m_{name} AS (SELECT x.{axis} AS i, sum(v * k.a * l.a) AS ma, sum(v * k.b * l.b) AS mb FROM x JOIN {u} k ON k.i = x.{at} JOIN {w} l ON l.i = x.{to} GROUP BY 1),
g_{name} AS (SELECT k.aa * l.aa AS aa, k.ab * l.ab AS ab, k.bb * l.bb AS bb FROM (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM {u}) k, (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM {w}) l),
{name} AS (SELECT i, (ma * bb - mb * ab) / (aa * bb - ab * ab) AS a, (mb * aa - ma * ab) / (aa * bb - ab * ab) AS b FROM m_{name}, g_{name})"""


_SWEEP = f"""WITH x AS (SELECT l_partkey AS p, l_suppkey AS s, year(l_shipdate) - 1992 AS y, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL),
s1 AS ({_start(1, "(SELECT count(*) FROM supplier)")}),
s2 AS ({_start(2, "10")}),
{_solved("u0", "p", (("s1", "s"), ("s2", "y")))},{_solved("u1", "s", (("u0", "p"), ("s2", "y")))},{_solved("u2", "y", (("u0", "p"), ("u1", "s")))},
f AS (SELECT 0::BIGINT AS mode, * FROM u0 UNION ALL SELECT 1, * FROM u1 UNION ALL SELECT 2, * FROM u2)"""


@_query(f"{_SWEEP} SELECT mode, i, 0::BIGINT AS r, round(a, 5) + 0.0 AS v FROM f UNION ALL SELECT mode, i, 1, round(b, 5) + 0.0 FROM f")
def decomp_cp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factor rows of parts, suppliers and years after one sweep of a CP model of rank 2."""
    model = factors.cp_als_frames(sales_cube(spark, sf_dir), 2, rounds=1)
    return factors.as_cells(model.factors).select("mode", "i", "r", (F.round("v", 5) + 0.0).alias("v"))


@_query(f"""{_SWEEP}, c AS (SELECT x.y, v, k.a * l.a * m.a + k.b * l.b * m.b AS model FROM x JOIN u0 k ON k.i = p JOIN u1 l ON l.i = s JOIN u2 m ON m.i = x.y)
SELECT y, count(*) AS n, round(sum((v - model) * (v - model)), 3) AS error FROM c GROUP BY y""")
def decomp_cp_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's squared error of that model over all stored cells."""
    x = sales_cube(spark, sf_dir)
    model = factors.cp_als_frames(x, 2, rounds=1)
    cells = factors.cp_cells(x.df, x.axes, model.factors)
    return cells.groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum((F.col("v") - F.col("model")) ** 2), 3).alias("error"))
