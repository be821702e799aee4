"""Incomplete factorisations and triangular solves of sparse matrices, by wavefronts over level sets.

A row's level is one more than the highest level of the rows that it needs, so that all rows of a
level are worked on at once; a job runs for each level.  Matrices are written once, divided by level,
so that a level reads its own rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyadic.iterate import cut, looked_up, shared_folder, written
from polyadic.operators.krylov import Preconditioner
from polyadic.tensor import Tensor


def level_sets(needs: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
    """(i, level) for all ``rows`` (i), where ``needs`` (i, j) says which row needs which other; and the number of levels.

    Raises ValueError if rows need one another in a circle.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "levels")
    left = needs.select("i", "j")
    waiting = written(left.select("i").distinct(), "waiting")
    many, count = waiting.count(), 0
    ready = rows.select("i").join(looked_up(waiting, many), "i", "left_anti")
    while True:
        ready.select("i").write.parquet(f"{folder}/level={count}")
        count += 1
        if not many:
            break
        # A row still waits if one that it needs waited in this round, so was not ready; the fewer of both are looked up.
        now = spark.read.schema("i long").parquet(f"{folder}/level={count - 1}")
        done = now.count()
        side, how = (now, "left_anti") if done < many else (waiting, "left_semi")
        left = written(left.join(looked_up(side.select(F.col("i").alias("j")), min(done, many)), "j", how).select("i", "j"), "left")
        still = written(left.select("i").distinct(), "waiting")
        before, many = many, still.count()
        if many == before:
            raise ValueError("rows need one another in a circle")
        ready, waiting = waiting.join(looked_up(still, many), "i", "left_anti"), still
    return spark.read.schema("i long, level int").parquet(folder), count


def _by_level(cells: DataFrame, level: DataFrame, count: int, folder: str) -> None:
    """Rows (i, ...) written to a folder for each level; rows of the first one are not looked up, nor two levels sorted."""
    later = level.where("level > 0")
    later = looked_up(later, later.count())
    if count <= 2:
        for k, how in enumerate(("left_anti", "left_semi")[:count]):
            cells.join(later, "i", how).write.parquet(f"{folder}/level={k}")
        return
    found = cells.join(later, "i", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    found.sortWithinPartitions("level", "i").write.partitionBy("level").parquet(folder)


@dataclass(frozen=True)
class Triangle:
    """A triangular matrix by levels: rows (i, j, v) in a folder for each, without the diagonal, and that as (i, d)."""

    folder: str
    levels: int
    n: int

    def rows(self, df: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        spark = df.sparkSession
        return spark.read.schema("i long, j long, v double").parquet(f"{self.folder}/off/level={level}"), spark.read.schema("i long, d double").parquet(f"{self.folder}/diagonal/level={level}")


def triangle(a: Tensor, lower: bool = True, unit: bool = False) -> Triangle:
    """One triangle of a square matrix, ready for solves; ``unit`` takes a diagonal of ones.

    A diagonal cell that is missing or 0 raises ZeroDivisionError.
    """
    i, j = a.axes
    n = a.shape[0]
    spark = a.df.sparkSession
    cells = written(a.df.select(F.col(i).alias("i"), F.col(j).alias("j"), "v").where(("i >= j" if lower else "i <= j")), "cells")
    rows = spark.range(n).select(F.col("id").alias("i"))
    if unit:
        diagonal = rows.withColumn("d", F.lit(1.0))
    else:
        diagonal = cut(cells.where("i = j and v <> 0").select("i", F.col("v").alias("d")))
        if diagonal.count() < n:
            raise ZeroDivisionError("a diagonal cell is 0")
    off = cells.where("i <> j and v <> 0")
    level, count = level_sets(off, rows)
    folder = shared_folder(spark, "triangle")
    for name, part in (("off", off), ("diagonal", diagonal)):
        _by_level(part.repartition("i").sortWithinPartitions("i"), level, count, f"{folder}/{name}")
    # The first level has no cells off the diagonal, but a folder, too.
    off.limit(0).select("i", "j", "v").write.mode("append").parquet(f"{folder}/off/level=0")
    return Triangle(folder, count, n)


def solve(t: Triangle, b: Tensor) -> Tensor:
    """x with T x = b, a level at a time."""
    b = Tensor(cut(b.renamed(("i",)).df), ("i",), b.shape)
    spark = b.df.sparkSession
    folder = shared_folder(spark, "solved")
    for level in range(t.levels):
        off, diagonal = t.rows(b.df, level)
        right = diagonal.join(b.df, "i", "left").select("i", "d", F.coalesce("v", F.lit(0.0)).alias("b"))
        if level:
            known = spark.read.schema("i long, v double").parquet(*(f"{folder}/level={k}" for k in range(level)))
            sums = off.join(looked_up(known.select(F.col("i").alias("j"), F.col("v").alias("x")), t.n), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
            right = right.join(sums, "i", "left").select("i", "d", (F.col("b") - F.coalesce("s", F.lit(0.0))).alias("b"))
        right.select("i", (F.col("b") / F.col("d")).alias("v")).where("v <> 0").write.parquet(f"{folder}/level={level}")
    return Tensor(spark.read.schema("i long, v double").parquet(*(f"{folder}/level={k}" for k in range(t.levels))), ("i",), (t.n,))


def _needed(rows: DataFrame, done: DataFrame) -> DataFrame:
    """(row, k, column, u): the cells of finished rows k that change a cell of ``rows`` or divide one.

    Pivots and what changes a row's own diagonal are as many as the rows' cells left of it.  Of the
    rest only columns are looked at that some of the rows have beside the diagonal, and of these only
    cells go on whose place the row has.
    """
    left = rows.where("j < i").select(F.col("i").alias("row"), F.col("j").alias("k"))
    upper = done.select(F.col("i").alias("k"), F.col("j").alias("column"), F.col("v").alias("u"))
    # Both are one join each: a pivot's column is k, and a diagonal's column is the row.
    pivots = left.join(upper.where("column = k"), "k")
    own = left.join(upper.where("column > k").withColumnRenamed("column", "row"), ["k", "row"]).withColumn("column", F.col("row"))
    beside = rows.where("i <> j").select(F.col("i").alias("row"), F.col("j").alias("column"))
    shared = upper.where("column > k").join(beside.select("column").distinct(), "column", "left_semi")
    rest = left.join(shared, "k").where("column <> row").join(beside, ["row", "column"], "left_semi")
    return pivots.select("row", "k", "column", "u").unionByName(own.select("row", "k", "column", "u")).unionByName(rest.select("row", "k", "column", "u"))


def _meet(rows: DataFrame, done: DataFrame) -> bool:
    """Whether eliminating may change a cell of ``rows`` beside the diagonal: if one is in a column of a finished row's upper cell."""
    columns = written(done.where("j > i").select("j").distinct(), "columns")
    return not rows.where("i <> j").join(looked_up(columns, columns.count()), "j", "left_semi").isEmpty()


def _eliminated(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``rows`` (i, j, v) after elimination with finished ones, where it changes only cells left of and on the diagonal.

    What is left of it meets its pivot and its mirror in that pivot's row in one shuffle by the pivot.
    """
    left = rows.where("j < i").select(F.col("j").alias("k"), F.col("i").alias("x"), F.col("v").alias("low"), F.lit(None).cast("double").alias("up"))
    upper = done.select(F.col("i").alias("k"), F.col("j").alias("x"), F.lit(None).cast("double").alias("low"), F.col("v").alias("up"))
    both = left.unionByName(upper).repartition("k").groupBy("k", "x").agg(F.max("low").alias("low"), F.max("up").alias("up"))
    pivot = F.max(F.when(F.col("x") == F.col("k"), F.col("up"))).over(Window.partitionBy("k"))
    both = both.withColumn("low", F.col("low") / pivot).where("low is not null")
    taken = both.where("up is not null").select(F.col("x").alias("i"), (-F.col("low") * F.col("up")).alias("v"))
    diagonal = rows.where("i = j").select("i", "v").unionByName(taken).groupBy("i").agg(F.sum("v").alias("v"))
    return both.select(F.col("x").alias("i"), F.col("k").alias("j"), F.col("low").alias("v")).unionByName(diagonal.select("i", F.col("i").alias("j"), "v")).unionByName(rows.where("j > i").select("i", "j", "v"))


def ilu0(a: Tensor) -> tuple[Tensor, Tensor]:
    """L (with a diagonal of ones) and U with L U = A on the cells that A has.

    Each level eliminates its rows at once, with the finished rows of the levels before: by the pivots'
    rows where only the diagonal can change, else a row and the rows that it needs are one group.
    A pivot that is missing or becomes 0 raises ZeroDivisionError.  ``a`` is read three times, so a
    written one is best.
    """
    names, n = a.axes, a.shape[0]
    spark = a.df.sparkSession
    cells = a.df.select(F.col(names[0]).alias("i"), F.col(names[1]).alias("j"), "v")
    if cells.where("i = j and v <> 0").count() < n:
        raise ZeroDivisionError("a diagonal cell is 0")
    level, count = level_sets(cells.where("j < i"), spark.range(n).select(F.col("id").alias("i")))
    source, folder = shared_folder(spark, "rows"), shared_folder(spark, "lu")
    _by_level(cells, level, count, source)

    def eliminate(row: pa.Table, others: pa.Table) -> pa.Table:
        i = row["i"][0].as_py()
        values = dict(zip(row["j"].to_pylist(), row["v"].to_pylist()))
        upper: dict[int, list[tuple[int, float]]] = {}
        for k, j, v in zip(others["k"].to_pylist(), others["column"].to_pylist(), others["u"].to_pylist()):
            upper.setdefault(k, []).append((j, v))
        for k in sorted(c for c in values if c < i):
            cells = upper[k]
            values[k] /= dict(cells)[k]
            for j, v in cells:
                if j > k and j in values:
                    values[j] -= values[k] * v
        if not values[i] or not np.isfinite(values[i]):
            raise ZeroDivisionError(f"the pivot of row {i} is {values[i]}")
        return pa.table({"i": pa.array([i] * len(values), pa.int64()), "j": pa.array(list(values), pa.int64()), "v": pa.array(list(values.values()), pa.float64())})

    # The first level's rows are finished as they are.
    folders = [f"{source}/level=0"]
    for k in range(1, count):
        rows = spark.read.schema("i long, j long, v double").parquet(f"{source}/level={k}")
        done = spark.read.schema("i long, j long, v double").parquet(*folders).where("j >= i")
        if k > 1:
            pivots = written(rows.where("j < i").select(F.col("j").alias("i")).distinct(), "pivots")
            done = done.join(looked_up(pivots, pivots.count()), "i", "left_semi")
        if _meet(rows, done):
            needed = _needed(rows, done)
            rows = rows.groupBy("i").cogroup(needed.groupBy("row")).applyInArrow(eliminate, "i long, j long, v double")
        else:
            rows = _eliminated(rows, done)
        folders.append(f"{folder}/level={k}")
        rows.write.parquet(folders[-1])
        if bad := spark.read.schema("i long, j long, v double").parquet(folders[-1]).where("i = j and not coalesce(v <> 0 and abs(v) < double('inf'), false)").head(1):
            raise ZeroDivisionError(f"the pivot of row {bad[0]['i']} is {bad[0]['v']}")
    out = spark.read.schema("i long, j long, v double").parquet(*folders)
    one = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    low, up = out.where("j < i").unionByName(one), out.where("j >= i")
    return tuple(Tensor(df.select(F.col("i").alias(names[0]), F.col("j").alias(names[1]), "v"), names, a.shape) for df in (low, up))


def ic0(a: Tensor) -> Tensor:
    """The lower triangle L with L L' = A on the cells of a symmetric positive definite matrix.

    A pivot that is not positive raises ZeroDivisionError; L L' only looks at one triangle of A.
    """
    low, up = ilu0(a)
    i, j = a.axes
    roots = cut(up.df.where(F.col(i) == F.col(j)).select(F.col(i).alias(j), F.col("v").alias("d")))
    if not roots.where("d <= 0").isEmpty():
        raise ZeroDivisionError("a pivot is not positive: the matrix is not positive definite")
    cells = low.df.join(looked_up(roots, a.shape[0]), j).select(i, j, (F.col("v") * F.sqrt("d")).alias("v"))
    return Tensor(written(cells, "root"), (i, j), a.shape)


def _transposed(a: Tensor) -> Tensor:
    i, j = a.axes
    return Tensor(a.df.select(F.col(j).alias(i), F.col(i).alias(j), "v"), a.axes, a.shape[::-1])


def ilu_preconditioner(a: Tensor) -> Preconditioner:
    """Solves with ILU(0) of ``a``."""
    low, up = ilu0(a)
    first, second = triangle(low, lower=True, unit=True), triangle(up, lower=False)
    return lambda r: solve(second, solve(first, r))


def ic_preconditioner(a: Tensor) -> Preconditioner:
    """Solves with IC(0) of a symmetric positive definite matrix."""
    low = ic0(a)
    first, second = triangle(low, lower=True), triangle(_transposed(low), lower=False)
    return lambda r: solve(second, solve(first, r))


def ssor_preconditioner(a: Tensor, omega: float = 1.0) -> Preconditioner:
    """Symmetric successive over-relaxation: (D + w L) D^-1 (D + w U) / (w (2 - w)), with the triangles of ``a`` itself."""
    if not 0 < omega < 2:
        raise ValueError("omega must be between 0 and 2")
    i, j = a.axes
    weighed = a.with_df(a.df.withColumn("v", F.when(F.col(i) == F.col(j), F.col("v")).otherwise(F.col("v") * omega)))
    first, second = triangle(weighed, lower=True), triangle(weighed, lower=False)
    diagonal = cut(a.df.where(F.col(i) == F.col(j)).select(F.col(i).alias("i"), F.col("v").alias("d")))

    def apply(r: Tensor) -> Tensor:
        y = solve(first, r)
        y = Tensor(y.df.join(diagonal, "i").select("i", (F.col("v") * F.col("d") * (omega * (2 - omega))).alias("v")), ("i",), y.shape)
        return solve(second, y)

    return apply
