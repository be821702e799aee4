"""Scans, orders and normalisation along lines of any length.

A line is cut into chunks by index arithmetic.  Each chunk is scanned on its own, the chunks' last
values form a shorter line that is scanned the same way, and what came before a chunk is added to
its cells, so no task holds a whole line.  Orders come from one range-partitioned sort of all cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyadic.iterate import cut
from polyadic.tensor import Tensor, grid

#: Cells of a line that one task takes; longer lines go by chunks.
CHUNK = 1 << 14
#: Rows of a side that is broadcast; the number of lines and chunks is known from the shape.
BROADCAST_ROWS = 200_000
#: Cells of a task that sorts or groups a known number.
TASK_CELLS = 1 << 20

_SCANS = {
    "sum": (F.sum, lambda a, b: a + b),
    "prod": (F.product, lambda a, b: a * b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: the session's number, more if a task had over TASK_CELLS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_CELLS))


def cells(t: Tensor, axes: Sequence[str]) -> int:
    """Cells of a line, or of a block of several axes."""
    return int(np.prod([t.size_of(a) for a in axes], dtype=np.int64))


def count(t: Tensor, *axes: str) -> int:
    """Lines along an axis, or blocks of several."""
    return cells(t, t.others(*axes))


def scan(t: Tensor, axis: str, op: str, chunk: int = CHUNK) -> Tensor:
    """Running sum, product, minimum or maximum of a tensor that has a row for every cell."""
    aggregate, combine = _SCANS[op]
    within = Window.partitionBy(*t.others(axis), "__c").orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    df = t.df.withColumn("__c", F.floor(F.col(axis) / chunk).cast("long")).withColumn("v", aggregate("v").over(within))
    if t.size_of(axis) <= chunk:
        return t.with_df(df)
    chunks = -(-t.size_of(axis) // chunk)
    ends = df.groupBy(*t.others(axis), "__c").agg(F.max_by("v", axis).alias("v"))
    shape = tuple(chunks if a == axis else s for a, s in zip(t.axes, t.shape, strict=True))
    carried = scan(Tensor(ends.withColumnRenamed("__c", axis).select(*t.axes, "v"), t.axes, shape), axis, op, chunk)
    before = carried.df.select(*t.others(axis), (F.col(axis) + 1).alias("__c"), F.col("v").alias("__b"))
    joined = df.join(_small(before, count(t, axis) * chunks), [*t.others(axis), "__c"], "left")
    return t.with_df(joined.withColumn("v", F.when(F.col("__b").isNull(), F.col("v")).otherwise(combine(F.col("__b"), F.col("v")))))


def places(df: DataFrame, order: Sequence[Column], name: str = "place", rows: int | None = None) -> DataFrame:
    """Rows with their 0-based place in an order that leaves no ties.

    If the number of ``rows`` is told, there are as many partitions as keep a task's rows few.

    The rows are sorted by range partitions and written, so that partitions and places in them stand
    fast; a place is the rows of the partitions before plus the place within.
    """
    ordered = df.orderBy(*order) if rows is None else df.repartitionByRange(tasks(df.sparkSession, rows), *order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ordered = cut(ordered)
    counts = ordered.groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ordered.join(F.broadcast(counts.select("__p", before.alias("__b"))), "__p")
    return out.withColumn(name, (F.col("__b") + F.col("__k")).cast("long")).drop("__p", "__k", "__b")


def ranked(t: Tensor, axis: str, descending: bool, name: str) -> DataFrame:
    """Every cell with its place along its line, ties by position; the tensor has a row for every cell.

    As every line has as many cells as the others, a place in the order of all cells tells the place in its line.
    """
    value = F.col("v").desc() if descending else F.col("v").asc()
    found = places(t.df, [*(F.col(a) for a in t.others(axis)), value, F.col(axis)], "__g", rows=cells(t, t.axes))
    return found.withColumn(name, F.col("__g") % t.size_of(axis)).drop("__g")


def differences(t: Tensor, axis: str, chunk: int | None = None) -> Tensor:
    """v[i + 1] - v[i], a row for each cell; cells without a row are 0.

    A chunk with the first cell of the next one is a group, and chunks are dealt to tasks of about
    TASK_CELLS cells, so that a task's rows do not grow with the line.
    """
    chunk = CHUNK if chunk is None else chunk
    keys, size, last = t.others(axis), t.size_of(axis), t.size_of(axis) - 2
    shape = tuple(s - (a == axis) for a, s in zip(t.axes, t.shape, strict=True))
    chunks = -(-(size - 1) // chunk)
    spark = t.df.sparkSession
    here = F.floor(F.col(axis) / chunk).cast("long")
    sent = t.df.select(*keys, F.col(axis), "v", here.alias("__c"))
    first = sent.where((F.col(axis) % chunk == 0) & (F.col(axis) > 0)).withColumn("__c", F.col("__c") - 1)
    # Chunks without any cell have rows, too.
    empty = grid(spark, (*keys, "__c"), (*(t.size_of(a) for a in keys), chunks)).select(*keys, F.lit(None).cast("long").alias(axis), F.lit(0.0).alias("v"), "__c")
    rows = sent.where(F.col("__c") < chunks).unionByName(first).unionByName(empty).repartition(tasks(spark, cells(t, t.axes)), *keys, "__c")
    fields = [*keys, axis]

    def between(key: tuple, rows: pa.Table) -> pa.Table:
        *line, c = (k.as_py() for k in key)
        low, width = c * chunk, min(chunk, last + 1 - c * chunk)
        x = np.zeros(chunk + 1)
        there = rows.filter(rows[axis].is_valid())
        np.add.at(x, there[axis].to_numpy() - low, there["v"].to_numpy())
        columns = {a: np.full(width, k, dtype=np.int64) for a, k in zip(keys, line, strict=True)}
        return pa.table({**columns, axis: np.arange(low, low + width), "v": np.diff(x)[:width]})

    out = rows.groupBy(*keys, "__c").applyInArrow(between, ", ".join(f"{a} long" for a in fields) + ", v double")
    return Tensor(out.select(*t.axes, "v"), t.axes, shape)


def with_totals(df: DataFrame, by: Sequence[str], lines: int, **totals: Column) -> DataFrame:
    """Cells with aggregates of their lines: partial sums where the cells are, then a join with a row for each line."""
    on = list(by)
    if not on:
        df, on = df.withColumn("__all", F.lit(0)), ["__all"]
    sums = df.groupBy(*on).agg(*(c.alias(n) for n, c in totals.items()))
    return df.join(_small(sums, lines), on)
