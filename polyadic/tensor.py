"""Tensors as DataFrames: one LONG column for each axis, a DOUBLE column ``v``, and a known shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tensor:
    """Cells of an n-dimensional array; a cell that has no row is 0."""

    df: DataFrame
    axes: tuple[str, ...]
    shape: tuple[int, ...]

    def __post_init__(self) -> None:
        if len(self.axes) != len(self.shape) or len(set(self.axes)) != len(self.axes) or "v" in self.axes:
            raise ValueError("axes and shape must match, and axis names be distinct and other than 'v'")

    def size_of(self, axis: str) -> int:
        return self.shape[self.axes.index(axis)]

    def others(self, *axes: str) -> tuple[str, ...]:
        for a in axes:
            self.axes.index(a)
        return tuple(a for a in self.axes if a not in axes)

    def with_df(self, df: DataFrame) -> Tensor:
        return replace(self, df=df.select(*self.axes, "v"))

    def renamed(self, names: Sequence[str]) -> Tensor:
        """The same cells under other axis names."""
        return Tensor(self.df.select(*(F.col(a).alias(n) for a, n in zip(self.axes, names, strict=True)), "v"), tuple(names), self.shape)

    def dense(self) -> Tensor:
        """Every cell as a row."""
        full = grid(self.df.sparkSession, self.axes, self.shape)
        return self.with_df(full.join(self.df, list(self.axes), "left").withColumn("v", F.coalesce("v", F.lit(0.0))))

    def to_numpy(self) -> np.ndarray:
        """The array on the driver; for small tensors."""
        out = np.zeros(self.shape)
        rows = self.df.toPandas()
        if len(rows):
            out[tuple(rows[a].to_numpy() for a in self.axes)] = rows["v"].to_numpy()
        return out


def grid(spark: SparkSession, axes: Sequence[str], shape: Sequence[int]) -> DataFrame:
    """A row for every index of a shape, by arithmetic on a range."""
    out, stride = spark.range(int(np.prod(shape, dtype=np.int64))), 1
    columns = []
    for axis, size in reversed(list(zip(axes, shape, strict=True))):
        columns.append((F.floor(F.col("id") / stride) % size).cast("long").alias(axis) if stride > 1 else (F.col("id") % size).alias(axis))
        stride *= size
    return out.select(*reversed(columns))


def from_table(df: DataFrame, axes: Mapping[str, Column], value: Column, shape: Sequence[int]) -> Tensor:
    """Sum ``value`` over a table by index expressions."""
    rows = df.select(*(c.cast("long").alias(a) for a, c in axes.items()), value.cast("double").alias("v"))
    return Tensor(rows.groupBy(*axes).agg(F.sum("v").alias("v")), tuple(axes), tuple(shape))


def from_numpy(spark: SparkSession, array: np.ndarray, axes: Sequence[str]) -> Tensor:
    """A small array's cells other than 0."""
    index = np.argwhere(array)
    rows = [(*map(int, i), float(array[tuple(i)])) for i in index]
    schema = ", ".join(f"{a} long" for a in axes) + ", v double"
    return Tensor(spark.createDataFrame(rows, schema), tuple(axes), tuple(map(int, array.shape)))


def positions(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """(key, position): 0-based places of the distinct values of ``key`` in their order.

    Values are sorted by range partitions; a place is the count of the partitions before plus the
    place within, so no task sees all values.
    """
    ordered = df.select(key).distinct().orderBy(key).select(key, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"))
    ordered = ordered.withColumn("__k", F.col("__m").bitwiseAND((1 << 33) - 1))
    counts = ordered.groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.join(F.broadcast(counts.select("__p", before.alias("__b"))), "__p").select(key, (F.col("__b") + F.col("__k")).cast("long").alias(name))
