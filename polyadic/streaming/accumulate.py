"""Tensors that grow with a stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_tensor(stream: DataFrame, axes: Mapping[str, Column], value: Column) -> DataFrame:
    """Sums of ``value`` by index over all that has arrived; write it in update or complete mode."""
    rows = stream.select(*(c.cast("long").alias(a) for a, c in axes.items()), value.cast("double").alias("v"))
    return rows.groupBy(*axes).agg(F.sum("v").alias("v"))


def windowed_tensor(stream: DataFrame, time: str, length: str, late: str, axes: Mapping[str, Column], value: Column) -> DataFrame:
    """Sums by index and tumbling window (its start in ``start``); rows later than ``late`` are left out.

    In append mode a window is written once, when the watermark has passed it.
    """
    rows = stream.withWatermark(time, late).select(F.window(time, length).alias("w"), *(c.cast("long").alias(a) for a, c in axes.items()), value.cast("double").alias("v"))
    return rows.groupBy("w", *axes).agg(F.sum("v").alias("v")).select(F.col("w.start").alias("start"), *axes, "v")
