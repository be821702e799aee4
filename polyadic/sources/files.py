"""Tensors in files: Parquet, binary, Arrow IPC and Matrix Market."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyadic.tensor import Tensor


def write_tensor(t: Tensor, path: str, partition_by: str | None = None) -> None:
    """Cells as Parquet (by one axis's values if wanted), axes and shape beside them."""
    spark = t.df.sparkSession
    writer = t.df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/cells")
    spark.createDataFrame([(k, a, s) for k, (a, s) in enumerate(zip(t.axes, t.shape, strict=True))], "k int, axis string, size long").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def read_tensor(spark: SparkSession, path: str) -> Tensor:
    meta = spark.read.parquet(f"{path}/shape").orderBy("k").collect()  # a row for each axis
    axes = tuple(r["axis"] for r in meta)
    cells = spark.read.parquet(f"{path}/cells").select(*(F.col(a).cast("long").alias(a) for a in axes), "v")
    return Tensor(cells, axes, tuple(r["size"] for r in meta))


def to_bytes(array: np.ndarray, magic: bytes) -> bytes:
    """Four magic bytes, version 1, rank, padding, 64-bit sizes and doubles, little-endian."""
    return magic + struct.pack("<III", 1, array.ndim, 0) + struct.pack(f"<{array.ndim}Q", *array.shape) + np.ascontiguousarray(array, "<f8").tobytes()


def read_binary(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """(path, position, v) for every cell of the binary files under ``path``, with (path, shape) as ``shape``.

    Positions are row-major.  A file is one task's work.
    """

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                if raw[:4] != magic:
                    raise ValueError(f"{name} is no tensor file")
                version, rank, _ = struct.unpack_from("<III", raw, 4)
                if version != 1:
                    raise ValueError(f"{name} has version {version}")
                shape = struct.unpack_from(f"<{rank}Q", raw, 16)
                data = np.frombuffer(raw, "<f8", count=int(np.prod(shape)), offset=16 + 8 * rank)
                for at in range(0, len(data), 100_000):
                    part = data[at : at + 100_000]
                    yield pd.DataFrame({"path": name, "position": np.arange(at, at + len(part)), "shape": [list(shape)] * len(part), "v": part})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cells, "path string, position long, shape array<long>, v double")


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, v, info) of Arrow IPC files with columns ``data`` and ``shape_info``, all batches."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                at = 0
                with pa.ipc.open_file(pa.py_buffer(raw)) as f:
                    for k in range(f.num_record_batches):
                        b = f.get_batch(k).to_pandas()
                        yield pd.DataFrame({"path": name, "position": np.arange(at, at + len(b)), "v": b["data"], "info": b["shape_info"]})
                        at += len(b)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cells, "path string, position long, v double, info long")


def read_matrix_market(spark: SparkSession, path: str) -> Tensor:
    """A coordinate matrix: real, integer or pattern; general, symmetric or skew-symmetric."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k")).where("line <> ''")
    head = lines.where("line like '\\%\\%MatrixMarket%'").first()["line"].lower().split()
    if head[1:3] != ["matrix", "coordinate"] or head[3] not in ("real", "integer", "pattern"):
        raise ValueError(f"can't read {' '.join(head)}")
    body = lines.where(~F.col("line").startswith("%"))
    first = body.orderBy("file", "block", "k").first()
    rows, columns = map(int, first["line"].split()[:2])
    parts = F.split("line", r"\s+")
    cells = body.where((F.col("file") != first["file"]) | (F.col("k") != first["k"])).select((parts[0].cast("long") - 1).alias("i"), (parts[1].cast("long") - 1).alias("j"), (F.lit(1.0) if head[3] == "pattern" else parts[2].cast("double")).alias("v"))
    if head[4] != "general":
        sign = -1.0 if head[4] == "skew-symmetric" else 1.0
        cells = cells.unionByName(cells.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v")))
    return Tensor(cells.groupBy("i", "j").agg(F.sum("v").alias("v")), ("i", "j"), (rows, columns))


def write_matrix_market(t: Tensor, path: str) -> None:
    """A general real coordinate matrix; header and cells are parts of one folder, the header's first by name."""
    n = t.df.count()
    i, j = t.axes
    cells = t.df.orderBy(i, j).select(F.concat_ws(" ", F.col(i) + 1, F.col(j) + 1, F.col("v")).alias("line"))
    head = t.df.sparkSession.createDataFrame([(f"%%MatrixMarket matrix coordinate real general\n{t.shape[0]} {t.shape[1]} {n}",)], "line string").coalesce(1)
    head.union(cells).write.mode("overwrite").text(path)
