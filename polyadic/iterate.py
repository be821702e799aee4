"""Cutting lineage between the rounds of iterative algorithms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str = "") -> str:
    """The checkpoint folder that driver and executors share, or with ``label`` a new path in it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="polyadic-"))
    return f"{context.getCheckpointDir()}/{label}-{uuid.uuid4().hex}" if label else context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet: smaller and faster to read than by ``cut``, for what many rounds read."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def unwritten(*frames: DataFrame) -> None:
    """Deletes what ``written`` wrote and nothing depends on any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Cells of a vector that is broadcast to a matrix' cells (some 40 bytes each); longer ones are shuffled with these.
VECTOR_CELLS = 1 << 21


def looked_up(vector: DataFrame, cells: int) -> DataFrame:
    """A vector of at most ``cells`` rows as the side of a join that is held in a table, so that the other side is not sorted."""
    return F.broadcast(vector) if cells <= VECTOR_CELLS else vector.hint("shuffle_hash")
