"""Written intermediates in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode without that setting, a temporary one.

    On a cluster a missing setting is an error: a machine-local folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="polyadic-"))
    return spark.sparkContext.getCheckpointDir()


def write_scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


#: Sides of a join are broadcast up to this many short rows (some 40 MB), and shuffled beyond.
BROADCAST_ROWS = 400_000


def small_side(df: DataFrame, label: str) -> DataFrame:
    """``df`` written, and broadcast in joins if it turns out to be small enough."""
    df = write_scratch(df, label)
    out = F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    out._scratch_path = df._scratch_path
    return out


#: Bytes of a batch of rows on its way to Python, where texts are long (Spark's default is 64 MB).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session gives rows to Python in batches of about BATCH_BYTES.

    A batch is held by the executor's JVM, outside its heap, and by the worker at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_scratch(*frames: DataFrame) -> None:
    """Delete written intermediates that nothing lazily depends on any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
