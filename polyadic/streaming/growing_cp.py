"""CP models of tensors that grow along one mode, kept up to date batch by batch.

After the online CP of Zhou et al. (2016): a batch's new rows of the growing factor are solved for
with the other factors as they are; then each other factor is solved for again from sums over all
batches, to which the batch adds its own part.  So a batch costs what its cells cost, however much
came before.  Factors and sums are frames in a shared folder, and a batch counts once: it is
committed by a marker written last, and a batch that is committed already changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polyadic.operators.factors import CPFrames, _summed, _times, cp_als_frames, gram, mttkrp_rows, start_frame
from polyadic.tensor import Tensor

_ROWS = "i long, u array<double>, m array<double>"


@dataclass
class GrowingCP:
    """A CP model over ``axes``, of which ``grows`` gets new indices with each batch.

    ``shape`` bounds the indices.  The first batch is fitted by at most ``rounds`` rounds of
    alternating least squares from ``start_frame``'s numbers (or from ``start``).
    """

    spark: SparkSession
    folder: str
    axes: Sequence[str]
    shape: Sequence[int]
    rank: int
    grows: str
    rounds: int = 20
    seed: int = 0
    start: Sequence[DataFrame] | None = None

    @property
    def _mode(self) -> int:
        return list(self.axes).index(self.grows)

    @property
    def _fixed(self) -> list[int]:
        return [k for k in range(len(self.axes)) if k != self._mode]

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self) -> list[int]:
        """Identifiers of the batches that count, in order."""
        fs, path = self._path("committed")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, batch: int, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/batch-{batch}/{name}")

    def _write(self, df: DataFrame, batch: int, name: str, schema: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}/{name}")
        return self._read(batch, name, schema)

    @property
    def _cell_schema(self) -> str:
        return ", ".join(f"{a} long" for a in self.axes) + ", v double"

    def factors(self) -> list[DataFrame]:
        """The factors after all committed batches, as frames (i, u)."""
        done = self.committed()
        if not done:
            raise ValueError("no batch has been committed")
        grown = reduce(DataFrame.unionByName, (self._read(b, "grown", "i long, u array<double>") for b in done))
        return [grown if k == self._mode else self._read(done[-1], f"mode-{k}", _ROWS).select("i", "u") for k in range(len(self.axes))]

    def cells(self) -> Tensor:
        """All cells of the committed batches."""
        parts = [self._read(b, "cells", self._cell_schema) for b in self.committed()]
        df = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self._cell_schema)
        return Tensor(df, tuple(self.axes), tuple(self.shape))

    def refined(self, rounds: int = 50, tolerance: float = 1e-9) -> CPFrames:
        """A model of all cells so far, by full rounds that start from the current factors; the kept state stays as it is."""
        return cp_als_frames(self.cells(), self.rank, rounds, tolerance, start=self.factors())

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch of cells (the axes and ``v``); repeated cells add up.  For ``foreachBatch``.

        An empty batch changes nothing.  A batch with an index of the growing mode that an earlier
        batch had raises ValueError and is not committed, as the sums cannot take its row back.
        """
        done = self.committed()
        if done and batch_id <= done[-1]:
            return
        rows = batch.groupBy(*(F.col(a).cast("long").alias(a) for a in self.axes)).agg(F.sum(F.col("v").cast("double")).alias("v"))
        x = Tensor(self._write(rows, batch_id, "cells", self._cell_schema), tuple(self.axes), tuple(self.shape))
        if x.df.isEmpty():
            return
        mode = self._mode
        if not done:
            start = self.start or [start_frame(self.spark, n, self.rank, k, self.seed) for k, n in enumerate(self.shape)]
            factors = list(cp_als_frames(x, self.rank, self.rounds, start=start).factors)
            sums, squares = {}, {k: np.zeros((self.rank, self.rank)) for k in self._fixed}
        else:
            factors = self.factors()
            late = x.df.select(F.col(self.grows).alias("i")).join(factors[mode].select("i"), "i", "left_semi").first()
            if late is not None:
                raise ValueError(f"{self.grows} = {late['i']} came with an earlier batch")
            sums = {k: self._read(done[-1], f"mode-{k}", _ROWS) for k in self._fixed}
            small = self._read(done[-1], "squares", "mode int, q array<double>").collect()  # a row for each mode
            squares = {r["mode"]: np.array(r["q"]).reshape(self.rank, self.rank) for r in small}
        grams = {k: gram(factors[k], self.rank) for k in self._fixed}
        solve = lambda frame, g: frame.withColumn("u", _times(F.col("m"), np.linalg.pinv(g, rcond=1e-13, hermitian=True)))
        new = solve(mttkrp_rows(x, factors, mode, self.rank), np.prod(list(grams.values()), axis=0))
        factors[mode] = self._write(new.select("i", "u"), batch_id, "grown", "i long, u array<double>")
        added = gram(factors[mode], self.rank)
        for k in self._fixed:
            part = mttkrp_rows(x, factors, k, self.rank)
            if k in sums:
                both = sums[k].select("i", "m").unionByName(part)
                part = both.groupBy("i").agg(_summed([F.get("m", F.lit(r)) for r in range(self.rank)]).alias("m"))
            squares[k] = squares[k] + added * np.prod([g for j, g in grams.items() if j != k], axis=0)
            factors[k] = self._write(solve(part, squares[k]).select("i", "u", "m"), batch_id, f"mode-{k}", _ROWS).select("i", "u")
            grams[k] = gram(factors[k], self.rank)
        small = self.spark.createDataFrame([(k, q.ravel().tolist()) for k, q in squares.items()], "mode int, q array<double>")
        self._write(small, batch_id, "squares", "mode int, q array<double>")
        fs, path = self._path(f"committed/{batch_id}")
        fs.create(path, False).close()
        for old in done[:-1]:  # the last version stays, for whoever still reads it
            for name in (*(f"mode-{k}" for k in self._fixed), "squares"):
                fs, path = self._path(f"batch-{old}/{name}")
                fs.delete(path, True)

    def run(self, cells: DataFrame, **trigger: object) -> StreamingQuery:
        """Start the model on a stream of cells; progress is in the same folder, so a restart goes on where it was."""
        writer = cells.writeStream.foreachBatch(self.update).option("checkpointLocation", f"{self.folder}/progress")
        return (writer.trigger(**trigger) if trigger else writer).start()
