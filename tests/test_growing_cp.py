"""A CP model on a stream: fits of whole runs, replays, restarts, late and empty batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyadic.operators.factors import cp_als_frames, cp_cells, start_frame
from polyadic.streaming.growing_cp import GrowingCP
from polyadic.tensor import from_numpy

RNG = np.random.default_rng(2)
TRUE = [RNG.random((n, 2)) + 0.1 for n in (7, 6, 5)]
CUBE = np.einsum("ar,br,cr->abc", *TRUE)
AXES = ("p", "s", "y")


def fit(model, array):
    cells = from_numpy(model.spark, array, AXES).df
    error = cp_cells(cells, AXES, model.factors()).agg(F.sum((F.col("v") - F.col("model")) ** 2)).first()[0]
    return 1 - (error / (array**2).sum()) ** 0.5


def numbers(model):
    return [sorted((r["i"], tuple(r["u"])) for r in u.collect()) for u in model.factors()]


def test_batches_by_year_end_as_a_full_run_does(spark, tmp_path):
    """Lineitem by ship year, of rank 1, where a full run has one place to go to."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cells = lines.select((F.col("l_partkey") % 20).alias("p"), (F.col("l_suppkey") % 9).alias("s"), (F.year("l_shipdate") - 1992).alias("y"), F.col("l_quantity").alias("v"))
    years = sorted(r["y"] for r in cells.select("y").distinct().collect())[:3]
    schema = cells.schema
    for n, y in enumerate(years):
        cells.where(F.col("y") == y).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    model = GrowingCP(spark, f"{tmp_path}/state", AXES, (20, 9, 10), 1, "y", rounds=6)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = model.run(stream, availableNow=True)
    assert query.awaitTermination(200) and query.exception() is None
    assert len(model.committed()) == len(years)
    whole = model.cells()
    assert whole.df.count() == cells.where(F.col("y").isin(years)).select("p", "s", "y").distinct().count()
    full = cp_als_frames(whole, 1, 8, 1e-10, start=[start_frame(spark, n, 1, k) for k, n in enumerate((20, 9, 10))])
    online = cp_cells(whole.df, AXES, model.factors())
    missing = model.refined(4, 1e-10)
    assert abs(missing.fit - full.fit) < 1e-6
    assert online.where("model is null").count() == 0
    before = numbers(model)
    model.update(cells.where(F.col("y") == years[1]), model.committed()[-1])  # a replay
    assert numbers(model) == before and len(model.committed()) == len(years)
    with pytest.raises(ValueError, match="earlier batch"):
        model.update(cells.where(F.col("y") == years[0]), 99)
    model.update(cells.where("y > 1000"), 100)
    assert numbers(model) == before and len(model.committed()) == len(years)


def plain(start, batches):
    """The same updates with NumPy arrays."""
    a, b = start[0].copy(), start[1].copy()
    pa, pb, qa, qb, c = 0, 0, 0, 0, np.zeros((5, 2))
    for ys in batches:
        x = CUBE[:, :, ys]
        new = np.einsum("abc,ar,br->cr", x, a, b) @ np.linalg.pinv((a.T @ a) * (b.T @ b))
        pa, qa = pa + np.einsum("abc,br,cr->ar", x, b, new), qa + (new.T @ new) * (b.T @ b)
        a = pa @ np.linalg.pinv(qa)
        pb, qb = pb + np.einsum("abc,ar,cr->br", x, a, new), qb + (new.T @ new) * (a.T @ a)
        b = pb @ np.linalg.pinv(qb)
        c[ys] = new
    return [a, b, c]


def test_a_known_rank_is_followed_over_restarts(spark, tmp_path):
    """From factors near the true ones, batches end where a plain version does, also by objects that start anew."""
    near = [u + RNG.normal(size=u.shape) * 0.02 for u in TRUE]
    start = [spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(u)], "i long, u array<double>") for u in near]
    batches = ((4, [0, 1, 2]), (5, [3]), (7, [4]))
    for batch, ys in batches:
        part = np.zeros_like(CUBE)
        part[:, :, ys] = CUBE[:, :, ys]
        rows = from_numpy(spark, part / 2, AXES).df
        model = GrowingCP(spark, str(tmp_path), AXES, CUBE.shape, 2, "y", rounds=0, start=start)
        model.update(rows.union(rows), batch)  # repeated cells add up
    assert model.committed() == [4, 5, 7] and fit(model, CUBE) > 0.98
    for frame, want in zip(model.factors(), plain(near, [ys for _, ys in batches]), strict=True):
        got = frame.orderBy("i").collect()
        assert [r["i"] for r in got] == list(range(len(want))) and np.allclose([r["u"] for r in got], want, atol=1e-9)


def test_without_batches_there_is_no_model(spark, tmp_path):
    model = GrowingCP(spark, str(tmp_path), AXES, (2, 2, 2), 1, "y")
    assert model.cells().df.count() == 0
    with pytest.raises(ValueError, match="no batch"):
        model.factors()
