"""Lines longer than a chunk: equal to NumPy and to the short way, over chunks of chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyadic.operators import lines, windows
from polyadic.tensor import from_numpy

RNG = np.random.default_rng(9)
VECTOR = np.where(RNG.random(61) < 0.3, 0.0, RNG.integers(-4, 5, 61) / 2)
CUBE = np.where(RNG.random((3, 23, 2)) < 0.3, 0.0, RNG.integers(1, 5, (3, 23, 2)) / 2)
SCANS = {"sum": np.cumsum, "prod": np.cumprod, "min": np.minimum.accumulate, "max": np.maximum.accumulate}


@pytest.fixture(params=[4, 1 << 14], ids=["chunks", "windows"], autouse=True)
def chunk(request, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", request.param)


@pytest.mark.parametrize("op", SCANS)
def test_scans(spark, op):
    assert np.allclose(windows.cumulative(from_numpy(spark, VECTOR, ["i"]), "i", op).to_numpy(), SCANS[op](VECTOR))
    assert np.allclose(windows.cumulative(from_numpy(spark, CUBE, ["a", "b", "c"]), "b", op).to_numpy(), SCANS[op](CUBE, axis=1))


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    t = from_numpy(spark, CUBE, ["a", "b", "c"])
    assert np.allclose(windows.cumulative(t, "b").to_numpy(), np.cumsum(CUBE, axis=1))
    assert np.allclose(np.exp(windows.softmax(t, "b", log=True).to_numpy()).sum(axis=1), 1)


@pytest.mark.parametrize("descending", [False, True])
def test_sorts_with_ties(spark, descending):
    sign = -1 if descending else 1
    for array, axes, axis in ((VECTOR, ["i"], "i"), (CUBE, ["a", "b", "c"], "b")):
        t, k = from_numpy(spark, array, axes), axes.index(axis)
        order = np.argsort(sign * array, axis=k, kind="stable")
        assert np.array_equal(windows.sort(t, axis, descending).to_numpy(), np.take_along_axis(array, order, k))
        assert np.array_equal(windows.sort(t, axis, descending, positions=True).to_numpy(), order)


def test_differences_softmax_and_norms(spark):
    v, t = from_numpy(spark, VECTOR, ["i"]), from_numpy(spark, CUBE, ["a", "b", "c"])
    assert np.array_equal(windows.diff(v, "i").to_numpy(), np.diff(VECTOR)) and windows.diff(v, "i").shape == (60,)
    assert np.array_equal(windows.diff(t, "b").to_numpy(), np.diff(CUBE, axis=1))
    assert np.allclose(windows.softmax(v, "i").to_numpy(), np.exp(VECTOR) / np.exp(VECTOR).sum())
    assert np.allclose(windows.softmax(t, "b").to_numpy(), np.exp(CUBE) / np.exp(CUBE).sum(axis=1, keepdims=True))
    want = (CUBE - CUBE.mean(axis=(0, 1))) / np.sqrt(CUBE.var(axis=(0, 1)) + 1e-5)
    assert np.allclose(windows.normalise(t, ["a", "b"]).to_numpy(), want)


def test_an_empty_vector_is_zeros(spark):
    t = from_numpy(spark, np.zeros(9), ["i"])
    assert np.array_equal(windows.cumulative(t, "i").to_numpy(), np.zeros(9))
    assert np.array_equal(windows.sort(t, "i", positions=True).to_numpy(), np.arange(9.0))


def test_places_follow_the_order_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    got = lines.places(df, [F.col("k").desc()]).collect()
    assert sorted(r["place"] for r in got) == list(range(1000)) and all(r["place"] == 999 - r["k"] for r in got)


def test_no_window_takes_a_whole_vector(spark, chunk):
    if lines.CHUNK > 4:
        return
    t = from_numpy(spark, VECTOR, ["i"])
    for out in (windows.cumulative(t, "i"), windows.softmax(t, "i"), windows.diff(t, "i")):
        plan = out.df._jdf.queryExecution().optimizedPlan().toString()
        assert all("__c" in line or "windowspecdefinition(i" not in line for line in plan.splitlines() if "Window [" in line)


def test_gradients_of_extremes_share_ties(spark):
    from polyadic.operators import ad

    x = np.array([3.0, 1, 3, 2, 3, 0, 1, 1, 2])
    t = from_numpy(spark, np.stack([x, -x]), ["r", "i"])
    g = from_numpy(spark, np.array([6.0, 2.0]), ["r"])
    got = ad.reduction_vjp(t, ["i"], "max", g).to_numpy()
    want = np.stack([np.where(x == 3, 2.0, 0.0), np.where(x == 0, 2.0, 0.0)])
    assert np.allclose(got, want)


def test_tasks_do_not_grow_with_the_line(spark, monkeypatch):
    """61 cells at 4 a task are 16 tasks, more than the session's 4; the results stay."""
    monkeypatch.setattr(lines, "TASK_CELLS", 4)
    v = from_numpy(spark, VECTOR, ["i"])
    placed = lines.places(v.dense().df, [F.col("i").desc()], rows=61)
    sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 12
    assert all(r["place"] == 60 - r["i"] for r in placed.collect())
    found = lines.differences(v, "i", chunk=2)
    assert np.array_equal(found.to_numpy(), np.diff(VECTOR)) and found.df.count() == 60
    assert found.df.rdd.getNumPartitions() >= 16
