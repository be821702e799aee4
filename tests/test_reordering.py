"""Reverse Cuthill-McKee against a plain queue, over several components."""

import random

import numpy as np
import pytest

from polyadic.operators import reordering
from polyadic.tensor import from_numpy


def around(near, start):
    level, todo = {start: 0}, [start]
    for u in todo:
        for v in near[u]:
            if v not in level:
                level[v] = level[u] + 1
                todo.append(v)
    deepest = max(level.values())
    return deepest, min((len(near[v]), v) for v in level if level[v] == deepest)[1], set(level)


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out, left = [], set(near)
    while left:
        _, _, part = around(near, min(left))
        start = min((len(near[v]), v) for v in part)[1]
        depth, end, _ = around(near, start)
        while (further := around(near, end))[0] > depth:
            start, (depth, end, _) = end, further
        queue, seen = [start], {start}
        for u in queue:
            for v in sorted(near[u] - seen, key=lambda v: (len(near[v]), v)):
                seen.add(v)
                queue.append(v)
        out += queue
        left -= part
    return out[::-1]


def graph():
    rng = random.Random(6)
    names = rng.sample(range(100), 40)
    grid = [(names[5 * r + c], names[5 * q + d]) for r in range(5) for c in range(5) for q, d in ((r, c + 1), (r + 1, c)) if q < 5 and d < 5]
    tree = [(names[25 + k], names[25 + (k - 1) // 2]) for k in range(1, 12)]
    return grid + tree + [(b, a) for a, b in grid[:6]] + [(names[38], names[38]), (names[39], names[0]), grid[0]]


def test_order_is_that_of_a_queue(spark):
    edges = graph()
    frame = spark.createDataFrame([*edges, (None, 1)], "src long, dst long")
    order = reordering.reverse_cuthill_mckee(frame)
    got = [r["id"] for r in order.orderBy("place").collect()]
    assert got == plain(edges) and [r["place"] for r in order.orderBy("place").collect()] == list(range(len(got)))
    assert reordering.bandwidth(frame, order) < reordering.bandwidth(frame) / 4


def test_matrix_moves_on_both_sides(spark):
    a = np.diag([1.0, 2, 3, 4])
    a[0, 3] = a[3, 0] = 5
    t = from_numpy(spark, a, ["i", "j"])
    order = spark.createDataFrame([(0, 1), (3, 2), (1, 0), (2, 3)], "id long, place long")
    back = [1, 0, 3, 2]  # the index at each place
    assert np.array_equal(reordering.reordered(t, order).to_numpy(), a[np.ix_(back, back)])
    with pytest.raises(ValueError, match="no place"):
        reordering.reordered(t, order.where("id <> 2"))
    with pytest.raises(ValueError, match="square"):
        reordering.reordered(from_numpy(spark, np.ones((2, 3)), ["i", "j"]), order)


def test_no_edges(spark):
    assert reordering.reverse_cuthill_mckee(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_steps_do_not_sort_the_edges(spark, monkeypatch, most):
    """Frontiers are looked up, broadcast or in a shuffled table; before, each level sorted all edges."""
    from polyadic import iterate

    plans, kept = [], reordering.cut
    monkeypatch.setattr(iterate, "VECTOR_CELLS", most)
    monkeypatch.setattr(reordering, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    path = [(k, k + 1) for k in range(11)] + [(20, 21)]
    both = reordering._both(spark.createDataFrame(path, "src long, dst long"))
    starts = spark.createDataFrame([(0, 0), (20, 20)], "id long, component long")
    levels = {r["id"]: r["level"] for r in reordering._levels(both, starts).collect()}
    assert levels == {**{k: k for k in range(12)}, 20: 0, 21: 1}
    steps = [p for p in plans if "Join" in p]
    assert steps and all("HashJoin" in p and "SortMergeJoin" not in p for p in steps)
