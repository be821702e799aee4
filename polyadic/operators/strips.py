"""Long vectors as frames of dense strips, and sparse matrices as frames of packed cells that look up strips.

A product broadcasts a vector's strips (8 bytes a cell) to a matrix that is packed once and not shuffled
again; only sums of strips are shuffled.  A solver's vectors are columns of one frame, its state, so that
they meet without a join, and each step writes the state anew and deletes the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyadic.iterate import looked_up, shared_folder, unwritten, written
from polyadic.operators.factorization import ic_preconditioner, ilu0, level_sets
from polyadic.operators.krylov import Solution, apply, cg
from polyadic.tensor import Tensor

#: Cells of a strip: at least and at most (places in it are short integers); strips that there should be.
LEAST_STRIP, MOST_STRIP, STRIPS = 1 << 10, 1 << 15, 16
#: Cells of a row of a packed matrix, and of a task's part of it.
CHUNK_CELLS, TASK_CELLS = 1 << 17, 1 << 22
#: Cells of a vector that is broadcast as strips; longer ones are shuffled to the matrix.
BROADCAST_CELLS = 1 << 23
#: Cells of sums that a task holds before it passes them on.
HELD_CELLS = 1 << 23
#: Levels of a triangle up to which a state is written for each.
LEVELS = 64

#: A state's step: from the sums of a product (zeros without one) and a strip's vectors by name to new ones and numbers that are summed up.
Step = Callable[[np.ndarray, dict[str, np.ndarray]], tuple[dict[str, np.ndarray], Sequence[float]]]


def strip_of(n: int) -> int:
    return min(MOST_STRIP, max(LEAST_STRIP, -(-n // STRIPS)))


def _arrays(batch: pa.RecordBatch, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=kind) if x.is_valid else np.zeros(0, dtype=kind) for x in batch[name]]


@dataclass(frozen=True)
class Packed:
    """Cells of a square matrix by level: rows (bi, bj, r, c, v) of cells of one pair of strips, in a folder for each level."""

    folder: str
    n: int
    strip: int

    def rows(self, df: DataFrame, level: int) -> DataFrame:
        return df.sparkSession.read.schema("bi int, bj int, r binary, c binary, v binary").parquet(f"{self.folder}/level={level}")


def packed(cells: DataFrame, n: int, stored: int, first: int = 0, later: DataFrame | None = None) -> Packed:
    """Cells (i, j, v) packed; ``later`` (i, level) says which rows are in later levels than ``first``."""
    strip, size = strip_of(n), CHUNK_CELLS
    spark = cells.sparkSession
    if later is None:
        cells = cells.withColumn("level", F.lit(first))
    else:
        cells = cells.join(looked_up(later, later.count()), "i", "left").withColumn("level", F.coalesce("level", F.lit(first)))
    place = [F.floor(F.col(x) / strip).cast("int").alias(f"b{x}") for x in "ij"] + [(F.col(x) % strip).cast("short").alias(y) for x, y in ("ir", "jc")]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // TASK_CELLS))
    order = ("level", "bi", "bj", "r")
    # Ranges, so that a task sums to few strips, and large pairs of strips are parted.
    cells = cells.select("level", *place, "v").repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, now = [], 0, None

        def row() -> pa.RecordBatch:
            parts = [pa.array([np.concatenate([h[k] for h in held]).tobytes()], pa.binary()) for k in range(3)]
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in now), *parts], ["level", "bi", "bj", "r", "c", "v"])

        for batch in batches:
            key = np.stack([batch[x].to_numpy() for x in ("level", "bi", "bj")])
            r, c, v = (batch[x].to_numpy() for x in ("r", "c", "v"))
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(r)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                at = tuple(key[:, a].tolist())
                if held and (at != now or many >= size):
                    yield row()
                    held, many = [], 0
                now = at
                held.append((r[a:b], c[a:b], v[a:b]))
                many += b - a
        if held:
            yield row()

    folder = shared_folder(spark, "packed")
    cells.mapInArrow(pack, "level int, bi int, bj int, r binary, c binary, v binary").write.partitionBy("level").parquet(folder)
    return Packed(folder, n, strip)


def product(a: Packed, x: DataFrame, column: str, level: int = 0, ways: Sequence[bool] = (False,)) -> DataFrame:
    """(s, sum): strips of A x, of strips (s, ``column``); ``ways`` are False for A, True for its transpose, both for A + A'.

    Strips without cells have no row.
    """
    strip, most = a.strip, HELD_CELLS
    rows = a.rows(x, level)
    for way in ways:
        vector = x.select(F.col("s").alias("bi" if way else "bj"), F.col(column).alias(f"x{int(way)}"))
        rows = rows.join(F.broadcast(vector) if a.n <= BROADCAST_CELLS else vector.hint("shuffle_hash"), "bi" if way else "bj")

    def told(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([y.tobytes() for y in held.values()], pa.binary())], ["s", "sum"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = [batch[k].to_pylist() for k in ("bi", "bj")]
            r, c, v = (_arrays(batch, k, kind) for k, kind in (("r", np.int16), ("c", np.int16), ("v", np.float64)))
            for way in ways:
                to, by, out = (c, r, at[1]) if way else (r, c, at[0])
                for row, x in enumerate(_arrays(batch, f"x{int(way)}", np.float64)):
                    y = np.bincount(to[row], v[row] * x[by[row]], strip)
                    if out[row] in held:
                        held[out[row]] += y
                    else:
                        held[out[row]] = y
                    if len(held) * strip > most:
                        yield told(held)
                        held = {}
        if held:
            yield told(held)

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        y = np.zeros(strip)
        for x in rows["sum"]:
            y += np.frombuffer(x.as_buffer())
        return pa.table({"s": pa.array([key[0].as_py()], pa.int32()), "sum": pa.array([y.tobytes()], pa.binary())})

    rows = rows.select("bi", "bj", "r", "c", "v", *(f"x{int(way)}" for way in ways))
    return rows.mapInArrow(products, "s int, sum binary").groupBy("s").applyInArrow(total, "s int, sum binary")


def dense(parts: Mapping[str, DataFrame], n: int) -> DataFrame:
    """(s, a column for each part): strips of vectors given as cells (i, v); what is missing is 0."""
    strip, names = strip_of(n), list(parts)
    spark = next(iter(parts.values())).sparkSession
    cells = spark.range(-(-n // strip)).select(F.col("id").cast("int").alias("s"), F.lit(0).cast("short").alias("at"), F.lit(-1).alias("what"), F.lit(0.0).alias("v"))
    for k, df in enumerate(parts.values()):
        cells = cells.unionByName(df.select(F.floor(F.col("i") / strip).cast("int").alias("s"), (F.col("i") % strip).cast("short").alias("at"), F.lit(k).alias("what"), F.col("v").cast("double")))

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        at, what, v = (rows[x].to_numpy() for x in ("at", "what", "v"))
        out = {"s": pa.array([key[0].as_py()], pa.int32())}
        for k, name in enumerate(names):
            x = np.zeros(strip)
            np.add.at(x, at[what == k], v[what == k])
            out[name] = pa.array([x.tobytes()], pa.binary())
        return pa.table(out)

    return cells.groupBy("s").applyInArrow(fill, ", ".join(["s int", *(f"{x} binary" for x in names)]))


class State:
    """Vectors of a solver, written as one frame (s, a column for each)."""

    def __init__(self, df: DataFrame, n: int):
        self.df, self.n = written(df, "state"), n

    def step(self, names: Sequence[str], f: Step, sums: DataFrame | None = None) -> np.ndarray:
        """The vectors ``names`` by ``f``, in place of all; and the numbers."""
        df, old = self.df, [c for c in self.df.columns if c not in ("s", "numbers")]
        df = df.drop("numbers").withColumn("sum", F.lit(None).cast("binary")) if sums is None else df.drop("numbers").join(F.broadcast(sums) if self.n <= BROADCAST_CELLS else sums, "s", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = {c: _arrays(batch, c, np.float64) for c in (*old, "sum")}
                for row, s in enumerate(batch["s"].to_pylist()):
                    vectors = {c: columns[c][row] for c in old}
                    total = columns["sum"][row]
                    out, numbers = f(total if len(total) else np.zeros(len(vectors[old[0]])), vectors)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([out[c].tobytes()], pa.binary()) for c in names), pa.array([[float(x) for x in numbers]], pa.list_(pa.float64()))], ["s", *names, "numbers"])

        before, self.df = self.df, written(df.mapInArrow(run, ", ".join(["s int", *(f"{c} binary" for c in names), "numbers array<double>"])), "state")
        unwritten(before)
        told = self.df.select(F.posexplode("numbers").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()  # some numbers
        return np.array([r["x"] for r in sorted(told, key=lambda r: r["k"])])

    def cells(self, name: str) -> Tensor:
        """A vector's cells, also those that are 0."""
        return cells(self.df, name, self.n)


def cells(df: DataFrame, name: str, n: int) -> Tensor:
    """All cells of a vector of strips (s, ``name``)."""
    strip = strip_of(n)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, x in zip(batch["s"].to_pylist(), _arrays(batch, name, np.float64), strict=True):
                x = x[: n - s * strip]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(s * strip, s * strip + len(x)), pa.int64()), pa.array(x)], ["i", "v"])

    return Tensor(df.select("s", name).mapInArrow(told, "i long, v double"), ("i",), (n,))


def ic_cg(a: Tensor, b: Tensor, tolerance: float = 1e-10, max_rounds: int = 200, strict: bool = True) -> tuple[Solution, Tensor]:
    """Conjugate gradients under IC(0) for a symmetric positive definite matrix; the solution, and what the matrix makes of it.

    IC(0) is taken as L D L', with the L of ILU(0) and its pivots, so no roots are drawn.  One half of the
    matrix is packed and taken both ways, and of two levels also L.  ``tolerance`` is of the residual's norm.
    Solves go by levels, a step each; a matrix of more than LEVELS goes by cells.  ``a`` is read some times,
    so a written one is best.
    """
    n = a.shape[0]
    a, b = a.renamed(("i", "j")), b.renamed(("i",))
    spark = a.df.sparkSession
    low, up = (t.df for t in ilu0(a))
    diagonal = up.where("i = j").select("i", "v")
    if not diagonal.where("v <= 0").isEmpty():
        raise ZeroDivisionError("a pivot is not positive: the matrix is not positive definite")
    low = low.where("i > j")
    turned = low.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    rows = spark.range(n).select(F.col("id").alias("i"))
    (low_level, lows), (up_level, ups) = level_sets(low, rows), level_sets(turned, rows)
    if lows + ups > LEVELS:
        found = cg(a, b, tolerance, max_rounds, ic_preconditioner(a), strict)
        return found, apply(a, found.x)
    stored = a.df.count() // 2
    # Rows of level 0 have no cells off the diagonal, and with one level there are none.
    half = packed(a.df.where("i > j"), n, stored) if lows > 1 else None
    first = packed(low, n, stored, 1, low_level.where("level > 1") if lows > 2 else None) if lows > 1 else None
    second = first if (lows, ups) == (2, 2) else packed(turned, n, stored, 1, up_level.where("level > 1") if ups > 2 else None) if ups > 1 else None
    back = (second is first,)
    levels = (x.where("level > 0").select("i", F.col("level").alias("v")) for x in (low_level, up_level))
    state = State(dense({"r": b.df, "d": diagonal, "a": a.df.where("i = j").select("i", "v")} | dict(zip(("lows", "ups"), levels, strict=True)), n), n)
    fixed = ("d", "a", "lows", "ups")

    def began(o: Mapping[str, np.ndarray]) -> np.ndarray:
        return np.where(o["lows"] == 0, o["r"], 0.0)

    def image(some: State, name: str, to: str, kept: tuple[str, ...] = ()) -> float:
        """Puts A times a vector beside the ``kept`` ones; gives the product of both."""

        def add(total: np.ndarray, o: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], list[float]]:
            w = total + o["a"] * o[name]
            return o | {to: w}, [o[name] @ w]

        return float(some.step((*kept, to), add, product(half, some.df, name, ways=(False, True)) if half else None)[0])

    def ended(o: Mapping[str, np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """D^-1 y, and the first level's part of z."""
        y = _over(y, o["d"])
        return y, np.where(o["ups"] == 0, y, 0.0)

    def solved(kept: tuple[str, ...]) -> float:
        """From y, the first level's part of L y = r, to z with L U z = r; gives r z."""
        for k in range(1, lows):
            last = k == lows - 1

            def forward(total: np.ndarray, o: dict[str, np.ndarray], k: int = k, last: bool = last) -> tuple[dict[str, np.ndarray], list[float]]:
                y = np.where(o["lows"] == k, o["r"] - total, o["y"])
                return o | (dict(zip("yz", ended(o, y))) if last else {"y": y}), []

            state.step((*kept, "r", *fixed, "y", *(["z"] if last else [])), forward, product(first, state.df, "y", k))
        if lows == 1:
            state.step((*kept, "r", *fixed, "y", "z"), lambda _, o: (o | dict(zip("yz", ended(o, o["y"]))), []))
        rz = 0.0
        for k in range(1, ups):
            last = k == ups - 1

            def backward(total: np.ndarray, o: dict[str, np.ndarray], k: int = k) -> tuple[dict[str, np.ndarray], list[float]]:
                z = np.where(o["ups"] == k, o["y"] - total, o["z"])
                return o | {"z": z}, [o["r"] @ z]

            rz = state.step((*kept, "r", *fixed, "z", *([] if last else ["y"])), backward, product(second, state.df, "z", k, back))[0]
        if ups == 1:
            rz = state.step((*kept, "r", *fixed, "z"), lambda _, o: (o, [o["r"] @ o["z"]]))[0]
        return float(rz)

    rr = state.step(("x", "r", *fixed, "y"), lambda _, o: (o | {"x": np.zeros(len(o["r"])), "y": began(o)}, [o["r"] @ o["r"]]))[0]
    size, rounds, before = float(rr) ** 0.5, 0, None
    while size > tolerance and rounds < max_rounds:
        kept = ("x",) if before is None else ("x", "p")
        rz = solved(kept)
        if not rz:
            break
        beta = rz / before if before is not None else 0.0
        state.step(("x", "r", *fixed, "p"), lambda _, o, beta=beta: (o | {"p": o["z"] + beta * o["p"] if "p" in o else o["z"]}, []))
        below = image(state, "p", "w", ("x", "r", *fixed, "p"))
        if below <= 0:  # not positive definite
            break
        alpha, before = rz / below, rz

        def moved(_: np.ndarray, o: dict[str, np.ndarray], alpha: float = alpha) -> tuple[dict[str, np.ndarray], list[float]]:
            o = o | {"x": o["x"] + alpha * o["p"], "r": o["r"] - alpha * o["w"]}
            return o | {"y": began(o)}, [o["r"] @ o["r"]]

        size, rounds = float(state.step(("x", "r", *fixed, "p", "y"), moved)[0]) ** 0.5, rounds + 1
    good = size <= tolerance
    if strict and not good:
        raise RuntimeError(f"no convergence after {rounds} rounds: the residual is {size:g}, not {tolerance:g}")
    out = State(state.df, n)
    image(out, "x", "w")
    return Solution(state.cells("x"), rounds, size, good), out.cells("w")


def _over(y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """y / d, 0 beyond the vector's end, where the last strip's diagonal is 0."""
    return np.divide(y, d, out=np.zeros(len(y)), where=d != 0)
