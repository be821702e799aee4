"""Sparse matrix and tensor algebra on stored cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyadic.iterate import looked_up, written
from polyadic.operators.elementwise import binary
from polyadic.plans.einsum import einsum
from polyadic.tensor import Tensor


def deduplicated(t: Tensor) -> Tensor:
    """One row for each index: repeated ones are summed."""
    return t.with_df(t.df.groupBy(*t.axes).agg(F.sum("v").alias("v")))


def dropped(t: Tensor, tolerance: float = 0.0) -> Tensor:
    """Without cells of an absolute value up to ``tolerance``."""
    return t.with_df(t.df.where(F.abs(F.col("v")) > tolerance))


def add(a: Tensor, b: Tensor, alpha: float = 1.0, beta: float = 1.0) -> Tensor:
    """alpha a + beta b over the union of stored cells; exact zeros go."""
    both = a.df.withColumn("v", F.col("v") * alpha).unionByName(b.renamed(a.axes).df.withColumn("v", F.col("v") * beta))
    return dropped(deduplicated(a.with_df(both)))


def intersected(a: Tensor, b: Tensor, op: str) -> Tensor:
    """A binary operation where both have a stored cell."""
    return binary(a, b.renamed(a.axes), op, how="inner")


def spmv(a: Tensor, x: Tensor) -> Tensor:
    return einsum("ij,j->i", a, x).renamed((a.axes[0],))


def spmm(a: Tensor, b: Tensor) -> Tensor:
    """Product of two sparse (or one sparse and one dense) matrices; exact zeros go."""
    return dropped(einsum("ij,jk->ik", a, b))


def masked_product(a: Tensor, b: Tensor, mask: DataFrame) -> Tensor:
    """The product of two sparse matrices of one square shape, only at the places (i, j) of ``mask``.

    Diagonals meet one cell each, and so does what goes from i over k back to i.  For the rest, rows
    that ``a`` has at the mask's places leave columns, and only cells of ``b`` in these are multiplied,
    so that a pattern without triangles makes no products beside those that count.
    """
    if not a.shape == b.shape or len(set(a.shape)) != 1:
        raise ValueError("two square matrices of one size are needed")
    mask = mask.select("i", "j").distinct()
    x = a.renamed(("i", "k")).df.withColumnRenamed("v", "__x")
    y = b.renamed(("k", "j")).df.withColumnRenamed("v", "__y")
    product = (F.col("__x") * F.col("__y")).alias("v")
    straight, turned = x.where("i = k").select("k", "__x"), y.where("k = j").select("k", "__y")
    x, y = x.where("i <> k"), y.where("k <> j")
    by_diagonal = straight.join(y, "k").select(F.col("k").alias("i"), "j", product)
    on_diagonal = x.join(turned, "k").select("i", F.col("k").alias("j"), product)
    both = straight.join(turned, "k").select(F.col("k").alias("i"), F.col("k").alias("j"), product)
    back = x.join(y.withColumnRenamed("j", "i"), ["i", "k"]).groupBy("i").agg(F.sum(product).alias("v")).select("i", F.col("i").alias("j"), "v")
    off = mask.where("i <> j").join(x.select("i").distinct(), "i", "left_semi")
    kept = y.join(off.select("j").distinct(), "j", "left_semi")
    rest = x.join(kept, "k").where("i <> j").select("i", "j", product).join(off, ["i", "j"], "left_semi")
    few = by_diagonal.unionByName(on_diagonal).unionByName(both).unionByName(back).join(mask, ["i", "j"], "left_semi")
    out = few.unionByName(rest).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return Tensor(out, ("i", "j"), a.shape)


def triangles_product(low: Tensor, up: Tensor) -> Tensor:
    """L U of a lower and an upper triangle at the places where either has a cell.

    If no cell beside the diagonal can get a product other than those with the diagonals, all cells
    meet in one shuffle by L's columns and U's rows; else it is a masked product.  Both are read
    three times, so written ones are best.
    """
    if not low.shape == up.shape or len(set(low.shape)) != 1:
        raise ValueError("two square matrices of one size are needed")
    x, y = low.renamed(("i", "j")).df, up.renamed(("i", "j")).df
    off_x, off_y = x.where("i <> j"), y.where("i <> j")
    rows, columns = written(off_x.select("i").distinct(), "rows"), written(off_y.select("j").distinct(), "columns")
    rows_, columns_ = looked_up(rows, rows.count()), looked_up(columns, columns.count())
    # Rows that L has off its diagonal, in columns that U has off its own.
    if not off_x.join(columns_, "j", "left_semi").isEmpty() or not off_y.join(columns_, "j", "left_semi").join(rows_, "i", "left_semi").isEmpty():
        return masked_product(low, up, x.select("i", "j").unionByName(y.select("i", "j")))
    none = F.lit(None).cast("double")
    both = x.select(F.col("j").alias("k"), F.col("i").alias("o"), F.col("v").alias("x"), none.alias("y")).unionByName(y.select(F.col("i").alias("k"), F.col("j").alias("o"), none.alias("x"), F.col("v").alias("y")))
    both = both.repartition("k").groupBy("k", "o").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    for name in "xy":
        both = both.withColumn(f"d{name}", F.max(F.when(F.col("o") == F.col("k"), F.col(name))).over(Window.partitionBy("k")))
    below = both.where("o <> k and x * dy is not null").select(F.col("o").alias("i"), F.col("k").alias("j"), (F.col("x") * F.col("dy")).alias("v"))
    above = both.where("o <> k and dx * y is not null").select(F.col("k").alias("i"), F.col("o").alias("j"), (F.col("dx") * F.col("y")).alias("v"))
    on = both.groupBy("o").agg(F.sum(F.col("x") * F.col("y")).alias("v"), F.max(F.col("o") == F.col("k")).alias("there")).where("there and v is not null")
    return Tensor(below.unionByName(above).unionByName(on.select(F.col("o").alias("i"), F.col("o").alias("j"), "v")), ("i", "j"), low.shape)


def transposed(a: Tensor) -> Tensor:
    return Tensor(a.df.select(*reversed(a.axes), "v"), a.axes[::-1], a.shape[::-1])


def norms(a: Tensor) -> DataFrame:
    """frobenius, one (largest column sum), inf (largest row sum), largest and stored cells, in one row."""
    i, j = a.axes
    rows = a.df.groupBy(i).agg(F.sum(F.abs(F.col("v"))).alias("__s")).agg(F.max("__s").alias("norm_inf"))
    columns = a.df.groupBy(j).agg(F.sum(F.abs(F.col("v"))).alias("__s")).agg(F.max("__s").alias("norm_one"))
    whole = a.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius"), F.max(F.abs(F.col("v"))).alias("largest"), F.count("*").alias("stored"))
    return whole.crossJoin(rows).crossJoin(columns)


def structure(a: Tensor) -> DataFrame:
    """Stored cells, density, bandwidths and whether pattern and values are symmetric, in one row."""
    i, j = a.axes
    cells = a.shape[0] * a.shape[1]
    mirrored = a.df.select(F.col(j).alias(i), F.col(i).alias(j), F.col("v").alias("w"))
    both = a.df.join(mirrored, [i, j], "left")
    return both.agg(
        F.count("*").alias("stored"),
        (F.count("*") / cells).alias("density"),
        F.max(F.greatest(F.col(j) - F.col(i), F.lit(0))).alias("upper_band"),
        F.max(F.greatest(F.col(i) - F.col(j), F.lit(0))).alias("lower_band"),
        F.min(F.col("w").isNotNull().cast("int")).alias("pattern_symmetric"),
        F.min(F.coalesce((F.col("v") == F.col("w")).cast("int"), F.lit(0))).alias("symmetric"),
    )


def row_counts(a: Tensor) -> DataFrame:
    """Stored cells of each row that has any."""
    return a.df.groupBy(a.axes[0]).agg(F.count("*").alias("stored"))


def scaled_rows(a: Tensor, d: Tensor) -> Tensor:
    """diag(d) a."""
    return einsum("ij,i->ij", a, d).renamed(a.axes)


def laplacian(a: Tensor) -> Tensor:
    """Degree matrix minus adjacency."""
    i, j = a.axes
    degree = a.df.groupBy(i).agg(F.sum("v").alias("v")).select(i, F.col(i).alias(j), "v")
    return dropped(deduplicated(a.with_df(degree.unionByName(a.df.withColumn("v", -F.col("v"))))))


def block_diagonal(blocks: Sequence[Tensor]) -> Tensor:
    out, at, to = None, 0, 0
    for b in blocks:
        part = b.df.select((F.col(b.axes[0]) + at).alias("i"), (F.col(b.axes[1]) + to).alias("j"), "v")
        out = part if out is None else out.unionByName(part)
        at, to = at + b.shape[0], to + b.shape[1]
    return Tensor(out, ("i", "j"), (at, to))


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def mask_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_semi").distinct()


def mask_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti").distinct()


def masked(t: Tensor, mask: DataFrame) -> Tensor:
    """The cells that ``mask`` (a frame of index tuples) names."""
    return t.with_df(t.df.join(mask, list(t.axes), "left_semi"))


def scaled_columns(a: Tensor, d: Tensor) -> Tensor:
    """a diag(d)."""
    return einsum("ij,j->ij", a, d).renamed(a.axes)


def is_banded(a: Tensor, lower: int, upper: int) -> DataFrame:
    """Whether all stored cells are within the bandwidths, in one row."""
    i, j = a.axes
    return a.df.agg(F.coalesce(F.max((F.col(j) - F.col(i) > upper) | (F.col(i) - F.col(j) > lower)), F.lit(False)).alias("x")).select((~F.col("x")).alias("banded"))


def is_dominant(a: Tensor, strict: bool = True) -> DataFrame:
    """Whether each row's diagonal exceeds (or without ``strict`` reaches) the sum of its other moduli, in one row."""
    i, j = a.axes
    v = F.abs("v")
    rows = a.df.groupBy(i).agg(F.sum(F.when(F.col(i) == F.col(j), v).otherwise(0.0)).alias("d"), F.sum(F.when(F.col(i) != F.col(j), v).otherwise(0.0)).alias("o"))
    good = F.col("d") > F.col("o") if strict else F.col("d") >= F.col("o")
    empty = F.lit(a.shape[0]) > F.count("*") if strict else F.lit(False)
    return rows.agg((F.coalesce(F.min(good), F.lit(True)) & ~empty).alias("dominant"))
