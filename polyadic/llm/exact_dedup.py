"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over the normalised text, sorted externally, and
each text is compared in full with its neighbour.  A group of copies may span partitions: splitters
also look at the identifier, and runs that touch a partition's edge are stitched afterwards, so a
group that holds a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_scratch, small_side, write_scratch
from .textarrays import byte_views, lowered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Splitters see this many leading characters of a text, so that sampling stays small.
PREFIX_CHARS = 24

_RUNS = "doc long, best long, size long, sha string, last boolean, pid int, run long, edge boolean, edge_text binary"


_SCHEMA = pa.schema(
    [("doc", pa.int64()), ("best", pa.int64()), ("size", pa.int64()), ("sha", pa.string()), ("last", pa.bool_()), ("pid", pa.int32()), ("run", pa.int64()), ("edge", pa.bool_()), ("edge_text", pa.binary())]
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare sorted neighbours; a row for each document with its run's last identifier and size."""
    pid, run_no = TaskContext.get().partitionId(), 0
    first_key = key = None
    pending: list[tuple[bytes, list]] = []  # runs under the current (prefix, hash)
    columns: list[list] = [[] for _ in _SCHEMA]

    def close(edge: bool) -> None:
        nonlocal run_no
        for text, ids in pending:
            n = len(ids)
            sha = hashlib.sha256(text).hexdigest()
            fills = (ids, [ids[-1]] * n, [n] * n, [sha] * n, [False] * (n - 1) + [True], [pid] * n, [run_no] * n, [edge] * n, [text if edge else None] + [None] * (n - 1))
            for column, values in zip(columns, fills, strict=True):
                column.extend(values)
            run_no += 1

    def filled() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)
        for c in columns:
            c.clear()
        return out

    for batch in batches:
        keys = zip(batch["prefix"].to_pylist(), batch["hash"].to_pylist(), strict=True)
        for raw, doc, here in zip(byte_views(batch["text"]), batch["doc"].to_pylist(), keys, strict=True):
            text = lowered(raw).tobytes()
            if here != key:
                close(edge=key == first_key)
                first_key, key, pending = first_key or here, here, []
                if len(columns[0]) >= 8192:
                    yield filled()
            if pending and pending[-1][0] == text:
                pending[-1][1].append(doc)
            else:
                pending.append((text, [doc]))
    close(edge=True)
    yield filled()


def _dedup(docs: DataFrame, id_col: str, text_col: str, keep: str) -> tuple[DataFrame, DataFrame]:
    """exact_dedup()'s rows, and the written intermediate that they are read from."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    sign = 1 if keep == "largest" else -1
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, UPPER, LOWER)
    rows = docs.select((F.col(id_col).cast("long") * sign).alias("doc"), text.alias("text"), F.translate(F.substring(text, 1, PREFIX_CHARS), UPPER, LOWER).alias("prefix"), F.xxhash64(norm).alias("hash"))
    dealt = rows.repartitionByRange("prefix", "hash", "doc")
    dealt = dealt.sortWithinPartitions("prefix", "hash", F.translate("text", UPPER, LOWER), F.col("doc").asc_nulls_first())
    runs = write_scratch(dealt.mapInArrow(_runs, _RUNS), "exact-runs")

    # The first and the last key of each partition, mostly single runs: short rows, two a task.
    edges = runs.where("edge_text is not null").groupBy("edge_text").agg(F.max("best").alias("all_best"), F.sum("size").alias("all_size"), F.max_by("pid", F.struct("best", "pid")).alias("win_pid"), F.collect_list(F.struct("pid", "run")).alias("at"))
    edges = edges.select("all_best", "all_size", "win_pid", F.explode("at").alias("at")).select("all_best", "all_size", "win_pid", F.col("at.pid").alias("pid"), F.col("at.run").alias("run"))
    edges = small_side(edges, "exact-edges")
    out = runs.drop("edge_text").join(edges, ["pid", "run"], "left")
    out = out.select(
        (F.col("doc") * sign).alias(id_col),
        (F.coalesce("all_best", "best") * sign).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("last") & (F.coalesce("win_pid", "pid") == F.col("pid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return out, runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and very long texts
    are compared whole.  ``keep`` says whether the smallest or the largest identifier of equal texts
    stays.  Identifiers are integers; a null identifier is never kept before another one.  Rows that
    repeat an identifier and a text count in group_size, and exactly one row of a group is marked
    kept.  An empty table gives no rows.  Columns of ``docs`` other than the two named are not read.
    """
    return _dedup(docs, id_col, text_col, keep)[0]


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that exact_dedup() keeps, with all their columns.

    Of rows that repeat an identifier and a text, one stays; an identifier stays if one of its texts
    does.  Rows with a null identifier stay.  Null texts count as empty ones, of which one stays.
    """
    found, runs = _dedup(docs, id_col, text_col, keep)
    by_id = found.groupBy(id_col).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    by_id = write_scratch(by_id.where("NOT kept OR rows > 1"), "judged")
    drop_scratch(runs)
    gone = small_side(by_id.where(~F.col("kept")).select(id_col), "dropped")
    twice = small_side(by_id.where("kept AND rows > 1").select(id_col), "repeated")
    drop_scratch(by_id)
    left = docs.join(gone, id_col, "left_anti")
    name = next(c for c in (f"norm{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    norm = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), 256)
    again = left.join(twice, id_col, "left_semi").withColumn(name, norm).dropDuplicates([id_col, name]).drop(name)
    return left.join(twice, id_col, "left_anti").unionByName(again)
