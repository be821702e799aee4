"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are cut into full sequences and one remainder.  Only the histogram of remainder lengths
(at most ``size`` rows) reaches the driver; there lengths are placed longest first, and the resulting
packing patterns are joined back to the pieces by their rank within a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import write_scratch

#: Pieces of one length are ranked in buckets of about this many.
RANK_BUCKET = 50_000


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that sum to ``size`` at most, each with the number of its sequences.

    Lengths are placed longest first, each into the packs with the most room left, as many copies at
    a time as there are such packs; a length that fits nowhere opens new packs.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        fresh: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=0)
            if room < length:
                each = max(1, size // length)
                whole, rest = divmod(left, each)
                for pattern, n in (((length,) * each, whole), ((length,) * rest, 1 if rest else 0)):
                    if n:
                        fresh.setdefault(size - sum(pattern), []).append((pattern, n))
                break
            pattern, n = by_room[room].pop()
            fits = min(room // length, max(1, left // n))
            used = min(n, left // fits)
            if used < n:
                by_room[room].append((pattern, n - used))
            grown = (*pattern, *(length,) * fits)
            fresh.setdefault(size - sum(grown), []).append((grown, used))
            left -= used * fits
            if not by_room[room]:
                del by_room[room]
        for room, packs in fresh.items():
            merged: dict[tuple[int, ...], int] = {}
            for pattern, n in by_room.get(room, []) + packs:
                merged[pattern] = merged.get(pattern, 0) + n
            by_room[room] = list(merged.items())
    return sorted((p, n) for packs in by_room.values() for p, n in packs)


def pieces_of(ids: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and CRC-32 of the pieces of a document's ids."""
    raw = ids.astype("<u4").tobytes()
    for start in range(0, len(ids), size):
        end = min(start + size, len(ids))
        yield start, end - start, zlib.crc32(raw[4 * start : 4 * end])


def pack(docs: DataFrame, encode: Callable[[pa.Array], Iterator[np.ndarray]], size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``encode`` turns an Arrow array of texts into one array of ids for each, end mark included; it
    runs on the executors.  Null texts are passed as empty.  Rows that repeat an identifier are
    packed as documents of their own; an empty table gives no rows.  Other columns are not read.
    Each sequence has ``size`` ids at most; full pieces stand alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch[0].to_pylist(), encode(batch[1]), strict=True):
                rows += [(doc, start, n, crc, len(ids)) for start, n, crc in pieces_of(ids, size)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "start", "length", "crc", "tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = write_scratch(texts.mapInArrow(cut, "doc long, start long, length long, crc long, tokens long"), "pieces")

    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    total = sum(counts.values())
    full = counts.pop(size, 0)
    patterns = shortest_pack_first(counts, size)

    # Slots: for each length, ranks from `first` on go to the sequences of a pattern, at `offset`.
    slots: dict[int, list[tuple[int, int, int]]] = {size: [(0, full, 0)]} if full else {}
    sequence, taken = full, dict.fromkeys(counts, 0)
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((sequence, n, offset))
            taken[length] += n
            offset += length
        sequence += n
    table = {}
    for length, rows in slots.items():
        base, n, offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        table[length] = (np.concatenate(([0], np.cumsum(n)[:-1])), base, offset)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the patterns, not by the data

    # Rank within a length: buckets of bounded size, so that one common length is many groups.
    buckets = max(1, total // RANK_BUCKET + 1)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc", "start"), F.lit(buckets)))
    starts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("length", "bucket").orderBy("doc", "start", "crc", "tokens")
    ranked = bucketed.withColumn("rank", F.row_number().over(in_bucket) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.select("doc", "start", "length", "crc", "tokens", (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot = shared.value
        for f in frames:
            sequence_id, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            order = np.argsort(f["length"].to_numpy(), kind="stable")
            lengths = f["length"].to_numpy()[order]
            cuts = np.flatnonzero(np.diff(lengths, prepend=-1))
            for at, end in zip(cuts, [*cuts[1:], len(order)], strict=True):
                rows = order[at:end]
                first, base, offs = slot[int(lengths[at])]
                rank = f["rank"].to_numpy()[rows]
                k = np.searchsorted(first, rank, side="right") - 1
                sequence_id[rows], offset[rows] = base[k] + rank - first[k], offs[k]
            yield f.drop(columns="rank").assign(sequence_id=sequence_id, offset=offset)

    placed = ranked.mapInPandas(place, "doc long, start long, length long, crc long, tokens long, sequence_id long, offset long")
    return placed.select(F.col("doc").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")
