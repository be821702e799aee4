"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole.

Hashes deal the universe of shingles into segments, as many as a size band allows differences (and a
few more), so two sets that are similar enough agree in some segments, or differ there by one shingle
where one-deletion neighbours are indexed too.  Equal segment keys give candidates.  Candidates whose
parity sketches already show too many differences are ruled out, and the others are verified on the
words of both texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import BROADCAST_ROWS, drop_scratch, small_side, write_scratch
from .textarrays import byte_views, let_go, mix, shingle_set

#: Segments beyond the pigeonhole's need, so that segments without shingles need no keys.
SPARE = 2
#: Segments beyond that, where a band allows many differences: so many more keys do linked sets share
#: than one, unlike strangers that have a passage in common.  At least EXTRA, and a tenth.
EXTRA = 4
#: Sets that share a quarter of a set's shingles without linking to it, as the cost model has it.
STRANGERS = 60
#: Sets in a block, when a key's sets are compared block by block, and key rows in a task.
BLOCK, TASK_ROWS = 256, 2_000
#: Rounds against pivots go on while one candidate of so many links, and at most so often.
JOINS, ROUNDS = 2, 6
#: In the last rounds a set asks for its nearest candidates first: 1, then so many times more each round.
WIDER = 8


@dataclass(frozen=True)
class Similarity:
    """Links are pairs with intersection / union >= num / den."""

    num: int
    den: int

    def differences(self, total: int) -> int:
        """Most shingles in which two linked sets of ``total`` shingles together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def linked(self, a: int, b: int, common: int) -> bool:
        return self.den * common >= self.num * (a + b - common) > 0

    def largest(self, n: int) -> int:
        """The largest set that a set of ``n`` can link with."""
        return n * self.den // self.num


@dataclass(frozen=True)
class Allocation:
    """How a band's universe is dealt: ``exact`` segments by key, ``near`` ones with one-deletion keys.

    Linked sets share at least ``need`` keys.
    """

    exact: int
    near: int
    need: int

    @property
    def segments(self) -> int:
        return self.exact + self.near


@cache
def bands(sim: Similarity, most: int) -> list[int]:
    """Lower ends of the size bands; linked sets are in one band or in neighbouring ones."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(-(-lows[-1] * sim.den // sim.num), lows[-1] * sim.den * 23 // (sim.num * 20)))
    return lows


def _extra(most: int) -> int:
    """Segments beyond what ``most`` differences and SPARE need."""
    return min(most // 4, max(EXTRA, most // 10))


def allocate(low: int, high: int, sim: Similarity) -> Allocation | None:
    """The cheapest allocation for sets of [low, high) shingles; None if only equal sets can link.

    Cost: keys of a set, and strangers met by chance.  An exact segment covers one difference and a
    near one two.
    """
    most = sim.differences(2 * (high - 1))
    if most == 0:
        return None
    cover = most + 1 + SPARE + _extra(most)
    best = None
    for near in range(0, cover // 2 + 1):
        exact = cover - 2 * near
        load = low / (exact + near)
        cost = exact + near * (1 + load) + STRANGERS * (exact * 0.25**load + near * (1 + load) * 0.25 ** max(load - 1, 0))
        if best is None or cost < best[0]:
            left = cover - SPARE - most
            best = (cost, Allocation(exact, near, -(-left // (2 if near else 1))))
        elif cost > 8 * best[0]:
            break
    return best[1]


def segment_keys(shingles: np.ndarray, band: int, plan: Allocation, first: int | None = None) -> np.ndarray:
    """Keys of a set under a band's plan: one for each segment, and its one-deletion neighbours.

    A segment's key is an order-free sum of its shingles.  Segments of no shingle (of one at most
    where neighbours are indexed) get a key only if they are more than SPARE covers.  With ``first``,
    only so many segments are used.
    """
    m = plan.segments
    seed = np.uint64(mix(np.array([band * 0x1F123BB5 + 7], dtype=np.uint64))[0])
    spread = mix(shingles ^ seed)
    segment = (spread % np.uint64(m)).astype(np.int64)
    value = mix(spread + seed)
    count = np.bincount(segment, minlength=m)
    order = np.argsort(segment, kind="stable")
    prefix = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value[order], out=prefix[1:])
    ends = np.cumsum(count)
    sums = prefix[ends] - prefix[ends - count]
    tag = mix(np.arange(m, dtype=np.uint64) * np.uint64(3) + seed)
    used = np.arange(m) < (m if first is None else first)
    full = used & (count > 0)
    keys = [mix(sums[full] ^ tag[full])]
    near = np.arange(m) >= plan.exact
    if plan.near:
        inside = near[segment] & (count[segment] > 1)
        keys.append(mix((sums[segment[inside]] - value[inside]) ^ tag[segment[inside]]))
    weak = used & (count <= near)
    if (weak * (1 + near)).sum() > SPARE:
        keys.append(mix(tag[weak] + np.uint64(1)))
    return np.unique(np.concatenate(keys))


def keys_of(shingles: np.ndarray, sim: Similarity) -> list[tuple[np.ndarray, int]]:
    """Keys of a set under its own band and, where a linked larger set may be there, under the next.

    With each the number of keys that a linked set of that band shares at least: SPARE segments may
    have none, and every difference spoils one segment at most.  Where all segments are exact, a set
    uses only the first ones, as many as its own linked sets can differ in (and the reserve): of two
    linked sets the one that uses fewer still uses enough.
    """
    lows, n = bands(sim, 1 << 40), len(shingles)
    b = int(np.searchsorted(lows, n, side="right")) - 1
    out = []
    for band in (b, b + 1):
        plan = _plans(sim)(band)
        if band > b and (plan is None or n * sim.den < sim.num * lows[band]):
            out.append((np.zeros(0, dtype=np.uint64), 1))
        elif plan is None:
            out.append((mix(np.array([shingles.sum(dtype=np.uint64)]) + np.uint64(band)), 1))
        else:
            most = sim.differences(n + min(lows[band + 1] - 1, sim.largest(n)))
            first = None if plan.near else min(plan.exact, most + SPARE + plan.need)
            out.append((segment_keys(shingles, band, plan, first), plan.need))
    return out


@cache
def _plans(sim: Similarity):
    lows = bands(sim, 1 << 40)
    return cache(lambda band: allocate(lows[band], lows[band + 1], sim))


def parity_sketch(shingles: np.ndarray, sim: Similarity) -> np.ndarray:
    """Whether each of some buckets (8 to 16 for each possible difference) holds an odd number of shingles.

    Two sketches differ in no more buckets than their sets differ in shingles.
    """
    size = 256
    while size < 8 * sim.differences(2 * len(shingles)):
        size *= 2
    at = (mix(shingles + np.uint64(0x632BE59BD9B4E019)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """Sketches of ``words`` words or more, all brought to that size."""
    out = np.zeros((len(sketches), words), dtype=np.uint64)
    for row, s in zip(out, sketches, strict=True):
        row[:] = np.bitwise_xor.reduce(s.reshape(-1, words), axis=0)
    return out


def _distances(n: np.ndarray, sketches: list[np.ndarray], a: np.ndarray, b: np.ndarray, sim: Similarity) -> np.ndarray:
    """In how many buckets the sketches of pairs of rows (a, b) differ; -1 if they, or the sizes, rule out a link."""
    keep = np.minimum(n[a], n[b]) * sim.den >= np.maximum(n[a], n[b]) * sim.num
    words = np.array([len(s) for s in sketches])
    least = np.minimum(words[a], words[b])
    most = (n[a] + n[b]) * (sim.den - sim.num) // (sim.den + sim.num)
    out = np.full(len(a), -1, dtype=np.int64)
    for w in np.unique(least[keep]).tolist():
        rows = np.flatnonzero(words >= w)
        place = np.zeros(len(words), dtype=np.int64)
        place[rows] = np.arange(len(rows))
        table = _folded([sketches[i] for i in rows.tolist()], w)
        pairs = np.flatnonzero(keep & (least == w))
        step = max(1, 4_000_000 // w)
        for at in range(0, len(pairs), step):
            p = pairs[at : at + step]
            out[p] = np.bitwise_count(table[place[a[p]]] ^ table[place[b[p]]]).sum(axis=1, dtype=np.int64)
    out[out > most] = -1
    return out


def _nearest(a: np.ndarray, b: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` nearest ones of one of their two rows."""
    keep = np.zeros(len(a), dtype=bool)
    for side in (a, b):
        order = np.lexsort((distance, side))
        first = np.concatenate(([True], side[order][1:] != side[order][:-1]))
        since = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        keep[order[since < most]] = True
    return keep


def words_of(raw: np.ndarray | None) -> list[bytes]:
    """The lower-cased words of a text."""
    return [] if raw is None else raw.tobytes().lower().split()


def shingles_of(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """The set itself: distinct ``n``-word shingles, or the whole of fewer words."""
    n = min(n, len(words))
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if n else set()


def _sketch(docs: DataFrame, n: int, sim: Similarity) -> DataFrame:
    """(doc, n, s1, s2, keys, own, need0, need1, odd): the set's size, a 128-bit digest of the words, the
    set's keys, how many of them are under its own band, how many a linked set shares under each band,
    and the parity sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            rows, keys, signs, odd = [], [], [], []
            for raw in byte_views(batch["text"]):
                words = words_of(raw)
                found = shingle_set(raw, n)
                (mine, need0), (next_, need1) = keys_of(found, sim) if len(found) else ((found, 1), (found, 1))
                rows.append((len(shingles_of(words, n)), len(mine), need0, need1))
                signs.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                odd.append(parity_sketch(found, sim).tobytes())
                keys += [mine, next_]
            sizes = np.array([len(k) for k in keys], dtype=np.int64).reshape(-1, 2).sum(axis=1)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
            sign = np.frombuffer(b"".join(signs), dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(columns[0]), pa.array(sign[0]), pa.array(sign[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *map(pa.array, columns[1:]), pa.array(odd, pa.binary())],
                ["doc", "n", "s1", "s2", "keys", "own", "need0", "need1", "odd"],
            )

    return docs.mapInArrow(sketch, "doc long, n long, s1 long, s2 long, keys array<long>, own long, need0 long, need1 long, odd binary")


def _verify(pairs: DataFrame, docs: DataFrame, n: int, sim: Similarity) -> DataFrame:
    """The pairs (a, b) that link, by the shingles of their whole texts."""
    wanted = write_scratch(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "wanted")
    ids = wanted.count()
    texts = write_scratch(docs.join(F.broadcast(wanted) if ids <= BROADCAST_ROWS else wanted, "doc", "left_semi"), "texts")
    drop_scratch(wanted)
    if texts.count() > ids:  # identifiers that repeat
        texts, rows = write_scratch(texts.distinct(), "texts"), texts
        drop_scratch(rows)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, set()
            for a, one, other in zip(batch["a"].to_pylist(), byte_views(batch["x"]), byte_views(batch["y"]), strict=True):
                if a != last or not np.array_equal(one, kept):
                    last, kept, x = a, one, shingles_of(words_of(one), n)
                y = shingles_of(words_of(other), n)
                keep.append(sim.linked(len(x), len(y), len(x & y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = texts.select(F.col("doc").alias("b"), F.col("text").alias("y")).join(pairs, "b").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("x")), "a")
    links = write_scratch(rows.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct(), "links")
    drop_scratch(texts)
    return links


def _not_ruled_out(pairs: DataFrame, odds: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for c in ("x", "y") for s in batch[c]]
            sizes = np.concatenate((batch["nx"].to_numpy(), batch["ny"].to_numpy()))
            rows = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(_distances(sizes, sketches, rows, rows + batch.num_rows, sim) >= 0))

    x = odds.select(F.col("doc").alias("a"), F.col("n").alias("nx"), F.col("odd").alias("x"))
    y = odds.select(F.col("doc").alias("b"), F.col("n").alias("ny"), F.col("odd").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "nx", "ny", "x", "y").mapInArrow(rule, "a long, b long")


def _open(rows: DataFrame, labels: DataFrame | None, seed: int) -> DataFrame:
    """(key, doc, n, label, members, pivot, pivot_n, pivot_label) of the keys that hold more than one label."""
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    label = F.col("doc") if labels is None else F.coalesce("component", "doc")
    marked = write_scratch(rows.select("key", "doc", "n", label.alias("label")), "marked")
    order = F.xxhash64("doc", F.lit(seed)).alias("h")
    mixed = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"), F.min(F.struct(order, "doc", "n", "label")).alias("p"))
    mixed = write_scratch(mixed.where("lo < hi").select("key", "members", F.col("p.doc").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.label").alias("pivot_label")), "mixed")
    out = write_scratch(marked.join(mixed, "key"), "open")
    drop_scratch(marked, mixed)
    return out


def _pivot_pairs(rows: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b): each set with the pivot of another label that it shares most keys with."""
    near_size = F.least("n", "pivot_n") * sim.den >= F.greatest("n", "pivot_n") * sim.num
    votes = rows.where((F.col("label") != F.col("pivot_label")) & near_size).groupBy("doc", "pivot").agg(F.count("*").alias("votes"))
    best = votes.groupBy("doc").agg(F.max(F.struct("votes", (-F.col("pivot")).alias("p"))).alias("best"))
    return best.select((-F.col("best.p")).alias("a"), F.col("doc").alias("b"))


def _other_pairs(rows: DataFrame, odds: DataFrame, sim: Similarity, most: int) -> DataFrame:
    """(a, b): pairs of sets with different labels and a common key that sketches do not rule out.

    All such pairs are compared: sets of one key in a task, those of very common keys in pairs of
    blocks; blocks are by label, so most blocks of a group that is joined already need no comparison.
    Of the pairs that may link, those among the ``most`` nearest of a set in its task become rows;
    where that leaves some out, a row (key) says that the key needs another round.
    """
    bins = max(1, rows.count() // TASK_ROWS)
    none = F.lit(-1).cast("long")
    few = rows.where(F.col("members") <= BLOCK).select("key", F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin"), none.alias("first"), none.alias("second"), F.lit(0).alias("side"), "doc", "label")
    many = rows.where(F.col("members") > BLOCK)
    # Blocks of a very common key: sets in order of label, those of one label by hash.
    sizes = many.groupBy("key", "label").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("key").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    sizes = sizes.select("key", "label", F.expr(f"before DIV {BLOCK}").alias("block0"), F.expr(f"(before + c - 1) DIV {BLOCK}").alias("block1"))
    placed = many.join(sizes, ["key", "label"]).withColumn("block", F.col("block0") + F.pmod(F.xxhash64("doc"), F.col("block1") - F.col("block0") + 1))
    placed = write_scratch(placed.select("key", "doc", "n", "label", "block"), "placed")
    blocks = placed.groupBy("key", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    other = blocks.select("key", *(F.col(c).alias(f"o_{c}") for c in ("block", "lo", "hi", "l0", "l1")))
    sized = (F.col("hi") * sim.den >= F.col("o_lo") * sim.num) & (F.col("o_hi") * sim.den >= F.col("lo") * sim.num)
    meets = (F.col("block") <= F.col("o_block")) & sized & ((F.col("l0") != F.col("l1")) | (F.col("o_l0") != F.col("o_l1")) | (F.col("l0") != F.col("o_l0")))
    met = blocks.join(other, "key").where(meets).select("key", "block", "o_block")
    apart = F.col("block") < F.col("o_block")
    at = F.array_distinct(F.array(F.struct("block", F.when(apart, 1).otherwise(0).alias("side")), F.struct(F.col("o_block").alias("block"), F.when(apart, 2).otherwise(0).alias("side"))))
    sides = met.select("key", F.col("block").alias("first"), F.col("o_block").alias("second"), F.explode(at).alias("at")).select("key", "first", "second", "at.block", "at.side")
    dealt = few.unionByName(placed.join(sides, ["key", "block"]).select("key", F.xxhash64("key").alias("bin"), "first", "second", "side", "doc", "label"))
    dealt = dealt.join(odds, "doc")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "side"], kind="stable")
        key, side = frame["key"].to_numpy(), frame["side"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        left, right = [], []
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
            split = int(np.searchsorted(side[at:end], 2))
            if 0 < split < end - at:
                i, j = np.divmod(np.arange(split * (end - at - split)), end - at - split)
                j += split
            else:
                i, j = _triangle(end - at)
            left.append(at + i)
            right.append(at + j)
        a, b = np.concatenate(left), np.concatenate(right)
        label, doc = frame["label"].to_numpy(), frame["doc"].to_numpy()
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
        distance = _distances(frame["n"].to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in frame["odd"]], a, b, sim)
        may = distance >= 0
        a, b, distance = a[may], b[may], distance[may]
        near = _nearest(a, b, distance, most)
        left_out = np.unique(key[a[~near]])
        a, b = doc[a[near]], doc[b[near]]
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        found = pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]}, dtype="Int64")
        return pd.concat([found, pd.DataFrame({"key": left_out}, dtype="Int64")]).reindex(columns=["a", "b", "key"])

    out = write_scratch(dealt.groupBy("bin", "first", "second").applyInPandas(compare, "a long, b long, key long").distinct(), "compared")
    drop_scratch(placed)
    return out


@cache
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _candidates(full: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, doc, n): keys that two sets or more have, of sets that could share enough of them."""
    copies = small_side(full.select("doc", "s1", "s2").join(reps.withColumnRenamed("rep", "doc"), ["doc", "s1", "s2"], "left_anti"), "copies")
    entries = full.join(copies, ["doc", "s1", "s2"], "left_anti")
    entries = entries.select("doc", "n", "own", "need0", "need1", F.posexplode("keys").alias("at", "key"))
    under = (F.col("at") >= F.col("own")).cast("int")
    entries = entries.select("key", "doc", "n", under.alias("under"), F.when(under == 0, F.col("need0")).otherwise(F.col("need1")).alias("need"))
    common = write_scratch(entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "common")
    met = entries.join(common, "key")
    # Linked sets share `need` keys, so all but the need - 1 most common keys of a set are enough to
    # meet by: the rarest key that both have is among them.  A set with fewer keys than that goes.
    by_doc = Window.partitionBy("doc", "under")
    met = met.withColumn("rank", F.row_number().over(by_doc.orderBy("members", "key"))).withColumn("c", F.count("*").over(by_doc)).withColumn("least", F.min("need").over(by_doc))
    kept = write_scratch(met.where("rank <= c - least + 1").select("key", "doc", "n"), "kept")
    again = write_scratch(kept.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key"), "again")
    shared = write_scratch(kept.join(again, "key"), "shared")
    drop_scratch(copies, common, kept, again)
    return shared


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest linked identifier).

    Sets are the distinct ``n``-word shingles of the text with A-Z lower-cased; a shorter text is one
    shingle; null, empty and wordless texts have no shingles and link with nothing; very long texts
    are taken whole.  Two rows link when intersection / union >= num / den, so equal sets do.  Texts
    of equal words are joined through one of them, and all other links are found, up to links within
    what is already one component.  Rows with one identifier are one node, which links when one of
    their texts does.  A null identifier is its own component.  An empty table gives no rows.
    Columns other than the two named are not read.
    """
    sim = Similarity(num, den)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sketches = write_scratch(_sketch(texts, n, sim), "sketches")
    full = sketches.where("n > 0 and doc is not null")
    # Copies fold into their smallest identifier, before anything is paired.
    reps = write_scratch(full.groupBy("s1", "s2").agg(F.min("doc").alias("rep")), "reps")
    shared = _candidates(full, reps)
    odds = full.select("doc", "n", "odd")

    # First each set against the pivot that it shares most keys with, which joins most of a group,
    # then against other pivots; then all pairs of what keys hold together and components do not.
    labels, rest, most = None, shared, 0
    for turn in count():
        rows = _open(rest, labels, turn)
        drop_scratch(rest)
        if most:
            compared = _other_pairs(rows, odds, sim, most)
            pairs = compared.where("a is not null").select("a", "b")
            rest = write_scratch(rows.join(compared.where("key is not null").select("key"), "key", "left_semi").select("key", "doc", "n"), "rest")
            drop_scratch(rows)
        else:
            rest = rows
            compared = pairs = write_scratch(_not_ruled_out(_pivot_pairs(rows, sim), odds, sim), "pairs")
        links = _verify(pairs, texts, n, sim)
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        before = labels
        labels = connected_components(edges if before is None else edges.union(before.select("node", "component")))
        few_join = links.count() * JOINS <= pairs.count()
        drop_scratch(compared, links, *([] if before is None else [before]))
        if most and rest.isEmpty():
            break
        most = most * WIDER if most else int(few_join or turn == ROUNDS)
    drop_scratch(rest)
    classes = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("doc", "n", "s1", "s2").join(classes, ["s1", "s2"], "left")
    out = write_scratch(out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")), "components")
    drop_scratch(sketches, reps, labels)
    return out


def keep_one_of_similar(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its component, with all their columns.

    Rows that repeat an identifier share one decision: they stay if one of them does.  Rows with a
    null identifier stay.
    """
    found = jaccard_components(docs, n, num, den, id_col, text_col)
    gone = found.groupBy(id_col).agg(F.min("component_id").alias("least")).where(F.col(id_col) != F.col("least"))
    dropped = small_side(gone.select(id_col), "dropped")
    drop_scratch(found)
    return docs.join(dropped, id_col, "left_anti")
