"""Phrase collocation mining over a dictionary of frequent words.

Words that occur often enough get numbers; pieces of text break where any other word stands, as no
frequent phrase can reach across one.  What is left are runs of numbers, whose n-grams are packed into
binary keys of fixed width.  Tasks sort and count their own keys, send them to ranges of keys set by
sampled splitters, and each range is sorted again and its runs of equal keys are summed.  Phrases of n
words are looked for only where both their phrases of n - 1 words may be frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyadic.tensor import positions

from .scratch import drop_scratch, write_scratch
from .textarrays import byte_views

#: Texts are cut into words in slices of about this many bytes, and n-grams counted in blocks of so many numbers.
SLICE_BYTES, BLOCK_IDS = 4_000_000, 1_500_000
#: A dictionary of this many bytes at most is broadcast; a larger one is joined.
DICTIONARY_BYTES = 64_000_000
#: Bits of the filter over frequent (n-1)-grams, for each of them and in all.  It may let too many n-grams pass, never too few.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
#: Rows and evenly spaced keys of a block that splitters are chosen from, n-grams of a range, and most ranges for each core.
SAMPLE_ROWS, SAMPLE_KEYS, RANGE_KEYS, CORE_RANGES = 24, 4_096, 1_500_000, 32
#: Words of a block where the dictionary is joined.
JOIN_BLOCK = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09]] = True
_PIECES, _WORDS = r"[.,;:!?\x0A-\x0D]+", r"[ \x09]+"
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(views: list[np.ndarray]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Of texts: their words, lower-cased and dictionary-encoded; whether a piece begins at each; whose text it is in."""
    raw = np.empty(sum(map(len, views)) + len(views) + 1, dtype=np.uint8)
    raw[0] = 0x0A
    ends, at = np.zeros(len(views), dtype=np.int64), 1
    for k, v in enumerate(views):  # with a line end after each text
        raw[at : at + len(v)] = v
        raw[at + len(v)] = 0x0A
        at += len(v) + 1
        ends[k] = at
    raw = _LOWER[raw]
    broken = _BREAK[raw]
    inside = ~(broken | _GAP[raw])
    step = np.diff(inside.view(np.int8))
    starts, stops = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    lengths = stops - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    letters = raw[inside]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    breaks = np.cumsum(broken, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    first = np.ones(len(starts), dtype=bool)
    first[1:] = breaks[1:] != breaks[:-1]
    return words.dictionary_encode(), first, np.searchsorted(ends, starts, side="right")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[str]]]:
    """Texts and their languages, in slices of bounded size (or of one text)."""
    for batch in batches:
        held, langs, size = [], [], 0
        for view, lang in zip(byte_views(batch["text"]), batch["lang"].to_pylist(), strict=True):
            if held and size + len(view) > SLICE_BYTES:
                yield held, langs
                held, langs, size = [], [], 0
            held.append(view)
            langs.append(lang)
            size += len(view)
        if held:
            yield held, langs


def _coded(langs: list[str]) -> tuple[list[str], np.ndarray]:
    names = sorted(set(langs))
    code = {l: k for k, l in enumerate(names)}
    return names, np.fromiter((code[l] for l in langs), dtype=np.int64, count=len(langs))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for views, langs in _slices(batches):
        words, _, text = _words(views)
        if not len(words):
            continue
        names, code = _coded(langs)
        both = words.indices.to_numpy() * np.int64(len(names)) + code[text]
        if len(names) * len(words.dictionary) <= 8 * len(both) + 1_000_000:
            counts = np.bincount(both)
            keys = np.flatnonzero(counts)
            counts = counts[keys]
        else:
            keys, counts = np.unique(both, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(names, dtype=object)[keys % len(names)], pa.string()), words.dictionary.take(pa.array(keys // len(names))).cast(pa.string()), pa.array(counts)], names=["lang", "word", "f"]
        )


def _encode(known: dict[str, tuple[pa.Array, np.ndarray]], form: str):
    """Texts as runs of word numbers: 0 where a piece ends or a word has none."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for views, langs in _slices(batches):
            words, first, text = _words(views)
            if not len(words):
                continue
            names, code = _coded(langs)
            indices, lang = words.indices.to_numpy(), code[text]
            ids = np.zeros(len(indices), dtype=np.int64)
            for k, name in enumerate(names):
                if name not in known:
                    continue
                spelt, numbers = known[name]
                there = pc.index_in(words.dictionary.cast(pa.string()), value_set=spelt)
                table = np.where(there.is_valid().to_numpy(zero_copy_only=False), numbers[there.fill_null(0).to_numpy()], 0)
                here = lang == k
                ids[here] = table[indices[here]]
            yield _as_row(ids, first, None, form)

    return encode


def _as_row(ids: np.ndarray, first: np.ndarray, own: int | None, form: str) -> pa.RecordBatch:
    """One row with a 0 before every piece; ``own`` is how many of ``ids`` may begin an n-gram."""
    at = np.arange(len(ids)) + np.cumsum(first)
    out = np.zeros(len(ids) + int(first.sum()) + 1, dtype=form)
    out[at] = ids
    begins = len(out) if own is None else int(at[own]) if own < len(at) else len(out)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)  # one 0 does for many
    return pa.RecordBatch.from_arrays([pa.array([out[keep].tobytes()], pa.binary()), pa.array([int(keep[:begins].sum())], pa.int64())], names=["ids", "own"])


def _joined(docs: DataFrame, dictionary: DataFrame, form: str) -> DataFrame:
    """What _encode() gives, by a join with a dictionary of any size.

    Words go to blocks by their place in a text, the first four of a block also to the one before, so
    that neither a long text nor a frequent word is one task's work.
    """
    whole = docs.withColumn("uid", F.monotonically_increasing_id())
    low = F.translate("text", _UPPER, _LOWERED)
    pieces = whole.select("uid", "lang", F.posexplode(F.split(low, _PIECES)).alias("piece", "p"))
    words = pieces.select("uid", "lang", "piece", F.posexplode(F.filter(F.split("p", _WORDS), lambda w: w != "")).alias("at", "word"))
    numbered = words.join(dictionary, ["lang", "word"], "left").select("uid", "piece", "at", F.coalesce("id", F.lit(0)).cast("long").alias("id"))
    block = F.floor(F.col("at") / JOIN_BLOCK).cast("int")
    early = (F.col("at") % JOIN_BLOCK < 4) & (F.col("at") >= JOIN_BLOCK)
    dealt = numbered.select("uid", "piece", F.explode(F.when(early, F.array(block, block - 1)).otherwise(F.array(block))).alias("block"), F.struct("at", "id").alias("w"))
    runs = dealt.groupBy("uid", "piece", "block").agg(F.sort_array(F.collect_list("w")).alias("w"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, block in zip(batch["w"], batch["block"].to_pylist(), strict=True):
                at, ids = (w.values.field(k).to_numpy() for k in (0, 1))
                yield _as_row(ids, np.arange(len(ids)) == 0, int((at < (block + 1) * JOIN_BLOCK).sum()), form)

    return runs.select("w", "block").mapInArrow(rows, "ids binary, own long")


def _scrambled(parts: list[np.ndarray], bits: int) -> np.ndarray:
    """Where n-grams are in a filter of 2 ** bits bits."""
    total = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        total = (total ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return (total * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _runs(parts: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct n-grams and their counts, by a sort and the lengths of runs."""
    n = len(parts[0])
    if not n:
        return parts, np.zeros(0, np.int64)
    if len(parts) == 2 and int(parts[0].max()) < 2**32 and int(parts[1].max()) < 2**32:
        packed = (parts[0].astype(np.uint64) << np.uint64(32)) | parts[1].astype(np.uint64)
        if counts is None:
            packed.sort()
        else:
            order = np.argsort(packed, kind="stable")
            packed, counts = packed[order], counts[order]
        edge = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
        out = [(packed[edge] >> np.uint64(32)).astype(np.int64), (packed[edge] & np.uint64(2**32 - 1)).astype(np.int64)]
    else:
        order = np.lexsort(parts[::-1])
        parts = [p[order] for p in parts]
        counts = counts[order] if counts is not None else None
        change = np.ones(n, dtype=bool)
        change[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in parts])
        edge = np.flatnonzero(change)
        out = [p[edge] for p in parts]
    sizes = np.diff(np.append(edge, n)) if counts is None else np.add.reduceat(counts, edge)
    return out, sizes.astype(np.int64)


def _grams(n: int, bitmap: np.ndarray | None, bits: int, form: str):
    """From binary rows of word numbers: each block's n-grams that may be frequent, and their counts."""

    def of_block(ids: np.ndarray, begins: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        if len(ids) < n:
            return [np.zeros(0, form)] * n, np.zeros(0, np.int64)
        starts = len(ids) - n + 1
        good = begins[:starts] & (ids[:starts] != 0)
        for k in range(1, n):
            good &= ids[k : k + starts] != 0
        at = np.flatnonzero(good)
        if bitmap is not None:
            at = at[_has(bitmap, _scrambled([ids[at + k] for k in range(n - 1)], bits))]
            at = at[_has(bitmap, _scrambled([ids[at + k] for k in range(1, n)], bits))]
        return _runs([ids[at + k] for k in range(n)])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        held, begins, size = [], [], 0
        for batch in batches:
            for raw, own in zip(batch["ids"], batch["own"].to_pylist(), strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype=form)
                for at in range(0, len(ids), BLOCK_IDS):  # a long row in parts that overlap by n - 1
                    part = ids[at : at + BLOCK_IDS + n - 1]
                    may = np.arange(at, at + len(part)) < min(own, at + BLOCK_IDS)
                    held += [part, np.zeros(1, form)]
                    begins += [may, np.zeros(1, bool)]
                    size += len(part)
                    if size >= BLOCK_IDS:
                        yield of_block(np.concatenate(held), np.concatenate(begins))
                        held, begins, size = [], [], 0
        if held:
            yield of_block(np.concatenate(held), np.concatenate(begins))

    return blocks


def _count_grams(runs: DataFrame, total: int, n: int, least: int, bitmap: np.ndarray | None, bits: int, form: str) -> DataFrame:
    """(key, f): n-grams with at least ``least`` occurrences; keys are the words' numbers as 8 bytes each, most significant first."""
    spark = runs.sparkSession
    blocks = _grams(n, bitmap, bits, form)
    count = runs.count()

    def columns(parts: list[np.ndarray]) -> bytes:
        return b"".join(p.astype(form).tobytes() for p in parts)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, _ in blocks(batches):
            step = max(1, len(parts[0]) // SAMPLE_KEYS)
            yield pa.RecordBatch.from_arrays([pa.array([columns([p[step // 2 :: step] for p in parts])], pa.binary())], names=["keys"])

    # The number and size of what is sampled are bounded.
    some = runs.sample(SAMPLE_ROWS / count, seed=11) if count > SAMPLE_ROWS else runs
    taken = [np.frombuffer(r["keys"], form).reshape(n, -1) for r in some.mapInArrow(sample, "keys binary").collect()]
    sampled, _ = _runs(list(np.concatenate(taken, axis=1)) if taken else [np.zeros(0, form)] * n)
    most = len(sampled[0])
    ranges = min(max(-(-total // RANGE_KEYS), 2), spark.sparkContext.defaultParallelism * CORE_RANGES, max(1, most))
    splitters = list(zip(*(s[np.linspace(0, most - 1, ranges + 1).astype(int)[1:-1]].tolist() for s in sampled))) if most else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, counts in blocks(batches):
            edges = [0]
            for s in splitters:  # among the first words, then among the second ones of the same first, and so on
                low, high = 0, len(counts)
                for p, x in zip(parts, s):
                    low, high = low + int(np.searchsorted(p[low:high], x)), low + int(np.searchsorted(p[low:high], x, side="right"))
                edges.append(low)
            edges.append(len(counts))
            rows = [(r, a, b) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _, _ in rows], pa.int32()), pa.array([columns([p[a:b] for p in parts]) for _, a, b in rows], pa.binary()), pa.array([counts[a:b].astype("<u4").tobytes() for _, a, b in rows], pa.binary())],
                names=["range", "keys", "counts"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def summed() -> tuple[list[np.ndarray], np.ndarray]:
            return _runs(list(np.concatenate(keys, axis=1)), np.concatenate(counts))

        for batch in batches:
            for k, c in zip(batch["keys"], batch["counts"], strict=True):
                keys.append(np.frombuffer(k.as_buffer(), form).reshape(n, -1))
                counts.append(np.frombuffer(c.as_buffer(), "<u4").astype(np.int64))
                size += len(counts[-1])
            if size > 2 * RANGE_KEYS:  # sum up what came so far
                parts, sums = summed()
                keys, counts, size = [np.array(parts)], [sums], 0
        if keys:
            parts, sums = summed()
            good = sums >= least
            raw = np.column_stack([p[good] for p in parts]).astype(">u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[at : at + 8 * n] for at in range(0, len(raw), 8 * n)], pa.binary()), pa.array(sums[good], pa.int64())], names=["key", "f"])

    dealt = runs.mapInArrow(deal, "range int, keys binary, counts binary")
    return write_scratch(dealt.groupBy("range").applyInArrow(merge, "key binary, f long"), f"grams-{n}")


def _filter(frequent: DataFrame, n: int, count: int) -> tuple[np.ndarray, int]:
    """A bitmap of bounded size in which every frequent n-gram's bit is set."""
    bits = max(10, int(min(MOST_FILTER_BITS, max(1, count) * FILTER_BITS) - 1).bit_length())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for batch in batches:
            if len(batch):
                ids = np.frombuffer(b"".join(batch["key"].to_pylist()), dtype=">u8").reshape(-1, n)
                places = _scrambled([ids[:, k].astype(np.int64) for k in range(n)], bits)
                np.bitwise_or.at(bitmap, (places >> np.uint64(3)).astype(np.int64), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bitmap.tobytes()], pa.binary())], names=["bitmap"])

    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    few = max(1, min(8, count * 8 // (1 << bits) + 1))  # bitmaps come to the driver one by one
    for r in frequent.coalesce(few).mapInArrow(mark, "bitmap binary").toLocalIterator():
        bitmap |= np.frombuffer(r["bitmap"], np.uint8)
    return bitmap, bits


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Each language's ``top`` phrases: (lang, rank, phrase, a, l, r, n, score), numbers long.

    Texts are lower-cased (A-Z), split into pieces at . , ; : ! ? and line ends, and pieces into words
    at spaces and tabs.  n counts the words of a language (null: und), a is how often a phrase of 2 to
    ``longest`` words occurs within pieces, overlaps included; those with a >= ``least`` are
    candidates.  Cutting one after its first words gives l and r, the counts of both parts, and a
    score floor(1000 a n / (l r)); the lowest-scoring cut counts, ties to the shortest first part.
    Candidates whose words lie inside a longer one that occurs as often are dropped.  Phrases are
    ranked by score and a, both falling, and then by their UTF-8 bytes.  Null and empty texts have no
    words, texts of any length are read whole, repeated rows count again, and an empty table gives no
    rows.  Columns other than text and language are not read.
    """
    if not 2 <= longest <= 5 or least < 1:
        raise ValueError("need 2 <= longest <= 5 and least >= 1")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    counts = write_scratch(texts.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    totals = write_scratch(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = counts.where(F.col("f") >= least)
    numbered = positions(frequent.select(F.struct("lang", "word").alias("key")), "key", "id").select("key.lang", "key.word", (F.col("id") + 1).alias("id"))
    dictionary = write_scratch(numbered.join(frequent, ["lang", "word"]), "dictionary")
    drop_scratch(counts)
    size = dictionary.agg(F.sum(F.octet_length("word") + 16).alias("bytes"), F.sum("f").alias("occurrences")).first()
    form = "<u4" if dictionary.count() < 2**32 else "<i8"
    if (size["bytes"] or 0) <= dictionary_bytes:
        known: dict[str, tuple[pa.Array, np.ndarray]] = {}
        for lang, rows in dictionary.select("lang", "word", "id").toPandas().groupby("lang"):  # of a checked size
            known[lang] = (pa.array(rows["word"], pa.string()), rows["id"].to_numpy(np.int64))
        runs = texts.mapInArrow(_encode(known, form), "ids binary, own long")
    else:
        runs = _joined(texts, dictionary.select("lang", "word", "id"), form)
    runs = write_scratch(runs, "runs")

    found = dictionary.select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), "f")
    grams, bitmap, bits = [], None, 0
    for n in range(2, longest + 1):
        level = _count_grams(runs, int(size["occurrences"] or 0), n, least, bitmap, bits, form)
        grams.append(level)
        if n < longest:
            many = level.count()
            if not many:
                break
            bitmap, bits = _filter(level, n, many)
    drop_scratch(runs)
    candidates = grams[0]
    for level in grams[1:]:
        candidates = candidates.unionByName(level)
    every = found.unionByName(candidates)

    # Both parts of every cut are frequent, too.
    words = (F.octet_length("key") / 8).cast("int")
    cut = candidates.select("key", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), words - 1)).alias("k"))
    cut = cut.select("key", "a", "k", F.expr("substring(key, 1, 8 * k)").alias("left"), F.expr("substring(key, 8 * k + 1)").alias("right"))
    cut = cut.join(every.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(every.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    number = F.conv(F.hex(F.substring("key", 1, 8)), 16, 10).cast("long")
    cut = cut.withColumn("id", number).join(dictionary.select("id", "lang"), "id").join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")), wide("l") * wide("r")).cast("long")
    cut = cut.withColumn("score", score)
    lowest = cut.groupBy("key").agg(F.min_by(F.struct("lang", "a", "l", "r", "n", "score"), F.struct("score", "k")).alias("best"))
    lowest = lowest.select("key", "best.*")

    # A longer phrase that occurs as often has one with one more word, which occurs as often, too.
    longer = candidates.where(words > 2).select("f", F.explode(F.array(F.expr("substring(key, 1, octet_length(key) - 8)"), F.expr("substring(key, 9)"))).alias("key"))
    longer = longer.groupBy("key").agg(F.max("f").alias("longer"))
    kept = lowest.join(longer, "key", "left").where("longer is null or 100 * longer < 100 * a").drop("longer")
    spelt = kept.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.conv(F.hex(F.col("key").substr(i * 8 + 1, F.lit(8))), 16, 10).cast("long"))).alias("at", "id"))
    spelt = spelt.join(dictionary.select("id", "word"), "id").groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = kept.join(spelt, "key").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
