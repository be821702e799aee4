"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop_scratch, write_scratch

UNDETERMINED = "und"
#: Dictionaries are made from about this many labelled rows of each language, chosen by a hash of the
#: row, up to this many bytes; as many other rows show what margins right answers have.
ROWS_PER_LANGUAGE, DICTIONARY_BYTES = 400, 96_000
#: Dictionaries hold pieces of lines of this many characters at most, from anywhere in the texts.
PIECE_CHARS = 400
#: More languages than this are refused: all dictionaries go to every task.
MAX_LANGUAGES = 500
#: The share of right answers that a margin may reject.
WRONGLY_REJECTED = 0.01
#: Texts are compressed in blocks of this many bytes, each against the dictionary anew, so that a
#: long text's own past does not hide the language.
BLOCK_BYTES = 2_048
#: Rows that a language must have for some of them to be held back.
LEAST_HELD = 20
_LETTER = regex.compile(r"\p{L}")


def _labelled(docs: DataFrame, learn: Column | None, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """(lang, text, held): about ``rows`` rows of each language for its dictionary, and as many others (held).

    Of a language of fewer than LEAST_HELD rows none is held back, so that no dictionary is empty.
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    named = named if learn is None else named.where(learn)
    counts = named.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / (1 << 30) * F.col("n")
    chosen = named.select(id_col, F.col(text_col), F.col(lang_col).alias("lang")).join(F.broadcast(counts.limit(MAX_LANGUAGES + 1)), "lang")
    return chosen.where(place < 2 * rows).select("lang", F.lower(text_col).alias("text"), ((F.col("n") >= LEAST_HELD) & (place >= F.least(F.lit(float(rows)), F.col("n") * 0.75))).alias("held"))


def fit(docs: DataFrame, learn: Column | None, id_col: str, text_col: str, lang_col: str, rows: int, size: int) -> tuple[dict[str, bytes], DataFrame]:
    """A raw-content dictionary for each language, and the rows that were held back.

    Whole texts are cut into pieces on the executors; distinct pieces of a language, in the order of
    a hash, fill its dictionary.  Only dictionaries reach the driver.
    """
    sample = write_scratch(_labelled(docs, learn, id_col, text_col, lang_col, rows), "lang-sample")
    pieces = sample.where("not held").select("lang", F.explode(F.expr(f"regexp_extract_all(text, '[^\\\\n]{{1,{PIECE_CHARS}}}', 0)")).alias("piece")).distinct()
    pieces = pieces.select("lang", "piece", F.xxhash64("piece").alias("h"), (F.octet_length("piece") + 1).alias("bytes"))
    upto = Window.partitionBy("lang").orderBy("h", "piece").rowsBetween(Window.unboundedPreceding, -1)
    kept = pieces.withColumn("before", F.coalesce(F.sum("bytes").over(upto), F.lit(0))).where(F.col("before") < size)
    models: dict[str, list[str]] = {r["lang"]: [] for r in sample.select("lang").distinct().collect()}  # MAX_LANGUAGES + 1 rows at most
    if len(models) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    for r in kept.orderBy("lang", "before").select("lang", "piece").collect():  # `size` bytes a language
        models[r["lang"]].append(r["piece"])
    return {lang: "\n".join(p).encode()[:size] for lang, p in sorted(models.items())}, sample


@cache
def _compressors(contents: tuple[bytes, ...], level: int) -> list:
    params = {"level": level}
    out = []
    for content in contents:
        d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(**params)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, **params))
    return out


def _judge(text: str | None, coders: list) -> tuple[int, float]:
    """The place of the smallest encoding (-1: the text has no letter) and the share by which the next one is larger."""
    text = (text or "").lower()
    if not coders or not _LETTER.search(text):
        return -1, 0.0
    raw = memoryview(text.encode())
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in coders])
    best, *rest = np.sort(sizes)
    return int(sizes.argmin()), float(1.0 - best / rest[0]) if rest else 1.0


def identify(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float | None = None, level: int = 6, rows_per_language: int = ROWS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (0 to 1), rejected.

    The smallest encoding of the whole text names the language; ties go to the name that sorts
    first.  The score is the margin: the share by which the second smallest is larger.  An answer is
    rejected when its margin is below ``min_margin``; without that, below the margin that all but
    WRONGLY_REJECTED of the right answers have among learned rows outside the dictionaries.  Texts
    that are null or have no letter are UNDETERMINED, with a score of 0, and rejected; so is
    everything if no row names a language.  ``learn`` is a condition on columns of ``docs``: languages
    of other rows are never read.  Rows that repeat an identifier are judged each, very long texts
    are judged whole, and an empty table gives no rows.
    """
    models, sample = fit(docs, learn, id_col, text_col, lang_col, rows_per_language, dictionary_bytes)
    names, contents = list(models), tuple(models.values())

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _compressors(contents, level)
        for batch in batches:
            judged = [_judge(text, coders) for text in batch["text"].to_pylist()]
            right = [score for (k, score), lang in zip(judged, batch["lang"].to_pylist(), strict=True) if k >= 0 and names[k] == lang]
            yield pa.RecordBatch.from_arrays([pa.array(right, pa.float64())], ["score"])

    if min_margin is None:
        held = sample.where("held").select("lang", "text").mapInArrow(margins, "score double")
        min_margin = held.agg(F.percentile("score", F.lit(WRONGLY_REJECTED))).first()[0] or 0.0
    drop_scratch(sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _compressors(contents, level)
        for batch in batches:
            judged = [_judge(text.as_py(), coders) for text in batch["text"]]
            langs = [names[k] if k >= 0 else UNDETERMINED for k, _ in judged]
            scores = [score for _, score in judged]
            rejected = [k < 0 or score < min_margin for k, score in judged]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc", "lang_pred", "score", "rejected"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return texts.mapInArrow(judge, "doc long, lang_pred string, score double, rejected boolean").withColumnRenamed("doc", id_col)
