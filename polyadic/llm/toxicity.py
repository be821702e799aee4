"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop_scratch, write_scratch
from .textarrays import byte_views, gram_hashes, let_go, lowered, mix, span_hashes

BITS = 20
#: About this many labelled rows are learned from at most (chosen by a hash), in shards of SHARD_ROWS
#: rows and SHARD_CHARS characters on average at most; the shards' weights are averaged.
MAX_TRAIN_ROWS, SHARD_ROWS, SHARD_CHARS = 40_000, 10_000, 60_000_000
#: Words are also seen by their first bytes, so that compounds of one stem are one feature.
STEMS = (3, 4, 5, 6, 7)

_WORD = np.zeros(258, dtype=np.int8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def gram_indices(raw: np.ndarray | None) -> np.ndarray:
    """Hashed words, word pairs, pairs that leave a word out, and stems, of a whole text, with repeats.

    A word is a run of ASCII letters, digits and non-ASCII bytes; A-Z are lower-cased.
    """
    if raw is None or not len(raw):
        return np.zeros(0, dtype=np.int64)
    step = np.diff(_WORD[np.concatenate(([256], raw, [257]))])
    low, starts, ends = lowered(raw), np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    words = span_hashes(low, starts, ends)
    grams = [gram_hashes(words, 1), gram_hashes(words, 2), gram_hashes(words, 2, gap=1)]
    for k in STEMS:
        longer = starts[ends - starts > k]
        grams.append(mix(span_hashes(low, longer, longer + k) + np.uint64(k)))
    grams = np.concatenate(grams)
    return (grams >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1) -> np.ndarray:
    """Weights of presence features (the last one is the bias) after FTRL-proximal over ``rows`` of distinct indices."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i, y in zip(rows, labels, strict=True):
            w = weights(z[i], n[i])
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(z, n)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, w): the weights other than 0, learned from one shard's rows in an order by hash and label.

    Texts become indices as their batches come.  All indices are in one buffer, so a worker that is
    used again gives their memory back.
    """
    let_go()
    held, used, ends, docs, labels = np.zeros(1 << 22, dtype=np.int32), 0, [0], [], []
    for batch in batches:
        docs.append(batch["doc"].to_numpy())
        labels.append(batch["label"].to_numpy())
        for raw in byte_views(batch["text"]):
            found = np.unique(gram_indices(raw))
            if used + len(found) >= len(held):
                held.resize(len(held) + max(len(held) // 2, len(found) + 1), refcheck=False)
            held[used : used + len(found)], held[used + len(found)] = found, 1 << BITS  # the bias
            used += len(found) + 1
            ends.append(used)
    labels = np.concatenate(labels)
    order = np.lexsort((labels, mix(np.concatenate(docs).view(np.uint64))))
    w = ftrl([held[ends[k] : ends[k + 1]] for k in order.tolist()], labels[order])
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["i", "w"])


def fit(texts: DataFrame, known: DataFrame, max_rows: int = MAX_TRAIN_ROWS, shard_rows: int = SHARD_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights other than 0, learned from about ``max_rows`` labelled rows at most.

    Rows are chosen by a hash of identifier, text and label, and joined back by identifier and text,
    so a text never meets another text's label, and repeated rows are learned from once.
    """
    rows = texts.select("doc", F.xxhash64("text").alias("h"), F.length("text").alias("chars")).join(known.distinct(), "doc").groupBy("doc", "h", "chars", "label").agg(F.count("*").alias("c"))
    rows = write_scratch(rows, "labelled")
    n, chars, repeats = rows.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    share = min(1.0, max_rows / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64("doc", "h", "label"), F.lit(1 << 30)) < share * (1 << 30)).select("doc", "h", "label")
    # Few enough texts in a shard for one task, also where they are very long.
    shards = max(1, -(-int(n * share) // shard_rows), -(-int(chars * share) // SHARD_CHARS))
    train = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc", "h"])
    if repeats > 1:
        train = train.groupBy("doc", "h", "label").agg(F.first("text").alias("text"))
    train = train.select("doc", "text", F.col("label").cast("double").alias("label")).withColumn("shard", F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(shards)))

    learned = train.groupBy("shard").applyInArrow(_learn, "i long, w double")
    averaged = learned.groupBy("i").agg((F.sum("w") / shards).alias("w")).orderBy("i").toPandas()  # 2 ** BITS rows at most
    drop_scratch(rows)
    return averaged["i"].to_numpy(dtype=np.int64), averaged["w"].to_numpy(dtype=np.float64)


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted.

    ``learn`` is a condition on ``id_col``: labels of other rows are never read.  Null and empty
    texts get the score of the bias; rows that repeat an identifier are scored each; labels that are
    null or neither 0 nor 1 are left out; with no labels every score is 0.5; very long texts are
    scored whole, and an empty table gives no rows.  Columns other than those named are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1))
    known = (known if learn is None else known.where(learn)).select(F.col(id_col).cast("long").alias("doc"), F.col(label_col).alias("label"))
    scorer = _scorer(docs, *fit(texts, known, max_train_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = scorer()
        for batch in batches:
            s = score_of(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc", "score", "predicted"])

    return texts.mapInArrow(score, "doc long, score double, predicted int").withColumnRenamed("doc", id_col)


def _scorer(docs: DataFrame, at: np.ndarray, w: np.ndarray) -> Callable[[], Callable[[pa.Array], np.ndarray]]:
    """Makes, in a task, a function from texts to scores; the sparse weights are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((at, w))

    def start() -> Callable[[pa.Array], np.ndarray]:
        let_go()
        at, w = shared.value
        table = np.zeros((1 << BITS) + 1)
        table[at] = w
        used = table != 0

        def score_of(texts: pa.Array) -> np.ndarray:
            sums = []
            for raw in byte_views(texts):
                i = gram_indices(raw)
                sums.append(table[np.unique(i[used[i]])].sum() + table[-1])
            return 1.0 / (1.0 + np.exp(-np.clip(np.array(sums, dtype=np.float64), -60, 60)))

        return score_of

    return start


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns; learned from all labels.

    Null and empty texts are scored like any other.  Every row is judged by itself, in one pass.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc"), F.col(label_col).alias("label"))
    scorer = _scorer(docs, *fit(texts, known, max_train_rows))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = scorer()
        for batch in batches:
            yield batch.filter(pa.array(score_of(batch[text_col]) < threshold))

    return docs.mapInArrow(judge, docs.schema)
