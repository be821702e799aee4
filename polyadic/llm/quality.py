"""Regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop_scratch, small_side, write_scratch
from .textarrays import byte_views, lowered, span_hashes, word_bounds

FEATURES = ("words", "word_length", "length_spread", "types", "top_word", "same_neighbour", "capitals", "symbols", "bare_symbols", "symbol_ends", "marks", "digits", "lines", "line_types")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,;:?'\"-()"]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT | _MARK)


def _logit(part: float, whole: float) -> float:
    """Log odds of a share, smoothed so that none and all stay finite."""
    return float(np.log((part + 0.5) / (whole - part + 0.5))) if whole else 0.0


def statistics_of(raw: np.ndarray | None) -> list[float]:
    """The transformed statistics FEATURES of a whole text; zeros for null, empty and wordless texts."""
    starts, ends = word_bounds(raw) if raw is not None and len(raw) else ((), ())
    n = len(starts)
    if not n:
        return [0.0] * len(FEATURES)
    lengths = ends - starts
    words = span_hashes(lowered(raw), starts, ends)
    kinds, counts = np.unique(words, return_counts=True)
    symbol, letter = _SYMBOL[raw], _LETTER[raw]
    letters_before = np.concatenate(([0], np.cumsum(letter)))
    line_ends = np.flatnonzero(raw == 10)
    line_starts = np.concatenate(([0], line_ends + 1))
    line_ends = np.append(line_ends, len(raw))
    full = line_ends > line_starts
    lines = int(full.sum())
    line_types = len(np.unique(span_hashes(raw, line_starts[full], line_ends[full])))
    return [
        float(np.log1p(n)),
        float(np.log(lengths.mean())),
        float(np.log(lengths.std() + 0.1)),
        float(np.log(len(kinds)) / np.log(n + 1)),
        _logit(counts.max(), n),
        _logit((words[1:] == words[:-1]).sum(), n),
        _logit(_UPPER[raw].sum(), letter.sum()),
        _logit(symbol.sum(), len(raw)),
        _logit((letters_before[ends] == letters_before[starts]).sum(), n),
        _logit(symbol[ends - 1].sum(), n),
        _logit(_MARK[raw].sum(), len(raw)),
        _logit(_DIGIT[raw].sum(), len(raw)),
        float(np.log(lines / n)),
        _logit(line_types, lines),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = np.array([statistics_of(raw) for raw in byte_views(batch["text"])], dtype=np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch["doc"], *map(pa.array, table.T)], ["doc", *FEATURES])


@dataclass
class Discriminant:
    """Two Gaussian classes; each keeps its mean, inverse Cholesky factor and log determinant."""

    prior: float
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row: a difference of Mahalanobis log densities."""
        log_density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        log_odds = log_density[1] - log_density[0] + self.prior
        return 1.0 / (1.0 + np.exp(-np.clip(log_odds, -60, 60)))


def fit(train: DataFrame, label: str, shrinkage: float = 0.1, floor: float = 1e-2) -> Discriminant:
    """Fit on all labelled rows: counts, sums and products of the features are one small aggregate.

    Each class covariance is shrunk towards the diagonal of the pooled one by ``shrinkage``; ``floor``
    is added to every variance.  A class without rows takes the pooled figures.
    """
    k = len(FEATURES)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col(f)).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {r[label]: r for r in train.groupBy(label).agg(F.count("*").alias("n"), *sums).collect()}  # two rows
    n, first, second = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for c in (0, 1):
        if c in rows:
            n[c] = rows[c]["n"]
            first[c] = [rows[c][f"s{i}"] for i in range(k)]
            for i, j in pairs:
                second[c, i, j] = second[c, j, i] = rows[c][f"p{i}_{j}"]
    total = max(n.sum(), 1)
    centre = first.sum(axis=0) / total
    pooled = second.sum(axis=0) / total - np.outer(centre, centre)
    target = np.diag(np.maximum(np.diag(pooled), 0))
    means, factors, logdets = [], [], []
    for c in (0, 1):
        mean = first[c] / n[c] if n[c] else centre
        own = second[c] / n[c] - np.outer(mean, mean) if n[c] > k else pooled
        shrunk = (1 - shrinkage) * own + shrinkage * target + floor * np.eye(k)
        low = np.linalg.cholesky(shrunk)
        means.append(mean)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(float(np.log((n[1] + 1) / (n[0] + 1))), means, factors, logdets)


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, shrinkage: float = 0.1) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted.

    ``learn`` is a condition on ``id_col``: labels of other rows are never read.  Null and empty
    texts get the score of all-zero statistics; rows that repeat an identifier are scored each;
    labels that are null or neither 0 nor 1 are left out; with no labels at all every score is 0.5.
    Columns other than those named are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    measured = write_scratch(texts.mapInArrow(_measure, "doc long, " + ", ".join(f"{f} double" for f in FEATURES)), "statistics")
    known = labels.where(F.col(label_col).isin(0, 1))
    known = (known if learn is None else known.where(learn)).select(F.col(id_col).cast("long").alias("doc"), F.col(label_col).alias("label"))
    model = fit(measured.join(known, "doc"), "label", shrinkage)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = model.score(f[list(FEATURES)].to_numpy())
            yield pd.DataFrame({"doc": f["doc"], "score": s, "predicted": (s >= threshold).astype("int32")})

    return measured.mapInPandas(score, "doc long, score double, predicted int").withColumnRenamed("doc", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, shrinkage: float = 0.1) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns; learned from all labels.

    Null and empty texts are scored like any other.  Every row is judged by itself, in one pass.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc"), F.col(label_col).alias("label"))
    texts = texts.join(small_side(known.select("doc").distinct(), "labelled"), "doc", "left_semi")  # all that fit() reads
    measured = write_scratch(texts.mapInArrow(_measure, "doc long, " + ", ".join(f"{f} double" for f in FEATURES)), "statistics")
    model = fit(measured.join(known, "doc"), "label", shrinkage)
    drop_scratch(measured)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([statistics_of(raw) for raw in byte_views(batch[text_col])], dtype=np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(table) >= threshold))

    return docs.mapInArrow(judge, docs.schema)
