"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (logs of counts and of smoothed
shares). Per class the labelled rows give a count, a sum and a sum of outer products,
added up map-side and then by key, so the driver sees a few hundred numbers whatever the
number of rows. A class's covariance is shrunk towards its own diagonal and towards the
pooled covariance. Scoring takes the Cholesky factors, computed once: a document's
log-density under a class is minus half the squared length of its whitened distance,
minus the log-determinant; the difference of the two plus the prior's log-odds gives the
probability of label 1.

All labelled rows outside the held-out fold train the model. Null and empty texts have
statistics like any others and are scored. Labels, lang, source and doc_id are never
inputs. With rows of one class only, every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.common import LOWER, SPACE_WORDS, WordHash, is_word_table, released, stage_table, steps, word_spans

FEATURES = (
    "bytes", "words", "word_length", "upper", "symbols", "digits", "stops", "shouts", "bars", "lines",
    "non_ascii", "same_as_before", "distinct", "repeated_lines", "short_words", "line_length",
)
#: Shares of the pooled covariance and of the diagonal in a class's covariance.
POOLED, DIAGONAL = 0.05, 0.05

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#*$%&<>", b"0123456789", b".,;:", b"!?", b"|", b"\n"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:0xC0] = 9
_CLASS[0xC0:] = 10
_LINES = is_word_table({0x0A})


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: WordHash) -> np.ndarray:
    """A row of FEATURES per document."""
    docs, size = len(offsets) - 1, np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(docs) * 11, size) + _CLASS[data], minlength=docs * 11).reshape(docs, 11).astype(float)
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, SPACE_WORDS)
    h, n = hasher.spans(low, starts, ends), np.diff(first)
    doc = np.repeat(np.arange(docs), n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    line_starts, line_ends, line_first = word_spans(data, offsets, _LINES)
    lines, line_doc = np.diff(line_first), np.repeat(np.arange(docs), np.diff(line_first))
    line_hash = hasher.spans(data, line_starts, line_ends)
    per_doc = lambda x, d: np.bincount(d, weights=x, minlength=docs)
    share = lambda part, whole: np.log((part + 0.5) / (whole + 1.0))
    total = size.astype(float)
    letters = kinds[:, 1] + kinds[:, 2]
    columns = [
        np.log1p(total), np.log1p(n), np.log((total + 1) / (n + 1)), share(kinds[:, 1], letters), share(kinds[:, 3], total),
        share(kinds[:, 4], total), share(kinds[:, 5], total), share(kinds[:, 6], total), share(kinds[:, 7], total), share(kinds[:, 8], total),
        share(kinds[:, 10], total), share(per_doc(same, doc), n), share(_distinct(h, doc, docs), n), share(lines - _distinct(line_hash, line_doc, docs), lines),
        share(per_doc(ends - starts <= 3, doc), n), np.log((total + 1) / (lines + 1)),
    ]
    return np.stack(columns, axis=1)


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Number of different values of h in each document (doc is sorted)."""
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=docs)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x (array of FEATURES) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch, data, offsets in steps(batches):
            x = statistics(data, offsets, hasher)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse Cholesky factor and half log-determinant; the prior's log-odds."""

    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    half_logdet: tuple[float, float]
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * np.square((x - m) @ w.T).sum(axis=1) - d for m, w, d in zip(self.means, self.whiten, self.half_logdet)]
        z = np.clip(density[1] - density[0] + self.log_odds, -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(labelled: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant | None:
    """labelled: x and label (0 or 1). None if a class has no rows."""
    size = len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size, size))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size - 1)
            x = np.hstack([np.ones((len(x), 1)), x])
            label = batch.column("label").to_numpy()
            for k in (0, 1):
                own = x[label == k]
                sums[k] += own.T @ own
        k, i, j = (v.ravel() for v in np.indices(sums.shape))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (k, i, j, sums.ravel())], ["k", "i", "j", "v"])

    rows = labelled.where("label in (0, 1)").select("x", F.col("label").cast("int").alias("label"))
    sums = np.zeros((2, size, size))
    for r in rows.mapInArrow(released(run), "k long, i long, j long, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.k, r.i, r.j] = r.v
    n = sums[:, 0, 0]
    if n.min() < 1:
        return None
    means = sums[:, 0, 1:] / n[:, None]
    scatter = [sums[k, 1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    both = (scatter[0] + scatter[1]) / n.sum()
    floor = 1e-6 * np.eye(size - 1) + 1e-3 * np.diag(np.diag(both))
    whiten, half = [], []
    for k in (0, 1):
        own = scatter[k] / n[k]
        own = (1 - pooled - diagonal) * own + pooled * both + diagonal * np.diag(np.diag(own)) + floor
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor))
        half.append(float(np.log(np.diag(factor)).sum()))
    return Discriminant((means[0], means[1]), (whiten[0], whiten[1]), (half[0], half[1]), float(np.log(n[1] / n[0])))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted."""
    rows = stage_table(features(docs), "statistics")
    known = labels.where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    model = fit(rows.where(~held_out()).join(known, "doc_id").select("x", "label"))
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = given.value.score(x) if given.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "x", held_out().alias("held_out")).mapInArrow(released(run), "doc_id long, held_out boolean, score double, predicted int")
