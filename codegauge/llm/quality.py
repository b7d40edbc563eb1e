"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a dozen transformed statistics (lengths, character classes, repetition).  Each class keeps its
mean and a covariance shrunk towards its diagonal by the Ledoit-Wolf intensity, stored as a Cholesky factor.  The
score is a logistic map of the difference of the two Mahalanobis log-densities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.common import slices
from codegauge.llm.learning import SAMPLE_ROWS, fit_logistic, held_out, labelled_sample, sigmoid
from codegauge.llm.words import U, split_words

CUT = 0.7
_CLASS = np.zeros(256, dtype=np.uint8)     # 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 plain mark, 6 space, 7 line end
_CLASS[[*range(0x21, 0x7F)]] = 4
_CLASS[[*range(0x61, 0x7B)]] = 1
_CLASS[[*range(0x41, 0x5B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 6
_CLASS[0x0A] = 7
FEATURES = ("log_words", "symbols", "upper", "digits", "distinct", "repeats", "top_word", "word_length", "symbol_ends",
            "line_length", "marks", "bytes_per_char", "word_spread")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; counts are smoothed, so that an empty text has finite ones."""
    words = split_words(texts)
    kind = _CLASS[words.buffer]
    offsets = words.text_offsets
    count = {k: _sums(kind == k, offsets).astype(float) for k in (1, 2, 3, 4, 5, 7)}
    size = np.diff(offsets).astype(float)
    chars = _sums((words.buffer & 0xC0) != 0x80, offsets).astype(float)
    n = words.counts.astype(float)
    lengths = words.ends - words.starts
    hashes = words.hashes()
    owner = np.repeat(np.arange(len(n)), words.counts)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    by, of = hashes[order], owner[order]
    head = np.ones(len(by), dtype=bool)
    head[1:] = (by[1:] != by[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(head)
    distinct = np.bincount(of[starts], minlength=len(n)).astype(float) if len(by) else np.zeros(len(n))
    top = np.zeros(len(n))
    if len(by):
        np.maximum.at(top, of[starts], np.diff(np.append(starts, len(by))))
    symbol_end = kind[words.ends - 1] == 4 if len(hashes) else np.zeros(0, dtype=bool)
    first = words.first
    mean_length = (_sums(lengths, first) + 5.0) / (n + 1)
    square = (_sums(lengths * lengths, first) + 35.0) / (n + 1)
    letters = count[1] + count[2]
    return np.stack([
        np.log1p(n),
        np.sqrt((count[4] + 0.05) / (size + 20)),
        np.sqrt((count[2] + 0.5) / (letters + 20)),
        np.sqrt((count[3] + 0.05) / (size + 20)),
        np.log((distinct + 2) / (n + 2)),
        np.sqrt((_sums(same, first) + 0.05) / (n + 5)),
        np.sqrt((top + 0.5) / (n + 5)),
        np.log(mean_length),
        np.sqrt((_sums(symbol_end, first) + 0.05) / (n + 5)),
        np.log((size + 40) / (count[7] + 1)),
        np.sqrt((count[5] + 0.5) / (size + 20)),
        (size + 10) / (chars + 10),
        np.log(np.maximum(square - mean_length**2, 0.05)),
    ], axis=1)


@dataclass
class Density:
    """A Gaussian: mean, inverse Cholesky factor of the shrunk covariance, log-determinant of the factor."""
    mean: np.ndarray
    whiten: np.ndarray
    log_det: float

    @classmethod
    def fit(cls, rows: np.ndarray) -> Density:
        n, d = rows.shape
        mean = rows.mean(axis=0)
        centred = rows - mean
        cov = centred.T @ centred / n
        target = np.diag(np.diag(cov)) + np.eye(d) * 1e-4
        spread = ((centred**2).T @ (centred**2) / n - cov**2)
        np.fill_diagonal(spread, 0)
        gap = ((cov - np.diag(np.diag(cov)))**2).sum()
        shrink = float(np.clip(spread.sum() / n / gap, 0.02, 1)) if gap > 0 else 1.0
        factor = np.linalg.cholesky((1 - shrink) * cov + shrink * target + np.eye(d) * 1e-6)
        return cls(mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def log_density(self, rows: np.ndarray) -> np.ndarray:
        return -0.5 * (((rows - self.mean) @ self.whiten.T) ** 2).sum(axis=1) - self.log_det


@dataclass
class QualityModel:
    """``classes`` is (good, bad) or None where the labels hold a single class; then every score is ``base``."""
    classes: tuple[Density, Density] | None
    a: float
    b: float
    base: float

    @classmethod
    def fit(cls, rows: np.ndarray, y: np.ndarray) -> QualityModel:
        base = float((y.sum() + 1) / (len(y) + 2))
        if min((y == 1).sum(), (y == 0).sum()) < 2:
            return cls(None, 0.0, 0.0, base)
        both = (Density.fit(rows[y == 1]), Density.fit(rows[y == 0]))
        gap = both[0].log_density(rows) - both[1].log_density(rows)
        a, b = fit_logistic(_squash(gap), y)
        return cls(both, a, b, base)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(rows), self.base)
        gap = self.classes[0].log_density(rows) - self.classes[1].log_density(rows)
        return sigmoid(self.a + self.b * _squash(gap))


def _squash(gap: np.ndarray) -> np.ndarray:
    """Far tails count by their logarithm, so that single outliers do not set the slope."""
    return np.sign(gap) * np.log1p(np.abs(gap))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["y", "row"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2,
                sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """The model from at most about ``sample_rows`` labelled rows (13 numbers each reach the driver)."""
    found = labelled_sample(docs, labels, label, modulus, remainder, sample_rows).select("text", "y").mapInArrow(
        _features, "y int, row binary").toArrow()
    y = found.column("y").to_numpy()
    rows = np.frombuffer(b"".join(found.column("row").to_pylist()), dtype=float).reshape(len(y), len(FEATURES))
    order = np.lexsort(np.column_stack([rows, y]).T)   # sums must not depend on the order rows arrive in
    return QualityModel.fit(rows[order], y[order])


def _scorer(model: QualityModel, cut: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = model.score(statistics(batch.column("text"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(score),
                 pa.array((score >= cut).astype(np.int32))],
                names=[*(c for c in batch.schema.names if c != "text"), "score", "predicted"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, cut: float = CUT,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text; more columns are ignored).

    ``score`` is the estimated probability of quality label 1.  Null texts are empty; an empty text has the
    statistics of no words, and a score.  Rows with a null or repeated ``doc_id`` are scored like any other; a null
    id is not held out.  Labels other than 0 and 1 are ignored; without labels of both classes every score is the
    smoothed share of label 1 (0.5 without labels).  An empty table gives no rows.
    """
    model = fit_quality(docs, labels, modulus=modulus, remainder=remainder, sample_rows=sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder), "text")
    return rows.mapInArrow(_scorer(model, cut), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, **fit) -> DataFrame:
    """The rows of ``docs`` scoring at least ``cut``, all columns as they are; rows with equal texts fare alike."""
    model = fit_quality(docs, labels, **fit)
    whole = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(statistics(batch.column("text"))) >= cut))
    return docs.mapInArrow(run, whole)
