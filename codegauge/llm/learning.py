"""Labelled training rows and one-dimensional logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows a model is fitted on (expected size of a hash sample; all rows are taken if there are fewer).
SAMPLE_ROWS = 40_000
_STEPS = 1 << 30


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a row's label must not be learned from; false for a null id, which is never learned from either."""
    return F.coalesce(fold(modulus) == remainder, F.lit(False)).alias("held_out")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int,
                    rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y): a hash sample of the labelled documents that may be learned from.

    A document's label is the largest of its non-null label rows; values other than 0 and 1 are left out.
    """
    marks = labels.where(F.col(label).isin(0, 1) & (fold(modulus) != remainder)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, rows / max(1, marks.count()))
    picked = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(_STEPS)) < int(share * _STEPS))
    # at most about ``rows`` short rows
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(picked), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(a, b) of P(y = 1) = 1 / (1 + exp(-(a + b x))), by Newton's method on slightly smoothed labels."""
    pos, neg = max(float((y == 1).sum()), 1.0), max(float((y == 0).sum()), 1.0)
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design = np.stack([np.ones_like(x), x], axis=1)
    w = np.array([np.log(pos / neg), 0.0])

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float((np.logaddexp(0, z) - target * z).sum() + ridge / 2 * (v @ v))

    now = loss(w)
    for _ in range(200):
        p = sigmoid(design @ w)
        gradient = design.T @ (target - p) - ridge * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-9 and loss(w + size * step) > now:
            size /= 2
        before, w = now, w + size * step
        now = loss(w)
        if before - now < 1e-10 * max(1.0, abs(now)):
            break
    return float(w[0]), float(w[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
