"""Small models trained on the driver from a bounded sample: logistic regression and probability calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels are learnt only from documents whose crc32(doc_id as text) modulo this is not 0.
FOLDS = 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def held_out() -> F.Column:
    """True for documents that no model learns from; false for a null doc_id, which no model learns from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def sampled_ids(labelled: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows, chosen by a hash of doc_id, so the bound holds at every input size."""
    order = F.xxhash64("doc_id")
    return labelled.where(F.col("doc_id").isNotNull()).orderBy(order, "doc_id").limit(rows)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient steps."""
    n, d = x.shape
    weight = weight / weight.sum()
    rate = 1.0 / (0.25 * float((weight * (x * x).sum(axis=1)).sum() + 1) + penalty)
    w, b = np.zeros(d), 0.0
    vw, vb = w.copy(), b
    for k in range(steps):
        gap = weight * (sigmoid(x @ vw + vb) - y)
        nw, nb = vw - rate * (x.T @ gap + penalty * vw), vb - rate * gap.sum()
        pull = k / (k + 3)
        vw, vb = nw + pull * (nw - w), nb + pull * (nb - b)
        w, b = nw, nb
    return w, float(b)


def fit_calibration(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: probability = sigmoid(a * score + b), with the smoothed targets that keep it finite."""
    if not len(score) or y.min() == y.max():
        return 1.0, 0.0
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = score.std() + 1e-9
    x = (score / scale)[:, None]
    w, b = fit_logistic(x, target, np.ones(len(y)), penalty=1e-4, steps=800)
    return float(w[0] / scale), b
