"""Training of small models on a bounded sample of labelled rows, and logistic regression on sparse rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import Rows

TRAIN_ROWS = 8_000
BLOCK = 256  # rows scored at once
FOLDS = 3


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, y`` of at most ``rows`` labelled documents: those with the smallest hash of their id.

    The ids are chosen from the labels alone and number at most ``rows``, so they can be broadcast; texts of other
    documents are not moved. Rows without id or label are not used; of several labels of one id the largest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return picked.join(F.broadcast(chosen), picked["doc_id"] == chosen["_id"]).drop("_id")


def fit_once(sample: DataFrame, fit: Callable[[list[bytes], np.ndarray], object]) -> object:
    """Run ``fit(texts, y)`` over the bounded sample in one Spark task; the model comes back pickled.

    Rows are sorted by id and text first, so a task that runs again gives the same model. No rows: ``fit([], [])``.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        model = fit([t.encode() for t in rows["text"]], rows["y"].to_numpy(dtype=np.float64))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    found = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], np.zeros(0))


def folds(n: int, count: int = FOLDS) -> np.ndarray:
    return np.random.default_rng(7).permutation(n) % count


def select(x: Rows, rows: np.ndarray) -> Rows:
    """The given rows, in their order."""
    length = np.diff(x.first)[rows]
    first = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(x.first[rows] - first[:-1], length) + np.arange(first[-1])
    return Rows(first, x.index[at], x.value[at])


def blockwise(score: Callable[[Rows], np.ndarray], x: Rows) -> np.ndarray:
    """Scores of many rows, a block at a time, so that temporaries stay small."""
    n = len(x.first) - 1
    if n <= BLOCK:
        return score(x)
    return np.concatenate([score(select(x, np.arange(b, min(b + BLOCK, n)))) for b in range(0, n, BLOCK)])


class Logistic:
    """Logistic regression on sparse rows by Adagrad over shuffled batches; all arithmetic is seeded."""

    def __init__(self, size: int, l2: float = 1e-6, rate: float = 0.5, epochs: int = 12, batch: int = 128):
        self.w, self.b = np.zeros(size), 0.0
        self.l2, self.rate, self.epochs, self.batch = l2, rate, epochs, batch

    def raw(self, x: Rows) -> np.ndarray:
        return blockwise(self._raw, x)

    def _raw(self, x: Rows) -> np.ndarray:
        products = np.concatenate([[0.0], np.cumsum(self.w[x.index] * x.value)])
        return np.diff(products[x.first]) + self.b

    def fit(self, x: Rows, y: np.ndarray) -> Logistic:
        n = len(y)
        share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.b = float(np.log(share / (1 - share)))
        if not n or share in (1e-3, 1 - 1e-3):
            return self
        rng = np.random.default_rng(11)
        seen, seen_b = np.full(len(self.w), 1e-8), 1e-8
        for _ in range(self.epochs):
            order = rng.permutation(n)
            for begin in range(0, n, self.batch):
                rows = order[begin : begin + self.batch]
                part = select(x, rows)
                error = sigmoid(self._raw(part)) - y[rows]
                at, where = np.unique(part.index, return_inverse=True)
                grad = np.bincount(where, error[part.row()] * part.value, minlength=len(at)) / len(rows) + self.l2 * self.w[at]
                seen[at] += grad**2
                self.w[at] -= self.rate * grad / np.sqrt(seen[at])
                g = error.mean()
                seen_b += g * g
                self.b -= self.rate * 0.2 * g / np.sqrt(seen_b)
        return self


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make ``sigmoid(slope * raw + shift)`` a calibrated probability.

    Newton steps on smoothed targets, halved until the loss falls; scores that separate the classes stay finite.
    """
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(raw.std()), 1e-6)
    x = np.stack([raw / scale, np.ones(len(raw))], axis=1)

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((np.logaddexp(0, z) - target * z).sum() + 0.005 * (t @ t))

    theta = np.array([1.0, float(np.log(pos / neg))])
    now = loss(theta)
    for _ in range(50):
        p = sigmoid(x @ theta)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - target) + 0.01 * theta)
        while loss(theta - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        theta = theta - step
        before, now = now, loss(theta)
        if before - now < 1e-9:
            break
    return float(max(theta[0], 1e-3) / scale), float(theta[1])
