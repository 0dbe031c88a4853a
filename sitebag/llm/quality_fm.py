"""Quality classifier: a factorisation machine over hashed words, text statistics and metadata.

A row's score is ``w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``: all pairwise interactions in
time linear in the row's features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import Rows, counted, stack, statistics
from .linear import FOLDS, TRAIN_ROWS, blockwise, fit_once, folds, platt, select, sigmoid, training_sample
from .quality_rules import _batched
from .textbatch import Words, chunks, mix, words

BITS = 15
FACTORS = 8
HELD_OUT_SHARE = 4
HELD_OUT_REST = 2
PREDICT_AT = 0.7
EPOCHS = 10
BATCH = 128


def raw_rows(w: Words) -> tuple[Rows, np.ndarray]:
    """Hashed words scaled to unit length, and the statistics of each text (metadata: its length and line structure)."""
    rows = counted(w.docs, w.doc(), mix(w.hash), BITS)
    length = np.sqrt(np.bincount(rows.row(), rows.value.astype(np.float64) ** 2, minlength=w.docs))
    rows.value = (rows.value / np.maximum(length, 1e-9)[rows.row()]).astype(np.float32)
    return rows, statistics(w)


def joined(rows: Rows, dense: np.ndarray) -> Rows:
    """Sparse rows with the dense columns as further indices above the hashed ones."""
    n, m = dense.shape
    length = np.diff(rows.first)
    first = np.concatenate([[0], np.cumsum(length + m)])
    index = np.empty(first[-1], dtype=np.int32)
    value = np.empty(first[-1], dtype=np.float32)
    at = np.arange(len(rows.index)) + m * rows.row()
    index[at], value[at] = rows.index, rows.value
    tail = (first[1:, None] - m + np.arange(m)).ravel()
    index[tail] = np.tile((1 << BITS) + np.arange(m), n)
    value[tail] = dense.ravel()
    return Rows(first, index, value)


class FactorMachine:
    def __init__(self, size: int, factors: int = FACTORS, seed: int = 5):
        self.w0 = 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, factors))

    def raw(self, x: Rows) -> np.ndarray:
        return blockwise(lambda part: self._parts(part)[0], x)

    def _parts(self, x: Rows) -> tuple[np.ndarray, np.ndarray]:
        def total(a: np.ndarray) -> np.ndarray:
            sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
            return sums[x.first[1:]] - sums[x.first[:-1]]

        value = x.value.astype(np.float64)
        weighted = self.v[x.index] * value[:, None]
        pull = total(weighted)
        z = self.w0 + total(self.w[x.index] * value) + 0.5 * (pull**2 - total(weighted**2)).sum(axis=1)
        return z, pull

    def fit(self, x: Rows, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-5) -> FactorMachine:
        n = len(y)
        share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.w0 = float(np.log(share / (1 - share)))
        if not n or share in (1e-3, 1 - 1e-3):
            self.v[:] = 0
            return self
        rng = np.random.default_rng(3)
        seen_w, seen_v, seen_0 = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(n)
            for begin in range(0, n, BATCH):
                rows = order[begin : begin + BATCH]
                part = select(x, rows)
                z, pull = self._parts(part)
                error = (sigmoid(z) - y[rows]) / len(rows)
                at, where = np.unique(part.index, return_inverse=True)
                value = part.value.astype(np.float64)
                scaled = error[part.row()] * value
                gw = np.bincount(where, scaled, minlength=len(at)) + l2 * self.w[at]
                slope = scaled[:, None] * (pull[part.row()] - self.v[part.index] * value[:, None])
                gv = np.stack([np.bincount(where, slope[:, f], minlength=len(at)) for f in range(slope.shape[1])], axis=1)
                gv += l2 * self.v[at]
                seen_w[at] += gw**2
                seen_v[at] += gv**2
                self.w[at] -= rate * gw / np.sqrt(seen_w[at])
                self.v[at] -= 0.3 * rate * gv / np.sqrt(seen_v[at])
                seen_0 += error.sum() ** 2
                self.w0 -= 0.1 * rate * error.sum() / np.sqrt(seen_0)
        return self


@dataclass
class QualityModel:
    machine: FactorMachine
    mean: np.ndarray
    deviation: np.ndarray
    calibration: tuple[float, float]

    def score(self, w: Words) -> np.ndarray:
        rows, dense = raw_rows(w)
        slope, shift = self.calibration
        return sigmoid(slope * self.machine.raw(joined(rows, self.scaled(dense))) + shift)

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.deviation, -5, 5).astype(np.float32)


def fit_quality(texts: list[bytes], y: np.ndarray) -> QualityModel:
    """Fit on all rows given; calibration from predictions of models that did not see the row."""
    pairs = [raw_rows(words(part, lower=False)) for part in _batched(texts)]
    sparse = stack([p[0] for p in pairs])
    dense = np.concatenate([p[1] for p in pairs])
    some = dense if len(dense) else np.zeros((1, dense.shape[1]), dtype=np.float32)
    model = QualityModel(FactorMachine(0), some.mean(axis=0), some.std(axis=0) + 1e-3, (1.0, 0.0))
    size = (1 << BITS) + dense.shape[1]
    if len(sparse.first) - 1 != len(y):  # the one empty batch of no texts
        model.machine = FactorMachine(size).fit(sparse, y[:0])
        return model
    x = joined(sparse, model.scaled(dense))
    fold = folds(len(y))
    raw = np.zeros(len(y))
    for k in range(FOLDS if len(y) >= 20 else 0):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        raw[own] = FactorMachine(size).fit(select(x, rest), y[rest]).raw(select(x, own))
    model.machine = FactorMachine(size).fit(x, y)
    if raw.any():
        model.calibration = platt(raw, y)
    return model


def held_out(doc_id: str = "doc_id"):
    """Rows never used for learning: crc32 of the id as text leaves 2 modulo 4. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_SHARE == HELD_OUT_REST


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """A model of ``labels.quality`` from at most ``rows`` labelled documents outside the held-out share."""
    return fit_once(training_sample(docs, labels.where(~held_out()), "quality", rows), fit_quality)


def score_quality(docs: DataFrame, model: QualityModel, predict_at: float = PREDICT_AT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row. Only the text is an input of the score; null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                score = shared.value.score(words(texts, lower=False))
                predicted = pa.array((score >= predict_at).astype(np.int32))
                arrays = [part.column("doc_id"), part.column("held_out"), pa.array(score), predicted]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
