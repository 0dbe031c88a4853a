"""Quality rules: exact counting rules, then a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import Rows, character_ngrams, counted, counts, stack
from .linear import FOLDS, Logistic, fit_once, folds, platt, select, sigmoid, training_sample
from .textbatch import CHUNK, Words, chunks, mix, words

BITS = 17
TRAIN_ROWS = 4_000  # a text has some thousand n-grams, and the fit holds all rows of the sample
MIN_WORDS = 10
MAX_REPEAT = 20  # per cent of the words
KEEP_AT = 0.5
_SAME = np.uint64(0x5A3E)  # stands for the second word of a pair of equal words


def ngram_rows(w: Words) -> Rows:
    """Words, word pairs (a pair of equal words counts as one feature whatever the word) and character 2- and 3-grams.

    Each kind is scaled to unit length, so a long text weighs as much as a short one.
    """
    doc = w.doc()
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, dtype=np.int64)
    left, right = w.hash[inner], w.hash[inner + 1]
    equal = left == right
    pair = mix(np.where(equal, _SAME, left * np.uint64(3) + right))
    kinds = [(doc, w.hash), (doc[inner], pair), (doc[inner], mix(equal.astype(np.uint64) + np.uint64(77)))]
    kinds += [character_ngrams(w, size)[::-1] for size in (2, 3)]
    found = []
    for salt, (d, h) in enumerate(kinds):
        rows = counted(w.docs, d, mix(h + np.uint64(salt)), BITS)
        length = np.sqrt(np.bincount(rows.row(), rows.value.astype(np.float64) ** 2, minlength=w.docs))
        rows.value = (rows.value / np.maximum(length, 1e-9)[rows.row()]).astype(np.float32)
        found.append(rows)
    owner = np.concatenate([r.row() for r in found])
    order = np.argsort(owner, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=w.docs))])
    return Rows(first, np.concatenate([r.index for r in found])[order], np.concatenate([r.value for r in found])[order])


@dataclass
class RuleModel:
    weights: np.ndarray
    shift: float
    calibration: tuple[float, float]

    def score(self, x: Rows) -> np.ndarray:
        linear = Logistic(1)
        linear.w, linear.b = self.weights, self.shift
        slope, offset = self.calibration
        return sigmoid(slope * linear.raw(x) + offset)


def _batched(texts: list[bytes]) -> list[list[bytes]]:
    out, size = [[]], 0
    for t in texts:
        if size > CHUNK:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


def fit_rules(texts: list[bytes], y: np.ndarray) -> RuleModel:
    """Fit on all rows; the calibration comes from predictions of models that did not see the row."""
    x = stack([ngram_rows(words(part, lower=False)) for part in _batched(texts)]) if texts else stack([])
    fold = folds(len(y))
    raw = np.zeros(len(y))
    for k in range(FOLDS if len(y) >= 20 else 0):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        raw[own] = Logistic(1 << BITS).fit(select(x, rest), y[rest]).raw(select(x, own))
    model = Logistic(1 << BITS).fit(x, y)
    return RuleModel(model.w.astype(np.float32), model.b, platt(raw, y) if raw.any() else (1.0, 0.0))


def train_rules(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleModel:
    """A model of ``labels.quality`` from at most ``rows`` labelled documents; without labels everything scores 0.5."""
    return fit_once(training_sample(docs, labels, "quality", rows), fit_rules)


def apply_rules(docs: DataFrame, model: RuleModel, keep_at: float = KEEP_AT) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept`` per row.

    ``kept`` is false where the counting rules fail, else whether the calibrated score is at least ``keep_at``. Null text
    counts as empty (no words, fails). Repeated rows are scored each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                w = words(texts, lower=False)
                c = counts(w)
                score = shared.value.score(ngram_rows(w))
                failed = (c.n_words < MIN_WORDS) | (100 * c.n_repeat_words > MAX_REPEAT * c.n_words)
                whole = (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)
                arrays = [part.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in whole)]
                arrays += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))]
                names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed score kept".split()
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, score double, kept boolean",
    )
