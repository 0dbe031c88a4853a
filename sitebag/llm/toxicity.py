"""Toxicity: a classifier chain over categories, each link fed with the probabilities of the links before it.

The labels name one category, toxic. Words and word beginnings that are typical of toxic texts (a likelihood-ratio test)
are the features in use. Half of them, by their hash, are evidence for two finer categories: a toxic text is ``repeated`` if
it has at least ``REPEATED`` occurrences of them, and ``dense`` if these are at least ``DENSE`` of its words. The links for
the finer categories see only the other half, so they have something to predict; the link for toxic sees everything and the
two probabilities. The chain predicts repeated, dense, toxic.

Later links train on out-of-fold probabilities of earlier ones, and each fold has its own typical features, chosen without its
rows. Choosing counts features where the rows are, over Spark; only rows cut down to the features in use meet in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import Rows, counted, letter_words
from .linear import FOLDS, Logistic, platt, select, sigmoid, training_sample
from .spark_help import releasing, staged, take
from .textbatch import chunks, mix

CATEGORIES = ("repeated", "dense", "toxic")
BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
TRAIN_ROWS = 20_000
REPEATED = 3
DENSE = 0.02
MIN_DOCS = 3
SURE = 15.0  # likelihood-ratio statistic from which a feature counts as typical (about 1e-4)
REJECT_AT = 0.5


def presence(texts: list[bytes]) -> tuple[Rows, np.ndarray]:
    """Words and word beginnings of each text, hashed, with their counts; and the number of words."""
    w = letter_words(texts)
    doc = w.doc()
    docs, hashes = [doc], [w.hash]
    for size in PREFIXES:
        h, at = w.prefix(size)
        docs.append(doc[at])
        hashes.append(mix(h + np.uint64(size)))
    return counted(w.docs, np.concatenate(docs), np.concatenate(hashes), BITS), w.counts()


@dataclass
class ToxicityModel:
    column: np.ndarray  # of each hash, its place among the features in use, or -1
    links: list[tuple[np.ndarray, float]] = field(default_factory=list)
    calibration: tuple[float, float] = (1.0, 0.0)

    def features(self, x: Rows, n_words: np.ndarray) -> Features:
        place = self.column[x.index]
        keep = place >= 0
        owner = x.row()[keep]
        n = len(x.first) - 1
        first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        shown = is_evidence(x.index[keep])
        often = np.bincount(owner, x.value[keep], minlength=n) / (1 + len(PREFIXES))
        evidence = 2 * np.bincount(owner[shown], x.value[keep][shown], minlength=n) / (1 + len(PREFIXES))
        rows = Rows(first, place[keep], np.ones(int(keep.sum()), dtype=np.float32))
        return Features(rows, shown, often, often / np.maximum(n_words, 1), evidence, evidence / np.maximum(n_words, 1))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each category, one column each."""
        found = self.features(*presence(texts))
        out = np.zeros((len(texts), len(CATEGORIES)))
        for i, (weights, shift) in enumerate(self.links):
            link = Logistic(1)
            link.w, link.b = weights, shift
            z = link.raw(found.inputs(out[:, :i]))
            if CATEGORIES[i] == "toxic":
                z = self.calibration[0] * z + self.calibration[1]
            out[:, i] = sigmoid(z)
        return out


def is_evidence(index: np.ndarray) -> np.ndarray:
    """Which features (by hash) are evidence for the finer categories."""
    return (index & 1).astype(bool)


@dataclass
class Features:
    """Rows over the features in use (by presence), which entries are evidence, how often the features and the evidence
    among them occur, and their shares of the words."""

    rows: Rows
    shown: np.ndarray
    often: np.ndarray
    share: np.ndarray
    evidence: np.ndarray
    evidence_share: np.ndarray

    def goals(self, y: np.ndarray) -> list[np.ndarray]:
        """Targets of the categories, in order."""
        return [y * (self.evidence >= REPEATED), y * (self.evidence_share >= DENSE), y]

    def inputs(self, earlier: np.ndarray) -> Rows:
        """Rows for the link after the ones whose probabilities are ``earlier``."""
        if earlier.shape[1] == len(CATEGORIES) - 1:
            return with_chain(self.rows, self.often, self.share, earlier)
        owner = self.rows.row()[~self.shown]
        first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(self.often)))])
        hidden = Rows(first, self.rows.index[~self.shown], self.rows.value[~self.shown])
        none = np.zeros(len(self.often))
        return with_chain(hidden, none, none, earlier)


def with_chain(rows: Rows, often: np.ndarray, share: np.ndarray, earlier: np.ndarray) -> Rows:
    """Dense columns first (occurrences, share, probabilities of earlier links), the features in use after them."""
    width = 2 + len(CATEGORIES)
    dense = np.zeros((len(often), width), dtype=np.float32)
    dense[:, 0] = np.log1p(often)
    dense[:, 1] = np.minimum(20 * share, 2)
    dense[:, 2 : 2 + earlier.shape[1]] = earlier
    length = np.diff(rows.first)
    first = np.concatenate([[0], np.cumsum(length + width)])
    index = np.empty(first[-1], dtype=np.int32)
    value = np.empty(first[-1], dtype=np.float32)
    head = (first[:-1, None] + np.arange(width)).ravel()
    index[head], value[head] = np.tile(np.arange(width), len(often)), dense.ravel()
    at = np.arange(len(rows.index)) + width * (rows.row() + 1)
    index[at], value[at] = rows.index + width, rows.value
    return Rows(first, index, value)


def constant_model(n: float, toxic: float) -> ToxicityModel:
    """The share of toxic rows for every text: what is known where the labels have one class or none."""
    share = np.clip(toxic / n if n else 0.0, 1e-3, 1 - 1e-3)
    link = np.zeros(2 + len(CATEGORIES)), float(np.log(share / (1 - share)))
    return ToxicityModel(np.full(1 << BITS, -1, dtype=np.int32), [link] * len(CATEGORIES))


def with_columns(features: np.ndarray) -> ToxicityModel:
    model = ToxicityModel(np.full(1 << BITS, -1, dtype=np.int32))
    model.column[features] = np.arange(len(features))
    return model


def fit_chain(x: Rows, n_words: np.ndarray, y: np.ndarray, fold: np.ndarray, typical: list[np.ndarray], chained: bool = True) -> ToxicityModel:
    """Train the links in order. ``typical`` lists the features of each fold's other rows and, last, of all rows.

    Without ``chained`` the links get no probabilities of earlier ones (to measure what the chain is worth).
    """
    width = 2 + len(CATEGORIES)
    model = with_columns(typical[-1])
    whole, parts = model.features(x, n_words), [with_columns(t).features(x, n_words) for t in typical[:-1]]
    out_of_fold, raw = np.zeros((len(y), len(CATEGORIES))), np.zeros(len(y))
    for i in range(len(CATEGORIES)):
        earlier = out_of_fold[:, :i] * chained
        for k, part in enumerate(parts):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            full, goal = part.inputs(earlier), part.goals(y)[i].astype(np.float64)
            raw[own] = Logistic(width + len(typical[k]), l2=1e-4).fit(select(full, rest), goal[rest]).raw(select(full, own))
        out_of_fold[:, i] = sigmoid(raw)
        link = Logistic(width + len(typical[-1]), l2=1e-4).fit(whole.inputs(earlier), whole.goals(y)[i].astype(np.float64))
        if not chained:
            link.w[2 : 2 + len(CATEGORIES)] = 0
        model.links.append((link.w, link.b))
    model.calibration = platt(raw, y)
    return model


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature of a task's rows in how many of each fold it is, and in how many toxic ones."""
    seen = np.zeros((2 * FOLDS, 1 << BITS), dtype=np.int32)
    for batch in batches:
        y, fold = (batch.column(c).to_numpy() for c in ("y", "fold"))
        begin = 0
        for part, texts in chunks(batch):
            x, _ = presence(texts)
            row = x.row() + begin
            np.add.at(seen, (fold[row], x.index), 1)
            np.add.at(seen, (FOLDS + fold[row], x.index), y[row])
            begin += part.num_rows
    at = np.flatnonzero(seen.any(axis=0))
    for i in range(0, len(at), 100_000):
        own = at[i : i + 100_000]
        names = ["feature", *(f"n{k}" for k in range(FOLDS)), *(f"p{k}" for k in range(FOLDS))]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(c) for c in seen[:, own])], names)


def typical_features(sample: DataFrame) -> tuple[list[np.ndarray], float, float]:
    """Features in a larger share of the toxic rows than of the others, beyond chance: of the rows outside each fold, and of all.

    ``sample`` has ``text, y, fold``. Also the number of rows, and of toxic ones.
    """
    sizes = {r["fold"]: (r["n"], r["p"]) for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()}
    columns = [f"{c}{k}" for c in "np" for k in range(FOLDS)]
    found = sample.select("text", "y", "fold").mapInArrow(releasing(_count_features), f"feature int, {', '.join(f'{c} int' for c in columns)}")
    found = found.groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns])

    def part(count: Column, expected: Column) -> Column:
        return F.when(count > 0, count * F.log(count / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)

    marks = []
    for left_out in (*range(FOLDS), None):
        folds = [k for k in range(FOLDS) if k != left_out]
        n, m = (float(sum(sizes.get(k, (0, 0))[i] for k in folds)) for i in (0, 1))
        all_, pos = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0)) for c in "np")
        share = m / n if n else 0.0
        stat = part(pos, all_ * share) + part(all_ - pos, all_ * (1 - share)) + part(m - pos, (n - all_) * share)
        stat = 2 * (stat + part(n - m - all_ + pos, (n - all_) * (1 - share)))
        marks.append(((stat >= SURE) & (pos > all_ * share) & (all_ >= MIN_DOCS)).alias(f"in{len(marks)}"))
    rows = found.select("feature", *marks).where(" or ".join(f"in{i}" for i in range(len(marks)))).collect()  # at most 2**BITS
    sets = [np.array(sorted(r["feature"] for r in rows if r[f"in{i}"]), dtype=np.int64) for i in range(len(marks))]
    return sets, float(sum(n for n, _ in sizes.values())), float(sum(p for _, p in sizes.values()))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``doc_id, text, y, fold``: one row of each chosen id (of several texts the least), folds by the hash of the id."""
    sample = training_sample(docs, labels, "toxic", rows)
    one = sample.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    return staged(one.select("doc_id", "r.text", "r.y", fold.alias("fold")), "training")


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chained: bool = True) -> ToxicityModel:
    """A chain from at most ``rows`` labelled documents of ``labels.toxic``; without labels nothing is toxic.

    Null text is empty. Rows that repeat an id count once. No rows or one class of labels: every text has the share of toxic rows.
    """
    sample = training_rows(docs, labels, rows)
    typical, n, toxic = typical_features(sample)
    if not 0 < toxic < n:
        return constant_model(n, toxic)
    wanted = sample.sparkSession.sparkContext.broadcast(np.unique(np.concatenate(typical)))

    def cut_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_use = np.zeros(1 << BITS, dtype=bool)
        in_use[wanted.value] = True
        for batch in batches:
            for part, texts in chunks(batch):
                x, n_words = presence(texts)
                keep = in_use[x.index]
                bounds = np.concatenate([[0], np.cumsum(keep)])[x.first]
                index, value = x.index[keep], x.value[keep]
                cells = [(index[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                arrays = [part.column("doc_id"), part.column("y"), part.column("fold"), pa.array(n_words.astype(np.int64))]
                arrays += [pa.array([c[i] for c in cells], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "y", "fold", "n_words", "index", "value"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        index = [np.frombuffer(b, dtype=np.int32) for b in frame["index"]]
        value = [np.frombuffer(b, dtype=np.float32) for b in frame["value"]]
        x = Rows(np.concatenate([[0], np.cumsum([len(i) for i in index])]), np.concatenate(index), np.concatenate(value))
        y, fold, n_words = (frame[c].to_numpy() for c in ("y", "fold", "n_words"))
        model = fit_chain(x, n_words, y.astype(np.float64), fold, typical, chained)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    small = sample.mapInArrow(cut_down, "doc_id long, y int, fold int, n_words long, index binary, value binary")
    return pickle.loads(small.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "model binary").first()["model"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, reject_at: float = REJECT_AT) -> DataFrame:
    """``doc_id, p_repeated, p_dense, p_toxic, toxic`` per row; null text is empty. Other columns are not read.

    Repeated rows are scored each; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                p = shared.value.score(texts)
                arrays = [part.column("doc_id"), *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(p[:, -1] >= reject_at)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, p_repeated double, p_dense double, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, model: ToxicityModel, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they were, in one pass over the table.

    Null text is empty. Repeated rows stay or go together, and columns may have any other names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                yield take(part, shared.value.score(texts)[:, -1] < reject_at)

    return docs.mapInArrow(releasing(run), docs.schema)
