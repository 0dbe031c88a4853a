"""Document fingerprints of improbable byte windows in chained Bloom filters.

Every ``WINDOW``-byte window of a text has an entropy; how rare that entropy is among all windows of the corpus ranks
the window. A window that is the rarest of its neighbourhood often enough is a feature. Features enter, in text order,
a chain of Bloom filters of ``BITS`` bits with ``PER_FILTER`` features each. Two chains are compared by the overlap of
bits beyond chance, per filter of the shorter chain with its best partner.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import CHUNK, chunks, mix

WINDOW = 32
NEIGHBOURS = 32
POPULARITY = 4
BITS = 2048
PER_FILTER = 160
HASHES = 5
LEVELS = 1000  # steps of entropy
TRIVIAL = 100  # windows below this step (long runs of one byte) rank last

_SCALE = 1 << 10
_TERM = np.array([0, *(round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1))], dtype=np.int32)
_FULL = int(_TERM[WINDOW])
_FAR = np.int64(1) << 62


def _levels(data: np.ndarray) -> np.ndarray:
    """Entropy step, 0 to ``LEVELS``, of the window that begins at each byte (the last ``WINDOW`` - 1 have none).

    Sliding sums: when a byte enters or leaves, only the term of its own count changes, and its count is how often it
    equals one of the neighbours within the window.
    """
    n = len(data)
    before = np.zeros(n, dtype=np.uint8)  # equal bytes among the WINDOW - 1 before
    after = np.zeros(n, dtype=np.uint8)
    for lag in range(1, WINDOW):
        same = data[lag:] == data[:-lag]
        before[lag:] += same
        after[:-lag] += same
    enter = _TERM[before + 1] - _TERM[before]
    leave = _TERM[after + 1] - _TERM[after]
    total = np.cumsum(enter, dtype=np.int64)
    starts = n - WINDOW + 1
    sums = total[WINDOW - 1 :].copy()
    sums[1:] -= np.cumsum(leave[: starts - 1], dtype=np.int64)
    return ((_FULL - sums) * LEVELS // _FULL).astype(np.int32)


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with zero gaps wide enough that no window or neighbourhood sees two; start and window count of each.

    A text shorter than a window has one window, filled up with zeros.
    """
    gap = bytes(WINDOW + NEIGHBOURS)
    data = np.frombuffer(gap.join([b"", *texts, b""]), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = len(gap) + np.concatenate([[0], np.cumsum(size + len(gap))[:-1]])
    return data, start, np.where(size > 0, np.maximum(size - WINDOW + 1, 1), 0)


def entropy_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy step."""
    data, start, windows = _laid_out(texts)
    level = _levels(data)
    edge = np.zeros(len(level) + 1, dtype=np.int8)
    np.add.at(edge, start, windows > 0)
    np.add.at(edge, start + windows, -(windows > 0).astype(np.int8))
    return np.bincount(level[np.cumsum(edge[:-1]) > 0], minlength=LEVELS + 1)


def _features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of each text in order, and where each text's begin."""
    data, start, windows = _laid_out(texts)
    level = _levels(data)
    n = len(level)
    edge = np.zeros(n + 1, dtype=np.int8)
    np.add.at(edge, start, windows > 0)
    np.add.at(edge, start + windows, -(windows > 0).astype(np.int8))
    inside = np.cumsum(edge[:-1]) > 0
    least = np.where(inside, (ranks[level].astype(np.int64) << 40) + np.arange(n), _FAR)
    width = 1
    while width < NEIGHBOURS:  # minimum over runs of 1, 2, 4 ... windows; ties go to the left
        least = np.minimum(least, np.concatenate([least[width:], np.full(min(width, n), _FAR)])[:n])
        width *= 2
    winner = least[least < _FAR] & ((1 << 40) - 1)
    if not len(winner):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    turn = np.flatnonzero(np.diff(winner, prepend=-1))
    votes = np.diff(turn, append=len(winner))
    at = winner[turn]
    few = np.minimum(windows[np.searchsorted(start, at, side="right") - 1], POPULARITY)
    at = at[votes >= few]
    raw = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]
    parts = np.ascontiguousarray(raw).view("<u8")
    value = np.zeros(len(at), dtype=np.uint64)
    for i in range(parts.shape[1]):
        value = mix(value + parts[:, i] + np.uint64(i))
    return value, np.searchsorted(at, np.append(start, len(data)))


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """One chain of filters, ``(filters, BITS / 8)`` bytes, for each text; none for an empty text."""
    value, first = _features(texts, ranks)
    counts = np.diff(first)
    chains = -(-counts // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(chains)])
    ordinal = np.arange(len(value)) - np.repeat(first[:-1], counts)
    filt = np.repeat(base[:-1], counts) + ordinal // PER_FILTER
    bits = np.zeros(int(base[-1]) * BITS, dtype=bool)
    for i in range(HASHES):
        bits[filt * BITS + ((value >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits.reshape(-1, BITS), axis=1)
    return [packed[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: shared bits beyond chance, of each filter of the shorter chain with its best partner, weighted by bits.

    Two empty chains are alike (1), an empty and a filled one are not (0).
    """
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(b) < len(a) or (len(a) == len(b) and b.tobytes() < a.tobytes()):
        a, b = b, a
    ones_b = np.bitwise_count(b).sum(axis=1).astype(np.float64)
    total = weight = 0.0
    for f in a:
        own = float(np.bitwise_count(f).sum())
        best = 0.0
        for begin in range(0, len(b), 4096):
            part, ones = b[begin : begin + 4096], ones_b[begin : begin + 4096]
            shared = np.bitwise_count(part & f).sum(axis=1)
            chance = own * ones / BITS
            room = np.maximum(np.minimum(own, ones) - chance, 1e-9)
            best = max(best, float(((shared - chance) / room).max()))
        total += own * min(best, 1.0)
        weight += own
    return total / weight


def to_string(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, BITS // 8)


def _count_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS + 1, dtype=np.int64)
    for batch in batches:
        for _, texts in chunks(batch):
            total += entropy_counts(texts)
    level = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(total[level], pa.int64())], ["level", "n"])


def entropy_ranks(docs: DataFrame, column: str = "text") -> np.ndarray:
    """Rank of each entropy step over all windows of all texts: 0 is the rarest step, trivial windows come last.

    At most ``LEVELS`` + 1 counts reach the driver, whatever the corpus. Steps that do not occur rank as rarest.
    """
    rows = docs.select(F.col(column).alias("text")).mapInArrow(_count_levels, "level int, n long")
    count = np.zeros(LEVELS + 1, dtype=np.int64)
    for level, n in rows.groupBy("level").agg(F.sum("n").alias("n")).collect():
        count[level] = n
    count[:TRIVIAL] = np.iinfo(np.int64).max
    ranks = np.empty(LEVELS + 1, dtype=np.int64)
    ranks[np.argsort(count, kind="stable")] = np.arange(LEVELS + 1)
    return ranks


def fingerprints(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key, fingerprint`` per row: the chain as base64. Equal texts have equal fingerprints; null is as empty: ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                found = pa.array([to_string(c) for c in digests(texts, ranks)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("key"), found], ["key", "fingerprint"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text"))
    return rows.mapInArrow(run, "key long, fingerprint string").withColumnRenamed("key", key)


def bounded_runs(rows: Iterator[tuple], size_of, limit: int = CHUNK) -> Iterator[list[tuple]]:
    """Lists of consecutive rows of about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
