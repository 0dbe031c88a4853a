"""Whole texts as byte arrays: words, word hashes and word shingles of a batch of documents at once.

A word is a maximal run of bytes other than space and 0x09-0x0D; in UTF-8 that is the same as the run of code points.
A batch is bounded by bytes (``CHUNK``); only a single longer document goes alone, in memory proportional to itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
CACHED = 1 << 15  # bytes of which sums are made at once
WORDS_PER_SHINGLE = 5

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)
_LANES = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (multiply and shift, one-to-one)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK + 4096)

        def powers(base: int) -> np.ndarray:
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            return np.cumprod(factors, dtype=np.uint64)

        tables = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
        if size <= 4 * CHUNK:
            _powers, _inverses = tables
        return tables
    return _powers, _inverses


@dataclass
class Words:
    """Words of a batch: byte range and hash of each, ``first[d]:first[d + 1]`` are those of document ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def range_hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of the batch."""
        return mix((self.sums[end] - self.sums[begin]) * _tables(len(self.data) + 1)[1][begin] + np.uint64(1))

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``size`` bytes of the words that are longer, and which words these are."""
        at = np.flatnonzero(self.end - self.start > size)
        begin = self.start[at]
        raw = (self.sums[begin + size] - self.sums[begin]) * _tables(len(self.data) + 1)[1][begin]
        return mix(raw + np.uint64(size)), at

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts())


def words(texts: list[bytes], lower: bool = True, separators: np.ndarray = SEPARATOR) -> Words:
    """Words of the texts, ASCII letters lower-cased if asked; equal words have equal hashes in every batch.

    ``separators`` marks the bytes that end words; line feed must be one of them.
    """
    joined = b"\n".join(texts) + b"\n"
    if lower:
        joined = joined.translate(LOWER)
    data = np.frombuffer(joined, dtype=np.uint8)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    outside = np.ones(len(data) + 1, dtype=bool)
    outside[1:] = np.frombuffer(joined.translate(separators.tobytes()), dtype=bool)
    edge = np.flatnonzero(outside[1:] != outside[:-1])  # the last byte is a line feed, so every word ends
    start, end = edge[::2], edge[1::2]
    powers, inverses = _tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    for begin in range(0, len(data), CACHED):
        values = data[begin : begin + CACHED].astype(np.uint64)
        values += np.uint64(1)
        values *= powers[begin : begin + len(values)]
        values[:1] += sums[begin : begin + 1]
        np.cumsum(values, out=sums[begin + 1 : begin + 1 + len(values)])
    raw = (sums[end] - sums[start]) * inverses[start]
    return Words(data, offsets, start, end, mix(raw), np.searchsorted(start, offsets), sums)


def run_sums(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` (64 at most) hashes the sum of the i-th times ``_LANES[i]``, from sums of half as many."""
    part, m = hashes * _LANES[0], 1
    total, done = hashes[:0], 0
    while True:
        if size & m:
            n = len(hashes) - done - m + 1
            total = total[:n] + part[done:][:n] * _LANES[done - 1] if done else part
            done += m
        if 2 * m > size:
            return total
        part = part[:-m] + part[m:] * _LANES[m - 1]
        m *= 2


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one document, and the index of each run's first word."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = run_sums(w.hash, size)
    fits = np.ones(n - size + 1, dtype=bool)
    for i in range(1, size):
        cut = w.first[1:-1] - i
        fits[cut[(cut >= 0) & (cut < len(fits))]] = False
    at = np.flatnonzero(fits)
    return mix(total[at]), at


def shingle_sets(w: Words, size: int = WORDS_PER_SHINGLE) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``size``-word shingles.

    A document of 1 to ``size`` - 1 words has its whole sequence as its one shingle, one without words none.
    """
    hashes, at = windows(w, size)
    bounds = np.searchsorted(at, w.first)
    out = []
    for d, n in enumerate(w.counts().tolist()):
        if n >= size:
            out.append(np.unique(hashes[bounds[d] : bounds[d + 1]]))
        elif n:
            own = w.hash[w.first[d] : w.first[d + 1]]
            out.append(mix(np.array([(own * _LANES[:n]).sum() + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(hashes[:0])
    return out


def set_id(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set of hashes; equal sets have equal names."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Split a record batch into runs of rows whose texts have about ``CHUNK`` bytes."""
    texts = text_bytes(batch.column(column))
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]
