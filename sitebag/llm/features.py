"""Hashed and counted features of texts, a batch of documents at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textbatch import Words, mix, windows, words

SYMBOLS = b"#*$%&|<>"


def _table(members: bytes | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


NOT_LETTER = ~(_table(range(65, 91)) | _table(range(97, 123)) | _table(range(128, 256)))
_SYMBOL, _UPPER, _DIGIT, _HIGH = _table(SYMBOLS), _table(range(65, 91)), _table(range(48, 58)), _table(range(128, 256))
_LETTER, _STOP, _CONTINUES = ~NOT_LETTER, _table(b".,;:!?"), _table(range(128, 192))


@dataclass
class Rows:
    """Sparse rows: ``index[first[d]:first[d + 1]]`` and ``value`` of document ``d``."""

    first: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def counted(docs: int, doc: np.ndarray, hashes: np.ndarray, bits: int) -> Rows:
    """Occurrences of hashed features per document; the low ``bits`` of a hash are its index."""
    key = (doc.astype(np.int64) << bits) | (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    first = np.searchsorted(key, np.arange(docs + 1, dtype=np.int64) << bits)
    return Rows(first, (key & ((1 << bits) - 1)).astype(np.int32), count.astype(np.float32))


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of flags between consecutive bounds."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[bounds])


def _repeats(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which (document, hash) pairs occur more than once, first ones included."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    same = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    twice = np.zeros(len(d), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(d), dtype=bool)
    out[order] = twice
    return out


def repeated_words(w: Words, size: int = 5) -> np.ndarray:
    """Which words lie in a window of ``size`` words that the document has twice or more."""
    hashes, at = windows(w, size)
    cover = np.zeros(len(w.hash) + 1, dtype=np.int32)
    if len(at):
        hit = at[_repeats(w.doc()[at], hashes)]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + size, -1)
    return np.cumsum(cover[:-1]) > 0


def lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each line that has a word, its document, and whether it equals an earlier line of the document."""
    feed = np.flatnonzero(w.data == 10)
    begin, end = np.concatenate([[0], feed[:-1] + 1]), feed
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[full], end[full]
    raw = w.range_hash(begin, end)
    doc = np.searchsorted(w.offsets, begin, side="right") - 1
    order = np.lexsort((np.arange(len(raw)), raw, doc))
    again = np.zeros(len(raw), dtype=bool)
    if len(raw):
        again[order[1:]] = (doc[order][1:] == doc[order][:-1]) & (raw[order][1:] == raw[order][:-1])
    return raw, doc, again


@dataclass
class Counts:
    """Exact counts of each document; words are runs without space and 0x09-0x0D, case kept."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def counts(w: Words) -> Counts:
    inside = np.zeros(len(w.data) + 1, dtype=np.int32)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    in_word = np.cumsum(inside[:-1]) > 0
    _, line_doc, again = lines(w)
    return Counts(
        w.counts(),
        per_doc(in_word & ~_CONTINUES[w.data], w.offsets),
        per_doc(_SYMBOL[w.data], w.offsets),
        np.bincount(line_doc[again], minlength=w.docs),
        per_doc(repeated_words(w), w.first),
    )


STATISTICS = (
    "log_words log_chars word_length symbols upper digits stops high unique_words same_as_before "
    "repeated_windows lines repeated_lines line_length bars_between letters"
).split()


def statistics(w: Words) -> np.ndarray:
    """One row of ``STATISTICS`` per document; all zero shares for an empty text. ``w`` keeps the case."""
    c = counts(w)
    size = np.maximum(np.diff(w.offsets) - 1, 0)
    n, size1 = np.maximum(c.n_words, 1), np.maximum(size, 1)
    doc = w.doc()
    same = np.zeros(len(w.hash), dtype=bool)
    if len(same):
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    distinct = counted(w.docs, doc, w.hash, 31)
    _, line_doc, again = lines(w)
    n_lines = np.bincount(line_doc, minlength=w.docs)
    letters = per_doc(_LETTER[w.data], w.offsets)
    bars = np.bincount(doc[(w.end - w.start == 1) & _SYMBOL[w.data[w.start]]], minlength=w.docs) if len(doc) else np.zeros(w.docs)
    columns = [
        np.log1p(c.n_words),
        np.log1p(size),
        c.word_chars / n,
        c.n_symbols / size1,
        per_doc(_UPPER[w.data], w.offsets) / np.maximum(letters, 1),
        per_doc(_DIGIT[w.data], w.offsets) / size1,
        per_doc(_STOP[w.data], w.offsets) / n,
        per_doc(_HIGH[w.data], w.offsets) / size1,
        np.diff(distinct.first) / n,
        np.bincount(doc[same], minlength=w.docs) / n,
        c.n_repeat_words / n,
        np.log1p(n_lines),
        np.bincount(line_doc[again], minlength=w.docs) / np.maximum(n_lines, 1),
        np.log1p(size / np.maximum(n_lines, 1)),
        bars / n,
        letters / size1,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def character_ngrams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``size`` bytes inside a document."""
    data = w.data.astype(np.uint64)
    n = len(data) - size
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    code = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        code |= data[i : n + i] << np.uint64(8 * i)
    edge = np.zeros(len(w.data) + 1, dtype=np.int8)
    lengths = np.maximum(np.diff(w.offsets) - 1 - size + 1, 0)
    has = lengths > 0
    np.add.at(edge, w.offsets[:-1][has], 1)
    np.add.at(edge, (w.offsets[:-1] + lengths)[has], -1)
    at = np.flatnonzero(np.cumsum(edge[:-1])[:n] > 0)
    return mix(code[at] + np.uint64(size)), np.repeat(np.arange(w.docs), lengths)


def letter_words(texts: list[bytes]) -> Words:
    """Runs of letters (ASCII letters lower-cased, and all bytes above 127)."""
    return words(texts, True, NOT_LETTER)


def stack(parts: list[Rows]) -> Rows:
    """Rows of several batches one below the other."""
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))]) if parts else np.zeros(1, dtype=np.int64)
    empty = np.zeros(0, dtype=np.int32)
    index = np.concatenate([p.index for p in parts]) if parts else empty
    value = np.concatenate([p.value for p in parts]) if parts else empty.astype(np.float32)
    return Rows(first.astype(np.int64), index, value)
