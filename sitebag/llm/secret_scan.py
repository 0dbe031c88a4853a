"""Secret scans: pattern matches, and a battery of randomness tests with length-aware false-discovery control.

A candidate is a run of 16 or more characters of ``[A-Za-z0-9+/_=-]``; those without a letter or without a digit, mostly
words, are in groups of their own, so that they do not move the thresholds of the others. Its smallest alphabet is
inferred; chi-squared uniformity over that alphabet, a runs test about the middle of the alphabet and the serial
correlation give one distance from randomness. How often natural text of the same length, read in the same alphabet, comes
as close is counted on letter windows of all texts; per alphabet and length class the Benjamini-Hochberg rule turns
these shares into a threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_help import releasing
from .textbatch import chunks

KINDS = ("assign", "access", "hex")
ADDED = "random"
MIN_LENGTH = 16
CLASSES = (16, 20, 24, 32, 40, 64)  # lower ends of the length classes, and the lengths of the natural windows
#: Alphabet groups: size, and the place of ``a`` in it. Alphabets that natural letters do not fit share the first. From
#: ``PLAIN`` on: tokens without a letter or without a digit, of one case or digits, of both cases, with other characters.
GROUPS = ((26, 0), (36, 10), (62, 36), (66, 36), (26, 0), (52, 26), (66, 36))
PLAIN = 4
CASED = (2, 3, 5, 6)  # groups of alphabets with both cases
_WINDOWS = 4096
STEPS = 240  # of the distance, on a logarithmic scale
FALSE_DISCOVERIES = 0.01

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("\\x20", " "),
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, as the shorter runs are dropped
_HINTS = (b"passw", b"secret", b"token", b"api")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """Pattern matches, leftmost and non-overlapping per kind, as (start, kind, end); too short ones are dropped."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _lookup(ranges: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(ranges.encode())] = True
    return out


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN = _lookup(_DIGITS + _LOWER + _UPPER + "+/_=-")
_IS_HEX, _IS_DIGIT, _IS_LETTER = _lookup("0123456789abcdef"), _lookup(_DIGITS), _lookup(_LOWER + _UPPER)
_IS_UPPER, _IS_LOWER = _lookup(_UPPER), _lookup(_LOWER)
#: Encodings by size: the first that holds all characters is inferred. Places in the order given.
ALPHABETS = (
    _DIGITS, _LOWER, _UPPER, _UPPER + _LOWER, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
    _DIGITS + _UPPER + _LOWER, _DIGITS + _UPPER + _LOWER + "+/_=-",
)


def _distance(codes: np.ndarray, row: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Squared distance from randomness of each row of characters (places in an alphabet of ``size``)."""
    m = len(n)
    if not m:
        return np.zeros(0)
    width = int(size.max())
    counts = np.bincount(row * width + codes, minlength=m * width).reshape(m, width)
    squares = (counts.astype(np.float64) ** 2).sum(axis=1)
    chi = squares * size / n - n
    uniform = np.maximum((chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n), 0)
    high = (codes >= (size // 2)[row]).astype(np.float64)
    inner = np.flatnonzero(row[1:] == row[:-1])
    changes = np.bincount(row[inner], high[inner] != high[inner + 1], minlength=m)
    up = np.bincount(row, high, minlength=m)
    mean = 1 + 2 * up * (n - up) / n
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-3))
    runs = np.where((up > 0) & (up < n), (changes + 1 - mean) / spread, np.sqrt(n))
    centre = codes - (np.bincount(row, codes, minlength=m) / n)[row]
    power = np.bincount(row, centre**2, minlength=m)
    product = np.bincount(row[inner], centre[inner] * centre[inner + 1], minlength=m)
    serial = np.where(power > 0, product / np.maximum(power, 1e-9) + 1 / n, 1.0) * np.sqrt(n)
    return uniform**2 + runs**2 + serial**2


def _step(distance: np.ndarray) -> np.ndarray:
    return np.minimum((np.log1p(distance) * 24).astype(np.int64), STEPS - 1)


def _class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASSES, n, side="right") - 1


@dataclass
class Candidates:
    doc: np.ndarray
    start: np.ndarray  # bytes from the beginning of the document
    end: np.ndarray
    group: np.ndarray
    length_class: np.ndarray
    step: np.ndarray


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])


def _runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(member.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    keep = end - start >= least
    return start[keep], end[keep]


def candidates(data: np.ndarray, offsets: np.ndarray) -> Candidates:
    """Runs of token characters, and their distance from randomness."""
    start, end = _runs(_TOKEN[data], MIN_LENGTH)
    digits = np.concatenate([[0], np.cumsum(_IS_DIGIT[data])])
    letters = np.concatenate([[0], np.cumsum(_IS_LETTER[data])])
    both = (digits[end] > digits[start]) & (letters[end] > letters[start])
    n = (end - start).astype(np.float64)
    row = np.repeat(np.arange(len(n)), end - start)
    at = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(end - start)[:-1]]), end - start) + start[row] if len(n) else row
    # a word with a capital at its beginning is read like any other word
    upper = np.concatenate([[0], np.cumsum(_IS_UPPER[data])])
    lower = np.concatenate([[0], np.cumsum(_IS_LOWER[data])])
    titled = _IS_UPPER[data[start]] & (upper[end] - upper[start] == 1) & (lower[end] - lower[start] == end - start - 1)
    chars = np.where((at == start[row]) & titled[row], data[at] | 32, data[at]) if len(n) else data[at]
    codes, size = np.zeros(len(chars), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    for alphabet in ALPHABETS:
        place = np.full(256, -1)
        place[list(alphabet.encode())] = np.arange(len(alphabet))
        fits = (np.bincount(row, place[chars] < 0, minlength=len(n)) == 0) & (size == 0)
        size[fits] = len(alphabet)
        mine = fits[row]
        codes[mine] = place[chars[mine]]
    doc = np.searchsorted(offsets, start, side="right") - 1
    mixed = np.select([size == g[0] for g in GROUPS[1:PLAIN]], range(1, PLAIN), 0)
    plain = np.select([size == g[0] for g in GROUPS[PLAIN + 1 :]], range(PLAIN + 1, len(GROUPS)), PLAIN)
    group = np.where(both, mixed, plain)
    return Candidates(doc, start - offsets[doc], end - offsets[doc], group, _class(n), _step(_distance(codes, row, n, size)))


def _parts_of(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of places below ``width``: the sum of squared counts, and the serial-correlation term of the distance."""
    m, n = codes.shape
    counts = np.bincount((codes + np.arange(m)[:, None] * width).ravel(), minlength=m * width).reshape(m, width).astype(np.float32)
    centre = codes.astype(np.float32)
    centre -= centre.mean(axis=1, keepdims=True)
    power, product = np.einsum("ij,ij->i", centre, centre), np.einsum("ij,ij->i", centre[:, 1:], centre[:, :-1])
    serial = np.where(power > 0, product / np.maximum(power, 1e-9) + 1 / n, 1.0) * np.sqrt(n)
    return np.einsum("ij,ij->i", counts, counts).astype(np.float64), serial


def _runs_about(codes: np.ndarray, half: int) -> np.ndarray:
    """The runs term of the distance, about a place in the alphabet."""
    n = codes.shape[1]
    is_high = codes >= half
    up = is_high.sum(axis=1)
    changes = (is_high[:, 1:] != is_high[:, :-1]).sum(axis=1)
    mean = 1 + 2 * up * (n - up) / n
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-3))
    return np.where((up > 0) & (up < n), (changes + 1 - mean) / spread, np.sqrt(n))


def _natural(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (group, class, step) of letter windows: each document's letters in order, cut into windows of every class.

    All classes read all letters but a document's last ones, fewer than a window, so counts do not depend on how documents fall
    into batches. Alphabets of one case read the letters in lower case, those of both cases as they are. The distance is that
    of :func:`_distance`, of which alphabets share parts.
    """
    at = np.flatnonzero(_IS_LETTER[data])
    letters = data[at]
    upper = letters < 97
    place = (letters | 32).astype(np.int64) - 97
    first = np.searchsorted(at, offsets)
    held = np.diff(first)
    out = np.zeros((len(GROUPS), len(CLASSES), STEPS), dtype=np.int64)
    for c, n in enumerate(CLASSES):
        many = held // n
        begin = np.repeat(first[:-1] - n * (np.cumsum(many) - many), many) + n * np.arange(many.sum())
        for b in range(0, len(begin), _WINDOWS):
            rows = begin[b : b + _WINDOWS, None] + np.arange(n)
            low, high = place[rows], upper[rows]
            squares, serial = _parts_of(low, 26)
            mixed = np.flatnonzero(high.any(axis=1))  # windows of lower letters alone are the same in both readings
            cased = np.where(high[mixed], low[mixed], low[mixed] + 26)  # upper before lower, as in those alphabets
            parts = _parts_of(cased, 52)
            known: dict[tuple[int, int], np.ndarray] = {}
            for g, (size, shift) in enumerate(GROUPS):
                if (size, shift) not in known:
                    # lower letters begin at ``shift`` in the alphabet
                    own, runs, ties = squares, np.full(len(low), np.sqrt(n)), serial
                    if g in CASED:
                        own, ties = squares.copy(), serial.copy()
                        own[mixed], ties[mixed] = parts
                        runs[mixed] = _runs_about(cased, size // 2 - (shift - 26))
                    else:
                        runs = _runs_about(low, size // 2 - shift)
                    chi = own * size / n - n
                    uniform = np.maximum((chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n), 0)
                    known[size, shift] = _step(uniform**2 + runs**2 + ties**2)
                out[g, c] += np.bincount(known[size, shift], minlength=STEPS)
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros((len(GROUPS), len(CLASSES), STEPS), dtype=np.int64)
    natural = np.zeros_like(found)
    for batch in batches:
        for _, texts in chunks(batch):
            data, offsets = _laid_out(texts)
            natural += _natural(data, offsets)
            own = candidates(data, offsets)
            np.add.at(found, (own.group, own.length_class, own.step), 1)
    g, c, s = np.nonzero(found + natural)
    yield pa.RecordBatch.from_arrays(
        [*(pa.array(x, pa.int32()) for x in (g, c, s)), pa.array(found[g, c, s]), pa.array(natural[g, c, s])],
        ["alphabet", "length_class", "step", "found", "natural"],
    )


def thresholds(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> np.ndarray:
    """Per alphabet group and length class the largest step that is still a discovery (-1: none), from all texts.

    The share of natural windows at most that far from randomness is a candidate's p-value; the Benjamini-Hochberg rule
    bounds the expected share of natural ones among the discoveries of each class. Only the counts (groups times
    classes times steps) reach the driver.
    """
    counted = docs.select("text").mapInArrow(releasing(_tally), "alphabet int, length_class int, step int, found long, natural long")
    found = np.zeros((len(GROUPS), len(CLASSES), STEPS))
    natural = np.zeros_like(found)
    totals = counted.groupBy("alphabet", "length_class", "step").agg(F.sum("found"), F.sum("natural"))
    for g, c, s, f, n in totals.collect():
        found[g, c, s], natural[g, c, s] = f, n
    p = (1 + np.cumsum(natural, axis=2)) / (1 + natural.sum(axis=2, keepdims=True))
    share = np.cumsum(found, axis=2) / np.maximum(found.sum(axis=2, keepdims=True), 1)
    good = (p <= rate * share) & (found > 0)
    return np.where(good.any(axis=2), STEPS - 1 - np.argmax(good[:, :, ::-1], axis=2), -1)


def _scan(texts: list[bytes], limit: np.ndarray) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and added spans of each text."""
    data, offsets = _laid_out(texts)
    runs, _ = _runs(_IS_HEX[data], MIN_LENGTH)
    with_hex = set((np.searchsorted(offsets, runs, side="right") - 1).tolist())
    base: list[list[Span]] = [[] for _ in texts]
    for i, raw in enumerate(texts):
        if i in with_hex or b"AKIA" in raw or any(h in raw.lower() for h in _HINTS):
            base[i] = base_spans(raw.decode("utf-8"))
    own = candidates(data, offsets)
    added: list[list[Span]] = [[] for _ in texts]
    for d, s, e in zip(*(x[own.step <= limit[own.group, own.length_class]].tolist() for x in (own.doc, own.start, own.end)), strict=True):
        begin = len(texts[d][:s].decode("utf-8"))
        end = begin + e - s
        if not any(a < end and begin < b for a, _, b in base[d]):
            added[d].append((begin, len(KINDS), end))
    return base, added


def find_secrets(docs: DataFrame, limit: np.ndarray) -> DataFrame:
    """``doc_id, spans, base`` per row: arrays of ``(kind, start, end)`` in code points, ends exclusive, in order.

    ``base`` holds the pattern matches, ``spans`` these and the random tokens that none of them touches (kind ``random``).
    Null and empty text: empty arrays. Repeated rows are read each; other columns are not read.
    """
    names = (*KINDS, ADDED)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def named(spans: list[Span]) -> list[dict]:
        return [{"kind": names[k], "start": s, "end": e} for s, k, e in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                base, added = _scan(texts, limit)
                every = pa.array([named(b + a) for b, a in zip(base, added, strict=True)], kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), every, pa.array([named(b) for b in base], kind)], ["doc_id", "spans", "base"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(releasing(run), f"doc_id long, spans {span}, base {span}")


def masked(docs: DataFrame, limit: np.ndarray, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``, ``n_chars`` counted again; all other columns as they were."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                base, added = _scan(texts, limit)
                out = part.column("text").to_pylist()
                sizes = part.column("n_chars").to_pylist() if "n_chars" in columns else []
                for i, (b, a) in enumerate(zip(base, added, strict=True)):
                    if b or a:
                        pieces, done = [], 0
                        for s, _, e in sorted(b + a):
                            if s >= done:
                                pieces += [out[i][done:s], mark]
                            done = max(done, e)
                        out[i] = "".join(pieces) + out[i][done:]
                        if sizes:
                            sizes[i] = len(out[i])
                arrays = {c: part.column(c) for c in columns}
                arrays["text"] = pa.array(out, pa.string())
                if sizes:
                    arrays["n_chars"] = pa.array(sizes, arrays["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return docs.mapInArrow(releasing(run), docs.schema)
