"""Fuzzy passages that repeat across documents: shared word k-mers, collinear chains, alignment.

1. Seeds are the minimizers of ``WINDOW`` consecutive ``K``-word runs, so any equal stretch of ``K + WINDOW - 1`` words
   shares one.
2. Holders of a seed are ordered by document. Each document meets the first holder and the one just before it, never all
   others: first inside a block of rows of one task, then the blocks' first ones across tasks. So a seed that a third of
   all documents hold sends its places in one document per block through the shuffle, and every place in a document but
   the very first has a partner. Of two documents all places of a seed meet (``_matches`` says what very many do).
   First holders and matches travel packed, all of a seed or of a document in one bucket, many of them in one row.
3. Per pair of documents the matches are chained in order in both texts, with a cost for the gap: the best of every prefix
   of the other text is kept, for many pairs at once or, where the texts hold many places, only where it grows.
4. Chains are aligned word by word along their diagonals, extended, and cut into all their maximal-scoring stretches.
5. Seeds of one passage may have different first holders, so that no chain holds all of it. Runs of seeds seen earlier
   that no passage covers go through an exact second pass: each of their ``MIN_WORDS``-word windows meets the first
   holder of that very window, so every equal stretch of that length is found, whoever else holds parts of it.
6. For nearly equal passages every place of a seed with words near it that no passage covers yet meets *all* earlier
   places of that seed, whatever their number: the ``MARGIN`` words to either side are laid on one another in both texts,
   and along one shift of two seeds. Blocks of places meet blocks, so a frequent seed is spread over tasks; only pairs
   that cover further words leave them (``_meet_all``) and go through steps 3 and 4.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_help import filter_bits, in_bits, partitions, releasing, slot_bits, slot_column, staged, take, unstaged
from .textbatch import _LANES, Words, chunks, mix, run_sums, windows, words

K = 6
WINDOW = 12
BLOCK_SEEDS = 2_000_000
PIECE_SEEDS = 100_000
BUCKETS = 8  # a shuffle partition; their rows travel packed, many in one row
PACKED = 500_000
ALL_PLACES = 256
NEAR_PLACES = 8
GRAM_BITS = 26
GAP_COST = 0.2
MIN_WORDS = 50
MIN_EQUAL = 80  # per cent of a passage's words that are equal at both ends of the alignment
MARGIN = 48
MISS = -3  # against +1 for an equal word, when a passage is trimmed
SIDE = 2 * MARGIN + K  # words around a seed
BLOCK_PLACES = 16_384
TILE = 1 << 17
MEET_ROWS = 16_384
REACH = 400
RUN = 4  # the outermost equal words of a stretch come in runs of more than -MISS

MATCH = "doc_id long, other_id long, pos int, other_pos int"
CHAIN = "doc_id long, other_id long, anchors binary, other_anchors binary, begin int, end int, other_begin int, other_end int"
PACKED_ROWS = "bucket int, hash binary, doc_id binary, other_id binary, n binary, pos binary, shift binary"
PASSAGE = "doc_id long, other_id long, start_word int, end_word int, other_start int, other_end int, equal_words int"


def _sorted_seeds(texts: list[bytes], doc_ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """hash, document and word position of the minimizers of each text."""
    return _minimizers(words(texts), doc_ids)


def _minimizers(w: Words, doc_ids: np.ndarray) -> tuple[np.ndarray, ...]:
    hashes, at = windows(w, K)
    bounds = np.searchsorted(at, w.first)
    n = np.diff(bounds)
    least, size = np.arange(len(hashes)), 1  # the first of the smallest hashes of ``size`` runs from each
    while size < WINDOW:
        step = min(size, WINDOW - size)
        left, right = least[: max(len(least) - step, 0)], least[step:]
        least, size = np.where(hashes[right] < hashes[left], right, left), size + step
    d = np.repeat(np.arange(w.docs), n)
    whole = np.arange(len(least)) + WINDOW <= bounds[1:][d[: len(least)]]
    picked = np.zeros(len(hashes), dtype=bool)
    picked[least[whole]] = True
    for e in np.flatnonzero((n > 0) & (n <= WINDOW)).tolist():
        own = hashes[bounds[e] : bounds[e + 1]]
        picked[bounds[e] : bounds[e + 1]] = False
        picked[bounds[e] + int(np.argmin(own))] = True
    kept = np.flatnonzero(picked)
    d = d[kept]
    return hashes[kept].view(np.int64), doc_ids[d].astype(np.int64), (at[kept] - w.first[d]).astype(np.int32)


def _holders(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by (hash, document): where each holder's rows begin, each holder's first holder, each row's holder."""
    change = np.ones(len(h), dtype=bool)
    change[1:] = h[1:] != h[:-1]
    own = change.copy()
    own[1:] |= doc[1:] != doc[:-1]
    begin = np.flatnonzero(own)
    lead = np.maximum.accumulate(np.where(change[begin], np.arange(len(begin)), 0))
    return begin, lead, np.cumsum(own) - 1


def _matches(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, done: int = 0) -> list[np.ndarray]:
    """For rows sorted by (hash, document, position): each holder's places with the first holder's and those before it.

    All places of two holders meet up to ``ALL_PLACES`` pairs. Beyond, a place meets the other's places whose numbers
    differ by ``NEAR_PLACES`` at most (the last ones where it has fewer), and the first. Holders below ``done`` are
    only partners.
    """
    begin, lead, holder = _holders(h, doc)
    count = np.diff(np.append(begin, len(h)))
    number = np.arange(len(h)) - begin[holder]
    found = []
    at = np.flatnonzero((lead[holder] != holder) & (holder >= done))
    before = at[holder[at] - 1 != lead[holder[at]]]
    for rows, partner in ((at, lead[holder[at]]), (before, holder[before] - 1)):
        m = count[partner]
        few = count[holder[rows]] * m <= ALL_PLACES
        low = np.where(few, 0, np.clip(number[rows] - NEAR_PLACES, 0, m - 1))
        high = np.where(few, m, np.clip(number[rows] + NEAR_PLACES + 1, low + 1, m))
        many = high - low
        a = np.repeat(rows, many)
        b = np.repeat(begin[partner] + low - np.cumsum(many) + many, many) + np.arange(len(a))
        found += [(a, b), (rows[low > 0], begin[partner[low > 0]])]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return [doc[a], doc[b], pos[a], pos[b]]


_PACKED_NAMES = ["bucket", "hash", "doc_id", "other_id", "n", "pos", "shift"]


def _buckets_of(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The names by which 64-bit keys are dealt, and the bucket of each; buckets are ranges of the names."""
    name = mix(keys.view(np.uint64))
    return name, ((name >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray], inner: dict[str, np.ndarray] | None = None, at: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a bucket, of rows in order of ``bucket``: their ``columns``, and ``inner``, of which those of row i begin at ``at[i]``."""
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    edge = np.append(first, len(bucket))
    arrays = {"bucket": pa.array(bucket[first].astype(np.int32))} | {c: _cut(x, edge) for c, x in columns.items()}
    arrays |= {c: _cut(x, at[edge]) for c, x in (inner or {}).items()}
    empty = pa.nulls(len(first), pa.binary())
    return pa.RecordBatch.from_arrays([arrays.get(c, empty) for c in _PACKED_NAMES], _PACKED_NAMES)


def _packed_matches(found: Iterator[list[np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Matches packed by their document: each pair once, with the number of its matches, then their places and shifts."""

    def pack(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        doc, other, pos, other_pos = (np.concatenate(x) for x in zip(*held, strict=True))
        high = np.uint64(0xFFFFFFFF00000000)
        order = np.argsort(_buckets_of(doc, buckets)[0] & high | mix(other.view(np.uint64)) >> np.uint64(32))
        doc, other, pos, other_pos = (x[order] for x in (doc, other, pos, other_pos))
        at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])))
        bounds = np.append(at, len(doc))
        pairs = {"doc_id": doc[at], "other_id": other[at], "n": np.diff(bounds).astype(np.int32)}
        return _packed(_buckets_of(doc[at], buckets)[1], pairs, {"pos": pos, "shift": other_pos - pos}, bounds)

    held: list[list[np.ndarray]] = []
    count = 0
    for rows in found:
        if len(rows[0]):
            held.append(rows)
            count += len(rows[0])
        if count >= PACKED:
            yield pack(held)
            held, count = [], 0
    if held:
        yield pack(held)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by bucket, one batch for each bucket."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
        for begin, end in zip(edge[:-1], edge[1:], strict=True):
            if held and bucket[begin] != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(begin, end - begin))
            last = bucket[begin]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _ordered(rank: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """The order of rows by numbers of which none is below 0."""
    bits = [int(x.max()).bit_length() if len(x) else 0 for x in (rank, *columns)]
    if sum(bits) > 63:
        return np.lexsort((*columns[::-1], rank))
    key = rank.astype(np.int64)
    for x, b in zip(columns, bits[1:], strict=True):
        key = key << b | x
    return np.argsort(key)


def _unpacked(batch: pa.RecordBatch, diagonals: bool = False) -> tuple[np.ndarray, ...]:
    """Matches of a bucket sorted by (document, other, position), or before the position by diagonal."""
    doc, other, n, pos, shift = (_numbers(batch.column(c), k)[0] for c, k in zip(_PACKED_NAMES[2:], ("<i8", "<i8", "<i4", "<i4", "<i4"), strict=True))
    order = np.lexsort((other, doc))
    x, y = doc[order], other[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
    rank = np.empty(len(doc), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    doc, other = x[new], y[new]
    rank, other_pos = np.repeat(rank, n), pos + shift
    order = _ordered(rank, shift - shift.min(initial=0), pos) if diagonals else _ordered(rank, pos, other_pos)
    rank = rank[order]
    return doc[rank], other[rank], pos[order], other_pos[order]


def _piece_matches(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The matches of sorted rows; seeds are whole in a piece, so pieces only bound what is held at once."""
    edges = np.append(np.flatnonzero(np.diff(h, prepend=h[:1] + 1)), len(h))
    begin = 0
    while begin < len(h):
        end = int(edges[min(np.searchsorted(edges, begin + PIECE_SEEDS), len(edges) - 1)])
        yield _matches(h[begin:end], doc[begin:end], pos[begin:end])
        begin = end


def _seed_blocks(seeds_of, buckets: int):
    """Map: matches inside blocks of rows (hash null) and each block's first holder of every seed (hash set), packed."""

    def block(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        ordered = (doc[1:] > doc[:-1]) | ((doc[1:] == doc[:-1]) & (pos[1:] >= pos[:-1]))
        order = np.argsort(h, kind="stable") if ordered.all() else np.lexsort((pos, doc, h))
        h, doc, pos = h[order], doc[order], pos[order]
        new = np.ones(len(h), dtype=bool)  # rows of one document may come more than once
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
        h, doc, pos = h[new], doc[new], pos[new]
        yield from _packed_matches(_piece_matches(h, doc, pos), buckets)
        _, lead, holder = _holders(h, doc)
        first = lead[holder] == holder
        h, doc, pos = h[first], doc[first], pos[first]
        for begin in range(0, len(h), PACKED):
            name, bucket = _buckets_of(h[begin : begin + PACKED], buckets)
            order = np.argsort(name, kind="stable")
            columns = {c: x[begin : begin + PACKED][order] for c, x in (("hash", h), ("doc_id", doc), ("pos", pos))}
            yield _packed(bucket[order], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            for part, texts in chunks(batch):
                seeds = seeds_of(texts, part.column("doc_id").to_numpy())
                held.append(seeds)
                count += len(seeds[0])
                if count >= BLOCK_SEEDS:
                    yield from block(held)
                    held, count = [], 0
        if count:
            yield from block(held)

    return run


def _meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (hash, document, position): matches with the first holder and the one before.

    Held are the places of three holders of one seed: the first, the one before and the open one.
    """
    names = ["doc_id", "other_id", "pos", "other_pos"]
    held: list[np.ndarray] | None = None
    done = 0  # holders at the beginning of ``held`` that are only partners now
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in ("hash", "doc_id", "pos")]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        begin, lead, _ = _holders(*rows[:2])
        last = len(begin) - 1  # may go on in the next batch
        full = [x[: begin[last]] for x in rows]
        yield pa.RecordBatch.from_arrays([*map(pa.array, _matches(*full, done))], names)
        partners = sorted({int(lead[last]), max(int(lead[last]), last - 1)} - {last})
        keep = np.concatenate([np.arange(begin[g], begin[g + 1]) for g in partners] + [np.arange(begin[last], len(rows[0]))])
        held, done = [x[keep] for x in rows], len(partners)
    if held is not None:
        yield pa.RecordBatch.from_arrays([*map(pa.array, _matches(*held, done))], names)


def _meet_buckets(buckets: int):
    """Map over packed first holders sorted by bucket: the packed matches of blocks with one another."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bucket(batches):
            h, doc, pos = (_numbers(batch.column(c), k)[0] for c, k in (("hash", "<i8"), ("doc_id", "<i8"), ("pos", "<i4")))
            order = np.lexsort((pos, doc, h))
            rows = [x[order] for x in (h, doc, pos)]
            for begin in range(0, len(h), PIECE_SEEDS):
                yield pa.RecordBatch.from_arrays([pa.array(x[begin : begin + PIECE_SEEDS]) for x in rows], ["hash", "doc_id", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _meet_blocks(pieces(batches))
        yield from _packed_matches(([x.to_numpy() for x in batch.columns] for batch in met), buckets)

    return run


def _met(docs: DataFrame, seeds_of, name: str) -> tuple[DataFrame, DataFrame]:
    """Matches of the places of equal seeds, packed, all of a document in one bucket; and the staged table they are read from."""
    parts = partitions(docs.sparkSession)
    seeds = staged(docs.mapInArrow(releasing(_seed_blocks(seeds_of, BUCKETS * parts)), PACKED_ROWS), name)
    across = seeds.where("hash is not null").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return seeds.where("hash is null").unionByName(across.mapInArrow(releasing(_meet_buckets(BUCKETS * parts)), PACKED_ROWS)), seeds


_PLACE = 32


def _chain_numbers(pos: list[int], other: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The indices of all chains of :func:`chains`, one chain after the other, and how many each has."""
    n, worth, low = len(pos), round(K / GAP_COST), (1 << _PLACE) - 1
    # places in the other text where a longer prefix has a greater best: a score with the words passed so far, and the match's number
    known, best = [-1], [0]
    score, back = [worth] * n, [-1] * n
    i = 0
    while i < n:
        j, here = i, pos[i]
        while j < n and pos[j] == here:  # matches at one word do not follow each other
            top = best[bisect_left(known, other[j]) - 1]
            reach = (top >> _PLACE) - here - other[j]
            if reach > 0:
                score[j], back[j] = worth + reach, (top & low) - 1
            j += 1
        for m in range(i, j):
            q = other[m]
            entry = (score[m] + here + q) << _PLACE | (m + 1)
            at = bisect_right(known, q)
            if best[at - 1] >= entry:
                continue
            begin = at - 1 if known[at - 1] == q else at
            while at < len(best) and best[at] <= entry:
                at += 1
            known[begin:at], best[begin:at] = [q], [entry]
        i = j
    order = np.argsort(-np.array(score), kind="stable")
    owner = np.empty(n, dtype=np.int64)
    owner[order] = np.arange(n)
    owner = owner.tolist()
    for m in range(n - 1, -1, -1):  # a match belongs to the best of the chains that go through it
        b = back[m]
        if b >= 0 and owner[m] < owner[b]:
            owner[b] = owner[m]
    found = np.array(owner)
    order = np.argsort(found, kind="stable")
    found = found[order]
    return order, np.diff(np.append(np.flatnonzero(np.append(True, found[1:] != found[:-1])), n))


def _chains_by_rows(pair: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_chain_numbers` gives for many pairs at once, matches in order of pair and ``p``; chains in order of the pairs.

    All matches at one word of their pair take one step together. Of each pair the best of every prefix of the other text is
    kept, so a step costs as much as the other text has places.
    """
    n, worth, low = len(p), round(K / GAP_COST), np.int64((1 << _PLACE) - 1)
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    new = np.append(True, (pair[1:] != pair[:-1]) | (p[1:] != p[:-1]))
    row = np.cumsum(new)
    row -= row[first][pair]
    known, rank = np.unique(pair << 32 | q, return_inverse=True)
    begin = np.searchsorted(known >> 32, np.arange(len(first) + 1))
    width = int(np.diff(begin).max()) + 1
    place = pair * width + rank - begin[pair] + 1
    by_row = np.argsort(row, kind="stable")
    edge = np.searchsorted(row[by_row], np.arange(int(row.max()) + 2)).tolist()
    place, passed, number = place[by_row], (p + q)[by_row], by_row - first[pair[by_row]] + 1
    start = first[pair[by_row]]
    last = np.maximum.reduceat(pair[by_row], edge[:-1]).tolist()  # pairs of each step, if long ones come first
    best = np.zeros((len(first), width), dtype=np.int64)
    flat = best.reshape(-1)
    score, back = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for lo, hi, upto in zip(edge[:-1], edge[1:], last, strict=True):
        at, here = place[lo:hi], passed[lo:hi]
        top = flat[at - 1]
        reach = (top >> _PLACE) - here
        some = reach > 0
        own = worth + reach * some
        score[lo:hi] = own
        back[lo:hi] = np.where(some, (top & low) - 1 + start[lo:hi], -1)
        flat[at] = np.maximum(flat[at], (own + here) << _PLACE | number[lo:hi])
        part = best[: upto + 1]
        np.maximum.accumulate(part, axis=1, out=part)
    turned = np.empty(n, dtype=np.int64)
    turned[by_row] = np.arange(n)
    order = np.lexsort((-score[turned], pair))
    owner = np.empty(n + 1, dtype=np.int64)  # the last one stands for no match
    owner[order] = np.arange(n)
    for lo, hi in zip(edge[-2::-1], edge[:0:-1], strict=True):  # a match belongs to the best of the chains that go through it
        np.minimum.at(owner, back[lo:hi], owner[by_row[lo:hi]])
    found = owner[:n]
    order = np.argsort(found, kind="stable")
    found = found[order]
    return order, np.diff(np.append(np.flatnonzero(np.append(True, found[1:] != found[:-1])), n))


def crossed_chains(p: np.ndarray, q: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chains of :func:`chains` for many pairs, whose matches in order of ``p`` begin at ``begin``.

    The indices of all chains one after the other, and how many each has.
    """
    n = np.diff(np.append(begin, len(p)))
    pair = np.repeat(np.arange(len(begin)), n)
    p, q = p.astype(np.int64), q.astype(np.int64)
    new = np.append(True, (pair[1:] != pair[:-1]) | (p[1:] != p[:-1]))
    rows = np.bincount(pair[new], minlength=len(begin))
    places = np.bincount(np.unique(pair << 32 | q) >> 32, minlength=len(begin))
    # nanoseconds of a step for a place of the other text and in itself, and of a match by itself
    by_rows = (rows * (3 * places + 300) < 1_500 * n) & (int(p.max()) + int(q.max()) + round(K / GAP_COST) * int(n.max()) < 1 << 30)
    order, sizes = [], []
    for k in np.flatnonzero(~by_rows).tolist():
        own, size = _chain_numbers(p[begin[k] : begin[k] + n[k]].tolist(), q[begin[k] : begin[k] + n[k]].tolist())
        order.append(own + begin[k])
        sizes.append(size)
    at = np.flatnonzero(by_rows)
    at = at[np.argsort(places[at], kind="stable")]
    while len(at):  # pairs with about as many places, long ones first
        m = max(1, int(np.searchsorted(np.cumsum(n[at]), TILE)))
        some = at[:m][np.argsort(-rows[at[:m]], kind="stable")]  # the steps of short ones end first
        at = at[m:]
        index = np.repeat(begin[some] - np.cumsum(n[some]) + n[some], n[some]) + np.arange(n[some].sum())
        own, size = _chains_by_rows(np.repeat(np.arange(len(some)), n[some]), p[index], q[index])
        order.append(index[own])
        sizes.append(size)
    return np.concatenate(order), np.concatenate(sizes)


def chains(pos: list[int], other: list[int]) -> list[list[int]]:
    """Collinear chains of matches given in order of ``pos``; indices of each chain, the best chain first.

    A match is worth ``K``; stepping from one to the next costs ``GAP_COST`` for each word passed in either text. With
    linear costs the best predecessor is a prefix maximum, kept for each place in the other text where it grows. A step
    that costs as much as the chain is worth starts a new chain. Scores are whole numbers, in units of ``GAP_COST``.
    """
    if not pos:
        return []
    order, size = _chain_numbers(pos, other)
    return [x.tolist() for x in np.split(order, np.cumsum(size)[:-1])]


def collinear_chains(p: np.ndarray, q: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chains of :func:`chains` for many pairs at once, each of whose matches go up in both texts; ``begin`` marks the pairs.

    There the best predecessor of a match is the one just before it, so scores are a sum that starts again where it would
    fall to zero. A chain ends where no later match of its run scores more. Begins and ends of
    the chains; every match is in one.
    """
    n = len(p)
    unit = round(K / GAP_COST)
    step = np.zeros(n, dtype=np.int64)
    step[1:] = unit - (p[1:] - p[:-1]) - (q[1:] - q[:-1])
    step[begin] = -(np.int64(1) << 40)  # no run goes on from one pair to the next
    total = np.cumsum(step)
    reach = total - np.minimum.accumulate(total)
    starts = np.flatnonzero(reach == 0)
    run = np.cumsum(reach == 0)
    # ends: the scores of a run from the right, kept apart from other runs by a bound that grows to the left
    lift = (run.max() - run + 1) * (np.int64(unit) * n + 1) if n else run
    later = np.maximum.accumulate((reach + lift)[::-1])[::-1]
    last = np.zeros(n, dtype=bool)
    last[:-1] = (run[1:] != run[:-1]) | (reach[:-1] + lift[:-1] >= later[1:])
    last[-1:] = True
    ends = np.flatnonzero(last) + 1
    return np.union1d(starts, ends[:-1]), ends


def _chain_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over packed matches sorted by bucket: chains of at least two seeds as arrays of anchors.

    Rows without ``other_id`` hold all places of a document's matches in order, one row a document.
    """
    names = ["doc_id", "other_id", "anchors", "other_anchors", "begin", "end", "other_begin", "other_end"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int32()] * 4]

    def listed(values: np.ndarray, size: np.ndarray) -> pa.Array:
        return _cut(values.astype(np.int32), np.concatenate([[0], np.cumsum(size)]))

    def emit(doc: np.ndarray, other: np.ndarray, p: np.ndarray, q: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the chains ``begin:end`` of the matches."""
        many = end - begin > 1
        b, e = begin[many], end[many]
        for at in range(0, len(b), 10_000):
            bb, ee = b[at : at + 10_000], e[at : at + 10_000]
            n = ee - bb
            rows = np.repeat(bb - np.cumsum(n) + n, n) + np.arange(n.sum())
            spans = (np.maximum(p[bb] - MARGIN, 0), p[ee - 1] + K + MARGIN, np.maximum(q[bb] - MARGIN, 0), q[ee - 1] + K + MARGIN)
            arrays = [pa.array(doc[bb]), pa.array(other[bb]), listed(p[rows], n), listed(q[rows], n), *(pa.array(x.astype(np.int32)) for x in spans)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    def places(doc: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.append(True, doc[1:] != doc[:-1])
        rank, ids = np.cumsum(new) - 1, doc[new]
        key = rank << 32 | p
        key.sort(kind="stable")
        key = key[np.append(True, key[1:] != key[:-1])]
        n = np.bincount(key >> 32, minlength=len(ids))
        arrays = [pa.array(ids), pa.nulls(len(ids), pa.int64()), listed(key & ((1 << 32) - 1), n), *(pa.nulls(len(ids), k) for k in kinds[3:])]
        yield pa.RecordBatch.from_arrays(arrays, names)

    def finish(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        doc, other, p, q = rows
        yield from places(doc, p)
        edge = np.flatnonzero((doc[1:] != doc[:-1]) | (other[1:] != other[:-1])) + 1
        begin = np.concatenate([[0], edge])
        falls = np.zeros(len(doc), dtype=bool)
        falls[1:] = (p[1:] <= p[:-1]) | (q[1:] <= q[:-1])
        falls[begin] = False
        crossed = np.add.reduceat(falls, begin) > 0
        of = np.repeat(crossed, np.diff(np.append(begin, len(doc))))
        straight = np.flatnonzero(~of)
        if len(straight):
            mine = [x[straight] for x in rows]
            yield from emit(*mine, *collinear_chains(mine[2].astype(np.int64), mine[3].astype(np.int64), np.searchsorted(straight, begin[~crossed])))
        turned = np.flatnonzero(of)
        if len(turned):
            mine = [x[turned] for x in rows]
            at, size = crossed_chains(mine[2], mine[3], np.searchsorted(turned, begin[crossed]))
            end = np.cumsum(size)
            yield from emit(*(x[at] for x in mine), end - size, end)

    for batch in _by_bucket(batches):
        yield from finish(_unpacked(batch))


def _word_codes(bitmap):
    """Map: documents whose id may be wanted -> 32-bit word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = take(batch, in_bits(bitmap.value, batch.column("slot").to_numpy()))
            for part, texts in chunks(wanted):
                w = words(texts)
                codes = (w.hash >> np.uint64(32)).astype("<u4")
                rows = [codes[w.first[d] : w.first[d + 1]].tobytes() for d in range(w.docs)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "codes"])

    return run


def _laid_along(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of ``a`` its place in ``b`` by the anchors ``(x, y)``, and whether the two words are equal.

    Between anchors on one diagonal words are compared in place; where the diagonal shifts, the break that keeps most
    equal words is taken. The ends run on along their diagonals.
    """
    shift = [q - p for p, q in zip(x, y, strict=True)]
    turns = [0] + [i for i in range(1, len(x)) if shift[i] != shift[i - 1]]
    j, same = np.arange(len(a)), np.zeros(len(a), dtype=bool)

    def equal(lo: int, hi: int, d: int, out: np.ndarray) -> np.ndarray:
        """Sets in ``out`` which words from ``lo`` to ``hi`` are equal; it holds no others."""
        begin, end = max(lo, -d), min(hi, len(b) - d)
        if begin < end:
            np.equal(a[begin:end], b[begin + d : end + d], out=out[begin - lo : end - lo])
        return out

    begin = 0
    for t, turn in enumerate(turns):
        d = shift[turn]
        end = len(a)
        if t + 1 < len(turns):
            nxt = turns[t + 1]
            lo, hi = min(x[nxt - 1] + K, x[nxt]), x[nxt]
            end = lo
            if hi > lo:
                gain = np.zeros(hi - lo + 1, dtype=np.int64)
                left, right = (equal(lo, hi, e, np.zeros(hi - lo, dtype=bool)).view(np.int8) for e in (d, shift[nxt]))
                np.cumsum(left - right, dtype=np.int64, out=gain[1:])
                end += int(np.argmax(gain))
        j[begin:end] += d
        if end > begin:
            equal(begin, end, d, same[begin:end])
        begin = end
    return j, same


def stretches(same: np.ndarray, miss: float = MISS) -> list[tuple[int, int]]:
    """All maximal-scoring stretches, in order and disjoint: +1 for an equal word, ``miss`` for another (Ruzzo and Tompa)."""
    padded = np.zeros(len(same) + 2, dtype=bool)
    padded[1:-1] = same
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int, float, float]] = []  # begin, end, score before and after
    score, done = 0.0, 0
    for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        before = score + miss * (begin - done)
        score, done = before + end - begin, end
        while True:
            k = len(held) - 1
            while k >= 0 and held[k][2] >= before:
                k -= 1
            if k < 0:  # nothing held can grow any more
                out += [h[:2] for h in held]
                held = [(begin, end, before, score)]
                break
            if held[k][3] >= score:
                held.append((begin, end, before, score))
                break
            begin, before = held[k][0], held[k][2]
            del held[k:]
    return out + [h[:2] for h in held]


def _passages(same: np.ndarray, min_words: int, min_equal: int) -> list[tuple[int, int, int]]:
    """Begin, end and equal words of the maximal stretches that are long and equal enough.

    A stretch of too few equal words is cut again, with a cost for unequal words at which a positive score has enough.
    """
    strict = -min_equal / (100 - min_equal) if min_equal < 100 else -float(len(same) + 1)
    out = []
    for s, e in stretches(same):
        if e - s < min_words:
            continue
        n = int(same[s:e].sum())
        if 100 * n >= min_equal * (e - s):
            out.append((s, e, n))
        else:
            out += [(s + t, s + u, int(same[s + t : s + u].sum())) for t, u in stretches(same[s:e], strict)]
    return [(s, e, n) for s, e, n in out if e - s >= min_words and 100 * n >= min_equal * (e - s)]


def align(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int]) -> tuple[int, int, int, int, int] | None:
    """Best-scoring stretch around the anchors ``(x, y)`` of two word sequences: begin, end, other begin, end, equal words."""
    j, same = _laid_along(a, b, x, y)
    found = [(s, e, int(same[s:e].sum())) for s, e in stretches(same)]
    if not found:
        return None
    s, e, n = max(found, key=lambda f: f[2] + MISS * (f[1] - f[0] - f[2]))
    return s, e, int(j[s]), int(j[e - 1]) + 1, n


def _one_diagonal(batch: pa.RecordBatch, needed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of chains on one diagonal compared word by word, all at once.

    Which rows are such chains; of those with at least ``needed`` equal words the row, its shift and where its words stand
    in the last array, which says whether each word of the row's part of the text is equal.
    """
    x, y = (_as_lists(batch.column(c)) for c in ("anchors", "other_anchors"))
    first = x.offsets.to_numpy().astype(np.int64)
    shift = y.flatten().to_numpy().astype(np.int64) - x.flatten().to_numpy()
    begin = first[:-1] - first[0]
    straight = np.minimum.reduceat(shift, begin) == np.maximum.reduceat(shift, begin)
    shift = shift[begin] + batch.column("begin").to_numpy() - batch.column("other_begin").to_numpy()

    def words_of(column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        array = batch.column(column)
        bounds = np.frombuffer(array.buffers()[1], dtype=np.int32, count=array.offset + len(array) + 1)[array.offset :].astype(np.int64)
        data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
        return np.ascontiguousarray(data).view("<u4"), (bounds[:-1] - bounds[0]) // 4, np.diff(bounds) // 4

    a, at_a, n_a = words_of("codes")
    b, at_b, n_b = words_of("other_codes")
    row = np.flatnonzero(straight)
    size = n_a[row]
    base = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(base, size)
    other = place + np.repeat(shift[row], size)
    inside = (other >= 0) & (other < np.repeat(n_b[row], size))
    same = np.zeros(len(place), dtype=bool)
    same[inside] = a[(place + np.repeat(at_a[row], size))[inside]] == b[(other + np.repeat(at_b[row], size))[inside]]
    sums = np.concatenate([[0], np.cumsum(same)])
    enough = sums[base + size] - sums[base] >= needed
    return straight, row[enough], shift[row[enough]], np.stack([base[enough], (base + size)[enough]], axis=1), same


def _align_rows(min_words: int, min_equal: int):
    names = ["doc_id", "other_id", "start_word", "end_word", "other_start", "other_end", "equal_words"]
    needed = -(-min_words * min_equal // 100)  # a passage has at least so many equal words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            straight, at, shift, bounds, same = _one_diagonal(batch, needed)
            docs, others, begins = (batch.column(c).to_numpy() for c in ("doc_id", "other_id", "begin"))
            other_begins = batch.column("other_begin").to_numpy()
            for i, d, (lo, hi) in zip(at.tolist(), shift.tolist(), bounds.tolist(), strict=True):
                p0, q0 = int(begins[i]), int(other_begins[i])
                for s, e, n in _passages(same[lo:hi], min_words, min_equal):
                    rows.append((int(docs[i]), int(others[i]), s + p0, e + p0, s + d + q0, e + d + q0, n))
            turned = take(batch, ~straight)
            columns = ("doc_id", "other_id", "anchors", "other_anchors", "begin", "other_begin", "codes", "other_codes")
            for doc, other, x, y, p0, q0, ca, cb in zip(
                *(turned.column(c).to_pylist() if c not in columns[2:4] else _as_lists(turned.column(c)).to_pylist() for c in columns), strict=True
            ):
                a, b = np.frombuffer(ca, dtype="<u4"), np.frombuffer(cb, dtype="<u4")
                j, equal = _laid_along(a, b, [p - p0 for p in x], [q - q0 for q in y])
                if int(equal.sum()) < needed:
                    continue
                for s, e, n in _passages(equal, min_words, min_equal):
                    rows.append((doc, other, s + p0, e + p0, int(j[s]) + q0, int(j[e - 1]) + 1 + q0, n))
            if rows:
                kinds = [pa.int64()] * 2 + [pa.int32()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _listed(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of all members of an array of lists or of their binary form; null is a list without any."""
    if pa.types.is_binary(values.type):
        held, begin = _numbers(values, "<i4")
        return np.repeat(np.arange(len(values)), np.diff(begin)), held.astype(np.int64)
    n = values.value_lengths().fill_null(0).to_numpy()
    return np.repeat(np.arange(len(values)), n), values.flatten().to_numpy().astype(np.int64)


def _as_lists(values: pa.Array) -> pa.Array:
    """Lists of whole numbers, which travel as binary values."""
    if pa.types.is_binary(values.type):
        held, begin = _numbers(values, "<i4")
        return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(held))
    return values


def _lists(rows: np.ndarray, values: np.ndarray, of: np.ndarray) -> pa.Array:
    """The values of the rows ``of`` as lists; ``rows``, the row numbers of the values, go up."""
    return pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(rows, of), len(rows)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _joined_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the spans that overlap or touch in each row, as row number times 2**32 and place, in order."""
    order = np.lexsort((end, start, row))
    start, end = (row << 32 | start)[order], (row << 32 | end)[order]
    upto = np.maximum.accumulate(end) if len(end) else end
    new = np.flatnonzero(np.append(True, start[1:] > upto[:-1])[: len(start)])
    return start[new], upto[np.append(new[1:], len(upto)) - 1] if len(new) else upto


def _open_windows(min_words: int, size: int):
    """Map: where windows of ``size`` words begin that lie in a run of seeds seen earlier and in no passage.

    Neighbouring seeds of an equal stretch begin at most ``WINDOW`` words apart; its ends lie less than ``WINDOW`` words
    before the first and at most ``WINDOW - 1 + K`` words after the last. Ranges as begins and (exclusive) ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, at = _listed(batch.column("seen"))
            (of, starts), (_, ends) = (_listed(batch.column(c)) for c in ("starts", "ends"))
            closed, reopened = _joined_spans(of, starts, ends - size + 1)
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] - at[:-1] > WINDOW)))
            last = np.append(first[1:], len(at)) - 1
            low, high = np.maximum(0, at[first] - WINDOW + 1), at[last] + WINDOW - 1 + K
            row = row[first]
            some = (high - low >= min_words) & (low < high - size + 1)
            row, low, end = row[some], (row << 32 | low)[some], (row << 32 | np.maximum(high - size + 1, 0))[some]
            # between the closed ranges, whose numbers begin at ``at``, lie the open ones of a run
            at = np.searchsorted(reopened, low, side="right")
            n = np.maximum(np.searchsorted(closed, end) - at, 0) + 1
            of = np.repeat(np.arange(len(low)), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            closed, reopened = np.append(closed, 0), np.append(reopened, 0)
            begins = np.where(k == 0, low[of], reopened[np.maximum(at[of] + k - 1, 0)])
            finals = np.where(k == n[of] - 1, end[of], closed[np.minimum(at[of] + k, len(closed) - 1)])
            some = begins < finals
            row, begins, finals = row[of][some], begins[some] & ((1 << 32) - 1), finals[some] & ((1 << 32) - 1)
            if len(row):
                docs = np.unique(row)
                arrays = [batch.column("doc_id").take(pa.array(docs)), *(_lists(row, x, docs) for x in (begins, finals))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "begins", "finals"])

    return run


def _gram_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int64) + 1


def _open_slots(size: int):
    """Map: the hash slots of open windows, from word codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, dtype=np.int64)]
            for codes, begins, finals in zip(*(batch.column(c).to_pylist() for c in ("codes", "begins", "finals")), strict=True):
                own = np.frombuffer(codes, dtype="<u4").astype(np.uint64)
                for s, e in zip(begins, finals, strict=True):
                    part = own[s : e + size - 1]
                    if len(part) >= size:
                        found.append(_gram_slots(mix(run_sums(part, size))))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["slot"])

    return run


def _sorted_grams(bitmap, size: int):
    """hash, document and position of the windows of ``size`` words whose hash slot is wanted."""

    def seeds_of(texts: list[bytes], doc_ids: np.ndarray) -> tuple[np.ndarray, ...]:
        w = words(texts)
        hashes, at = windows(replace(w, hash=w.hash >> np.uint64(32)), size)
        keep = in_bits(bitmap.value, _gram_slots(hashes))
        hashes, at = hashes[keep], at[keep]
        d = np.searchsorted(w.first, at, side="right") - 1
        return hashes.view(np.int64), doc_ids[d].astype(np.int64), (at - w.first[d]).astype(np.int32)

    return seeds_of


def _packed_spans(buckets: int):
    """Map: the passages of documents, packed like matches without another document: begins as places, lengths as shifts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc_id").to_numpy()
            (row, starts), (_, ends) = (_listed(batch.column(c)) for c in ("starts", "ends"))
            name, bucket = _buckets_of(doc, buckets)
            order = np.argsort(name, kind="stable")
            n = np.bincount(row, minlength=len(doc))
            at = np.argsort(np.argsort(order)[row], kind="stable")
            inner = {"pos": starts[at].astype(np.int32), "shift": (ends - starts)[at].astype(np.int32)}
            columns = {"doc_id": doc[order], "n": n[order].astype(np.int32)}
            yield _packed(bucket[order], columns, inner, np.concatenate([[0], np.cumsum(n[order])]))

    return run


def _join_windows(size: int, min_words: int):
    """Map over packed matches of windows and packed passages sorted by bucket: the equal stretches that lie in no passage."""
    names = ["doc_id", "other_id", "start_word", "end_word", "other_start", "other_end", "equal_words"]

    def outside(doc: np.ndarray, start: np.ndarray, end: np.ndarray, spans: pa.RecordBatch) -> np.ndarray:
        """Which stretches no passage of their document covers whole."""
        of, n, begin, long = (_numbers(spans.column(c), k)[0] for c, k in (("doc_id", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("shift", "<i4")))
        ids = np.unique(of)
        if not len(ids):
            return np.ones(len(doc), dtype=bool)
        row = np.repeat(np.searchsorted(ids, of), n) + 1
        at = np.argsort(row << 32 | begin)
        known = (row << 32 | begin)[at]
        upto = np.maximum.accumulate((row << 32 | (begin + long))[at])
        mine = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
        mine = np.where(ids[mine] == doc, mine + 1, 0)
        last = np.searchsorted(known, mine << 32 | start, side="right") - 1
        return (mine == 0) | (last < 0) | (upto[last] < (mine << 32 | end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bucket(batches):
            found = batch.column("other_id").is_valid()
            doc, other, p, q = _unpacked(batch.filter(found), diagonals=True)
            if not len(doc):
                continue
            d = q - p
            new = np.append(True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (d[1:] != d[:-1]) | (p[1:] > p[:-1] + size))
            at = np.flatnonzero(new)
            doc, other, d, s, e = doc[at], other[at], d[at], p[at], p[np.append(at[1:], len(p)) - 1] + size
            left = np.flatnonzero(e - s >= min_words)
            left = left[outside(doc[left], s[left], e[left], batch.filter(pc.invert(found)))]
            doc, other, d, s, e = (x[left] for x in (doc, other, d, s, e))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(other), *(pa.array(x.astype(np.int32)) for x in (s, e, s + d, e + d, e - s))], names)

    return run


def _seen(chained: DataFrame) -> DataFrame:
    """``doc_id, seen``: the places of each document's seeds that were seen earlier, in order."""
    return chained.where("other_id is null").selectExpr("doc_id", "anchors as seen")


def _spans(found: DataFrame) -> DataFrame:
    """``doc_id, starts, ends``: the different passages of each document."""
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("s"))
    return spans.selectExpr("doc_id", "s.start_word as starts", "s.end_word as ends")


def _exact_passages(docs: DataFrame, chained: DataFrame, found: DataFrame, min_words: int) -> DataFrame | None:
    """Equal passages in runs of seeds seen earlier that ``found`` leaves open, or None where nothing is open."""
    spark = docs.sparkSession
    parts = partitions(spark)
    size = min(min_words, len(_LANES))
    done = _spans(found)
    left = _seen(chained).join(done, "doc_id", "left").mapInArrow(_open_windows(min_words, size), "doc_id long, begins array<int>, finals array<int>")
    left = staged(left, "open")
    codes = _of_documents(docs, left, _word_codes, "doc_id long, codes binary")
    slots = slot_bits(codes.join(left, "doc_id").mapInArrow(_open_slots(size), "slot long"), GRAM_BITS)
    if not slots.any():
        return None
    grams, held = _met(docs, _sorted_grams(spark.sparkContext.broadcast(slots), size), "grams")
    exact = (
        grams.unionByName(done.mapInArrow(_packed_spans(BUCKETS * parts), PACKED_ROWS))
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(releasing(_join_windows(size, min_words)), PASSAGE)
    )
    exact = staged(exact, "exact")
    unstaged(held)
    unstaged(left)
    return exact


def _of_documents(docs: DataFrame, wanted: DataFrame, cut, kind: str) -> DataFrame:
    """What ``cut`` makes of the documents of ``wanted`` and of a few others."""
    bitmap = docs.sparkSession.sparkContext.broadcast(filter_bits(wanted, "doc_id"))
    return docs.withColumn("slot", slot_column("doc_id")).mapInArrow(releasing(cut(bitmap)), kind)


def _aligned(docs: DataFrame, repeated: bool, pairs: DataFrame, min_words: int, min_equal: int, name: str) -> DataFrame:
    """The passages of chains; ``repeated`` says whether a doc_id stands on several rows."""
    wanted = pairs.select("doc_id").union(pairs.select("other_id")).distinct()
    codes = _of_documents(docs, wanted, _word_codes, "doc_id long, codes binary")
    codes = staged(codes.dropDuplicates(["doc_id"]) if repeated else codes, "codes")
    own = pairs.join(codes, "doc_id").withColumn("codes", F.expr("substring(codes, 4 * begin + 1, 4 * (end - begin))"))
    both = own.join(codes.select(F.col("doc_id").alias("other_id"), F.col("codes").alias("other_codes")), "other_id")
    both = both.withColumn("other_codes", F.expr("substring(other_codes, 4 * other_begin + 1, 4 * (other_end - other_begin))"))
    found = staged(both.mapInArrow(releasing(_align_rows(min_words, min_equal)), PASSAGE).distinct(), name)
    unstaged(codes)
    return found


def _open_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of seeds seen earlier beside which a word stands in no passage, with the joined passages of their document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, at = _listed(batch.column("seen"))
        (of, starts), (_, ends) = (_listed(batch.column(c)) for c in ("starts", "ends"))
        begins, finals = _joined_spans(of, starts, ends)
        if len(begins):
            k = np.searchsorted(begins, row << 32 | np.maximum(at - MARGIN, 0), side="right") - 1
            left = (k < 0) | (finals[k] < (row << 32 | at + K + MARGIN))
            row, at = row[left], at[left]
        if len(row):
            docs = np.unique(row)
            arrays = [batch.column("doc_id").take(pa.array(docs)), _lists(row, at, docs)]
            some = np.isin(begins >> 32, docs)
            arrays += [_lists(begins[some] >> 32, x[some] & ((1 << 32) - 1), docs) for x in (begins, finals)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "places", "starts", "ends"])


def _short_codes(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each word's hash; 0 and 1 stand for no word."""
    return np.maximum((hashes >> np.uint64(48)).astype("<u2"), 2)


def _around(codes: np.ndarray, first: np.ndarray, empty: int) -> np.ndarray:
    """Rows of the words from ``MARGIN`` before a seed to ``MARGIN`` after it, ``empty`` outside their text.

    Texts begin at ``first``. The row of the seed at ``at`` of text ``d`` is that of number ``at + MARGIN * d``.
    """
    apart = np.full(len(codes) + MARGIN * len(first), empty, dtype=codes.dtype)
    apart[np.arange(len(codes)) + np.repeat(np.arange(1, len(first)) * MARGIN, np.diff(first))] = codes
    return sliding_window_view(np.pad(apart, (0, SIDE), constant_values=empty), SIDE)


def _cut(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Numbers as binary values that end where the next one begins."""
    offsets = (bounds * numbers.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def _rows_of(rows: np.ndarray) -> pa.Array:
    """The rows of a table of numbers as binary values."""
    return _cut(rows.reshape(-1), np.arange(len(rows) + 1) * rows.shape[1])


def _numbers(values: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of an array of binary values, and where each value's begin."""
    raw = np.frombuffer(values.buffers()[1], dtype=np.int32, count=values.offset + len(values) + 1)[values.offset :].astype(np.int64)
    data = values.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8)[raw[0] : raw[-1]] if raw[-1] > raw[0] else np.zeros(0, dtype=np.uint8)
    return np.ascontiguousarray(held).view(kind), (raw - raw[0]) // np.dtype(kind).itemsize


def _doc_words(bitmap):
    """Map: documents whose id may be wanted -> short word codes and seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = take(batch, in_bits(bitmap.value, batch.column("slot").to_numpy()))
            for part, texts in chunks(wanted):
                w = words(texts)
                codes = _short_codes(w.hash)
                h, d, pos = _minimizers(w, np.arange(w.docs))
                bounds = np.searchsorted(d, np.arange(w.docs + 1))
                columns = [_cut(codes, w.first), _cut(h, bounds), _cut(pos, bounds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "codes", "hashes", "at"])

    return run


def _sides(h: np.ndarray, pos: np.ndarray, doc: np.ndarray, kept: np.ndarray) -> pa.Array:
    """For each kept seed the 32-bit names and distances of the seeds that follow within ``MARGIN`` words of its document."""
    name = (mix(h.view(np.uint64)) >> np.uint64(40)).astype(np.int64)
    end = np.searchsorted(doc * (1 << 32) + pos, doc[kept] * (1 << 32) + pos[kept] + MARGIN, side="right")
    n = end - kept - 1
    rows = np.repeat(kept + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
    value = (name[rows] << 7 | (pos[rows] - pos[np.repeat(kept, n)])).astype(np.int32)
    return _cut(value, np.concatenate([[0], np.cumsum(n)]))


PLACE = "hash long, doc_id long, pos int, words binary, sides binary, open binary"
_PLACE_NAMES = ["hash", "doc_id", "pos", "words", "sides", "open"]


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open places with the words around them and which of these no passage covers."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 1_000):
            batch = whole.slice(begin, 1_000)
            own, first = _numbers(batch.column("codes"), "<u2")
            (h, bounds), (pos, _) = (_numbers(batch.column(c), kind) for c, kind in (("hashes", "<i8"), ("at", "<i4")))
            d, pos = np.repeat(np.arange(batch.num_rows), np.diff(bounds)), pos.astype(np.int64)
            (of, places), (ds, starts), (_, ends) = (_listed(batch.column(c)) for c in ("places", "starts", "ends"))
            edge = np.zeros(len(own) + 1, dtype=np.int32)
            np.add.at(edge, np.minimum(first[ds] + starts, first[ds + 1]), 1)
            np.add.at(edge, np.minimum(first[ds] + ends, first[ds + 1]), -1)
            free = np.cumsum(edge)[:-1] == 0
            picked = np.flatnonzero(np.isin(d << 32 | pos, of << 32 | places))
            doc = batch.column("doc_id").to_numpy()
            free_rows, own_rows = _around(free, first, 0), _around(own, first, 0)
            for at in range(0, len(picked), 10_000):
                k = picked[at : at + 10_000]
                row = first[d[k]] + pos[k] + MARGIN * d[k]
                left = free_rows[row]
                some = left.any(axis=1)
                k, row = k[some], row[some]
                arrays = [pa.array(h[k]), pa.array(doc[d[k]]), pa.array(pos[k].astype(np.int32)), _rows_of(own_rows[row])]
                yield pa.RecordBatch.from_arrays([*arrays, _sides(h, pos, d, k), _rows_of(np.packbits(left[some], axis=1))], _PLACE_NAMES)


def _all_rows(bitmap, min_words: int):
    """Map: places of seeds whose hash slot is wanted; of places with equal words around them in one batch the first document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                w = words(texts)
                h, d, pos = _minimizers(w, np.arange(w.docs))
                kept = np.flatnonzero(in_bits(bitmap.value, _gram_slots(h.view(np.uint64))) & (w.counts()[d] >= min_words))
                if not len(kept):
                    continue
                doc = part.column("doc_id").to_numpy()[d]
                around = _around(_short_codes(w.hash), w.first, 1)[w.first[d[kept]] + pos[kept] + MARGIN * d[kept]]
                whole = np.zeros((len(kept), -(-SIDE // 4)), dtype=np.uint64)
                whole.view("<u2")[:, :SIDE] = around
                same = mix((mix(whole) * _LANES[: whole.shape[1]]).sum(axis=1))
                order = np.lexsort((pos[kept], doc[kept], same, h[kept]))
                new = np.ones(len(order), dtype=bool)
                x, y = h[kept][order], same[order]
                new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                one = np.sort(order[new])
                kept, around = kept[one], around[one]
                for b in range(0, len(kept), 10_000):
                    k = kept[b : b + 10_000]
                    rows = _rows_of(around[b : b + 10_000])
                    arrays = [pa.array(h[k]), pa.array(doc[k]), pa.array(pos[k]), rows, _sides(h, pos.astype(np.int64), d.astype(np.int64), k)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(k), pa.binary())], _PLACE_NAMES)

    return run


def _shifted(sides: pa.Array, others: pa.Array, group: np.ndarray, other_group: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Open places and places of their group that have a following seed at another distance: both numbers, both distances.

    Seeds that stand several times beside a place are left out, as some place there has each distance. In order of the
    open places, of which each is whole in a part.
    """

    def once(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, value = _listed(lists)
        key = row << 32 | (value >> 7) + (1 << 24)
        _, at, count = np.unique(key, return_index=True, return_counts=True)
        at = at[count == 1]
        return row[at], value[at] >> 7, value[at] & 127

    a, name, gap = once(sides)
    b, other_name, other_gap = once(others)
    name, other_name = ((g[x] << 25) + (1 << 24) + y for g, x, y in ((group, a, name), (other_group, b, other_name)))
    order = np.lexsort((other_gap, other_name))
    b, other_name, other_gap = b[order], other_name[order], other_gap[order]
    low, high = np.searchsorted(other_name, name), np.searchsorted(other_name, name, side="right")
    key = other_name << 7 | other_gap
    left, right = np.searchsorted(key, name << 7 | gap), np.searchsorted(key, name << 7 | gap, side="right")
    some = high - low > right - left
    a, gap, low, left, right, high = (x[some] for x in (a, gap, low, left, right, high))
    n = left - low + high - right
    total = np.cumsum(n)
    new = np.flatnonzero(np.diff(a, prepend=-1))
    begin = 0
    while begin < len(a):
        upto = int(np.searchsorted(new, np.searchsorted(total, total[begin] + TILE)))
        upto = len(new) if upto >= len(new) else max(upto, int(np.searchsorted(new, begin, side="right")))
        end = int(new[upto]) if upto < len(new) else len(a)
        m, skip = n[begin:end], right[begin:end] - left[begin:end]
        place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        at = np.repeat(low[begin:end], m) + place
        at += np.where(place >= np.repeat(left[begin:end] - low[begin:end], m), np.repeat(skip, m), 0)
        yield np.repeat(a[begin:end], m), b[at], np.repeat(gap[begin:end], m), other_gap[at]
        begin = end


def _runs_of(equal: np.ndarray) -> np.ndarray:
    """Where ``RUN`` words in a row are equal, along the first axis."""
    pairs = equal[1:] & equal[:-1]
    return pairs[2:] & pairs[:-2]


def _touched(free: np.ndarray) -> np.ndarray:
    """Where runs of ``RUN`` words have a free one, along the second axis."""
    out = free[:, : 1 - RUN].copy()
    for t in range(1, RUN):
        out |= free[:, t : SIDE + 1 - RUN + t]
    return out


_APART = [t for t in range(SIDE + 1 - RUN) if t + RUN < MARGIN or t > MARGIN + K]  # runs with a word between them and the seed


def _run_names(words: np.ndarray, group: np.ndarray):
    """Of the runs of ``RUN`` words that begin at a column ``t`` the names, and those with the next word towards the seed.

    Equal runs of different groups have different names; a run that touches the seed has no longer one (0).
    """
    rows = np.ascontiguousarray(words.T)
    lane = group.astype(np.uint64) * _LANES[0]

    def names(t: int) -> tuple[np.ndarray, np.ndarray]:
        name = rows[t].astype(np.uint64)
        for i in range(1, RUN):
            name |= rows[t + i].astype(np.uint64) << np.uint64(16 * i)
        name = mix(name) + lane
        if t not in _APART:
            return name, np.zeros(0, dtype=np.uint64)
        return name, mix(name + (rows[t - 1 if t > MARGIN else t + RUN].astype(np.uint64) + np.uint64(1)) * _LANES[1])

    return names


def _runs_apart(a: np.ndarray, b: np.ndarray, group: np.ndarray, other_group: np.ndarray, low: np.ndarray, high: np.ndarray, free: np.ndarray):
    """Pairs with ``RUN`` equal words in a row that are not equal all the way from the seed.

    Open places are rows of ``a``, their partners the rows ``low:high`` of ``b``. Numbers of the pairs, and of the places
    too many of whose partners are such to be told one by one. Places without an equal run that has a free word have none.

    The end towards the seed of such a run is told by an unequal word before it. For each place of a run there are as many
    partners with the same run as with the same run and word, unless some have the run alone; only these are listed.
    """
    names_of, other_names_of = _run_names(a, group), _run_names(b, other_group)
    slots = np.uint64((1 << (8 * max(len(a), len(b), 1)).bit_length()) - 1)
    taken = np.zeros(int(slots) + 1, dtype=bool)
    holder = np.zeros(int(slots) + 1, dtype=np.int32)
    most = (high - low) // 4
    count = np.zeros(len(a), dtype=np.int64)
    further = np.zeros(len(a), dtype=bool)
    pairs = [np.zeros(0, dtype=np.int64)]
    nearest, to = (np.zeros(len(a), dtype=np.int64) for _ in range(2))
    touch = np.ascontiguousarray(_touched(free).T)
    shift = len(b).bit_length()

    def those_in(at: np.ndarray, of: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Which of the slots ``among`` are in ``of[at]``."""
        taken[of[at]] = True
        found = taken[among]
        taken[of[at]] = False
        return found

    def once(at: np.ndarray, name: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One open place for each name of the places ``at`` (a name may have a few), and for each of ``at`` the one that stands for it."""
        holder[of] = at
        one = holder[of]
        own = (one == at) | (name[at] != name[one])
        return at[own], np.where(own, at, one)

    def ranges(few: np.ndarray, names: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Sets for the places ``few`` where their names begin and end among the sorted ones; where each of these begins."""
        begin = np.flatnonzero(np.append(True, known[1:] != known[:-1]))
        one = known[begin]
        at = np.searchsorted(one, names[few])
        edge = np.append(begin, len(known))
        nearest[few] = edge[at]
        to[few] = edge[at + (one[np.minimum(at, len(one) - 1)] == names[few])]
        return np.repeat(begin, np.diff(edge))

    for t in range(SIDE + 1 - RUN):
        (grams, longer), (other_grams, other_longer) = names_of(t), other_names_of(t)
        own, others = ((x & slots).astype(np.int32) for x in (grams, other_grams))
        hit = np.flatnonzero(those_in(slice(None), others, own))
        if not len(hit):
            continue
        few, one = once(hit, grams, own[hit])
        near = np.flatnonzero(those_in(few, own, others))  # all that can have a run of the open places
        order = np.argsort(other_grams[near])
        near = near[order]
        first = ranges(few, grams, other_grams[near])
        some = to[one] > nearest[one]
        hit, one = hit[some], one[some]
        further[hit] |= touch[t][hit]
        if t not in _APART:
            continue
        some = count[hit] <= most[hit]
        hit, one = hit[some], one[some]
        if not len(hit):
            continue
        at, many = nearest[one], to[one] - nearest[one]
        few, one = once(hit, longer, (longer[hit] & slots).astype(np.int32))
        ranges(few, longer, np.sort(other_longer[near]))
        joined = to[one] - nearest[one]
        many -= joined
        count[hit] += many
        more = (many > 0) & (count[hit] <= most[hit])
        hit, many, joined, at = hit[more], many[more], joined[more], at[more]
        if not len(hit):
            continue
        # in order of the runs, then of the runs with the next word
        key, other_key = (
            f.astype(np.uint64) << np.uint64(64 - shift) | names >> np.uint64(shift) for f, names in ((at, longer[hit]), (first, other_longer[near]))
        )
        order = np.argsort(other_key)
        same = np.searchsorted(other_key[order], key)  # joined ones from here
        order = near[order]
        i = np.repeat(hit, many)
        place = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        place += np.where(place >= np.repeat(same - at, many), np.repeat(joined, many), 0)
        j = order[np.repeat(at, many) + place]
        ok = (j >= low[i]) & (j < high[i])
        pairs.append(i[ok] * len(b) + j[ok])
    dense = np.flatnonzero((count > most) & further)
    found = np.unique(np.concatenate(pairs))
    i, j = found // len(b), found % len(b)
    ok = further[i] & (count[i] <= most[i])
    return i[ok], j[ok], dense


def _meet_all(min_words: int, min_equal: int):
    """Map over places sorted by (hash, block, other block): matches of open places that cover words no passage covers.

    Only pairs with as many equal words as a passage needs, and with ``RUN`` equal words in a row of which one is not
    covered (any stretch that covers more begins or ends in such a run), are cut into stretches. What a passage covers
    needs no other partner; a stretch that may only be equal enough beyond the words in view leaves them open.

    A stretch that is not equal throughout has a run of ``RUN`` equal words at an end that is parted from the seed, and
    equal stretches are covered by the exact pass before. So in large groups only pairs with such a run are compared.
    """
    names = ["doc_id", "other_id", "anchors", "other_anchors"]
    span = min(min_words, MARGIN + K)  # of a longer passage at least so many words stand around one of its seeds
    needed = min(-(-min_words * min_equal // 100), 3 * span // 4 + 1) if span < min_words else -(-min_words * min_equal // 100)
    listed = min_words <= len(_LANES)  # longer equal passages may have parts of several documents in the exact pass
    column = np.arange(SIDE)
    before = column < MARGIN + np.arange(MARGIN + 1)[:, None]

    def covers(equal: np.ndarray, free: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Which columns of ``equal`` have a run with a free word; ``runs`` are the runs' beginnings."""
        touch = np.flatnonzero(np.convolve(free, np.ones(RUN, dtype=int))[RUN - 1 : SIDE] > 0)
        return runs[touch].any(axis=0)

    def long_enough(equal: np.ndarray, runs: np.ndarray, free: np.ndarray) -> np.ndarray:
        """Which columns of ``equal`` have words enough, a positive score and a free word from a run to the end of a run."""
        n = equal.shape[1]
        step = equal.view(np.int8) * np.int8(1 - MISS) + np.int8(MISS)
        never = (runs.view(np.int8) ^ 1).astype(np.int16) << 9
        score, out = np.zeros(n, dtype=np.int16), np.zeros(n, dtype=bool)
        least = np.full(n, SIDE, dtype=np.int16)  # before a run
        before_free = least.copy()
        lowest = []
        for k in range(SIDE):
            if k <= SIDE - RUN:
                least = np.minimum(least, score + never[k])
            lowest.append(least)
            np.copyto(before_free, least, where=free[k])
            score += step[k]
            if k + 1 >= span:
                out |= runs[k + 1 - RUN] & (score > np.maximum(before_free, lowest[k + 1 - span]))
        return out

    def settle(equal: np.ndarray, free: np.ndarray) -> list[int]:
        """Columns of ``equal`` to pass on; takes what they cover from ``free``."""
        runs = _runs_of(equal)
        left = np.flatnonzero(covers(equal, free, runs))
        if not len(left):
            return []
        left = left[np.argsort(-equal[:, left].sum(axis=0), kind="stable")]
        out = []
        while len(left):
            same = np.ascontiguousarray(equal[:, left[0]])
            hit = any(e - s >= span and int(same[s:e].sum()) >= needed and free[s:e].any() for s, e in stretches(same))
            for s, e, _ in _passages(same, span, min_equal) if hit else []:
                free[s:e] = False
            if hit:
                out.append(int(left[0]))
            left = left[1:]
            if hit and len(left):
                left = left[covers(equal, free, runs[:, left])]
                if len(left) > 32:  # of fewer it is as cheap to look at each
                    left = left[long_enough(equal[:, left], runs[:, left], np.broadcast_to(free[:, None], (SIDE, len(left))))]
        return out

    def promising(equal: np.ndarray, free: np.ndarray, touch: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Which rows of ``equal``, of the open places ``i``, have words enough and a stretch long enough that may cover more."""
        equal = np.ascontiguousarray(equal.T)
        runs = _runs_of(equal)
        enough = np.add.reduce(equal.view(np.uint8), axis=0, dtype=np.uint8) >= needed
        at = np.flatnonzero(enough & (runs & np.ascontiguousarray(touch[i].T)).any(axis=0))
        if not len(at):
            return at
        if len(at) < len(i):
            equal, runs = equal[:, at], runs[:, at]
        return at[long_enough(equal, runs, np.ascontiguousarray(free[i[at]].T))]

    def straight(a, b, free, touch, i, j):
        """The promising ones of the pairs ``i, j``."""
        keep = [s + promising(a[i[s : s + 16_384]] == b[j[s : s + 16_384]], free, touch, i[s : s + 16_384]) for s in range(0, len(i), 16_384)]
        at = np.concatenate(keep) if keep else np.zeros(0, dtype=np.int64)
        return i[at], j[at]

    def turned(a, b, beyond, i, j, gap, other_gap) -> np.ndarray:
        """Which words are equal up to a second seed on the seed's diagonal or after the seed on the second one's.

        ``beyond`` are the words of all rows of ``b`` from each on, as many as stand after a seed; no open place has those
        past a row's end.
        """
        x = a[i]
        out = x == b[j]
        out &= before[gap]
        out[:, MARGIN + K :] |= x[:, MARGIN + K :] == beyond[j * (SIDE + MARGIN) + MARGIN + K + other_gap - gap]
        return out

    def all_pairs(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the open places ``at`` with all their partners, about ``TILE`` at a time."""
        n = high[at] - low[at]
        for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(n) // TILE)) + 1):
            n = high[part] - low[part]
            i = np.repeat(part, n)
            yield i, np.arange(len(i)) + np.repeat(low[part] - np.cumsum(n) + n, n)

    def groups(whole: pa.RecordBatch, group: np.ndarray) -> Iterator[tuple[int, int, list[int], list[int]]]:
        opened = whole.column("open").is_valid().to_numpy(zero_copy_only=False)
        both = np.isin(group, group[opened]) & np.isin(group, group[~opened])
        docs, places = whole.column("doc_id").to_numpy(), whole.column("pos").to_numpy()
        order = np.lexsort((places, docs, group))
        order = order[both[order]]
        at, other_at = order[opened[order]], order[~opened[order]]
        if not len(at):
            return
        ids, rank = np.unique(docs, return_inverse=True)
        key, other_key = (group[x] * len(ids) + rank[x] for x in (at, other_at))
        low, high = np.searchsorted(other_key, group[at] * len(ids)), np.searchsorted(other_key, key)
        some = high > low
        at, low, high = at[some], low[some], high[some]
        if not len(at):
            return
        mine, others = (whole.take(pa.array(x)) for x in (at, other_at))
        (doc, pos), (other, other_pos) = (tuple(x.column(c).to_numpy() for c in ("doc_id", "pos")) for x in (mine, others))
        a, b = (_numbers(x.column("words"), "<u2")[0].reshape(-1, SIDE) for x in (mine, others))
        free = np.unpackbits(_numbers(mine.column("open"), "u1")[0].reshape(len(at), -1), axis=1)[:, :SIDE].astype(bool)
        touch = _touched(free)
        g, other_g = group[at], group[other_at]

        met = np.bincount(g, weights=high - low, minlength=int(group[-1]) + 1)
        rows = np.bincount(g, minlength=len(met)) + np.bincount(other_g, minlength=len(met))
        large = (met > SIDE * rows) & listed
        dense = np.flatnonzero(~large[g])
        found = []
        if large.any():
            few, other_few = np.flatnonzero(large[g]), np.flatnonzero(large[other_g])
            i, j, many = _runs_apart(
                a[few], b[other_few], g[few], other_g[other_few], *(np.searchsorted(other_few, x[few]) for x in (low, high)), free[few]
            )
            found.append(straight(a, b, free, touch, few[i], other_few[j]))
            dense = np.union1d(dense, few[many])
        if len(dense):
            found += [straight(a, b, free, touch, i, j) for i, j in all_pairs(dense, low, high)]
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        edge = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i)).tolist()
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            k = int(i[s])
            for m in settle((b[j[s:e]] == a[k]).T, free[k]):
                q = j[s + m]
                yield int(doc[k]), int(other[q]), [int(pos[k])], [int(other_pos[q])]

        left, touch = free.any(axis=1), _touched(free)
        beyond = sliding_window_view(np.pad(b, ((0, 0), (0, MARGIN)), constant_values=1).reshape(-1), MARGIN)
        for i, j, gap, other_gap in _shifted(mine.column("sides"), others.column("sides"), g, other_g):
            at = np.flatnonzero((j < high[i]) & left[i])
            i, j, gap, other_gap = (x[at] for x in (i, j, gap, other_gap))
            keep = [
                s + promising(turned(a, b, beyond, *(x[s : s + 16_384] for x in (i, j, gap, other_gap))), free, touch, i[s : s + 16_384])
                for s in range(0, len(i), 16_384)
            ]
            if not keep:
                continue
            at = np.concatenate(keep)
            i, j, gap, other_gap = (x[at] for x in (i, j, gap, other_gap))
            edge = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i)).tolist()
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                k = int(i[s])
                for m in settle(turned(a, b, beyond, *(x[s:e] for x in (i, j, gap, other_gap))).T, free[k]):
                    p, q, x, y = int(pos[k]), int(other_pos[j[s + m]]), int(gap[s + m]), int(other_gap[s + m])
                    yield int(doc[k]), int(other[j[s + m]]), [p, p + x], [q, q + y]

    def matches(held: list[pa.RecordBatch], group: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = list(groups(pa.Table.from_batches(held).combine_chunks().to_batches()[0], group))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        numbers: list[np.ndarray] = []  # of the groups of the rows held
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("hash", "i", "j")], axis=1)
            new = np.append(last is not None and (key[0] != last).any(), (key[1:] != key[:-1]).any(axis=1))
            group = np.cumsum(new) + (numbers[-1][-1] if numbers else 0)
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if new.any() and sum(map(len, numbers)) + cut >= MEET_ROWS:
                yield from matches([*held, batch.slice(0, cut)], np.concatenate([*numbers, group[:cut]]))
                held, numbers = [], []
                batch, group = batch.slice(cut), group[cut:] - group[-1]
            held.append(batch)
            numbers.append(group)
            last = key[-1]
        if held:
            yield from matches(held, np.concatenate(numbers))

    return run


def _further_passages(docs: DataFrame, repeated: bool, chained: DataFrame, found: DataFrame, min_words: int, min_equal: int) -> DataFrame | None:
    """Nearly equal passages that cover words beside seeds seen earlier which ``found`` leaves open, from all holders.

    In view are the words on the seed's diagonal and along one shift to a second seed; a passage of which less than
    ``min_words`` stand along any two neighbouring diagonals needs a chain of the first pass.
    """
    spark = docs.sparkSession
    left = _seen(chained).join(_spans(found), "doc_id", "left").mapInArrow(_open_places, "doc_id long, places array<int>, starts array<int>, ends array<int>")
    codes = _of_documents(docs, left, _doc_words, "doc_id long, codes binary, hashes binary, at binary")
    codes = codes.dropDuplicates(["doc_id"]) if repeated else codes
    mine = staged(codes.join(left, "doc_id").mapInArrow(releasing(_open_rows), PLACE), "open_rows")
    slots = slot_bits(mine.selectExpr(f"(hash & {(1 << GRAM_BITS) - 1}L) + 1 as slot"), GRAM_BITS)
    if not slots.any():
        return None
    open_rows, every = mine, staged(docs.mapInArrow(releasing(_all_rows(spark.sparkContext.broadcast(slots), min_words)), PLACE), "places")
    # blocks of open places meet blocks of all places; all but frequent seeds have one of each
    counts = mine.groupBy("hash").agg(F.count("*").alias("n")).join(every.groupBy("hash").agg(F.count("*").alias("m")), "hash")
    blocks = counts.selectExpr("hash", f"int(ceil(n / {BLOCK_PLACES})) as ni", f"int(ceil(m / {BLOCK_PLACES})) as nj")
    all_rows, blocks = every, F.broadcast(staged(blocks.where("ni > 1 or nj > 1"), "blocks"))
    own, many = "pmod(xxhash64(doc_id, pos), coalesce({0}, 1))", "explode(sequence(0, coalesce({0}, 1) - 1))"
    mine = mine.join(blocks, "hash", "left").selectExpr(*_PLACE_NAMES, f"int({own.format('ni')}) as i", f"{many.format('nj')} as j")
    every = every.join(blocks, "hash", "left").selectExpr(*_PLACE_NAMES, f"{many.format('ni')} as i", f"int({own.format('nj')}) as j")
    met = (
        mine.unionByName(every)
        .repartition(partitions(spark), "hash", "i", "j")
        .sortWithinPartitions("hash", "i", "j")
        .mapInArrow(releasing(_meet_all(min_words, min_equal)), "doc_id long, other_id long, anchors array<int>, other_anchors array<int>")
    )
    met = staged(met.distinct(), "further_matches")
    unstaged(open_rows)
    unstaged(all_rows)
    if met.isEmpty():
        return None
    begins = [f"greatest(0, element_at({x}, 1) - {REACH}) as {name}" for x, name in (("anchors", "begin"), ("other_anchors", "other_begin"))]
    ends = [f"element_at({x}, -1) + {K + REACH} as {name}" for x, name in (("anchors", "end"), ("other_anchors", "other_end"))]
    return _aligned(docs, repeated, met.selectExpr("*", *begins, *ends), min_words, min_equal, "further")


def several_texts(docs: DataFrame) -> DataFrame:
    """``_id, _least`` of the doc_ids that stand on rows with different texts: the smallest text hash, whose text counts."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    least = docs.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(text).alias("_least"), F.max(text).alias("_most"))
    return staged(least.where("_id is not null and _least <> _most").select("_id", "_least"), "several")


def _counting_rows(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, text`` with a doc_id; of different texts of one doc_id only that with the smallest hash."""
    several = several_texts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    if several.isEmpty():
        return rows
    found = rows.join(several, F.col("doc_id") == F.col("_id"), "left")
    return found.where(F.col("_least").isNull() | (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_least"))).select("doc_id", "text")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_equal: int = MIN_EQUAL) -> DataFrame:
    """Passages of at least ``min_words`` words that an earlier document (smaller doc_id) has too, equal or nearly.

    Columns ``doc_id, other_id, start_word, end_word, other_start, other_end, equal_words``; word positions count from 0,
    ends are exclusive. The first document that holds a passage has no row for it. Null and empty texts, texts below
    ``min_words`` and rows without doc_id give none. Rows with equal doc_id are one document; if their texts differ, the
    one with the smallest hash counts (:func:`several_texts`). No rows give no rows; other columns are not read. Whole
    texts are compared.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = _counting_rows(docs)
    matches, seeds = _met(docs, _sorted_seeds, "seeds")
    chained = matches.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(releasing(_chain_pairs), CHAIN)
    chained = staged(chained, "chains")
    unstaged(seeds)
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    found = _aligned(docs, repeated, chained.where("other_id is not null"), min_words, min_equal, "passages")
    exact = _exact_passages(docs, chained, found, min_words)
    if exact is not None:
        found = found.unionByName(exact)
    further = _further_passages(docs, repeated, chained, found, min_words, min_equal)
    unstaged(chained)
    return (found if further is None else found.unionByName(further)).distinct()


def merged_spans(passages: DataFrame) -> DataFrame:
    """``doc_id, spans``: the disjoint word spans of each document's passages, in order."""
    by_doc = passages.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("all"))
    joined = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<start_word:int,end_word:int>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end_word"] >= s["start_word"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start_word"].alias("start_word"),
                        F.greatest(F.element_at(done, -1)["end_word"], s["end_word"]).alias("end_word"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return by_doc.select("doc_id", joined.alias("spans"))


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with each document's passages cut out of ``text`` and ``n_chars`` counted again.

    A cut runs from the first word of a passage to the word after it. A document of which no word is left goes; one
    that had none to begin with stays. All columns stay as they are otherwise, whatever their names. Repeated rows are cut
    alike; of different texts of one doc_id only the one that counted for the passages is cut. A row without doc_id stays.
    """
    columns = docs.columns
    spans = merged_spans(passages).select(F.col("doc_id").alias("_doc"), F.expr("flatten(transform(spans, s -> array(s.start_word, s.end_word)))").alias("_bounds"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    several = several_texts(docs)
    if not several.isEmpty():
        other = F.col("_least").isNotNull() & (F.xxhash64(F.coalesce("_row.text", F.lit(""))) != F.col("_least"))
        packed = packed.join(several, "_id", "left").select("_row", F.when(~other, F.col("_id")).alias("_id"))
    cut = packed.join(spans, F.col("_id") == F.col("_doc"), "left").select("_row", "_bounds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column("_row"))
            bounds_of, begin = batch.column("_bounds"), 0
            for part, texts in chunks(rows):
                w = words(texts, lower=False)
                out, keep = [], []
                bounds = bounds_of.slice(begin, part.num_rows).to_pylist()
                begin += part.num_rows
                old = part.column("text").to_pylist()
                for d, (text, edge_words) in enumerate(zip(texts, bounds, strict=True)):
                    if not edge_words:
                        out.append(old[d])
                        keep.append(True)
                        continue
                    first, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
                    at = [int(w.start[first + i] - w.offsets[d]) if i < n else len(text) for i in edge_words]
                    edges = [0, *at, len(text)]
                    rest = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    out.append(rest.decode("utf-8"))
                    keep.append(bool(rest.split()))
                arrays = {c: part.column(c) for c in columns}
                arrays["text"] = pa.array(out, pa.string())
                if "n_chars" in arrays:
                    kind = arrays["n_chars"].type
                    counts = [n if not o else len(t) for n, o, t in zip(arrays["n_chars"].to_pylist(), bounds, out, strict=True)]
                    arrays["n_chars"] = pa.array(counts, kind)
                yield take(pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays)), keep)

    return cut.mapInArrow(releasing(run), docs.schema)
