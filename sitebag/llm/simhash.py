"""Near copies by SimHash: 64-bit fingerprints, pigeonhole blocks, exact Hamming distance.

A fingerprint is cut into ``BLOCKS`` pieces. Two fingerprints that differ in at most ``distance`` bits differ in at most as
many pieces, so they agree on some choice of ``BLOCKS - distance`` whole pieces. Each choice is a bit mask; fingerprints are
joined on their masked value under every mask, and the pairs that meet are verified. No pair within the distance is missed.

Equal fingerprints collapse first. What meets under a mask value is dealt by (mask, value); a value that more than
``BLOCK_ROWS`` fingerprints share is cut into blocks and every pair of blocks is a group of its own, so no task holds more
than two blocks. A group reports a spanning forest of its links, fewer rows than it has fingerprints, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .spark_help import dealt_join, partitions, staged
from .textbatch import chunks

BITS = 64
WORDS_PER_SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
BLOCK_ROWS = 4096
_HASHES = 1 << 16


def shingle_hashes(text: bytes, size: int = WORDS_PER_SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of every ``size``-word shingle of the lower-cased text, repeats included, in arrays of bounded length."""
    found = text.lower().split()  # on bytes: ASCII letters, and the six separators 0x09-0x0D and 0x20
    n = len(found)
    digest = xxhash.xxh64_intdigest
    if n < size:
        if n:
            yield np.array([digest(b" ".join(found), SEED)], dtype=np.uint64)
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    for i in range(0, n - size + 1, _HASHES):
        j = min(i + _HASHES, n - size + 1)
        places = zip(starts[i:j].tolist(), ends[i + size - 1 : j + size - 1].tolist(), strict=True)
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in places), dtype=np.uint64, count=j - i)


def fingerprint(text: bytes, size: int = WORDS_PER_SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if over half of the shingle hashes have it; 0 without shingles."""
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, size):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Signed 64-bit masks of every choice of ``blocks - distance`` of the ``blocks`` pieces of a fingerprint."""
    if not 0 <= distance < blocks <= BITS:
        raise ValueError(f"needs distance < blocks <= {BITS}, not {distance} and {blocks}")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    pieces = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    wanted = [sum(chosen) for chosen in combinations(pieces, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in wanted]


def spanning_links(prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a spanning forest of the links between distinct unsigned fingerprints.

    A flood: the fingerprints not reached yet are compared with one reached at a time, so a tight cluster empties at once.
    """
    left, right = [], []
    rest = np.arange(len(prints))
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = np.bitwise_count(prints[rest] ^ prints[x]) <= distance
            if near.any():
                hit, rest = rest[near], rest[~near]
                left.append(np.full(len(hit), x))
                right.append(hit)
                reached.extend(hit.tolist())
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for part, texts in chunks(batch):
                found = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64)
                place = np.arange(seen, seen + len(found), dtype=np.int64)
                seen += len(found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found), pa.array(place)], ["doc_id", "print", "place"])

    return run


SMALL_GROUP = 16


def _verify(distance: int):
    """Map over rows sorted by group (mask, value, i, j): links ``a, b`` of fingerprints that meet and are close."""

    def settle(group: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        width = np.bincount(group)
        left, right = [], []
        small = width[group] <= SMALL_GROUP
        for lag in range(1, int(width[width <= SMALL_GROUP].max(initial=0))):
            near = (group[:-lag] == group[lag:]) & small[lag:] & (np.bitwise_count(prints[:-lag] ^ prints[lag:]) <= distance)
            at = np.flatnonzero(near)
            left.append(at)
            right.append(at + lag)
        begin = np.concatenate([[0], np.cumsum(width)])
        for g in np.flatnonzero(width > SMALL_GROUP).tolist():
            a, b = spanning_links(prints[begin[g] : begin[g + 1]], distance)
            left.append(a + begin[g])
            right.append(b + begin[g])
        if left:
            a, b = (prints[np.concatenate(x)].view(np.int64) for x in (left, right))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("mask", "value", "i", "j", "print")]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(rows[0]):
                continue
            cut = np.zeros(len(rows[0]), dtype=bool)
            for column in rows[:4]:
                cut[1:] |= column[1:] != column[:-1]
            open_at = int(np.flatnonzero(cut)[-1]) if cut.any() else 0
            if open_at:
                yield from settle(np.cumsum(cut[:open_at]), rows[4][:open_at].view(np.uint64))
            held = [column[open_at:] for column in rows]
        if held is not None and len(held[0]):
            yield from settle(np.zeros(len(held[0]), dtype=np.int64), held[4].view(np.uint64))

    return run


def near_links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints of column ``print`` (long): a spanning set of all pairs within the distance."""
    spark = prints.sparkSession
    choices = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(m).cast("long").alias("bits")) for i, m in enumerate(masks(distance, blocks))])
    keyed = prints.select("print", F.explode(choices).alias("m"))
    keyed = keyed.select(F.col("m.mask").alias("mask"), F.col("print").bitwiseAND(F.col("m.bits")).alias("value"), "print")
    met = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = met.select("mask", "value", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("cuts"))
    placed = keyed.join(met, ["mask", "value"]).withColumn("block", F.pmod(F.xxhash64("print"), F.col("cuts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    placed = placed.select("mask", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "print")
    # with several blocks a pair (i, j) holds block i whole, so the pairs (i, i) would only repeat it
    placed = placed.join(met.where("cuts > 1").select("mask", "value", F.lit(True).alias("cut")), ["mask", "value"], "left")
    placed = placed.where("cut is null or i < j").drop("cut")
    return (
        placed.repartition(partitions(spark), "mask", "value", "i", "j")
        .sortWithinPartitions("mask", "value", "i", "j")
        .mapInArrow(_verify(distance), "a long, b long")
        .distinct()
    )


def simhash_components(docs: DataFrame, size: int = WORDS_PER_SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs`` (``doc_id`` long, ``text`` string; others ignored).

    Fingerprints link when they differ in at most ``distance`` bits; component_id is the smallest doc_id reachable. More
    ``blocks`` make longer keys, so fewer fingerprints meet by chance, for more keys each: 6 give 20 keys of 32 bits.

    Null or empty text: fingerprint 0, linked like any other. Fewer than ``size`` words: the sequence is the one shingle.
    Repeated rows each come back, in the same component. A null doc_id counts for nothing in the smallest id; a component
    of such rows alone is null. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(rows.mapInArrow(_fingerprints(size), "doc_id long, print long, place long"), "prints")
    firsts = staged(rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    classes = components(near_links(firsts.select("print"), distance, blocks))
    classed = firsts.join(classes.withColumnRenamed("node", "print"), "print", "left")
    classed = staged(classed.withColumn("class", F.coalesce("component", "print")).select("print", "class", "first", "n"), "classed")
    least = classed.groupBy("class").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    named = classed.select("print", "class", "n", F.xxhash64("print").alias("place"))
    found = dealt_join(named, least, "class", "place", "prints").select("print", "component_id", "n")
    out = dealt_join(rows, staged(found, "found"), "print", "place")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
