"""Exact Jaccard join of documents on word shingles: blocked sparse products of the document by n-gram incidence.

1. One pass names every document's shingle set (equal sets collapse) and adds up a fixed-size table of how many sets
   have a shingle of each hash bucket.
2. Two sets with Jaccard >= t share at least ``SHARED`` shingles among the first ``n - ceil(t n) + SHARED`` of each in
   any common order, and the smaller one has them among its first ``n - ceil(2t/(1+t) n) + SHARED``. With the rare
   buckets first, these columns of the incidence matrix are few and thin. Rows that meet in thin columns are counted,
   and a count below the bound discards the pair; rows of a wide column hang on its first row. What remains connected
   forms candidate blocks.
3. Inside a block the rows' full sparse product gives overlap counts; pairs outside the size bounds are not looked at,
   pairs already connected need no count. Large blocks are cut by size, so that only sizes within the bounds meet, and
   then into pairs of row blocks.

Only the order of shingles depends on the approximate counts, so the result is exact whatever they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .spark_help import dealt_join, filter_bits, in_bits, partitions, releasing, slot_column, staged, take
from .textbatch import WORDS_PER_SHINGLE, chunks, mix, set_id, shingle_sets, words

THRESHOLD = 75  # per cent
SKETCH_BITS = 22  # 4 MB of counters; a larger corpus keeps its order sharp with a few bits more
SLICE = 4096
HOT = 1 << 14
SHARED = 6
THIN = 48  # a column of at most so many rows of compatible sizes counts pairs, a wider one only connects
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 2_000_000


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def _profile(bits: int, size: int):
    """Map: documents -> (doc_id, n, set_id) rows and, last, slices of the task's shingle counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, dtype=np.int64)
        waiting: list[np.ndarray] = []
        held = 0
        mask = np.uint64((1 << bits) - 1)

        def settle() -> None:
            nonlocal counters, waiting, held
            if waiting:
                counters += np.bincount(np.concatenate(waiting), minlength=1 << bits)
            waiting, held = [], 0

        for batch in batches:
            for part, texts in chunks(batch):
                sets = shingle_sets(words(texts), size)
                for s in sets:
                    waiting.append((s & mask).astype(np.int64))
                    held += len(s)
                if held > 1 << bits:
                    settle()
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_id(s) for s in sets], pa.int64()),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    ["doc_id", "n", "set_id", "slice", "counts"],
                )
        settle()
        table = np.minimum(counters, 255).astype(np.uint8).reshape(-1, min(SLICE, 1 << bits))
        used = np.flatnonzero(table.any(axis=1))
        for begin in range(0, len(used), 256):
            some = used[begin : begin + 256]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, pa.array(some, pa.int32()), pa.array([table[i].tobytes() for i in some], pa.binary())],
                ["doc_id", "n", "set_id", "slice", "counts"],
            )

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = np.frombuffer(data, dtype=np.uint8)
            if i in totals:
                totals[i] += own
            else:
                totals[i] = own.astype(np.int64)
    if totals:
        # fine steps of the logarithm: 8 to each doubling, 255 stands for 2**32
        steps = [np.minimum(np.log2(t + 1) * 8, 255).astype(np.uint8).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(steps, pa.binary())], ["slice", "counts"])


def _rank_table(profile: DataFrame, bits: int) -> np.ndarray:
    """Commonness (logarithm) of each hash bucket over all documents; 2**bits bytes."""
    slices = profile.where("slice is not null").select("slice", "counts")
    summed = slices.repartition(partitions(profile.sparkSession), "slice").mapInArrow(_add_slices, "slice int, counts binary")
    ranks = np.zeros((1 << bits) // min(SLICE, 1 << bits) * min(SLICE, 1 << bits), dtype=np.uint8).reshape(-1, min(SLICE, 1 << bits))
    for i, data in summed.toLocalIterator():
        ranks[i] = np.frombuffer(data, dtype=np.uint8)
    return ranks.reshape(-1)


def _columns(ranks, size: int, percent: int):
    """Map: documents -> the incidence entries (hash, set_id, n) of the columns that can witness a link.

    n is negative where only the larger partner's bound holds. Columns of very common buckets are ``hot``: their entries
    get a ``salt`` so that they spread over all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        mask = np.uint64(len(table) - 1)
        usual = np.median(table[table > 0]) if table.any() else 0
        hot_rank = max(np.log2(HOT) * 8, usual + 24)
        seen: set[int] = set()
        for batch in batches:
            for _, texts in chunks(batch):
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
                for s in shingle_sets(words(texts), size):
                    n = len(s)
                    if not n:
                        continue
                    name = set_id(s)
                    if name in seen:
                        continue
                    seen.add(name)
                    rank = table[(s & mask).astype(np.int64)]
                    keep = min(n, n - _ceil(percent * n, 100) + SHARED)
                    own = n - _ceil(2 * percent * n, 100 + percent) + SHARED
                    first = np.argsort(rank, kind="stable")[:keep]
                    signed = np.full(len(first), n, dtype=np.int32)
                    signed[own:] = -n
                    found.append((s[first].view(np.int64), np.full(len(first), name, dtype=np.int64), signed, rank[first] >= hot_rank))
                if len(seen) > 1_000_000:
                    seen.clear()
                if found:
                    arrays = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                    salt = pa.array(np.where(arrays[3], arrays[1], 0))
                    yield pa.RecordBatch.from_arrays([*arrays, salt], ["hash", "set_id", "n", "hot", "salt"])

    return run


def _meet_in_columns(percent: int):
    """Map over entries sorted by (hash, |n|, set_id): pairs ``a < b`` of sets, how often they met, and the bound for it.

    Only ``THIN`` rows of the column that is still open are held from one batch to the next, and the first usable row of a
    wide one. A hot column is a node of
    its own for each band of compatible sizes; the contraction of components splits such hubs, no task holds the column.
    """

    def hot_edges(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, s, n = (batch.column(c).to_numpy() for c in ("hash", "set_id", "n"))
        band = np.floor(np.log(np.abs(n)) / np.log(100 / percent)).astype(np.uint64)
        nodes = [mix(mix(h.view(np.uint64)) + band + np.uint64(i)).view(np.int64) for i in (0, 1)]
        a, b = np.concatenate([s, s]), np.concatenate(nodes)
        low, high = pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))
        return pa.RecordBatch.from_arrays([low, high, pa.array(np.zeros(len(a), dtype=np.int64)), pa.array(np.ones(len(a), dtype=np.int64))], ["a", "b", "need", "met"])

    def settle(h: np.ndarray, s: np.ndarray, signed: np.ndarray, group: np.ndarray, lead: int | None) -> Iterator[pa.RecordBatch]:
        """``lead`` is the first usable row of group 0, where that group began in an earlier batch and is wide."""
        n = np.abs(signed).astype(np.int64)
        flagged = signed > 0
        width = np.bincount(group)
        first = np.full(len(width), len(h))
        np.minimum.at(first, group[flagged], np.flatnonzero(flagged))
        leads = s[np.minimum(first, len(h) - 1)]
        if lead is not None:
            width[0], first[0], leads[0] = THIN + 1, -1, lead
        width = width[group]
        found = []
        widest = int(width[width <= THIN].max(initial=0))
        for lag in range(1, widest):
            i = np.arange(len(h) - lag)
            meet = (group[:-lag] == group[lag:]) & flagged[:-lag] & (width[lag:] <= THIN)
            i = i[meet]
            i = i[(100 * n[i] >= percent * n[i + lag]) & (s[i] != s[i + lag])]
            need = np.minimum(SHARED, -(-percent * (n[i] + n[i + lag]) // (100 + percent)))
            found.append(np.stack([np.minimum(s[i], s[i + lag]), np.maximum(s[i], s[i + lag]), need], axis=1))
        at = np.flatnonzero((width > THIN) & (np.arange(len(h)) > first[group]))
        own = leads[group[at]]
        at, own = at[own != s[at]], own[own != s[at]]
        found.append(np.stack([np.minimum(own, s[at]), np.maximum(own, s[at]), np.zeros(len(at), dtype=np.int64)], axis=1))
        pairs, met = np.unique(np.concatenate(found), axis=0, return_counts=True)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([*(pa.array(pairs[:, i]) for i in range(3)), pa.array(met)], ["a", "b", "need", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lead = None, None
        for batch in batches:
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            if hot.any():
                yield hot_edges(take(batch, hot))
                batch = take(batch, ~hot)
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in ("hash", "set_id", "n")]
            h, s, signed = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            n = np.abs(signed).astype(np.int64)
            cut = np.ones(len(h), dtype=bool)
            cut[1:] = (h[1:] != h[:-1]) | (100 * n[:-1] < percent * n[1:])
            group = np.cumsum(cut) - 1
            open_at = int(np.flatnonzero(cut)[-1])
            goes_on = open_at == 0 and lead is not None
            wide = goes_on or len(h) - open_at > THIN
            done = len(h) if wide else open_at
            if done:
                yield from settle(h[:done], s[:done], signed[:done], group[:done], lead)
            if wide and not goes_on:
                usable = s[open_at:][signed[open_at:] > 0]
                lead = int(usable[0]) if len(usable) else None
            elif not wide:
                lead = None
            # a wide column's last rows stay for the next sizes to be compared with, its lead for the next rows to meet
            begin = max(open_at, len(h) - THIN) if wide else open_at
            held = [h[begin:], s[begin:], signed[begin:]]
        if held is not None:
            yield from settle(*held, np.zeros(len(held[0]), dtype=np.int64), lead)

    return run


def _sets(bitmap, size: int):
    """Map: documents whose id may be wanted -> (doc_id, set_id, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = take(batch, in_bits(bitmap.value, batch.column("slot").to_numpy()))
            for part, texts in chunks(wanted):
                sets = shingle_sets(words(texts), size)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "set_id", "hashes"],
                )

    return run


def product_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links between rows ``left`` and rows ``right``, by row-wise sparse products.

    Row x times the transposed incidence gives x's overlap with every row of ``right`` at once. Rows are taken by size;
    a row outside the size bound of x is discarded, and a row already connected to x needs no count.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not len(left) or not len(right) or not sizes.sum():
        return []
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    in_right = np.zeros(len(sets), dtype=bool)
    in_right[right] = True
    entries = in_right[row]
    order = np.argsort(column[entries], kind="stable")
    rows_of = row[entries][order]
    starts = np.zeros(column.max() + 2, dtype=np.int64)
    np.cumsum(np.bincount(column[entries], minlength=column.max() + 1), out=starts[1:])
    label = np.arange(len(sets))
    out = []
    for x in left[np.argsort(sizes[left], kind="stable")].tolist():
        n = sizes[x]
        open_ = in_right & (label != label[x]) & (100 * sizes >= percent * n) & (percent * sizes <= 100 * n)
        if not n or not open_.any():
            continue
        own = column[begin[x] : begin[x + 1]]
        length = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(length) + length, length) + np.arange(length.sum())
        overlap = np.bincount(rows_of[at], minlength=len(sets))
        linked = open_ & (100 * overlap >= percent * (n + sizes - overlap))
        for y in np.flatnonzero(linked).tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                out.append((x, y))
    return out


def _product(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        name, at = np.unique(table.column("set_id").to_numpy(), return_index=True)
        block = table.column("block").to_numpy()[at]
        hashes = table.column("hashes")
        sets = [np.frombuffer(hashes[int(k)].as_buffer(), dtype=np.uint64) for k in at]
        links = product_links(sets, np.flatnonzero(block == i), np.flatnonzero(block == j), percent)
        pairs = name[np.array(links, dtype=np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def jaccard_components(
    docs: DataFrame, percent: int = THRESHOLD, size: int = WORDS_PER_SHINGLE, sketch_bits: int = SKETCH_BITS
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs`` (``doc_id`` long, ``text`` string; others ignored).

    Two documents link when ``100 * intersection >= percent * union`` of their sets of lower-cased ``size``-word
    shingles; component_id is the smallest doc_id reachable. Exact but for collisions of 64-bit hashes.

    Null or empty text: empty set, linked with nothing. Fewer than ``size`` words: the sequence is the one shingle.
    Repeated rows each come back, in the same component. A null doc_id counts for nothing in the smallest id; alone
    it gives a null component. No rows give no rows.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = staged(
        docs.mapInArrow(releasing(_profile(sketch_bits, size)), "doc_id long, n long, set_id long, slice int, counts binary"), "profile"
    )
    members = profile.where("slice is null").select("doc_id", "n", "set_id")
    ranks = spark.sparkContext.broadcast(_rank_table(profile, sketch_bits))
    entries = docs.mapInArrow(releasing(_columns(ranks, size, percent)), "hash long, set_id long, n int, hot boolean, salt long")
    met = (
        entries.repartition(parts, "hash", "salt")
        .drop("salt")
        .sortWithinPartitions("hash", F.abs("n"), "set_id")
        .mapInArrow(releasing(_meet_in_columns(percent)), "a long, b long, need long, met long")
    )
    met = met.groupBy("a", "b", "need").agg(F.sum("met").alias("met")).where("met >= need").select("a", "b")
    blocks = staged(components(met), "blocks")
    reps = members.groupBy("set_id", "n").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    reps = staged(reps, "reps")
    rows = staged(reps.drop("rows").join(blocks.withColumnRenamed("node", "set_id"), "set_id"), "rows")
    links = _product_rows(docs, rows, percent, size).applyInArrow(_product(percent), "a long, b long")
    classes = components(links).withColumnRenamed("node", "set_id").withColumnRenamed("component", "class")
    linked = reps.where("n > 0").join(classes, "set_id", "left").withColumn("class", F.coalesce("class", "set_id"))
    linked = staged(linked.select("set_id", "class", "doc_id", "rows", F.xxhash64("set_id").alias("place")), "linked")
    least = linked.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    found = staged(dealt_join(linked, least, "class", "place", "sets").select("set_id", "component_id", "rows"), "found")
    full = members.where("n > 0").withColumn("place", F.monotonically_increasing_id())
    full = dealt_join(full, found, "set_id", "place", "rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _product_rows(docs: DataFrame, rows: DataFrame, percent: int, size: int):
    """Sets of the candidate components grouped by pairs of row blocks.

    A component above ``BLOCK_ROWS`` sets or ``BLOCK_SHINGLES`` shingles is cut by size first: sets link only with sizes within
    ``percent``, so with bands of that width only equal and neighbouring bands meet; a band above the bounds is cut by hash.
    """
    spark = docs.sparkSession
    banded = rows.withColumn("band", F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(math.log(100 / percent) * (1 + 1e-9))).cast("int"))

    def cuts(of: DataFrame, *by: str) -> DataFrame:
        counts = of.groupBy(*by).agg(F.count("*").alias("sets"), F.sum("n").alias("entries"))
        needed = F.greatest(F.ceil(F.col("sets") / BLOCK_ROWS), F.ceil(F.col("entries") / BLOCK_SHINGLES), F.lit(1)).cast("int")
        return counts.select(*by, "sets", needed.alias("cuts"))

    whole = cuts(banded, "component").where("sets > 1")
    banded = banded.join(whole.select("component", (F.col("cuts") > 1).alias("large")), "component")
    banded = banded.withColumn("band", F.when(F.col("large"), F.col("band")).otherwise(0)).drop("large")
    # the bands of a component number at most the logarithm of the largest size
    known = cuts(banded, "component", "band").groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "cuts"))).alias("known"))
    rows = banded.join(known, "component")
    bitmap = spark.sparkContext.broadcast(filter_bits(rows, "doc_id"))
    full = docs.withColumn("slot", slot_column("doc_id")).mapInArrow(releasing(_sets(bitmap, size)), "doc_id long, set_id long, hashes binary")
    placed = full.join(rows.select("doc_id", "set_id", "component", "band", "known"), ["doc_id", "set_id"])
    number = lambda band, cut: F.shiftleft(band.cast("long"), 32) + cut
    own = number(F.col("band"), F.pmod(F.xxhash64("set_id"), F.try_element_at("known", F.col("band"))))
    others = F.flatten(
        F.transform(
            F.filter(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.map_contains_key("known", b)),
            lambda b: F.transform(F.sequence(F.lit(0), F.element_at("known", b) - 1), lambda c: number(b, c)),
        )
    )
    placed = placed.withColumn("block", own).withColumn("other", F.explode(others))
    placed = placed.select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "hashes"
    )
    return placed.groupBy("component", "i", "j")
