"""Best-fit packing of token sequences by a tree of local rounds.

Pieces are dealt into parts by hash and every part packs its own best-fit, longest first. Bins that can gain nothing
more are final. Of the others a part hands on only what later rounds can use: after a best-fit round at most one bin of
a part is at most half full, so a merge of ``FAN_IN`` parts has at most that many bins to place and needs at most that
many receivers of each residual. Handed-on bins are the items of the next round, up to one part. No task sees more
than a part, no bin is dropped, and what a part holds back could not have been filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_help import releasing, staged
from .textbatch import chunks
from .word_bpe import word_bpe

CAPACITY = 2048
PART_ITEMS = 50_000
FAN_IN = 8
SEPARATOR_ID = 0


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(path)
        closing = np.array([SEPARATOR_ID], dtype="<u4").tobytes()
        for batch in batches:
            for part, texts in chunks(batch):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    ids += closing
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc_id, i, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                last = len(names) if keep_ids else len(names) - 1
                yield pa.RecordBatch.from_arrays(arrays[:last], names[:last])
        word_bpe.cache_clear()  # the worker lives on, and other stages need the memory

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32`` (and ``ids``, binary little-endian) of tokenized documents.

    A document is its token ids and one separator id; only longer ones are cut, every ``capacity`` ids.
    Null text is empty: one piece of one id.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(releasing(_pieces(tokenizer_path, capacity, keep_ids)), schema)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit of items in the given order: bin and offset of each item, fill of each bin.

    Bins are kept by residual; a bit per residual finds the tightest bin in one step.
    """
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    occupied = 0
    fill: list[int] = []
    bins, offsets = [], []
    for size in sizes:
        usable = occupied >> size
        if usable:
            residual = size + (usable & -usable).bit_length() - 1
            b = by_residual[residual].pop()
            if not by_residual[residual]:
                occupied ^= 1 << residual
        else:
            b, residual = len(fill), capacity
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += size
        left = residual - size
        if left:
            by_residual[left].append(b)
            occupied |= 1 << left
    return bins, offsets, fill


def _round(capacity: int):
    """One part: items (item, size, ...) -> bin, offset and the bin's fill beside each item."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", *[c for c in ("doc_id", "piece", "item") if c in items]], ascending=False, kind="stable")
        bins, offsets, fill = best_fit(items["size"].tolist(), capacity)
        numbered = np.array(bins)
        if "item" in items:  # a bin is called after the item that opened it
            first = np.zeros(len(fill), dtype=np.int64)
            item = items["item"].to_numpy()
            first[numbered[::-1]] = item[::-1]
            name = first[numbered]
        else:
            name = (int(items["part"].iloc[0]) << 32) + numbered
        return items.assign(bin=name, shift=offsets, fill=np.array(fill, dtype=np.int64)[numbered]).drop(columns=["size", "part"])

    return run


def _hand_on(fills: DataFrame, capacity: int, fan_in: int) -> DataFrame:
    """Of bins (part, item, size): those at most half full, and ``fan_in`` of each residual that could take one."""
    ranked = fills.where(F.col("size") < capacity).withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY part, size ORDER BY item)")
    )
    return ranked.where((2 * F.col("size") <= capacity) | (F.col("rank") <= fan_in)).drop("rank")


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece placed once, sequences gapless from 0.

    ``pieces`` has ``length`` (1 to ``capacity``) and any other columns, none of them called as the two added.
    No rows give no rows; repeated rows are packed each for itself.
    """
    kept = [c for c in pieces.columns if c != "length"]
    spread = F.xxhash64(*[c for c in pieces.columns if c in ("doc_id", "piece")] or pieces.columns)
    count = pieces.count()
    parts = max(1, -(-count // part_items))
    local = pieces.withColumn("part", F.pmod(spread, F.lit(parts)).cast("int")).withColumn("size", F.col("length"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    placed = local.groupBy("part").applyInPandas(_round(capacity), f"{shape}, bin long, shift long, fill long")
    placed = staged(placed, "packed")
    total = F.max("fill").alias("size")
    bins = placed.groupBy(F.col("bin").alias("item")).agg(total).withColumn("part", F.shiftright("item", 32).cast("int"))
    moves: list[DataFrame] = []
    while parts > 1:
        parts = -(-parts // fan_in)
        items = _hand_on(bins, capacity, fan_in ** (len(moves) + 1))
        items = items.withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
        merged = items.groupBy("part").applyInPandas(_merged(capacity), "part int, item long, bin long, shift long, fill long")
        merged = staged(merged, "merged")
        moves.append(merged.select("item", "bin", "shift"))
        bins = merged.groupBy("part", F.col("bin").alias("item")).agg(total)
    out = placed.select(*kept, "length", F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))

    def moved(rows: DataFrame, level: DataFrame) -> DataFrame:
        level = level.where("item <> bin").select(F.col("item").alias("sequence_id"), F.col("bin").alias("_bin"), F.col("shift").alias("_shift"))
        rows = rows.join(level, "sequence_id", "left")
        return rows.select(
            *kept,
            "length",
            F.coalesce("_bin", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset"),
        )

    return reduce(moved, moves, out)


def _merged(capacity: int):
    inner = _round(capacity)

    def run(items: pd.DataFrame) -> pd.DataFrame:
        part = items["part"].iloc[0]
        return inner(items).assign(part=part)[["part", "item", "bin", "shift", "fill"]]

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize and pack: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) per piece.

    Null text is empty and packs as one id; repeated rows are packed each; extra columns are ignored.
    """
    pieces = staged(token_pieces(docs, tokenizer_path, capacity, keep_ids), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    return pack(pieces, capacity).select(*columns)
