"""Small Spark helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged, unstaged

__all__ = ["arrow_rows", "dealt_join", "filter_bits", "in_bits", "partitions", "read", "releasing", "slot_bits", "slot_column", "staged", "take", "unstaged"]

FILTER_BITS = 24
HOT_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows of an Arrow batch from here on. A batch of whole texts stands in memory several times, in the JVM and in the
    worker, so a stage that only maps over texts asks for fewer rows than Spark's 10,000, which suit rows of numbers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slot_column(key: str, bits: int = FILTER_BITS) -> Column:
    """Hash slot of a key, 1 to 2**``bits``."""
    return (F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << bits)) + 1).cast("long")


def filter_bits(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the hash slots of the keys: 2 MB for 24 bits, whatever the number of keys.

    A map over a large table drops rows whose slot is empty before it touches their text; a join after it removes
    the rest exactly. Only the bitmap, whose size is fixed, comes to the driver.
    """
    return slot_bits(keys.select(slot_column(key, bits).alias("slot")), bits)


def slot_bits(slots: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The bitmap of a column ``slot`` of places from 1 to 2**``bits``."""
    rows = (
        slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map"))
        .collect()
    )
    out = np.zeros(((1 << bits) // 32768 + 1) * 4096, dtype=np.uint8)
    for bucket, data in rows:
        begin = (bucket - 1) * 4096
        out[begin : begin + len(data)] |= np.frombuffer(data, dtype=np.uint8)
    return out


def in_bits(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots (as of :func:`slot_column`) are set."""
    at = slots.astype(np.int64) - 1
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def take(batch: pa.RecordBatch, keep: Sequence[bool] | np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(keep, type=pa.bool_()))


def dealt_join(rows: DataFrame, table: DataFrame, key: str, place: str, n: str = "n", hot_rows: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a ``key`` and in ``n`` how many ``rows`` share it.

    A key with more than its share of all rows is dealt over several tasks by ``place`` (a number that differs between rows
    of one key) and its row of ``table`` is copied as often. At most ``8 * parts`` keys can be that hot, a list
    of proven size, which is why it alone is broadcast. ``n`` and ``place`` are not returned.
    """
    parts = partitions(rows.sparkSession)
    total = table.agg(F.sum(n)).first()[0] or 0
    share = max(hot_rows or HOT_ROWS, -(-total // (8 * parts)))
    cuts = F.ceil(F.col(n) / F.lit(share)).cast("int")
    hot = F.broadcast(table.where(F.col(n) > share).select(key, cuts.alias("_cuts")))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.col(place), F.coalesce("_cuts", F.lit(1))).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(cuts, F.lit(1)) - 1))).drop(n)
    return dealt.drop("_cuts", place).join(copies, [key, "_salt"]).drop("_salt")


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The map ``run``, after which the worker hands memory back that its allocators keep for reuse.

    Workers live on after a task; what they hold on to would stand beside the next task's data.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped
