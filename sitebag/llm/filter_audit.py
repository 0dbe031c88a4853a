"""What each filter removes under every order of filters, kept by a stream that retracts earlier decisions.

Documents come as a stream of files, read in available-now micro-batches. Four filters look at a document alone, the fifth
(a copy of a smaller doc_id's text) at the whole table. Keyed state holds, for each text, the smallest doc_id seen and what
the rows with that id count for. When a smaller id arrives, the rows that counted as first are taken back from the counters of
their part and return as copies. After the last micro-batch the sums of all changes are the counts of the whole table,
in whichever order the files came.

The state is a table of one small row a distinct text (and part and label kind), joined with each micro-batch by text and written again;
micro-batches are few and large. Copies are combined before they are dealt by text, so a text that a third of all rows
share arrives as one row for each part and kind. The counters have at most 32 masks a part; every order and step is read
off them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path
from .spark_help import staged
from .textbatch import chunks

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
COPY = 1 << FILTERS.index("E")
BATCHES = 4
_UPPER, _CONTINUED = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    words = text.split()  # on bytes: the separators 0x09-0x0D and 0x20 alone
    points = len(text.translate(None, _CONTINUED))
    upper = len(text) - len(text.translate(None, _UPPER))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * upper > UPPER_PERCENT * points,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch):
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("part"),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([own_mask(t) for t in texts], pa.int32()),
                ],
                ["doc_id", "part", "key", "mask"],
            )


def combined(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each text, part, mask and label kind of a micro-batch.

    ``least`` is the smallest doc_id, ``at_least`` how many rows have it, ``rows`` how many have any id and ``free`` how many none. Rows of
    one doc_id are counted first, so a text that a third of all rows share is combined inside each task before it is dealt.
    """
    rows = rows.join(labels, "doc_id", "left").withColumn("kind", F.coalesce("kind", F.lit(0)))
    rows = rows.groupBy("doc_id", "key", "part", "mask", "kind").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc_id").isNotNull()
    first = F.min(F.when(known, F.struct("doc_id", "n"))).alias("_first")
    counts = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for c, k in ((known, "rows"), (~known, "free"))]
    out = rows.groupBy("key", "part", "mask", "kind").agg(first, *counts)
    return out.select("key", "part", "mask", "kind", F.col("_first.doc_id").alias("least"), F.coalesce("_first.n", F.lit(0)).alias("at_least"), "rows", "free")


STATE = "key binary, part string, mask int, kind int, least long, at_least long"


def merged(state: DataFrame, arrived: DataFrame) -> DataFrame:
    """State rows and rows of :func:`combined` beside ``low``, the smallest id of their text after this micro-batch."""
    both = arrived.withColumn("is_new", F.lit(True)).unionByName(
        state.select("*", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("free"), F.lit(False).alias("is_new"))
    )
    lows = both.groupBy("key").agg(F.min("least").alias("low"))
    return both.join(lows, "key").withColumn("first", F.coalesce(F.col("least") == F.col("low"), F.lit(False)))


def changes(rows: DataFrame) -> DataFrame:
    """Changes ``part, mask, rows, good, toxic`` of the counters by rows of :func:`merged`.

    A row that arrives adds what it counts for. A row of the state whose id is no longer the smallest is taken back and
    returns as a copy; any other has been counted already.
    """
    own = F.when(F.col("first"), F.col("at_least")).otherwise(0)
    taken_back = F.when(F.col("first"), 0).otherwise(F.col("at_least"))
    unlike = F.when(F.col("is_new"), F.col("free") + own).otherwise(-taken_back)
    copies = F.when(F.col("is_new"), F.col("rows") - own).otherwise(taken_back)
    both = F.array(F.struct(F.col("mask").alias("mask"), unlike.alias("n")), F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), copies.alias("n")))
    parts = rows.select("part", "kind", F.explode(both).alias("c")).select("part", "kind", "c.mask", "c.n").where("n <> 0")
    good, toxic = F.col("kind").bitwiseAND(1), F.col("kind").bitwiseAND(2) / 2
    sums = [F.sum(F.col("n") * w).cast("long").alias(k) for w, k in ((F.lit(1), "rows"), (good, "good"), (toxic, "toxic"))]
    return parts.groupBy("part", "mask").agg(*sums)


def run_counters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Counters ``part, mask, rows, good, toxic`` after all micro-batches that are available now.

    ``documents`` streams ``doc_id, text, source``; ``labels`` is a table ``doc_id, kind`` of at most one row a doc_id. Micro-batch n
    reads the state that the one before wrote and writes its own state and summed changes under its number in the shared
    folder, so one that is run again after a failure replaces both and nothing counts twice.
    """
    spark = documents.sparkSession
    path = stage_path(spark, "audit")
    spark.createDataFrame([], "part string, mask int, rows long, good long, toxic long").write.parquet(f"{path}/changes/batch=-1")
    spark.createDataFrame([], STATE).write.parquet(f"{path}/state/-1")

    def sink(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = staged(merged(session.read.schema(STATE).parquet(f"{path}/state/{number - 1}"), combined(batch, labels)), "merged")
        state = rows.where("first").groupBy("key", "part", "mask", "kind").agg(F.min("least").alias("least"), F.sum("at_least").alias("at_least"))
        state.write.mode("overwrite").parquet(f"{path}/state/{number}")
        changes(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    stream = rows.mapInArrow(_read_texts, "doc_id long, part string, key binary, mask int").writeStream.foreachBatch(sink)
    stream.option("checkpointLocation", stage_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{path}/changes").groupBy("part", "mask")
    return found.agg(*[F.sum(c).alias(c) for c in ("rows", "good", "toxic")])


ORDERS = ["".join(p) for p in permutations(FILTERS)]
REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def _weights() -> dict[str, np.ndarray]:
    """For every order and step (rows) which masks (columns) count: kept, removed, redundant, unique_fails, shapley."""
    out = {k: np.zeros((len(ORDERS) * len(FILTERS), 1 << len(FILTERS)), dtype=np.int64) for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for o, order in enumerate(ORDERS):
        bits = [1 << FILTERS.index(f) for f in order]
        for s, bit in enumerate(bits):
            row = o * len(FILTERS) + s
            for mask in range(1 << len(FILTERS)):
                gone = any(mask & b for b in bits[:s])
                out["kept"][row, mask] = not gone and not mask & bit
                out["removed"][row, mask] = bool(mask & bit) and not gone
                out["redundant"][row, mask] = bool(mask & bit) and gone
                out["unique_fails"][row, mask] = mask == bit
    own = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    for f in range(len(FILTERS)):
        out["shapley"][own == f] = out["removed"][own == f].sum(axis=0)
    return out


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = _weights()
    orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    for batch in batches:
        for part, counters in zip(batch.column("part").to_pylist(), batch.column("counters").to_pylist(), strict=True):
            by_mask = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
            for c in counters:
                by_mask[:, c["mask"]] += c["rows"], c["good"], c["toxic"]
            rows, good, toxic = by_mask
            numbers = [weights[k] @ rows for k in ("kept", "removed", "redundant", "unique_fails")]
            numbers += [weights["removed"] @ good, weights["removed"] @ toxic, weights["shapley"] @ rows]
            arrays = [pa.array([part] * len(orders)), pa.array(orders.tolist()), pa.array(steps), *map(pa.array, numbers)]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in REPORT.split(", ")])


def order_report(counters: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: what the step's filter does there. A part has at most 32 counters."""
    packed = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("counters"))
    return packed.mapInArrow(_reports, REPORT)


def label_kinds(labels: DataFrame) -> DataFrame:
    """``doc_id, kind``: quality + 2 * toxic. Several rows of a doc_id count as one with the larger values; null is 0."""
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int") for c in ("quality", "toxic")]
    return rows.agg((one[0] + 2 * one[1]).alias("kind"))


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Report on the Parquet table of documents at ``path`` (``doc_id, text, source``; other columns are ignored).

    Its files are streamed in about ``batches`` micro-batches (a file is never split between two).

    Null text is empty text, null source the empty part. Rows of one doc_id and text are no copies of each other; a row
    without doc_id is nobody's copy and makes none. A document without labels counts as neither good nor toxic. No rows give
    no rows.
    """
    table = spark.read.parquet(path)
    files = table.inputFiles()
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches)))
    folder, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # the table is one file: streams read folders
        rows = stream.option("pathGlobFilter", name).parquet(folder)
    else:
        rows = stream.parquet(path)
    return order_report(run_counters(rows, staged(label_kinds(labels), "kinds")))
