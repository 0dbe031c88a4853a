"""Rows beside their next row in a total order of all rows, without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordering import search_sorted
from .spark_help import partitions

PARTS_PER_TASK = 4


def dealt_descending(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``part, tail, key, column`` sorted within partitions so that each part runs from large to small keys.

    Parts are ranges between borders that are keys of the table. The row that follows a part (the largest key of the
    part below; for the lowest part the largest of all) stands at the part's end once more, marked ``tail``. So a scan
    of a partition sees every row and its successor. Null keys come after all others; equal keys order by text.
    """
    spark = docs.sparkSession
    tasks = partitions(spark)
    parts = tasks * PARTS_PER_TASK
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(key, shares, 20 * parts).alias("borders"), F.max(key).alias("top")).first()
    borders = sorted(set(found["borders"] or []))
    known = F.array(*[F.lit(b) for b in borders]).cast("array<bigint>")
    # keys equal to a border belong to the part below it, whose largest key they are
    above = search_sorted(known, F.col(key) - 1, len(borders)) if borders else F.lit(0)
    part = F.coalesce(above, F.lit(0))
    is_border = F.col(key).isin(borders) if borders else F.lit(False)
    copies = F.array_compact(
        F.array(
            F.struct(part.alias("part"), F.lit(False).alias("tail")),
            F.when(F.coalesce(is_border, F.lit(False)), F.struct((part + 1).alias("part"), F.lit(True).alias("tail"))),
            F.when(F.col(key).eqNullSafe(F.lit(found["top"])), F.struct(F.lit(0).alias("part"), F.lit(True).alias("tail"))),
        )
    )
    rows = docs.select(key, column, F.inline(copies))
    rows = rows.repartition(tasks, "part")
    return rows.sortWithinPartitions("part", "tail", F.col(key).desc_nulls_last(), F.xxhash64(column), column)
