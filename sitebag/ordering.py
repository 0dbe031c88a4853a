"""Prefix sums, ranks and quantiles that never sort a whole group inside one task.

A window without ``PARTITION BY``, or with one hot key, sends an unbounded number of rows to a single task.
The helpers here cut every group into order-preserving buckets first: per-bucket totals are a small table whose
running sum gives each bucket its offset, and the row-level window then runs inside ``(group, bucket)``.
Bucket borders depend on the data only (never on partition ids or on a random sample), so recomputed
partitions after an executor loss give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_BORDERS = 256


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def attach(df: DataFrame, extra: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``extra`` on ``keys`` (NULL-safe) and keep one copy of the key columns.

    Without keys ``extra`` is one row; its columns then come from a scalar subquery instead of from a cross join.
    """
    if not keys:
        row = extra.select(F.struct(*extra.columns).alias("_row")).scalar()
        packed = df.withColumn("_row", row)
        return packed.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in extra.columns])
    right = extra.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in extra.columns if c not in keys])
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return df.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def search_sorted(borders: Column, value: Column, max_len: int) -> Column:
    """Number of entries of the ascending array ``borders`` that are <= ``value`` (binary search)."""
    steps = [1 << s for s in reversed(range(max(1, max_len).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda lo, step: F.when(
            (lo + step <= F.size(borders)) & (F.get(borders, lo + step - 1) <= value), lo + step
        ).otherwise(lo),
    )


def ordered_prefix(
    df: DataFrame, order: Sequence[Column], sums: Sequence[str], by: Sequence[str] = (), borders: int | None = None
) -> DataFrame:
    """Add ``<s>_before`` (sum over the rows sorting before this one) and ``<s>_total`` per ``by`` group.

    ``order`` lists ascending sort expressions. Borders are the keys of the ``borders`` rows with the smallest
    hash: a uniform row sample that is a function of the data alone and has a fixed size (by default four times the
    shuffle partitions, so a larger cluster gets more, smaller buckets).
    """
    borders = borders or max(MIN_BORDERS, 4 * _shuffle_partitions(df))
    key = order[0] if len(order) == 1 else F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    keyed = df.withColumn("_k", key)
    # reading the sums here keeps the sample on the same aggregated exchange as the other two uses of ``df``
    weighted = F.lit(False)
    for s in sums:
        weighted = weighted | (F.col(s) >= 0)
    sample = (
        keyed.where(weighted)
        .select("_k", F.xxhash64(*[F.col(c) for c in by], "_k").alias("_h"))
        .orderBy("_h", "_k")
        .limit(borders)
        .agg(F.sort_array(F.collect_set("_k")).alias("_b"))
    )
    placed = (
        keyed.withColumn("_borders", sample.scalar())
        .withColumn("_bucket", search_sorted(F.col("_borders"), F.col("_k"), borders))
        .drop("_borders")
    )
    group = Window.partitionBy(*by)
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    totals = totals.select(
        *by,
        "_bucket",
        *[(F.sum(f"_t_{s}").over(upto) - F.col(f"_t_{s}")).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(group).alias(f"{s}_total") for s in sums],
    )
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = attach(placed, totals, [*by, "_bucket"])
    for s in sums:
        out = out.withColumn(f"{s}_before", F.sum(s).over(inside) - F.col(s) + F.col(f"_o_{s}"))
    return out.drop("_k", "_bucket", *[f"_o_{s}" for s in sums])


def seed_key(seed: int, *cols: str | Column) -> Column:
    """Reproducible pseudo-random order key: md5 of the seed and the given values."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


WHOLE_ROWS = 1_000_000


def seeded_rank(
    df: DataFrame,
    ident: str,
    by: Sequence[str] = (),
    seed: int = 42,
    rank: str = "rn",
    size: str | None = None,
    whole_rows: int = WHOLE_ROWS,
) -> DataFrame:
    """1-based random rank within ``by`` (ordered by :func:`seed_key`, then id) and optionally the group size.

    A group of at most ``whole_rows`` rows is ranked by one window. A larger one is cut by the leading hex digits of its
    keys, which are uniform, into at least 16 parts for each shuffle partition, and the parts' counts give each its offset;
    so a group that holds a third of all rows occupies every task, and only such groups pay for parts. The order is the
    same either way.
    """
    digits = max(2, math.ceil(math.log(16 * _shuffle_partitions(df), 16)))
    keyed = df.withColumn("_key", seed_key(seed, *by, ident))
    sizes = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    keyed = attach(keyed, sizes, by)
    is_large = F.col("_size") > whole_rows
    keyed = keyed.withColumn("_slot", F.when(is_large, F.substring("_key", 1, digits)).otherwise(""))
    upto = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = keyed.where(is_large).groupBy(*by, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select(*by, "_slot", (F.sum("_c").over(upto) - F.col("_c")).alias("_offset"))
    inside = Window.partitionBy(*by, "_slot").orderBy("_key", ident)
    out = attach(keyed, offsets, [*by, "_slot"], "left")
    out = out.withColumn(rank, F.row_number().over(inside) + F.coalesce("_offset", F.lit(0).cast("bigint")))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_key", "_slot", "_offset", "_size")


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """Linearly interpolated quantiles per ``by``, one column per entry of ``probs``; NULL values are ignored.

    Exact form: collapse to (group, value) counts, take prefix counts, pick the two neighbouring order statistics.
    No task holds the values of a whole group. ``approx=True`` uses the sketch instead.
    """
    if approx:
        return df.groupBy(*by).agg(*[F.percentile_approx(value, p, 100000).alias(n) for n, p in probs.items()])
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = ordered_prefix(hist, [F.col("_v")], ["_n"], by)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n_total") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_n_before") <= at) & (at < F.col("_n_before") + F.col("_n"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{tag}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_f"))
    out = ranked.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n)
            for n in probs
        ],
    )
