"""Array helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; lambdas would otherwise recompute it per element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def indices(size: Column) -> Column:
    """``[0, 1, .., size-1]``, empty for size 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def total(arr: Column, kind: str = "bigint") -> Column:
    return F.aggregate(arr, F.lit(0).cast(kind), lambda acc, x: acc + x.cast(kind))


def _append_sums(arr: Column, start: Column) -> Column:
    empty = F.array().cast("array<bigint>")
    return F.aggregate(
        arr,
        empty,
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), start) + x.cast("bigint"))),
    )


def running_sum(arr: Column) -> Column:
    """Inclusive running sums of an integer array.

    Appending to an array copies it, so one fold over n values costs n*n/2 copies. Folding blocks of about the cube
    root of 2n values, then the block sums, keeps the copies per value below 100 for reads of a million bases.
    """
    def blockwise(values: Column) -> Column:
        block = F.greatest(F.ceil(F.cbrt(F.size(values) * 2)), F.lit(4)).cast("int")
        return let(
            block,
            lambda k: F.transform(
                indices(F.ceil(F.size(values) / k)), lambda b: F.slice(values, (b * k + 1).cast("int"), k)
            ),
        )

    def combine(blocks: Column) -> Column:
        ends = _append_sums(F.transform(blocks, lambda b: total(b)), F.lit(0).cast("bigint"))
        return let(
            ends,
            lambda e: F.flatten(
                F.transform(
                    blocks, lambda b, i: _append_sums(b, F.coalesce(F.get(e, i - 1), F.lit(0).cast("bigint")))
                )
            ),
        )

    return let(arr, lambda values: let(blockwise(values), combine))


def sorted_quantile(sorted_arr: Column, p: float) -> Column:
    """Linearly interpolated quantile of an already sorted numeric array."""
    def pick(values: Column) -> Column:
        pos = F.lit(float(p)) * (F.size(values) - 1)
        lo = F.floor(pos).cast("int")
        a, b = F.get(values, lo), F.get(values, F.ceil(pos).cast("int"))
        return a + (b - a) * (pos - lo)

    return let(sorted_arr, pick)


