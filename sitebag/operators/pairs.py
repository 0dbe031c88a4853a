"""Comparison of two call sets read by read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let
from ..ordering import attach, quantiles
from ..session import staged
from . import wavefront
from .metrics import ratio


NEAR, LIKE, TABLE = 512, 64, 1 << 22


def _distances(found_by):
    @F.pandas_udf(T.IntegerType())
    def distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            found = [None if a is None or b is None else found_by(a, b) for a, b in zip(left, right, strict=True)]
            yield pd.Series(found, dtype="Int32")

    return distances


def _far(a: str, b: str) -> int:
    return wavefront.distance(a, b) if len(a) * len(b) > TABLE else wavefront.bit_distance(a, b)


def edit_distance(a: Column, b: Column, long_reads: bool = False) -> Column:
    """Exact Levenshtein distance; pairs that are close pay for a narrow band only.

    With a limit the distance is computed inside a band of that width and is -1 beyond it. Pairs further apart than the limit go by
    bit vectors in Arrow batches, 64 cells of the table at a time. With ``long_reads`` the limits are 64 and 512, and pairs beyond
    whose table has over ``TABLE`` cells are extended along diagonals: letters plus distance squared, not letters squared.
    """
    out = F.lit(-1)
    for limit in (NEAR, LIKE) if long_reads else (LIKE,):
        near = F.levenshtein(a, b, limit)
        out = F.when(near.isNull() | (near >= 0), near).otherwise(out)
    out = F.when(a == b, 0).otherwise(out)
    far = out < 0
    return F.when(far, _distances(_far if long_reads else wavefront.bit_distance)(F.when(far, a), F.when(far, b))).otherwise(out)


def compare_callsets(
    a: DataFrame,
    b: DataFrame,
    key: str = "read_id",
    seq: str = "seq",
    quality: str | None = None,
    excerpt: int | None = None,
    long_reads: bool = False,
) -> DataFrame:
    """Full outer comparison: presence, lengths, edit distance, exact match, quality delta.

    The edit distance covers whole sequences and is NULL where a side is missing. ``excerpt`` adds the first so many
    letters of both sides for a report. ``long_reads`` is for sequences of 10,000 letters and more (:func:`edit_distance`).
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        cols = [F.col(key), F.col(seq).alias(f"seq_{tag}")]
        cols.append((F.col(quality) if quality else F.lit(None).cast("double")).alias(f"quality_{tag}"))
        return df.select(*cols, F.lit(True).alias(f"in_{tag}"))

    j = side(a, "a").join(side(b, "b"), key, "full")
    has_a, has_b = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    presence = F.when(has_a & has_b, F.lit("shared")).when(has_a, F.lit("a_only")).otherwise(F.lit("b_only"))
    la, lb = F.length("seq_a"), F.length("seq_b")
    edit = edit_distance(F.col("seq_a"), F.col("seq_b"), long_reads)
    parts = [F.substring(f"seq_{s}", 1, excerpt).alias(f"prefix_{s}") for s in "ab"] if excerpt else []
    return j.select(
        key, presence.alias("presence"), "seq_a", "seq_b", la.alias("length_a"), lb.alias("length_b"),
        (la - lb).alias("length_delta"), (la == lb).alias("same_length"), edit.alias("edit_distance"),
        (F.col("seq_a") == F.col("seq_b")).alias("exact_match"),
        "quality_a", "quality_b", (F.col("quality_a") - F.col("quality_b")).alias("quality_delta"),
        *parts,
    )


def presence_counts(pairs: DataFrame) -> DataFrame:
    p = F.col("presence")
    return pairs.agg(
        F.count_if(p == "shared").alias("shared"), F.count_if(p == "a_only").alias("a_only"), F.count_if(p == "b_only").alias("b_only")
    )


OPS = ("matches", "mismatches", "insertions", "deletions")
RUN = T.StructType([T.StructField("op", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("a", "b", "length")]])
TOTALS = T.StructType([T.StructField(name, T.IntegerType()) for name in OPS])


@F.pandas_udf(TOTALS)
def _align(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for left, right, cost in batches:
        rows = [
            (None,) * 4 if a is None or b is None else wavefront.totals(a, b, None if pd.isna(c) else int(c))
            for a, b, c in zip(left, right, cost, strict=True)
        ]
        yield pd.DataFrame(rows, columns=list(OPS), dtype="Int32")


@F.pandas_udf(T.ArrayType(RUN))
def _align_runs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    names = RUN.fieldNames()
    for left, right in batches:
        yield pd.Series(
            [
                None if a is None or b is None else [dict(zip(names, run, strict=True)) for run in wavefront.path(a, b)]
                for a, b in zip(left, right, strict=True)
            ]
        )


def alignment_ops(pairs: DataFrame, a: str = "seq_a", b: str = "seq_b", runs: bool = False) -> DataFrame:
    """Match / mismatch / insertion / deletion totals, identity and the coverage of both sides for shared pairs.

    Of all alignments of least unit cost the one with most matches. A side's coverage is the share of its letters that
    stand on an equal letter of the other. ``runs`` adds the path as ``array<struct<op, a, b, length>>`` in order (``=``, ``X``,
    ``I`` for letters of ``a`` alone, ``D`` for letters of ``b`` alone). A pair with a NULL side has NULL totals.

    Opt-in: a Python step, Arrow-batched and after every filter; equal sequences skip it, and a column ``edit_distance`` spares it
    the search for the distance, which costs less than that column, so a caller who needs the totals alone drops it.
    """
    same = F.col(a) == F.col(b)
    left, right, n = F.when(~same, F.col(a)), F.when(~same, F.col(b)), F.length(a)
    if runs:
        whole = F.array(F.struct(F.lit("=").alias("op"), F.lit(0).alias("a"), F.lit(0).alias("b"), n.alias("length")))
        path = F.when(same, F.filter(whole, lambda r: r["length"] > 0)).otherwise(_align_runs(left, right))
        ops = pairs.withColumn("_r", path)
        count = lambda op: F.aggregate("_r", F.lit(0), lambda acc, r: acc + F.when(r["op"] == op, r["length"]).otherwise(0))
        ops = ops.withColumn("_o", F.when(F.col("_r").isNotNull(), F.struct(*[count(op).alias(c) for op, c in zip("=XID", OPS, strict=True)])))
    else:
        full = F.struct(n.alias("matches"), *[F.lit(0).alias(c) for c in OPS[1:]])
        cost = F.col("edit_distance") if "edit_distance" in pairs.columns else F.lit(None)
        ops = pairs.withColumn("_o", F.when(same, full).otherwise(_align(left, right, F.when(~same, cost).cast("int"))))
    eq, x, i, d = (F.col(f"_o.{k}") for k in OPS)
    return ops.select(
        *pairs.columns, eq.alias("matches"), x.alias("mismatches"), i.alias("insertions"), d.alias("deletions"),
        ratio(eq, eq + x + i + d).alias("identity"), ratio(eq, F.length(a)).alias("coverage_a"), ratio(eq, F.length(b)).alias("coverage_b"),
        *([F.col("_r").alias("runs")] if runs else []),
    )


def target_to_query(runs: Column) -> Column:
    """array<int>: for each letter of side ``b`` the place in ``a`` of the equal letter it is aligned with, or -1."""
    return F.flatten(
        F.transform(
            runs,
            lambda r: F.when(r["op"] == "=", F.sequence(r["a"], r["a"] + r["length"] - 1))
            .when(r["op"] != "I", F.array_repeat(F.lit(-1), r["length"]))
            .otherwise(F.array().cast("array<int>")),
        )
    )


def lift_sites(sites: Column, runs: Column) -> Column:
    """Places in ``a`` of the given places of ``b`` (0-based), in order; NULL where no equal letter is aligned or ``b`` has ended."""
    def lifted(places: Column) -> Column:
        at = lambda p: F.when(p >= 0, F.get(places, p.cast("int")))
        return F.transform(sites, lambda p: F.when(at(p) >= 0, at(p)))

    return let(target_to_query(runs), lifted)


def count_projected(sites: Column, runs: Column) -> Column:
    """How many of the places of ``b`` are aligned with an equal letter of ``a``."""
    return F.size(F.filter(lift_sites(sites, runs), lambda p: p.isNotNull()))


def event_totals(pairs: DataFrame) -> DataFrame:
    """Totals of alignment events and of presence over all pairs."""
    return pairs.agg(
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in OPS],
        F.count_if(F.col("presence") != "b_only").alias("reads_a"),
        F.count_if(F.col("presence") != "a_only").alias("reads_b"),
    )


def error_rates(totals: DataFrame) -> DataFrame:
    """Substitution, insertion and deletion counts per correctly called base (at least 1)."""
    right = F.greatest(F.col("matches"), F.lit(1))
    return totals.select(
        "*", ratio(F.col("mismatches"), right).alias("substitution_rate"), ratio(F.col("insertions"), right).alias("insertion_rate"),
        ratio(F.col("deletions"), right).alias("deletion_rate"),
    )


def callset_summary(pairs: DataFrame, identity: str = "identity") -> DataFrame:
    """Means, fractions and the median identity over shared pairs; 0.0 for an empty set, NULL qualities stay out."""
    measures = ("edit_distance", "same_length", "exact_match", "length_a", "length_b", "length_delta", "quality_a", "quality_b", "quality_delta")
    rows = pairs.where(F.col("presence") == "shared").select(F.col(identity).alias("identity"), *measures)
    rows = staged(rows, "summary")  # numbers alone; the means and the median would each compare all sequences
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows.agg(
        F.count(F.lit(1)).alias("shared_reads"),
        zero(F.avg("identity")).alias("mean_identity"),
        zero(F.avg("edit_distance")).alias("mean_edit_distance"),
        zero(F.avg(F.col("same_length").cast("int"))).alias("same_length_fraction"),
        zero(F.avg(F.col("exact_match").cast("int"))).alias("exact_match_fraction"),
        zero(F.avg("length_a")).alias("mean_length_a"),
        zero(F.avg("length_b")).alias("mean_length_b"),
        zero(F.avg("length_delta")).alias("mean_length_delta"),
        F.avg("quality_a").alias("mean_quality_a"),
        F.avg("quality_b").alias("mean_quality_b"),
        F.avg("quality_delta").alias("mean_quality_delta"),
    )
    return attach(out, quantiles(rows, "identity", {"median_identity": 0.5}), []).withColumn(
        "median_identity", zero(F.col("median_identity"))
    )


def projection_coverage(pairs: DataFrame, sites: str = "target_sites", projected: str = "valid_sites") -> DataFrame:
    """Per sample the share of target (``b``) and prediction (``a``) on equal letters, and the share of target sites projected."""
    used = F.col("matches")
    return pairs.withColumn("target_coverage", ratio(used, F.length("seq_b"))).withColumn(
        "predicted_coverage", ratio(used, F.length("seq_a"))
    ).withColumn("site_coverage", ratio(F.col(projected), F.col(sites), None))


def projection_summary(rows: DataFrame) -> DataFrame:
    """Means over the samples; samples without sites stay out of the site mean, and every mean of nothing is 0.0."""
    means = ("target_coverage", "predicted_coverage", "site_coverage")
    return rows.agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in means],
        F.count_if(F.coalesce(F.col("site_coverage"), F.lit(0.0)) == 0.0).alias("samples_without_projection"),
    )


def worst_n(pairs: DataFrame, n: int, keys: Sequence[str] = ("edit_distance",), ident: str = "read_id", identity: str = "identity") -> DataFrame:
    """Shared pairs of lowest identity, then largest listed keys ascending, then id: a distributed top-k."""
    order: list[Column] = [F.col(identity).asc(), *[F.col(k).asc() for k in keys], F.col(ident).asc()]
    return pairs.where(F.col("presence") == "shared").orderBy(*order).limit(n)
