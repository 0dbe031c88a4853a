"""Profiles of alignment records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import alignment_metrics
from ..functions.signal import decode_overflow
from ..ordering import attach, quantiles
from ..session import staged
from ..sources.sam import tag_int, tag_ints

# Reported percentiles.
LEVELS = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}
MEASURES = ("length", "aligned_fraction", "softclip_fraction", "mapq", "identity", "move_span_ratio", "move_ns_ratio")


def read_measures(reads: DataFrame) -> DataFrame:
    """Per record the profiled measures; NULL where a record lacks the tags or bases for one."""
    m = alignment_metrics(F.col("cigar"), tag_int(F.col("tags"), "NM"), F.col("seq"))
    moves = decode_overflow(tag_ints(F.col("tags"), "mv"))
    ns, ts = tag_int(F.col("tags"), "ns"), F.coalesce(tag_int(F.col("tags"), "ts"), F.lit(0))
    rows = reads.select("*", m.alias("_m"), moves.alias("_mv"), ns.alias("_ns"), ts.alias("_ts"))
    span = (F.size("_mv") - 1) * F.get("_mv", 0)
    timed = F.col("_mv").isNotNull() & F.col("_ns").isNotNull()
    return rows.select(
        "read_id",
        F.col("is_reverse"),
        (F.map_contains_key("tags", "MM") & F.map_contains_key("tags", "ML")).alias("has_mod_tags"),
        F.length("seq").alias("length"),
        "_m.aligned_fraction",
        "_m.softclip_fraction",
        "mapq",
        "_m.identity",
        F.when(timed, span / F.greatest(F.col("_ns") - F.col("_ts"), F.lit(1))).alias("move_span_ratio"),
        F.when(timed, span / F.greatest(F.col("_ns"), F.lit(1))).alias("move_ns_ratio"),
    )


def alignment_profile(reads: DataFrame, approx: bool = False) -> DataFrame:
    """One row per measure with its percentiles, plus the reverse and tagged fractions of all records."""
    rows = staged(read_measures(reads), "measures")  # a few numbers per record; the records are parsed once
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in MEASURES]).unpivot([], list(MEASURES), "measure", "value")
    counts = long.groupBy("measure").agg(F.count("value").alias("records"))
    shares = rows.agg(
        F.avg(F.col("is_reverse").cast("int")).alias("reverse_fraction"), F.avg(F.col("has_mod_tags").cast("int")).alias("tagged_fraction")
    )
    out = attach(counts, quantiles(long, "value", LEVELS, ["measure"], approx), ["measure"], "left")
    return out.withColumn("reverse_fraction", shares.select("reverse_fraction").scalar()).withColumn(
        "tagged_fraction", shares.select("tagged_fraction").scalar()
    )
