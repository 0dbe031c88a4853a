"""Fixed-length windows over reads, their labels and negative windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import indices, let
from ..functions.labels import CANONICAL, IGNORE, MODIFIED
from ..functions.sequence import bases, centered_kmer, nearest_base
from ..ordering import seed_key
from .joins import regular_windows


def chunk_windows(reads: DataFrame, length: str, chunk: int, overlap: int, signal: str | None = None) -> DataFrame:
    """One row per overlapping window, anchored at the end of the read; with ``signal`` also its slice."""
    first, last = regular_windows(F.col(length), chunk, overlap)
    numbers = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    starts = F.transform(numbers, lambda k: first + k * (chunk - overlap))
    kept = [c for c in reads.columns if c != signal]
    rows = reads.select(*kept, *([F.col(signal).alias("_sig")] if signal else []), F.explode(starts).alias("window_start"))
    rows = rows.withColumn("window_end", F.col("window_start") + chunk)
    if signal:
        rows = rows.withColumn("window_signal", F.slice("_sig", F.col("window_start") + 1, F.lit(chunk))).drop("_sig")
    return rows


def sequence_windows(reads: DataFrame, chunk: int, overlap: int, seq: str = "seq", name: str = "target_seq") -> DataFrame:
    """One row per overlapping window of letters, anchored at the end of the read, with its letters; other columns are kept.

    The read is cut once into pieces of one stride, from which each window takes its own, and only these leave the read's row: work
    is linear in the read, where a cut from the whole read for each window walks it from its start.
    """
    stride = chunk - overlap
    first, last = regular_windows(F.length(seq), chunk, overlap)
    kept = [c for c in reads.columns if c != seq]
    rows = reads.select(*kept, F.col(seq).alias("_seq"), first.alias("_first"), last.alias("_last"))
    pieces = F.regexp_extract_all(F.substring("_seq", F.col("_first") + 1, F.length("_seq")), F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))

    def window(cut: Column, k: Column) -> Column:
        text = F.substring(F.array_join(F.slice(cut, k + 1, F.lit(-(-chunk // stride))), ""), 1, chunk)
        return F.struct((F.col("_first") + k * stride).alias("window_start"), text.alias("text"))

    cuts = F.when(F.col("_last") >= 0, let(pieces, lambda cut: F.transform(indices(F.col("_last") + 1), lambda k: window(cut, k))))
    rows = rows.select(*kept, F.explode(cuts).alias("_w"))
    start = F.col("_w.window_start")
    return rows.select(*kept, start.alias("window_start"), (start + chunk).alias("window_end"), F.col("_w.text").alias(name))


def negative_targets(
    seq: Column, mode: str = "center", motifs: Sequence[str] | None = None, k: int = 5, ignore: int = IGNORE
) -> Column:
    """Target array of an unmodified window: canonical-A at the centre-most candidate A, or at all of them."""
    def build(letters: Column) -> Column:
        def candidate(b: Column, i: Column) -> Column:
            hit = b == "A"
            return hit & centered_kmer(seq, i, k).isin(*motifs) if motifs is not None else hit

        marks = F.transform(letters, lambda b, i: F.when(candidate(b, i), F.lit("A")).otherwise(F.lit("-")))
        if mode == "all":
            return F.transform(
                marks, lambda m: F.when(m == "A", F.lit(CANONICAL["A"])).otherwise(F.lit(ignore)).cast("smallint")
            )
        return let(
            marks,
            lambda ms: let(
                nearest_base(ms),
                lambda at: F.transform(
                    ms, lambda m, i: F.when(i == at, F.lit(CANONICAL["A"])).otherwise(F.lit(ignore)).cast("smallint")
                ),
            ),
        )

    if mode not in ("center", "all"):
        raise ValueError(f"unknown label mode {mode!r}")
    return let(bases(F.upper(seq)), build)


def sample_negatives(
    candidates: DataFrame, positives: DataFrame, per_positive: int, read_id: str = "read_id", start: str = "window_start", seed: int = 42
) -> DataFrame:
    """Per read at most per_positive * max(positives, 1) of its candidate windows (all when per_positive <= 0).

    The order key is seeded with the read id, so a read's picks do not depend on other reads; the window function
    runs per read, over a list bounded by the read's length.
    """
    if per_positive <= 0:
        return candidates
    counts = positives.groupBy(read_id).agg(F.count(F.lit(1)).alias("_pos"))
    rows = candidates.join(counts, read_id, "left")
    w = Window.partitionBy(read_id).orderBy(seed_key(seed, read_id, start), start)
    quota = F.greatest(F.coalesce("_pos", F.lit(0)), F.lit(1)) * per_positive
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= quota).drop("_rn", "_pos")


def label_windows(
    windows: DataFrame,
    units: DataFrame,
    keep_base: str = "A",
    max_length: int | None = None,
    read_id: str = "read_id",
) -> DataFrame:
    """Label arrays of windows from the units assigned to them; every window keeps a ``reject_reason`` or NULL.

    ``windows``: read_id, window_start, window_end, left, target_seq. ``units``: read_id, window_start, start,
    center_index, label, pattern_id, motif, orientation, identity. The lists follow the units' order on the read.
    """
    key = [read_id, "window_start"]
    entry = F.struct("start", "center_index", "label", "pattern_id", "motif", "orientation", "identity")
    per_window = units.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("_units"))
    joined = windows.join(per_window, key, "left")
    letter = lambda u: F.substring(F.upper("target_seq"), (u["center_index"] - F.col("left") + 1).cast("int"), F.lit(1))
    kept = F.filter(F.coalesce("_units", F.array()), lambda u: (u["center_index"] >= F.col("left")) & (letter(u) == keep_base))
    joined = joined.withColumn("_kept", kept).withColumn("label_length", F.length("target_seq"))
    reason = (
        F.when(F.col("_units").isNull() | (F.col("label_length") == 0), F.lit("no_label"))
        .when(~F.upper("target_seq").rlike("^[ACGTU]*$"), F.lit("no_label"))
    )
    if max_length is not None:
        reason = reason.when(F.col("label_length") > max_length, F.lit("too_long"))
    reason = reason.when(F.size("_kept") == 0, F.lit("no_label"))
    joined = joined.withColumn("reject_reason", reason)
    local = F.map_from_entries(
        F.transform("_kept", lambda u: F.struct((u["center_index"] - F.col("left")).cast("int").alias("i"), u["label"].cast("int").alias("v")))
    )
    target = let(
        local,
        lambda labels: F.transform(indices(F.col("label_length")), lambda i: F.coalesce(labels[i], F.lit(IGNORE)).cast("smallint")),
    )

    def listed(name: str) -> Column:
        return F.array_join(F.transform("_kept", lambda u: u[name].cast("string")), ",")

    def count(value: int) -> Column:
        return F.size(F.filter("_kept", lambda u: u["label"] == value))

    identity = F.aggregate("_kept", F.lit(0.0), lambda a, u: a + u["identity"]) / F.size("_kept")
    ok = F.col("reject_reason").isNull()
    return joined.select(
        *[c for c in windows.columns],
        "reject_reason",
        "label_length",
        F.when(ok, target).alias("target"),
        F.when(ok, listed("pattern_id")).alias("pattern_ids"),
        F.when(ok, listed("motif")).alias("motifs"),
        F.when(ok, listed("orientation")).alias("orientations"),
        F.when(ok, F.size("_kept")).alias("labeled_count"),
        F.when(ok, count(MODIFIED)).alias("positive_count"),
        F.when(ok, count(CANONICAL["A"])).alias("negative_count"),
        F.when(ok, identity).alias("mean_identity"),
    )
