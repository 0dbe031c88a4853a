"""Training chunks from alignment records: windows over the signal with their reference, or the first reason against them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.alignment import aligned_identity, alignment_metrics, query_to_ref
from ..functions.arrays import let
from ..functions.labels import label_targets
from ..functions.sequence import bases, encode_bases, revcomp
from ..functions.signal import decode_moves
from ..ordering import search_sorted
from ..sources.sam import tag_int, tag_ints
from .joins import regular_windows
from .qc import primary_only

# The published limits of the alignment builder.
LIMITS = {
    "mapq": 20, "read_identity": 0.80, "read_aligned_fraction": 0.85, "chunk_aligned_fraction": 0.85, "chunk_identity": 0.70,
    "min_reference": 25, "span_factor": 2.5, "max_target": None,
}
RECORD_REASONS = (
    "low_mapq", "low_read_identity", "low_read_aligned_fraction", "missing_signal", "invalid_interval", "signal_too_short",
    "invalid_move_table", "move_seq_mismatch",
)
CHUNK_REASONS = (
    "zerolen_sequence", "low_aligned_fraction", "short_reference", "long_reference", "no_reference", "n_in_reference",
    "low_base_identity", "no_a", "too_long",
)
LONGEST_READ = 1 << 24


def first_reason(earlier: Column, rules: Sequence[tuple[str, Column]]) -> Column:
    """``earlier`` where it is set, else the name of the first rule that does not hold; a rule without a value fails."""
    return F.coalesce(earlier, *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


def with_reference(
    rows: DataFrame, bins: DataFrame, keys: Sequence[str], low: str, high: str, bin_size: int, contig: str = "contig", name: str = "reference"
) -> DataFrame:
    """``rows`` with the reference letters [low, high) of their contig, as far as the contig goes; NULL where low is NULL.

    ``keys`` name a row. A row meets the bins it touches in an equi-join on (contig, bin), so no contig is ever one value; its
    pieces are as many as its span has bins, and only the first carries the row's other columns, so that a long row is moved as
    often as a short one. Rows without a span meet nothing and are spread over the tasks.
    """
    numbers = F.sequence(F.floor(F.col(low) / F.lit(float(bin_size))), F.floor((F.col(high) - 1) / F.lit(float(bin_size))))
    nowhere = F.array(-1 - F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1 << 20)))
    own = F.struct(*[c for c in rows.columns if c not in keys])
    spread = rows.select(*keys, own.alias("_own"), F.col(contig).alias("_c"), F.col(low).alias("_lo"), F.col(high).alias("_hi"),
                         F.posexplode(F.coalesce(numbers, nowhere)).alias("_i", "_b"))
    packed = spread.select(*keys, F.when(F.col("_i") == 0, F.col("_own")).alias("_row"), "_c", "_lo", "_hi", "_b")
    right = bins.select(F.col("contig").alias("_c"), F.col("bin").alias("_b"), F.col("start").alias("_s"), F.col("seq").alias("_seq"))
    joined = packed.join(right, ["_c", "_b"], "left")
    begin, end = F.greatest(F.col("_lo"), F.col("_b") * bin_size), F.least(F.col("_hi"), (F.col("_b") + 1) * bin_size)
    piece = F.substring("_seq", (begin - F.col("_s") + 1).cast("int"), (end - begin).cast("int"))
    found = joined.groupBy(*keys).agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.sort_array(F.collect_list(F.when(piece.isNotNull(), F.struct(F.col("_b").alias("b"), piece.alias("p"))))).alias("_p")
    )
    text = F.array_join(F.transform("_p", lambda p: p["p"]), "")
    others = [F.col(f"_row.{c}").alias(c) for c in rows.columns if c not in keys]
    return found.select(*keys, *others, F.when(F.col(f"_row.{low}").isNotNull(), text).alias(name))


def signal_intervals(records: DataFrame, signals: DataFrame, chunk: int, limits: Mapping) -> DataFrame:
    """Records with their signal ``[sp + ts, sp + ns)``, the emission of their bases and the first reason against them.

    Records that the cheap rules reject ask for no signal: they join on a key that no signal has.
    """
    m = alignment_metrics(F.col("cigar"), tag_int(F.col("tags"), "NM"), F.col("seq"))
    rows = records.select("*", m.alias("_m"))
    cheap = [
        ("low_mapq", F.col("mapq") >= limits["mapq"]),
        ("low_read_identity", F.col("_m.identity") >= limits["read_identity"]),
        ("low_read_aligned_fraction", F.col("_m.aligned_fraction") >= limits["read_aligned_fraction"]),
    ]
    rows = rows.withColumn("_why", first_reason(F.lit(None).cast("string"), cheap)).drop("_m")
    sid = F.coalesce(F.col("tags")["pi"], F.col("read_id"))
    rows = rows.withColumn("_sid", F.when(F.col("_why").isNull(), sid).otherwise(F.concat(F.lit("\x00"), F.col("read_id"))))
    rows = rows.join(signals.select(F.col("signal_id").alias("_sid"), F.col("signal").alias("_sig")), "_sid", "left").drop("_sid")
    offset = F.coalesce(tag_int(F.col("tags"), "sp"), F.lit(0))
    rows = rows.withColumn("signal_start", offset + tag_int(F.col("tags"), "ts")).withColumn("signal_end", offset + tag_int(F.col("tags"), "ns"))
    rows = rows.withColumn("_moves", F.when(F.col("_sig").isNotNull(), decode_moves(tag_ints(F.col("tags"), "mv"))))
    start, end = F.col("signal_start"), F.col("signal_end")
    dear = [
        ("missing_signal", F.col("_sig").isNotNull()),
        ("invalid_interval", (start >= 0) & (end > start) & (end <= F.size("_sig"))),
        ("signal_too_short", end - start >= chunk),
        ("invalid_move_table", F.size("_moves.emitted") > 0),
        ("move_seq_mismatch", F.size("_moves.emitted") == F.length("seq")),
    ]
    return rows.withColumn("_why", first_reason(F.col("_why"), dear))


def chunk_rows(
    records: DataFrame, signals: DataFrame, bins: DataFrame, chunk: int, overlap: int, limits: Mapping = LIMITS,
    sample_type: str = "rna", bin_size: int = 10000, need_tags: Sequence[str] = ("mv", "ns"), mode: str = "full-mod",
) -> DataFrame:
    """Every window of every usable record, and every rejected record, with the first ``reject_reason`` (NULL: kept).

    ``records`` are parsed alignments with unique ``read_id`` (others than primary ones are no records here), ``signals`` has signal_id and
    signal, ``bins`` come from ``read_fasta_bins`` with ``bin_size``. Kept windows carry their signal, the reference they span, read
    as the sample was sequenced (``target_seq``), and its target labels. Rules run in the order of :data:`RECORD_REASONS` and
    :data:`CHUNK_REASONS`. A record without windows left has one row, without a window.
    """
    limits = {**LIMITS, **limits}
    rows = signal_intervals(primary_only(records, need_tags), signals, chunk, limits)
    turned = F.col("is_reverse") if sample_type == "dna" else ~F.col("is_reverse")
    order = lambda c: F.when(turned, F.reverse(c)).otherwise(c)
    rows = rows.withColumn("_q", F.when(F.col("_why").isNull(), order(bases(F.upper("seq")))))
    rows = rows.withColumn("_r", F.when(F.col("_why").isNull(), order(query_to_ref(F.col("cigar"), F.col("pos0")))))
    first, last = regular_windows((F.col("signal_end") - F.col("signal_start")).cast("int"), chunk, overlap)
    starts = F.transform(F.sequence(F.lit(0), last), lambda k: first + k * (chunk - overlap))

    def window(emitted: Column, ws: Column) -> Column:
        left, right = (search_sorted(emitted, at - 1, LONGEST_READ) for at in (ws, ws + chunk))
        cut = lambda c, a, b: F.slice(c, a + 1, b - a)
        return let(
            F.struct(left.alias("a"), right.alias("b")),
            lambda x: F.struct(
                ws.alias("window_start"), x["a"].alias("left"), x["b"].alias("right"),
                F.array_join(cut(F.col("_q"), x["a"], x["b"]), "").alias("query"), cut(F.col("_r"), x["a"], x["b"]).alias("places"),
                F.slice("_sig", (F.col("signal_start") + ws + 1).cast("int"), F.lit(chunk)).alias("signal"),
            ),
        )

    windows = F.when(F.col("_why").isNull(), let(F.col("_moves.emitted"), lambda e: F.transform(starts, lambda ws: window(e, ws))))
    rows = rows.select("read_id", "contig", "is_reverse", F.col("_why").alias("reject_reason"), F.explode_outer(windows).alias("_w"))
    rows = rows.select("read_id", "contig", "is_reverse", "reject_reason", "_w.*").withColumn("window_end", F.col("window_start") + chunk)
    aligned = F.filter("places", lambda p: p >= 0)
    rows = rows.withColumn("_lo", F.array_min(aligned)).withColumn("ref_span", F.array_max(aligned) - F.col("_lo") + 1)
    rows = rows.withColumn("aligned_fraction", F.when(F.size("places") > 0, F.size(aligned) / F.size("places")))
    n = F.col("right") - F.col("left")
    own = F.col("window_start").isNull()
    rules = [
        ("zerolen_sequence", own | (n > 0)),
        ("low_aligned_fraction", own | (F.col("aligned_fraction") >= limits["chunk_aligned_fraction"])),
        ("short_reference", own | (F.col("ref_span") >= limits["min_reference"])),
        ("long_reference", own | (F.col("ref_span") <= F.ceil(F.lit(float(limits["span_factor"])) * n))),
    ]
    rows = rows.withColumn("reject_reason", first_reason(F.col("reject_reason"), rules))
    rows = rows.withColumn("ref_start", F.when(F.col("reject_reason").isNull(), F.col("_lo"))).drop("_lo")
    # what meets the reference: letters as text, places from the window's first one, and nothing of the windows rejected so far
    places = F.transform("places", lambda p: F.when(p >= 0, p - F.col("ref_start")).otherwise(-1).cast("int"))
    for name, value in (("signal", F.col("signal")), ("query", F.col("query")), ("places", places)):
        rows = rows.withColumn(name, F.when(F.col("reject_reason").isNull(), value))
    rows = with_reference(rows.withColumn("_end", F.col("ref_start") + F.col("ref_span")), bins, ["read_id", "window_start"], "ref_start", "_end", bin_size)
    measured = aligned_identity(bases(F.col("query")), F.col("places"), F.col("reference"), F.lit(0), F.col("is_reverse"))
    rows = rows.withColumn("identity", F.when(F.col("reject_reason").isNull(), measured["identity"]))
    oriented = F.when(F.col("is_reverse"), revcomp(F.upper("reference"))).otherwise(F.upper("reference"))
    rows = rows.withColumn("target_seq", F.reverse(oriented) if sample_type == "rna" else oriented)
    rules = [
        ("no_reference", own | (F.length("reference") == F.col("ref_span"))),
        ("n_in_reference", own | F.col("target_seq").rlike("^[ACGTU]*$")),
        ("low_base_identity", own | (F.col("identity") >= limits["chunk_identity"])),
        ("no_a", own | F.col("target_seq").contains("A")),
    ]
    if limits["max_target"] is not None:
        rules.append(("too_long", own | (F.col("ref_span") <= limits["max_target"])))
    rows = rows.withColumn("reject_reason", first_reason(F.col("reject_reason"), rules))
    kept = F.col("reject_reason").isNull()
    return rows.select(
        "read_id", "window_start", "window_end", "left", "right", "aligned_fraction", "ref_start", "ref_span", "identity", "reject_reason",
        F.when(kept, F.col("signal")).alias("signal"), F.when(kept, F.col("target_seq")).alias("target_seq"),
        F.when(kept, label_targets(encode_bases(F.col("target_seq")), mode)).alias("targets"),
    )


def counted(rows: DataFrame, reasons: Sequence[str] = (*RECORD_REASONS, *CHUNK_REASONS), reason: str = "reject_reason") -> tuple[DataFrame, Observation]:
    """``rows`` and the counters that whatever writes them fills in passing: one for each reason, ``written`` and ``seen``."""
    seen = Observation("chunk counters")
    counts = [F.count_if(F.col(reason) == r).alias(r) for r in reasons]
    return rows.observe(seen, *counts, F.count_if(F.col(reason).isNull()).alias("written"), F.count(F.lit(1)).alias("seen")), seen


def write_chunks_counted(rows: DataFrame, path: str) -> DataFrame:
    """Write the kept rows and return the counters ``counter, rows`` of all of them, from the same pass."""
    watched, seen = counted(rows)
    watched.where(F.col("reject_reason").isNull()).drop("reject_reason").write.parquet(path)
    found = seen.get
    return rows.sparkSession.createDataFrame([(k, int(v)) for k, v in found.items()], "counter string, rows long")
