"""Joins between reads, signals, windows, patterns and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import indices, let, total
from ..functions.sequence import bases
from ..ordering import attach


def attach_signal(
    reads: DataFrame, signals: DataFrame, min_length: int = 1, read_id: str = "read_id", parent: str = "pi"
) -> DataFrame:
    """Slice ``[sp+ts, sp+ns)`` of each read's signal; the signal id is the parent id where there is one.

    An inner equi-join, so only signals that some read needs are moved. ``reject_reason`` marks invalid or short
    intervals; their signal is NULL.
    """
    key = F.coalesce(F.col(parent), F.col(read_id))
    keyed = reads.withColumn("_sid", key)
    right = signals.select(F.col("signal_id").alias("_sid"), F.col("signal").alias("_sig"))
    start, end = F.coalesce("sp", F.lit(0)) + F.col("ts"), F.coalesce("sp", F.lit(0)) + F.col("ns")
    joined = keyed.join(right, "_sid").withColumn("signal_start", start).withColumn("signal_end", end)
    reason = F.when(
        (F.col("signal_start") < 0) | (F.col("signal_end") <= F.col("signal_start")) | (F.col("signal_end") > F.size("_sig")),
        F.lit("invalid_interval"),
    ).when(F.col("signal_end") - F.col("signal_start") < min_length, F.lit("signal_too_short"))
    out = joined.withColumn("reject_reason", reason)
    cut = F.slice("_sig", (F.col("signal_start") + 1).cast("int"), (F.col("signal_end") - F.col("signal_start")).cast("int"))
    return out.withColumn("signal", F.when(F.col("reject_reason").isNull(), cut)).drop("_sid", "_sig")


def _window_number(position: Column, first: Column, chunk: int, stride: int, last: Column) -> Column:
    """Array of the numbers of the regular windows ``[first + k*stride, .. + chunk)`` that hold ``position``."""
    low = F.greatest(F.ceil((position - first - chunk + 1) / F.lit(float(stride))), F.lit(0)).cast("int")
    high = F.least(F.floor((position - first) / F.lit(float(stride))), last).cast("int")
    return F.when((position >= first) & (high >= low), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def regular_windows(length: Column, chunk: int, overlap: int) -> tuple[Column, Column]:
    """(first offset, last window number) of windows anchored at the end of a signal; last is -1 when it is too short."""
    if not 0 <= overlap < chunk:
        raise ValueError("overlap must be in [0, chunk)")
    stride = chunk - overlap
    room = length - chunk
    first = F.when(room >= 0, F.pmod(room, F.lit(stride))).otherwise(0)
    last = F.when(room >= 0, F.floor((room - first) / F.lit(float(stride)))).otherwise(-1)
    return first.cast("int"), last.cast("int")


def windows_of_points(points: DataFrame, length: str, position: str, chunk: int, overlap: int) -> DataFrame:
    """One row per (point, window that holds it); the range predicate becomes arithmetic, so no range join runs."""
    stride = chunk - overlap
    first, last = regular_windows(F.col(length), chunk, overlap)
    numbers = _window_number(F.col(position), first, chunk, stride, last)
    out = points.withColumn("_k", F.explode(numbers))
    start = first + F.col("_k") * stride
    return out.withColumn("window_start", start).withColumn("window_end", start + chunk).drop("_k")


def bases_in_windows(
    reads: DataFrame, chunk: int, overlap: int, read_id: str = "read_id", emitted: str = "emitted", length: str = "signal_length"
) -> DataFrame:
    """Per window the half-open range [left, right) of bases whose emitted position lies inside it.

    ``emitted`` is ascending. Each base adds itself to its windows by arithmetic and the counts combine map-side:
    right - left is the number of bases inside, left the smallest index. Windows without bases are not listed.
    """
    points = reads.select(read_id, length, F.posexplode(emitted).alias("_i", "_pos"))
    placed = windows_of_points(points, length, "_pos", chunk, overlap)
    return placed.groupBy(read_id, "window_start", "window_end").agg(
        F.min("_i").alias("left"), (F.max("_i") + 1).alias("right")
    )


def assign_best_window(units: DataFrame, chunk: int, overlap: int, length: str = "signal_length", position: str = "center_signal") -> DataFrame:
    """Give each unit the containing window with the largest margin min(x-start, end-x), the first on ties.

    The margin falls on both sides of the window whose centre is nearest, so that window's number, held to those that contain the
    unit, is the choice: arithmetic on the unit's own row, without a list of its windows, a join or a shuffle.
    """
    stride = chunk - overlap
    first, last = regular_windows(F.col(length), chunk, overlap)
    rows = units.withColumn("_first", first).withColumn("_last", last)
    off = F.col(position) - F.col("_first")
    low = F.greatest(F.ceil((off - chunk + 1) / F.lit(float(stride))), F.lit(0)).cast("int")
    high = F.least(F.floor(off / F.lit(float(stride))), F.col("_last")).cast("int")
    nearest = F.ceil((2 * off - chunk - stride) / F.lit(2.0 * stride)).cast("int")
    rows = rows.withColumn("_low", low).withColumn("_high", high).where((F.col(position) >= F.col("_first")) & (F.col("_high") >= F.col("_low")))
    start = F.col("_first") + F.least(F.greatest(nearest, F.col("_low")), F.col("_high")) * stride
    rows = rows.withColumn("window_start", start).withColumn("window_end", F.col("window_start") + chunk)
    return rows.drop("_first", "_last", "_low", "_high")


SEGMENT = 1024
CUT = 16


def segments(reads: DataFrame, pad: Column, read_id: str = "read_id", seq: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """Reads cut into pieces of 1024 bases plus ``pad`` bases on both sides: (read, seg_start, seg_from, piece).

    Positions of a piece are then found inside a short string, so scanning stays linear for very long reads.
    """
    cuts = F.transform(indices(F.ceil(F.length("_seq") / F.lit(float(SEGMENT)))), lambda k: (k * SEGMENT).cast("int"))
    rows = reads.select(F.col(read_id), F.col(seq).alias("_seq"), F.length(seq).alias("read_length"), *keep)
    rows = rows.select(read_id, "read_length", "_seq", *keep, F.explode(cuts).alias("seg_start"))
    low = F.greatest(F.col("seg_start") - pad, F.lit(0))
    return rows.select(
        read_id, "read_length", "seg_start", low.alias("seg_from"), *keep,
        F.substring("_seq", low + 1, F.col("seg_start") + SEGMENT + pad - low).alias("piece"),
    )


SEED_SLOTS = 1 << 16  # bits of the filter over seed k-mers, whatever the number of patterns


def _slot(kmer: Column) -> Column:
    return F.pmod(F.xxhash64(kmer), F.lit(SEED_SLOTS)).cast("int")


def _seed_facts(seeds: DataFrame) -> DataFrame:
    """One row: the longest pattern, the lengths of seeds, and a bitmap of the slots of their k-mers."""
    facts = seeds.agg(F.max(F.length("pattern")).alias("_longest"), F.sort_array(F.collect_set("_len")).alias("_lens"))
    bits = seeds.select(_slot(F.col("_kmer")).alias("_s")).selectExpr("shiftright(_s, 6) as _w", "shiftleft(1L, _s & 63) as _bit")
    words = bits.groupBy("_w").agg(F.bit_or("_bit").alias("_bit")).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bit"))).alias("_m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(SEED_SLOTS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0).cast("bigint")))
    return attach(facts, words.select(whole.alias("_bits")), [])


def pattern_hits(
    reads: DataFrame,
    patterns: DataFrame,
    max_mismatches: int = 0,
    min_identity: float = 0.0,
    both_orientations: bool = False,
    read_id: str = "read_id",
    seq: str = "seq",
) -> DataFrame:
    """Every placement of a pattern on a read with few enough mismatches.

    Pigeonhole seeds: with m mismatches allowed, of m+1 disjoint blocks of a pattern at least one matches exactly
    (m is what max_mismatches and min_identity leave for the pattern's length). The k-mers of a piece of a read are tested
    against a bitmap of fixed size over the seeds' k-mers before anything is exploded; the few that pass become rows, each with the
    bases around it, and meet the pattern blocks in an equi-join on (length, k-mer). Only such candidates are compared
    base by base. No read x pattern x start product is formed and no hit is lost. A placement that several blocks find is
    kept for the first of them alone.

    ``patterns`` has pattern_id, pattern, center. How the lists are joined is left to the optimiser, by their measured sizes;
    nothing is collected while the plan is built.
    """
    both = patterns.select("pattern_id", "pattern", "center", F.lit("+").alias("orientation"))
    if both_orientations:
        both = both.unionByName(
            patterns.select(
                "pattern_id",
                F.reverse("pattern").alias("pattern"),
                (F.length("pattern") - 1 - F.col("center")).cast("int").alias("center"),
                F.lit("-").alias("orientation"),
            )
        )
    size = F.length("pattern")
    allowed = F.filter(
        F.sequence(F.lit(0), F.lit(max_mismatches)), lambda m: F.lit(1.0) - m / size >= F.lit(float(min_identity))
    )
    both = both.where(size > 0).withColumn("_parts", F.size(allowed)).where("_parts > 0")

    def edge(b: Column) -> Column:
        return F.floor(size * b / F.col("_parts").cast("double")).cast("int")

    blocks = F.transform(
        indices(F.col("_parts")),
        lambda b: F.struct(
            b.alias("block"), edge(b).alias("at"), (edge(b + 1) - edge(b)).alias("len"),
            F.substring("pattern", edge(b) + 1, edge(b + 1) - edge(b)).alias("kmer"),
        ),
    )
    seeds = both.withColumn("_blocks", F.filter(blocks, lambda x: x["len"] > 0)).withColumn("_b", F.explode("_blocks"))
    seeds = seeds.select(
        "pattern_id", "pattern", "center", "orientation", "_blocks", F.col("_b.block").alias("_block"), F.col("_b.at").alias("_at"),
        F.col("_b.len").alias("_len"), F.col("_b.kmer").alias("_kmer"),
    )
    facts = _seed_facts(seeds)
    pieces = segments(attach(reads.select(read_id, seq), facts.select("_longest"), []), F.col("_longest"), read_id, seq, ["_longest"])
    pieces = attach(pieces, facts.select("_lens", "_bits"), [])
    # a letter of a string is found by counting from its beginning, so k-mers are cut from parts of CUT letters with their surroundings
    at = F.col("seg_start") - F.col("seg_from") + F.col("_cut") * CUT
    before = F.least(at, F.col("_longest"))
    own = F.least(F.lit(SEGMENT), F.col("read_length") - F.col("seg_start"))
    parts = pieces.withColumn("_own", own).withColumn("_cut", F.explode(indices(F.ceil(F.col("_own") / F.lit(float(CUT))))))
    parts = parts.select(
        read_id, "read_length", "_longest", "_lens", "_bits", (F.col("seg_from") + at).alias("_from"), before.alias("_lead"),
        F.least(F.lit(CUT), F.col("_own") - F.col("_cut") * CUT).alias("_size"),
        F.substring("piece", at - before + 1, before + CUT + F.col("_longest")).alias("_part"),
    )
    # plain explodes: Spark fuses them with the test, and only places that pass become rows
    tested = parts.withColumn("_len", F.explode("_lens")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)))
    tested = tested.withColumn("_kmer", F.substring("_part", F.col("_lead") + F.col("_r") + 1, F.col("_len")))
    slot = _slot(F.col("_kmer"))
    seen = tested.where(F.getbit(F.get("_bits", F.shiftright(slot, 6)), slot.bitwiseAND(63)) == 1)
    back = F.least(F.col("_lead") + F.col("_r"), F.col("_longest"))
    kmers = seen.select(
        read_id, "read_length", (F.col("_from") + F.col("_r")).alias("_pos"), back.alias("_before"),
        F.substring("_part", F.col("_lead") + F.col("_r") - back + 1, back + F.col("_longest")).alias("_context"), "_len", "_kmer",
    )
    joined = kmers.join(seeds, ["_len", "_kmer"])
    joined = joined.withColumn("start", F.col("_pos") - F.col("_at"))
    joined = joined.where((F.col("start") >= 0) & (F.col("start") + size <= F.col("read_length")))
    joined = joined.withColumn("_window", F.substring("_context", F.col("_before") - F.col("_at") + 1, size))
    earlier = (F.col("_block") > 0) & F.exists(
        "_blocks",
        lambda x: (x["block"] < F.col("_block")) & (F.substring("_window", x["at"] + 1, x["len"]) == x["kmer"]),
    )
    differing = total(F.zip_with(bases(F.col("_window")), bases(F.col("pattern")), lambda a, b: (a != b).cast("int"))).cast("int")
    mism = F.when(F.col("_len") == size, F.lit(0)).otherwise(differing)  # a seed as long as its pattern is all of it
    hits = joined.where(~earlier).withColumn("mismatches", mism)
    hits = hits.withColumn("identity", 1.0 - F.col("mismatches") / size)
    return hits.where((F.col("mismatches") <= max_mismatches) & (F.col("identity") >= min_identity)).select(
        read_id, "pattern_id", "orientation", "start", (F.col("start") + size).alias("end"),
        (F.col("start") + F.col("center")).alias("center_index"), "mismatches", "identity",
    )


def select_non_overlapping(hits: DataFrame, read_id: str = "read_id") -> DataFrame:
    """Greedy choice per read by (identity desc, mismatches, start, pattern id), skipping overlaps; ordered by start.

    Hits of different runs of overlapping hits never compete, so each run is decided on its own: the sequential
    fold works on one run, and a read with very many hits does not form one long list.
    """
    w = Window.partitionBy(read_id).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    entry = F.struct(
        (-F.col("identity")).alias("neg_identity"), F.col("mismatches"), F.col("start"), F.col("pattern_id"),
        F.col("orientation"), F.col("end"), F.col("center_index"),
    )
    per_run = marked.groupBy(read_id, "_run").agg(F.sort_array(F.collect_list(entry)).alias("_c"))
    kept = F.aggregate(
        "_c",
        F.slice("_c", 1, 0),
        lambda acc, c: F.when(
            F.exists(acc, lambda o: (c["start"] < o["end"]) & (c["end"] > o["start"])), acc
        ).otherwise(F.concat(acc, F.array(c))),
    )
    return per_run.select(read_id, F.explode(kept).alias("_u")).select(
        read_id, "_u.pattern_id", "_u.orientation", "_u.start", "_u.end", "_u.center_index", "_u.mismatches",
        (-F.col("_u.neg_identity")).alias("identity"),
    )


def find_patterns(reads: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    """:func:`pattern_hits` followed by :func:`select_non_overlapping`."""
    return select_non_overlapping(pattern_hits(reads, patterns, **options), options.get("read_id", "read_id"))


def _level(lo: Column, hi: Column, bin_size: int) -> Column:
    """The level whose bins, ``bin_size * 2**level`` wide, are at least as wide as the interval, so that it lies in two at most."""
    return F.greatest(F.ceil(F.log2((hi - lo) / F.lit(float(bin_size)))), F.lit(0)).cast("int")


def _binned(lo: Column, hi: Column, levels: Column, bin_size: int) -> Column:
    """array<struct<_level, _bin>>: the bins of the interval at each of the levels."""
    def at(level: Column) -> Column:
        wide = F.pow(F.lit(2.0), level) * bin_size
        numbers = F.sequence(F.floor(lo / wide), F.floor((hi - 1) / wide))
        return F.transform(numbers, lambda b: F.struct(level.alias("_level"), b.alias("_bin")))

    return F.flatten(F.transform(levels, at))


def anti_overlap(
    windows: DataFrame, intervals: DataFrame, pad: int = 0, bin_size: int = 1024,
    read_id: str = "read_id", start: str = "left", end: str = "right",
) -> DataFrame:
    """Windows [start, end) that touch no interval of their read padded by ``pad``; empty windows are left out.

    A window is touched when, of the zones that begin before its end, the one that reaches farthest ends after its start. So
    zones, placed at their start, and windows, placed at their end, are sorted together along the read, and one running maximum
    decides: a single shuffle of both, each row once, however long zones or windows are. The window function runs per read,
    over a list bounded by the read's length. No bins are needed; ``bin_size`` stays for callers that give it.
    """
    zones = intervals.select(
        F.col(read_id), F.greatest(F.col("start") - pad, F.lit(0)).cast("bigint").alias("_at"), (F.col("end") + pad).cast("bigint").alias("_reach")
    ).where(F.col(read_id).isNotNull() & (F.col("_reach") > F.col("_at")))
    filled = windows.where(F.col(end) > F.col(start)).withColumn("_at", F.col(end).cast("bigint"))
    rows = filled.withColumn("_zone", F.lit(0)).unionByName(zones.withColumn("_zone", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy(read_id).orderBy("_at", "_zone").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("_farthest", F.max("_reach").over(before)).where("_zone = 0")
    return swept.where(F.col("_farthest").isNull() | (F.col("_farthest") <= F.col(start))).select(*windows.columns)


def with_candidate_base(windows: DataFrame, seq: str = "target_seq", base: str = "A", motifs: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Windows that hold ``base``, or a ``base`` whose k-mer is in ``motifs``."""
    from ..functions.sequence import centered_kmer

    if motifs is None:
        return windows.where(F.col(seq).contains(base))
    listed = F.array(*[F.lit(m) for m in motifs])
    hit = F.exists(
        indices(F.length(seq)),
        lambda i: (F.substring(seq, i + 1, F.lit(1)) == base) & F.array_contains(listed, centered_kmer(F.col(seq), i, k)),
    )
    return windows.where(hit)


def common_strata(df: DataFrame, source: str, strata: Sequence[str]) -> DataFrame:
    """Strata present in every source: one distinct-count per stratum instead of a join per source."""
    present = df.select(source, *strata).distinct()
    n_sources = present.select(source).distinct().agg(F.count(F.lit(1)).alias("n"))
    counts = present.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") == n_sources.scalar()).drop("_n")


def in_common_strata(df: DataFrame, source: str, strata: Sequence[str]) -> DataFrame:
    """Rows of the strata that every source has."""
    return df.join(common_strata(df, source, strata), list(strata), "left_semi")


def join_manifests(reads: DataFrame, runs: DataFrame, oligos: DataFrame, run: str = "run_id", ids: str = "oligo_ids") -> DataFrame:
    """Reads -> run row -> listed oligos. Ids without an oligo row stop the query, whichever columns are used of it."""
    listed = runs.withColumn("oligo_id", F.explode(ids))
    known = listed.join(oligos.withColumn("_known", F.lit(True)), "oligo_id", "left")
    defined = F.when(F.col("_known"), F.col("oligo_id")).otherwise(
        F.raise_error(F.concat(F.lit("oligo not in manifest: "), F.col("oligo_id")))
    )
    checked = known.withColumn("_id", defined).where("_id IS NOT NULL")  # a filter on the rows is never pruned
    return reads.join(checked.drop("_known", "_id"), run)


def undefined_oligos(runs: DataFrame, oligos: DataFrame, ids: str = "oligo_ids") -> DataFrame:
    """(run_id, oligo_id) pairs whose oligo is not defined; must be empty before :func:`join_manifests`."""
    return runs.select("run_id", F.explode(ids).alias("oligo_id")).join(oligos.select("oligo_id"), "oligo_id", "left_anti")


def merge_sources(sources: dict[str, DataFrame], text_fill: str = "", column: str = "source_dataset") -> DataFrame:
    """Stack sources with differing columns; strings a source lacks become ``text_fill``, other columns NULL."""
    out = None
    types: dict[str, str] = {}
    for name, df in sources.items():
        types.update(dict(df.dtypes))
        part = df.withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    texts = [c for c, t in types.items() if t == "string"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(text_fill)) for c in texts})


def pad_array(arr: Column, width: int, fill) -> Column:
    """Right-pad to a fixed width (0 for references, -100 for targets)."""
    missing = F.greatest(F.lit(width) - F.size(arr), F.lit(0))
    return F.concat(arr, F.array_repeat(F.lit(fill), missing))


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order`` with the number of dropped duplicates.

    One partial aggregate: each task keeps one row per key, so a hot key sends one row per task. The kept row is a struct,
    which Spark aggregates by sorting the keys of a task (SortAggregate), not by hashing.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    out = df.groupBy(*key).agg(best.alias("_r"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return out.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest], "duplicates")
