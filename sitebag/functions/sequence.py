"""Sequence functions. All are built-in expressions; a base array is made once per row, so work is linear in length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Base tokens (0 is padding / unknown), complement pairs and motif patterns.
TOKENS = "ACGT"
DECODE = "NACGT"
COMPLEMENT_FROM = "ACGTUNacgtun"
COMPLEMENT_TO = "TGCAANTGCAAN"
MOTIFS = {
    "DRACH": "^[AGT][AG]AC[ACT]$",
    "RRACH": "^[AG][AG]AC[ACT]$",
}


def bases(seq: Column) -> Column:
    """One array element per base; empty for an empty sequence."""
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def normalize_seq(seq: Column, keep_u: bool = False) -> Column:
    """Trim, upper-case, drop blanks and dashes; U becomes T unless ``keep_u``."""
    text = F.translate(F.upper(F.trim(seq)), " -", "")
    return text if keep_u else F.translate(text, "U", "T")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def encode_bases(seq: Column) -> Column:
    """A, C, G, T/U -> 1..4; anything else -> 0."""
    return F.transform(
        bases(F.translate(F.upper(seq), "U", "T")), lambda b: F.instr(F.lit(TOKENS), b).cast("tinyint")
    )


def decode_bases(tokens: Column) -> Column:
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when((t >= 0) & (t < len(DECODE)), F.substring(F.lit(DECODE), t.cast("int") + 1, 1)).otherwise(
                F.lit("N")
            ),
        ),
        "",
    )


def _flank(k: int) -> int:
    if k <= 0 or k % 2 == 0:
        raise ValueError(f"k must be a positive odd number, got {k}")
    return k // 2


def centered_kmer(seq: Column, center: Column, k: int) -> Column:
    """k bases around ``center``; ``edge`` where a flank is missing."""
    flank = _flank(k)
    outside = (center < flank) | (center + flank >= F.length(seq))
    return F.when(outside, F.lit("edge")).otherwise(
        F.upper(F.substring(seq, center.cast("int") - flank + 1, F.lit(k)))
    )


def reference_kmer(window: Column, at: Column, k: int) -> Column:
    """k bases around 0-based ``at`` of a reference window; NULL when incomplete or holding N."""
    flank = _flank(k)
    part = F.upper(F.substring(window, at.cast("int") - flank + 1, F.lit(k)))
    return F.when((at >= flank) & (F.length(part) == k) & ~part.contains("N"), part)


def motif_class(seq: Column, center: Column) -> Column:
    """DRACH / non_DRACH / edge from the five bases around ``center``."""
    window = centered_kmer(seq, center, 5)
    return (
        F.when(window == "edge", F.lit("edge"))
        .when(window.rlike(MOTIFS["DRACH"]), F.lit("DRACH"))
        .otherwise(F.lit("non_DRACH"))
    )


def motif_match(kmer: Column, motif: str | None) -> Column:
    """Named motif or regular expression (search semantics); an empty motif accepts everything."""
    if not motif or not motif.strip():
        return F.lit(True)
    pattern = MOTIFS.get(motif.upper(), motif.upper())
    return F.coalesce(kmer.rlike(pattern), F.lit(False))


def nearest_base(base_array: Column, base: str = "A") -> Column:
    """0-based index of the ``base`` closest to the middle, first on ties; NULL when absent."""
    def closest(arr: Column) -> Column:
        middle = (F.size(arr) - 1) / F.lit(2.0)
        return F.array_min(
            F.transform(arr, lambda b, i: F.when(b == base, F.struct(F.abs(i - middle).alias("d"), i.alias("i"))))
        )["i"]

    return let(base_array, closest)


def target_to_reference(index: Column, length: Column, start: Column, end: Column, strand: Column, sample_type: str):
    """Reference coordinate of a target index; RNA targets run 3'->5', minus-strand mappings are mirrored."""
    oriented = (length - 1 - index) if sample_type == "rna" else index
    return F.when(strand == -1, end - 1 - oriented).otherwise(start + oriented)


def primary_site(
    seq: Column, contig: Column, start: Column, end: Column, strand: Column, sample_type: str = "rna", k: int = 5
) -> Column:
    """Struct (site_key, site_pos, kmer, motif) of the centre-most A; ``no_A``/-1 when the sequence has none."""
    def describe(at: Column) -> Column:
        pos = target_to_reference(at, F.length(seq), start, end, strand, sample_type)
        none = F.struct(
            F.lit("no_A").alias("site_key"),
            F.lit(-1).cast("bigint").alias("site_pos"),
            F.lit("no_A").alias("kmer"),
            F.lit("no_A").alias("motif"),
        )
        site = F.struct(
            F.concat_ws(":", contig, pos.cast("string"), strand.cast("string"), F.lit("A")).alias("site_key"),
            pos.cast("bigint").alias("site_pos"),
            centered_kmer(seq, at, k).alias("kmer"),
            motif_class(seq, at).alias("motif"),
        )
        return F.when(at.isNull(), none).otherwise(site)

    return let(nearest_base(bases(F.upper(seq))), describe)


def oligo_site(seq: Column, oligo_id: Column, at: Column, motif: Column, k: int = 5) -> Column:
    """Primary site of a labelled window, keyed by pattern id instead of by coordinate."""
    return F.struct(
        F.concat_ws(":", oligo_id, at.cast("string"), F.lit("1"), F.lit("A")).alias("site_key"),
        at.cast("bigint").alias("site_pos"),
        centered_kmer(seq, at, k).alias("kmer"),
        motif.alias("motif"),
    )


def signal_order(seq: Column, is_reverse: Column, sample_type: str = "rna") -> Column:
    """Bases in the order the signal was emitted."""
    text = F.translate(F.upper(seq), "U", "T")
    flip = ~is_reverse if sample_type == "rna" else is_reverse
    return F.when(flip, F.reverse(text)).otherwise(text)


def trim_context(seq: Column, pre: int, post: int) -> Column:
    """Drop ``pre`` leading and ``post`` trailing bases."""
    if pre <= 0 and post <= 0:
        return seq
    pre, post = max(pre, 0), max(post, 0)
    return F.substring(seq, F.lit(pre + 1), F.greatest(F.length(seq) - pre - post, F.lit(0)))


# Spellings of the modification token, longest first.
MARK = r"(?i)/m6a|\[m6a\]|\(m6a\)|m6a"


def parse_marked_seq(text: Column, center: Column | None = None) -> Column:
    """Struct (seq, center, error) of a sequence that may mark its modified base.

    A mark gives the centre, an explicit ``center`` must agree with it; without either the centre-most A is taken.
    ``error`` names the broken rule and is NULL for a usable row.
    """
    explicit = F.lit(None).cast("int") if center is None else center.cast("int")
    raw = F.regexp_replace(F.trim(text), " ", "")
    at = F.regexp_instr(raw, F.lit(MARK))
    marked = at > 0
    seq = normalize_seq(F.regexp_replace(raw, MARK, "A"))
    implied = F.length(normalize_seq(F.substring(raw, F.lit(1), at - 1)))
    found = F.when(marked, implied).otherwise(F.coalesce(explicit, nearest_base(bases(seq))))
    error = (
        F.when(marked & explicit.isNotNull() & (explicit != implied), F.lit("center_disagrees_with_mark"))
        .when(found.isNull(), F.lit("no_A"))
        .when((found < 0) | (found >= F.length(seq)), F.lit("center_outside_sequence"))
        .when(F.substring(seq, found + 1, F.lit(1)) != "A", F.lit("center_not_A"))
    )
    return F.struct(seq.alias("seq"), found.cast("int").alias("center"), error.alias("error"))


def base_positions(seq: Column, base: str) -> Column:
    """0-based positions of ``base`` (U counts as T)."""
    arr = bases(F.translate(F.upper(seq), "U", "T"))
    return F.filter(F.transform(arr, lambda b, i: F.when(b == base.upper(), i)), lambda x: x.isNotNull())


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"F", "Column", "annotations", "let"}]
