"""Site-level aggregation of per-read calls and the joins with trusted sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordering import attach, quantiles
from ..session import staged
from . import metrics as M

SITE = ("contig", "pos", "strand")
SCORES = ("mod_fraction", "mean_prob_zero_filled", "mean_called_prob", "median_called_prob")


def site_stats(
    calls: DataFrame,
    keys: Sequence[str] = SITE,
    prob: str = "prob",
    score: str = "mean_prob_zero_filled",
    threshold: float = 0.5,
    median: str | None = None,
    exact_sum: float | None = None,
) -> DataFrame:
    """Coverage, called fraction and mean probabilities per site, with a chosen score and its prediction.

    Counts and sums are map-side combined, so a site holding a large share of all rows costs one partial row per
    task. ``exact_sum=u`` sums ``round(prob/u)`` as integers for probabilities stored on a grid of step ``u`` (e.g.
    1/255), which makes the sum independent of row order. The median is computed only when selected: on a grid the calls
    are counted per (site, level) by a plain hash aggregate first, so the median sees at most 1/u + 1 counts of a site;
    otherwise ``exact`` ranks value counts in bounded buckets and ``approx`` uses the sketch.
    """
    if score not in SCORES:
        raise ValueError(f"unknown score {score!r}")
    if score == "median_called_prob" and median is None:
        median = "exact"
    p = F.col(prob)
    on_grid = median == "exact" and exact_sum
    if on_grid:
        levels = calls.groupBy(*keys, F.round(p / exact_sum).cast("bigint").alias("_level")).agg(F.count(F.lit(1)).alias("_rows"))
        level, rows = F.col("_level"), F.col("_rows")
        called = F.when(level.isNotNull(), rows).otherwise(0)
        out = levels.groupBy(*keys).agg(
            F.sum(rows).alias("coverage"),
            F.sum(called).alias("num_mod_calls"),
            (F.sum(level * rows) * F.lit(float(exact_sum))).alias("_sum"),
            (F.percentile(level, 0.5, rows) * F.lit(float(exact_sum))).alias("median_called_prob"),
        )
    elif exact_sum:
        called_sum = F.sum(F.round(p / exact_sum).cast("bigint")) * F.lit(float(exact_sum))
    else:
        called_sum = F.sum(p)
    if not on_grid:
        out = calls.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("coverage"), F.count(p).alias("num_mod_calls"), called_sum.alias("_sum")
        )
    out = out.select(
        *keys,
        "coverage",
        "num_mod_calls",
        (F.col("num_mod_calls") / F.col("coverage")).alias("mod_fraction"),
        (F.coalesce(F.col("_sum"), F.lit(0.0)) / F.col("coverage")).alias("mean_prob_zero_filled"),
        F.when(F.col("num_mod_calls") > 0, F.col("_sum") / F.col("num_mod_calls")).alias("mean_called_prob"),
        *(["median_called_prob"] if on_grid else []),
    )
    if median and not on_grid:
        middle = quantiles(calls, prob, {"median_called_prob": 0.5}, keys, approx=median == "approx")
        out = attach(out, middle, keys, "left")
    out = out.withColumn("score", F.coalesce(F.col(score), F.lit(0.0)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def site_sums(calls: DataFrame, keys: Sequence[str] = SITE, prob: str = "prob", exact_sum: float | None = None) -> DataFrame:
    """Coverage, called rows and summed probability of each site: sums that can be added up further."""
    level = F.round(F.col(prob) / exact_sum).cast("bigint") if exact_sum else F.col(prob)
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("coverage"), F.count(prob).alias("num_mod_calls"), F.sum(level).alias("_level_sum"))


def scores_of_sums(sums: DataFrame, score: str = "mean_prob_zero_filled", exact_sum: float | None = None, keys: Sequence[str] = SITE) -> DataFrame:
    """``keys, coverage, score`` of :func:`site_sums`, added up over ``keys``; any score but the median."""
    sums = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("coverage", "num_mod_calls", "_level_sum")])
    total = F.col("_level_sum") * F.lit(float(exact_sum)) if exact_sum else F.col("_level_sum")
    values = {
        "mod_fraction": F.col("num_mod_calls") / F.col("coverage"),
        "mean_prob_zero_filled": F.coalesce(total, F.lit(0.0)) / F.col("coverage"),
        "mean_called_prob": F.when(F.col("num_mod_calls") > 0, total / F.col("num_mod_calls")),
    }
    return sums.select(*keys, "coverage", F.coalesce(values[score], F.lit(0.0)).alias("score"))


def project_calls(
    records: DataFrame,
    base: str = "A",
    code: str = "a",
    oriented: bool = False,
    motif: str | None = None,
    bins: DataFrame | None = None,
    k: int = 5,
    bin_size: int = 10000,
) -> DataFrame:
    """Alignment records -> one row ``read_id, contig, pos, strand, prob`` per aligned candidate base; prob NULL = not called.

    ``records`` has read_id, flag, contig, pos0, cigar, seq and the tag map. Unmapped, secondary and supplementary records
    and those without sequence are left out. A candidate is a stored base equal to ``base``; calls are walked along the
    stored sequence. With ``oriented`` reverse records are read as they were sequenced: the complement is the candidate
    and the walk starts at the other end. ``motif`` keeps sites whose reference k-mer (from ``bins`` of ``bin_size``) matches.

    Calls are laid out along the read once, so a read costs its length, whatever the number of calls; only candidates become rows.
    """
    from ..functions.alignment import calls_by_place, decode_mod_tags, query_to_ref
    from ..functions.sequence import bases, motif_match
    from ..sources.sam import tag_ints
    from .qc import FLAG_REVERSE, FLAG_SECONDARY, FLAG_SUPPLEMENTARY, FLAG_UNMAPPED

    usable = F.col("flag").bitwiseAND(FLAG_UNMAPPED | FLAG_SECONDARY | FLAG_SUPPLEMENTARY) == 0
    rows = records.where(usable & F.col("contig").isNotNull() & F.col("seq").isNotNull())
    reverse = F.col("flag").bitwiseAND(FLAG_REVERSE) != 0
    other = dict(zip("ACGT", "TGCA"))[base]
    wanted = F.when(reverse, F.lit(other)).otherwise(F.lit(base)) if oriented else F.lit(base)
    called = decode_mod_tags(F.col("seq"), F.col("tags")["MM"], tag_ints(F.col("tags"), "ML"), base, code, reverse if oriented else None)
    letters = bases(F.translate(F.upper("seq"), "U", "T"))
    rows = rows.select(
        "read_id",
        "contig",
        F.when(reverse, F.lit("-")).otherwise(F.lit("+")).alias("strand"),
        wanted.alias("_wanted"),
        F.arrays_zip(letters.alias("b"), query_to_ref(F.col("cigar"), F.col("pos0")).alias("r"), calls_by_place(called).alias("p")).alias("_bases"),
    )
    candidates = F.filter("_bases", lambda x: (x["b"] == F.col("_wanted")) & (x["r"] >= 0))
    rows = rows.select("read_id", "contig", "strand", F.explode(candidates).alias("_c"))
    out = rows.select("read_id", "contig", F.col("_c.r").alias("pos"), "strand", F.col("_c.p").alias("prob"))
    if motif is None:
        return out
    if bins is None:
        raise ValueError("a motif needs reference bins")
    sites = out.select("contig", "pos", "strand").distinct()
    fit = site_context(sites, bins, k, None, bin_size=bin_size).where(motif_match(F.col("kmer"), motif))
    return out.join(fit.select("contig", "pos", "strand"), ["contig", "pos", "strand"], "left_semi")


def collapse_strand(calls: DataFrame, strand: str = "strand") -> DataFrame:
    """Put both strands on ``.`` before aggregating."""
    return calls.withColumn(strand, F.lit("."))


def min_coverage(sites: DataFrame, n: int, coverage: str = "coverage") -> DataFrame:
    return sites.where(F.col(coverage) >= n)


def label_sites(
    sites: DataFrame, gold: DataFrame, keys: Sequence[str] = SITE, info: Sequence[str] = ("name", "support")
) -> DataFrame:
    """All sites plus ``is_gold`` and the gold columns.

    A left equi-join: the optimiser broadcasts the gold list when its measured size is below the session's limit
    and sort-merges (with AQE skew splitting) beyond it.
    """
    tagged = gold.select(*keys, *[F.col(c).alias(f"gold_{c}") for c in info], F.lit(1).alias("is_gold"))
    return sites.join(tagged, list(keys), "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(0)))


def coverage_counts(sites: DataFrame, gold: DataFrame, floor: int, keys: Sequence[str] = SITE) -> DataFrame:
    """Gold sites in total, covered before and after the coverage floor, and never covered: one row."""
    covered = sites.select(*keys, F.col("coverage"))
    joined = gold.select(*keys).distinct().join(covered, list(keys), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("gold_total"),
        F.count("coverage").alias("covered"),
        F.count_if(F.col("coverage") >= floor).alias("covered_after_filter"),
        F.count_if(F.col("coverage").isNull()).alias("uncovered"),
    )


def gold_overlap(sites: DataFrame, gold: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Distinct keys in both (``shared``), in gold only and in the sites only: one aggregate by key over a tagged union."""
    tagged = sites.select(*keys, F.lit(True).alias("_site")).unionByName(gold.select(*keys, F.lit(False).alias("_site")))
    seen = tagged.groupBy(*keys).agg(F.bool_or("_site").alias("_a"), F.bool_or(~F.col("_site")).alias("_b"))
    counts = seen.agg(
        F.count_if(F.col("_a") & F.col("_b")).alias("shared"),
        F.count_if(~F.col("_a")).alias("gold_only"),
        F.count_if(~F.col("_b")).alias("sites_only"),
    )
    kinds = F.array(*[F.struct(F.col(k).alias("sites"), F.lit(k).alias("kind")) for k in ("shared", "gold_only", "sites_only")])
    return counts.select(F.inline(kinds))


CONVENTIONS = ("as_is", "flip", "ignore", "either")


def _strands(convention: Column, strand: Column) -> Column:
    known = strand.isin("+", "-")
    return (
        F.when(convention == "ignore", F.array(F.lit(".")))
        .when(convention == "either", F.array(F.lit("+"), F.lit("-")))
        .when(~known, F.array(F.lit(".")))
        .when(convention == "flip", F.array(F.when(strand == "+", F.lit("-")).otherwise(F.lit("+"))))
        .otherwise(F.array(strand))
    )


def convention_grid(gold: DataFrame, shifts: Sequence[int], conventions: Sequence[str] = CONVENTIONS) -> DataFrame:
    """Gold sites moved by every shift under every strand convention; starts below 0 vanish, collisions collapse."""
    grid = F.array(
        *[F.struct(F.lit(c).alias("convention"), F.lit(int(s)).alias("shift")) for c in conventions for s in shifts]
    )
    moved = gold.select("contig", "pos", "strand", F.explode(grid).alias("_g")).select(
        F.col("_g.convention").alias("convention"),
        F.col("_g.shift").alias("shift"),
        "contig",
        (F.col("pos") + F.col("_g.shift")).alias("pos"),
        F.explode(_strands(F.col("_g.convention"), F.col("strand"))).alias("strand"),
    )
    return moved.where(F.col("pos") >= 0).distinct()


def convention_sweep(
    calls: DataFrame,
    gold: DataFrame,
    shifts: Sequence[int],
    conventions: Sequence[str] = CONVENTIONS,
    floor: int = 1,
    threshold: float = 0.5,
    top_ns: Sequence[int] = (100, 500, 1000),
    **stats,
) -> DataFrame:
    """Metrics of every (convention, shift) in one job, best first by (roc, average precision, largest top-n, gold).

    Raw calls are aggregated once; the view without strands adds those sums up. A site is positive for the few combinations its
    key matches, all others are its negatives. So each view is counted by score and cumulated once, whatever the number of
    combinations, and a combination's matched scores look up how many sites lie at or above them: areas and
    counts follow from these numbers and the matched ones alone. (A median does not add up; there the calls are aggregated
    for each view.)
    """
    if stats.get("score") == "median_called_prob":
        both = site_stats(calls, **stats).select(*SITE, "coverage", "score")
        flat = site_stats(collapse_strand(calls), **stats).select(*SITE, "coverage", "score")
    else:
        exact, score = stats.get("exact_sum"), stats.get("score", "mean_prob_zero_filled")
        sums = staged(site_sums(calls, SITE, stats.get("prob", "prob"), exact), "sums")
        both, flat = scores_of_sums(sums, score, exact), scores_of_sums(collapse_strand(sums), score, exact)
    sites = both.withColumn("view", F.lit("strand")).unionByName(flat.withColumn("view", F.lit("flat")))
    sites = staged(sites, "sites")  # one row per site: matched, counted and ranked below
    moved = convention_grid(gold, shifts, conventions).withColumn(
        "view", F.when(F.col("convention") == "ignore", F.lit("flat")).otherwise(F.lit("strand"))
    )
    hits = moved.join(sites, ["view", *SITE], "left")
    combo = ["convention", "shift"]
    totals = hits.groupBy(*combo, "view").agg(
        F.count(F.lit(1)).alias("gold_sites"), F.count("coverage").alias("covered_before_filter")
    )
    kept = sites.where(F.col("coverage") >= floor)
    counts = kept.groupBy("view", "score").agg(F.count(F.lit(1)).alias("n"))
    above = M.cumulate(counts.withColumn("p", F.lit(0).cast("bigint")), ["view"])
    above = above.select("view", "score", F.col("n").alias("_at"), F.col("fp").alias("_above"))
    per_view = kept.groupBy("view").agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("score") >= threshold).alias("_called"))
    matched = hits.where(F.col("coverage") >= floor).groupBy(*combo, "view", "score").agg(F.count(F.lit(1)).alias("p"))
    matched = M.cumulate(matched.withColumn("n", F.lit(0).cast("bigint")), [*combo, "view"])
    matched = matched.select(*combo, "view", "score", "p", "tp", "positives").join(above, ["view", "score"]).join(per_view, "view")
    p, tp = F.col("p"), F.col("tp")
    negatives = F.col("_all") - F.col("positives")
    below = negatives - (F.col("_above") - tp)
    areas = matched.groupBy(*combo).agg(
        F.sum(p).alias("_p"),
        F.sum(F.when(F.col("score") >= threshold, p).otherwise(0)).alias("_tp"),
        F.sum(M.wide(p) * M.wide(2 * below + F.col("_at") - p)).alias("_area"),
        F.sum(p * (tp / F.col("_above"))).alias("_ap"),
    )
    scored = totals.join(per_view, "view", "left").join(areas, combo, "left")
    known = F.col("_all").isNotNull()
    zero = lambda c: F.when(known, F.coalesce(F.col(c), F.lit(0)))
    scored = scored.select(
        *combo, "gold_sites", "covered_before_filter", "_area", "_ap", zero("_tp").alias("tp"), (F.col("_called") - zero("_tp")).alias("fp"),
        zero("_p").alias("evaluated_gold_sites"), (F.col("_all") - zero("_p")).alias("evaluated_negative_sites"),
    )
    pos, neg = F.col("evaluated_gold_sites").cast("double"), F.col("evaluated_negative_sites").cast("double")
    scored = scored.withColumn("roc_auc", F.when((pos > 0) & (neg > 0), F.col("_area").cast("double") / (2.0 * pos * neg)))
    scored = scored.withColumn("average_precision", F.when((pos > 0) & (neg > 0), F.col("_ap") / pos))
    # the ranking of sites does not depend on the combination, so one top-k per strand view serves all of them
    order = [F.col("score").desc(), *[F.col(k) for k in SITE]]
    best = None
    for view in ("strand", "flat"):
        part = kept.where(F.col("view") == view).orderBy(*order).limit(max(top_ns))
        part = part.withColumn("_rn", F.row_number().over(Window.partitionBy("view").orderBy(*order)))
        best = part if best is None else best.unionByName(part)
    ranked = moved.join(best.select("view", *SITE, "_rn"), ["view", *SITE])
    tops = ranked.groupBy(*combo).agg(*[F.count_if(F.col("_rn") <= n).alias(f"_top{n}") for n in top_ns])
    out = scored.join(tops, combo, "left")
    tp, fp, pos = F.col("tp"), F.col("fp"), F.col("evaluated_gold_sites")
    return out.select(
        *combo,
        "gold_sites",
        "covered_before_filter",
        "evaluated_gold_sites",
        "evaluated_negative_sites",
        "roc_auc",
        "average_precision",
        M.ratio(tp, tp + fp).alias("precision"),
        M.ratio(tp, pos).alias("recall"),
        M.ratio(2 * tp, tp + fp + pos).alias("f1"),
        *[
            M.ratio(
                F.coalesce(f"_top{n}", F.lit(0)), F.least(pos + F.col("evaluated_negative_sites"), F.lit(n))
            ).alias(f"top{n}_gold_fraction")
            for n in top_ns
        ],
    ).orderBy(
        F.col("roc_auc").desc_nulls_last(),
        F.col("average_precision").desc_nulls_last(),
        F.col(f"top{max(top_ns)}_gold_fraction").desc_nulls_last(),
        F.col("evaluated_gold_sites").desc(),
        *combo,
    )


def site_context(
    sites: DataFrame,
    bins: DataFrame,
    k: int,
    motif: str | None = None,
    contig: str = "contig",
    pos: str = "pos",
    strand: str = "strand",
    bin_size: int = 10000,
) -> DataFrame:
    """Reference base and strand-aware k-mer of each site; ``bins`` comes from ``read_fasta_bins`` with ``bin_size``.

    An equi-join on (contig, bin): a hot contig spreads over its bins. Sites outside the reference keep NULLs.
    """
    from ..functions.sequence import motif_match, reference_kmer, revcomp

    keyed = sites.withColumn("_bin", F.floor(F.col(pos) / F.lit(float(bin_size))))
    right = bins.select(
        F.col("contig").alias("_c"), F.col("bin").alias("_b"), F.col("start").alias("_s"), F.col("seq").alias("_seq")
    )
    joined = keyed.join(right, (F.col(contig) == F.col("_c")) & (F.col("_bin") == F.col("_b")), "left")
    at = F.col(pos) - F.col("_s")
    base = F.upper(F.substring("_seq", (at + 1).cast("int"), F.lit(1)))
    kmer = reference_kmer(F.col("_seq"), at, k)
    out = joined.withColumn("ref_base", F.when(base != "", base)).withColumn(
        "kmer", F.when(F.col(strand) == "-", revcomp(kmer)).otherwise(kmer)
    )
    out = out.drop("_c", "_b", "_s", "_seq", "_bin")
    return out.where(motif_match(F.col("kmer"), motif)) if motif else out


def gold_sanity(gold_context: DataFrame, base: str = "A", motif: str | None = "DRACH") -> DataFrame:
    """Checked / compatible gold sites and motif fractions overall (NULL strand), plus mismatches per strand and base.

    Only sites over A, C, G or T are checked for the base. A site without strand may fit on either: its base or the
    complement, its k-mer or the reverse complement. Every site counts for the motif, one without a k-mer as no match.
    """
    from ..functions.sequence import motif_match, revcomp

    comp = dict(zip("ACGT", "TGCA"))[base]
    strand, ref = F.col("strand"), F.upper(F.translate("ref_base", "Uu", "Tt"))
    known = F.when(ref.isin("A", "C", "G", "T"), ref)
    fits = F.when(strand == "+", known == base).when(strand == "-", known == comp).otherwise(known.isin(base, comp))
    kmer = F.col("kmer")
    matched = F.coalesce(motif_match(kmer, motif), F.lit(False))
    either = matched | (~strand.isin("+", "-") & F.coalesce(motif_match(revcomp(kmer), motif), F.lit(False)))
    rows = gold_context.select("strand", known.alias("ref_base"), fits.alias("_fits"), either.alias("_motif"))
    counts = rows.groupBy("strand", "ref_base").agg(
        F.count("ref_base").alias("checked"),
        F.count_if("_fits").alias("compatible"),
        F.count_if(~F.col("_fits")).alias("mismatched"),
        F.count(F.lit(1)).alias("motif_checked"),
        F.count_if("_motif").alias("motif_matched"),
    )
    overall = counts.agg(*[F.sum(c).alias(c) for c in ("checked", "compatible", "mismatched", "motif_checked", "motif_matched")])
    overall = overall.select(F.lit(None).cast("string").alias("strand"), F.lit(None).cast("string").alias("ref_base"), "*")
    listed = counts.where("ref_base IS NOT NULL")
    both = listed.unionByName(overall)
    return both.withColumn("compatible_fraction", M.ratio(F.col("compatible"), F.col("checked"), None)).withColumn(
        "motif_fraction", M.ratio(F.col("motif_matched"), F.col("motif_checked"), None)
    )


def read_scores(calls: DataFrame, read: Sequence[str] = ("read_id",), prob: str = "prob", label: str | None = None) -> DataFrame:
    """Mean probability (and label) of each read over its called sites; reads without any are dropped."""
    rows = calls.where(F.col(prob).isNotNull())
    aggs = [F.avg(prob).alias("read_score"), F.count(F.lit(1)).alias("num_sites")]
    if label:
        aggs.append(F.avg(label).alias("read_label"))
    return rows.groupBy(*read).agg(*aggs)
