"""Seeded, stratified sampling: bags, mixtures, splits and class balancing.

Every pick is "rank within the stratum by a seeded md5 key, keep the first k". Ranks come from
:func:`sitebag.ordering.seeded_rank`, so a stratum that holds a third of all rows is ranked by many tasks, and the
picks depend on ids and the seed alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordering import attach, ordered_prefix, seed_key, seeded_rank
from ..session import staged

NO_SITE = "no_A"


def _usable(df: DataFrame, site: str | None) -> DataFrame:
    return df.where(F.coalesce(F.col(site) != NO_SITE, F.lit(True))) if site else df


def _numbered(table: DataFrame, order: Sequence[str], weight: str | None = None, name: str = "bag_key") -> DataFrame:
    """Consecutive ids from 0 in the given order; with ``weight`` the first id of a row that owns several."""
    one = table.withColumn("_w", F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint"))
    out = ordered_prefix(one, [F.col(c) for c in order], ["_w"])
    return out.withColumn(name, F.col("_w_before")).drop("_w", "_w_before", "_w_total")


def stratified_bags(
    df: DataFrame,
    strata: Sequence[str],
    bag_size: int,
    min_size: int = 1,
    max_per_stratum: int = 0,
    balance: bool = True,
    ratio: str = "ratio_label",
    ident: str = "sample_id",
    site: str | None = "site_key",
    seed: int = 42,
) -> DataFrame:
    """Cut every (ratio, stratum) into bags of ``bag_size``; returns the kept rows with ``bag_key``.

    Bags below ``min_size`` are dropped, at most ``max_per_stratum`` stay per (ratio, stratum) (0 = all), and with
    ``balance`` every ratio keeps as many bags as the poorest one. Fails when a ratio yields no bag at all.
    """
    if not 0 < min_size <= bag_size:
        raise ValueError("need 0 < min_size <= bag_size")
    rows = _usable(df, site)
    ranked = seeded_rank(rows, ident, [ratio, *strata], seed)
    ranked = ranked.withColumn("_bag", F.floor((F.col("rn") - 1) / bag_size)).drop("rn")
    keys = [ratio, *strata, "_bag"]
    bags = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("bag_reads")).where(F.col("bag_reads") >= min_size)
    if max_per_stratum > 0:
        bags = seeded_rank(bags, "_bag", [ratio, *strata], seed, rank="_r").where(F.col("_r") <= max_per_stratum).drop("_r")
    bags = staged(bags, "bags")  # one row per bag; counted, ranked and numbered below
    per_ratio = bags.groupBy(ratio).agg(F.count(F.lit(1)).alias("_n"))
    made = per_ratio.agg(F.count(F.lit(1)).alias("made"), F.min("_n").alias("fewest"))
    wanted = df.select(ratio).distinct().agg(F.count(F.lit(1)).alias("wanted"))
    complete = made.withColumn("wanted", wanted.scalar()).select(
        F.when(F.col("made") == F.col("wanted"), F.col("fewest")).otherwise(
            F.raise_error(F.lit("some ratios produced no bags")).cast("bigint")
        )
    )
    fewest = complete.scalar()
    if balance:
        uid = bags.withColumn("_uid", F.concat_ws("|", *[F.col(c).cast("string") for c in [*strata, "_bag"]]))
        bags = seeded_rank(uid, "_uid", [ratio], seed, rank="_r").where(F.col("_r") <= fewest).drop("_r", "_uid")
    else:
        bags = bags.where(fewest > 0)
    return attach(ranked, _numbered(staged(bags, "kept"), keys), keys).drop("_bag")


def common_strata_sample(
    df: DataFrame,
    strata: Sequence[str],
    cap: int = 0,
    ratio: str = "ratio_label",
    ident: str = "sample_id",
    site: str | None = "site_key",
    seed: int = 42,
) -> DataFrame:
    """From every stratum that all ratios share draw the same number of rows per ratio; one bag per (stratum, ratio)."""
    rows = _usable(df, site)
    counts = rows.groupBy(*strata, ratio).agg(F.count(F.lit(1)).alias("_n"))
    n_ratios = df.select(ratio).distinct().agg(F.count(F.lit(1)).alias("n"))
    quota = F.min("_n") if cap <= 0 else F.least(F.min("_n"), F.lit(cap))
    keep = counts.groupBy(*strata).agg(F.count(F.lit(1)).alias("_k"), quota.alias("_keep"))
    keep = keep.where(F.col("_k") == n_ratios.scalar()).drop("_k")
    bags = _numbered(attach(counts.drop("_n"), keep, strata), [*strata, ratio])
    ranked = seeded_rank(rows, ident, [ratio, *strata], seed, rank="_rn")
    return attach(ranked, bags, [*strata, ratio]).where(F.col("_rn") <= F.col("_keep")).drop("_rn", "_keep")


def mixture_plan(
    counts: DataFrame, ratios: Sequence[tuple[str, float]], bag_size: int, bags_per_stratum: int = 0, replace: bool = False
) -> DataFrame:
    """Per stratum the segments ``(ratio, bags made, positives and negatives per bag, first offsets)``.

    Ratios consume the stratum's shuffled positives and negatives in order without reuse. The number of bags a
    ratio can still fill is a quotient of what is left, so one fold over the ratio list replaces drawing bag by bag.
    ``counts`` has ``_pos`` and ``_neg`` per stratum.
    """
    specs = F.array(
        *[
            F.struct(
                F.lit(i).alias("order"),
                F.lit(label).alias("label"),
                F.lit(float(r)).alias("ratio"),
                F.lit(round(bag_size * r)).cast("bigint").alias("pos"),
                F.lit(bag_size - round(bag_size * r)).cast("bigint").alias("neg"),
            )
            for i, (label, r) in enumerate(ratios)
        ]
    )
    none = F.lit(2**62).cast("bigint")

    def fits(left: Column, need: Column) -> Column:
        if replace:
            return F.when((need > 0) & (left <= 0), F.lit(0)).otherwise(none)
        return F.when(need > 0, F.floor(F.greatest(left, F.lit(0)) / F.greatest(need, F.lit(1)))).otherwise(none)

    quota = F.lit(bags_per_stratum if bags_per_stratum > 0 else (1 if replace else 2**62)).cast("bigint")
    segment = "struct<order:int,label:string,ratio:double,pos:bigint,neg:bigint,made:bigint,pos_from:bigint,neg_from:bigint>"

    def step(acc: Column, s: Column) -> Column:
        made = F.least(fits(F.col("_pos") - acc["p"], s["pos"]), fits(F.col("_neg") - acc["n"], s["neg"]), quota)
        entry = F.struct(
            s["order"].alias("order"), s["label"].alias("label"), s["ratio"].alias("ratio"), s["pos"].alias("pos"), s["neg"].alias("neg"),
            made.alias("made"), acc["p"].alias("pos_from"), acc["n"].alias("neg_from"),
        )
        used = F.lit(0 if replace else 1)
        return F.struct(
            (acc["p"] + made * s["pos"] * used).alias("p"),
            (acc["n"] + made * s["neg"] * used).alias("n"),
            F.concat(acc["out"], F.array(entry)).alias("out"),
        )

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("p"), zero.alias("n"), F.array().cast(f"array<{segment}>").alias("out"))
    return counts.withColumn("_plan", F.aggregate(specs, start, step)["out"])


def synthesize_mixtures(
    df: DataFrame,
    strata: Sequence[str],
    ratios: Sequence[tuple[str, float]],
    bag_size: int,
    bags_per_stratum: int = 0,
    replace: bool = False,
    side: str = "class",
    positive: str = "positive",
    negative: str = "negative",
    ident: str = "sample_id",
    site: str | None = "site_key",
    seed: int = 42,
) -> DataFrame:
    """Bags with known mixture ratios from a positive and a negative control, matched by stratum.

    Without replacement a row's rank alone tells its ratio and bag. With replacement each bag slot draws rank
    ``hash mod n`` and meets its row in an equi-join on (stratum, side, rank).
    """
    rows = _usable(df.where(F.col(side).isin(positive, negative)), site)
    is_pos = F.col(side) == positive
    counts = rows.groupBy(*strata).agg(F.count_if(is_pos).alias("_pos"), F.count_if(~is_pos).alias("_neg"))
    counts = counts.where((F.col("_pos") > 0) & (F.col("_neg") > 0))
    plan = mixture_plan(counts, ratios, bag_size, bags_per_stratum, replace)
    ranked = seeded_rank(rows, ident, [side, *strata], seed, rank="_rn")
    parts = plan.select(*strata, "_pos", "_neg", F.explode("_plan").alias("_s")).where(F.col("_s.made") > 0)
    parts = parts.select(*strata, "_pos", "_neg", "_s.*")
    first = _numbered(parts.select(*strata, "order", "made"), [*strata, "order"], "made", "_first")
    segments = attach(parts.drop("made"), first, [*strata, "order"])
    out_cols = [*df.columns, "bag_key", "synthetic_ratio", "synthetic_ratio_label"]
    if replace:
        slots = segments.withColumn("_b", F.explode(F.expr("sequence(0L, made - 1)")))
        slots = slots.withColumn("_i", F.explode(F.expr("sequence(0L, pos + neg - 1)")))
        take_pos = F.col("_i") < F.col("pos")
        size = F.when(take_pos, F.col("_pos")).otherwise(F.col("_neg"))
        draw = F.conv(F.substring(seed_key(seed, *strata, "order", "_b", "_i"), 1, 12), 16, 10).cast("bigint")
        slots = slots.select(
            *strata, F.when(take_pos, F.lit(positive)).otherwise(F.lit(negative)).alias(side), (draw % size + 1).alias("_rn"),
            (F.col("_first") + F.col("_b")).alias("bag_key"), F.col("ratio").alias("synthetic_ratio"), F.col("label").alias("synthetic_ratio_label"),
        )
        return attach(ranked, slots, [*strata, side, "_rn"]).select(*out_cols)
    per_stratum = segments.groupBy(*strata).agg(F.collect_list(F.struct("label", "ratio", "pos", "neg", "made", "pos_from", "neg_from", "_first")).alias("_segs"))
    joined = attach(ranked, per_stratum, strata)
    at = F.col("_rn") - 1

    def where_in(s: Column) -> tuple[Column, Column]:
        size, start = (F.when(is_pos, s[a]).otherwise(s[b]) for a, b in (("pos", "neg"), ("pos_from", "neg_from")))
        return size, start

    def mine(s: Column) -> Column:
        size, start = where_in(s)
        return (at >= start) & (at < start + size * s["made"])

    placed = joined.withColumn("_s", F.get(F.filter("_segs", mine), 0)).where("_s IS NOT NULL")
    size, start = where_in(F.col("_s"))
    return placed.select(
        *df.columns,
        (F.col("_s._first") + F.floor((at - start) / size)).alias("bag_key"),
        F.col("_s.ratio").alias("synthetic_ratio"),
        F.col("_s.label").alias("synthetic_ratio_label"),
    )


def stratified_split(df: DataFrame, strata: Sequence[str], fraction: float, ident: str = "sample_id", seed: int = 42) -> DataFrame:
    """Per stratum round(n * fraction) validation rows, at least 1 and at most n-1 where n > 1 and fraction > 0."""
    ranked = seeded_rank(df, ident, strata, seed, rank="_rn", size="_n")
    wanted = F.bround(F.col("_n") * F.lit(float(fraction))).cast("bigint")
    if fraction > 0:
        wanted = F.when(F.col("_n") > 1, F.least(F.greatest(wanted, F.lit(1)), F.col("_n") - 1)).otherwise(F.least(wanted, F.lit(0)))
    return ranked.withColumn("split", F.when(F.col("_rn") <= wanted, F.lit("validation")).otherwise(F.lit("train"))).drop("_rn", "_n")


def _keep_smallest(df: DataFrame, keep: DataFrame, group: Sequence[str], rank_by: Sequence[str], ident: str, seed: int) -> DataFrame:
    ranked = seeded_rank(df, ident, rank_by, seed, rank="_rn")
    return attach(ranked, keep, group).where(F.col("_rn") <= F.col("_keep")).drop("_rn", "_keep")


def class_quota(
    df: DataFrame, group: Sequence[str], cls: str, classes: Sequence = ("positive", "negative"), cap: int | None = None
) -> DataFrame:
    """Counts of both classes and the number to keep of each per group, including groups that keep nothing."""
    a, b = (F.count_if(F.col(cls) == c) for c in classes)
    quota = df.groupBy(*group).agg(a.alias("first_count"), b.alias("second_count"))
    limit = [F.col("first_count"), F.col("second_count")] + ([F.lit(cap)] if cap else [])
    return quota.withColumn("kept_per_class", F.least(*limit))


def balance_classes(
    df: DataFrame,
    group: Sequence[str],
    cls: str = "class",
    cap: int | None = None,
    classes: Sequence = ("positive", "negative"),
    ident: str = "sample_id",
    seed: int = 42,
) -> DataFrame:
    """Per group equally many rows of both classes; groups with one class vanish."""
    rows = df.where(F.col(cls).isin(*classes))
    keep = class_quota(rows, group, cls, classes, cap).where("kept_per_class > 0").select(*group, F.col("kept_per_class").alias("_keep"))
    return _keep_smallest(rows, keep, group, [*group, cls], ident, seed)


def balance_source_class(
    df: DataFrame,
    source: str,
    cls: str = "class",
    cap: int | None = None,
    classes: Sequence = ("positive", "negative"),
    within: Sequence[str] = (),
    ident: str = "sample_id",
    seed: int = 42,
) -> DataFrame:
    """Cut every existing (source, class) to the smallest one (at most ``cap``), separately per ``within`` (splits)."""
    rows = df.where(F.col(cls).isin(*classes))
    counts = rows.groupBy(*within, source, cls).agg(F.count(F.lit(1)).alias("_n"))
    least = F.min("_n") if cap is None else F.least(F.min("_n"), F.lit(cap))
    keep = counts.groupBy(*within).agg(least.alias("_keep"))
    return _keep_smallest(rows, keep, within, [*within, source, cls], ident, seed)


def pair_counts(
    counts: DataFrame,
    weights: tuple[float, float],
    caps: tuple[int | None, int | None] = (None, None),
    total: int | None = None,
) -> DataFrame:
    """Planned rows of two sources: ``counts`` is one row (first, second); adds first_planned, second_planned, short_by.

    Without a total the larger scale both sources can carry is used. With a total the rounded share goes to the
    first source, the rest to the second, and what the second cannot give goes back to the first.
    """
    wa, wb = (float(w) for w in weights)
    if wa < 0 or wb < 0 or wa + wb == 0:
        raise ValueError("weights must not be negative and not both zero")
    a, b = F.col("first"), F.col("second")
    la = a if caps[0] is None else F.least(a, F.lit(int(caps[0])))
    lb = b if caps[1] is None else F.least(b, F.lit(int(caps[1])))
    zero = F.lit(0).cast("bigint")
    if total is None:
        if wa == 0 or wb == 0:
            pa, pb = (zero, lb) if wa == 0 else (la, zero)
        else:
            scale = F.least(la / F.lit(wa), lb / F.lit(wb))
            pa, pb = F.floor(scale * wa), F.floor(scale * wb)
        short = zero
    else:
        goal = F.least(F.lit(int(total)), la + lb)
        short = F.greatest(F.lit(int(total)) - la - lb, zero)
        if wa == 0 or wb == 0:
            pa, pb = (zero, F.least(lb, goal)) if wa == 0 else (F.least(la, goal), zero)
        else:
            share = F.least(la, F.bround(goal * wa / (wa + wb)).cast("bigint"))
            pb = F.least(lb, goal - share)
            pa = F.least(la, goal - pb)
    return counts.withColumn("first_planned", pa).withColumn("second_planned", pb).withColumn("short_by", short)


def mix_two_sources(
    df: DataFrame,
    source: str,
    names: tuple[str, str],
    weights: tuple[float, float],
    caps: tuple[int | None, int | None] = (None, None),
    total: int | None = None,
    ident: str = "sample_id",
    seed: int = 42,
) -> DataFrame:
    """Seeded picks of both sources according to :func:`pair_counts`."""
    rows = df.where(F.col(source).isin(*names))
    counts = rows.agg(F.count_if(F.col(source) == names[0]).alias("first"), F.count_if(F.col(source) == names[1]).alias("second"))
    plan = pair_counts(counts, weights, caps, total)
    ranked = seeded_rank(rows, ident, [source], seed, rank="_rn")
    limit = F.when(F.col(source) == names[0], plan.select("first_planned").scalar()).otherwise(plan.select("second_planned").scalar())
    return ranked.where(F.col("_rn") <= limit).drop("_rn")


def kmer_balanced(df: DataFrame, kmer: str, y: str, cap: int | None = None, ident: str = "sample_id", seed: int = 42) -> DataFrame:
    """Per k-mer min(negatives, positives, cap) rows of each label."""
    return balance_classes(df, [kmer], y, cap, (1, 0), ident, seed)


def kmer_stats(df: DataFrame, kmer: str, y: str, cap: int | None = None) -> DataFrame:
    """Every k-mer with its label counts and the rows kept per label, zero included."""
    return class_quota(df, [kmer], y, (1, 0), cap).select(
        kmer, F.col("first_count").alias("positives"), F.col("second_count").alias("negatives"), "kept_per_class"
    )


def shuffle_order(df: DataFrame, ident: str = "sample_id", seed: int = 42, name: str = "position") -> DataFrame:
    """Dense random permutation 0..n-1 as a column."""
    return seeded_rank(df, ident, (), seed, rank="_rn").withColumn(name, F.col("_rn") - 1).drop("_rn")
