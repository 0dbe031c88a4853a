"""Filters, quality rules, splits and contract checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..ordering import seed_key, seeded_rank

# Fixed values of the SAM format: flag bits.
FLAG_UNMAPPED, FLAG_REVERSE, FLAG_SECONDARY, FLAG_SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x800


TOP_ROWS = 100_000


def primary_only(reads: DataFrame, need_tags: Sequence[str] = ("mv", "ns"), flag: str = "flag", tags: str = "tags") -> DataFrame:
    """Mapped primary records that are no duplex parents (``dx`` = 1) and carry the needed tags."""
    def usable(t: Column) -> Column:
        keep = F.coalesce(t["dx"], F.lit("0")) != "1"
        for tag in need_tags:
            keep = keep & F.map_contains_key(t, tag)
        return keep

    # the filter is pushed below the parsing projection, so it names each parsed column once
    good = F.col(flag).bitwiseAND(FLAG_UNMAPPED | FLAG_SECONDARY | FLAG_SUPPLEMENTARY) == 0
    return reads.where(good).where(let(F.col(tags), usable))


# The published rule presets (a value below the limit is rejected).
PRESETS = {
    "alignment-strict": {"identity": 0.80, "aligned_fraction": 0.85, "mapq": 20, "chunk_fraction": 0.85, "chunk_identity": 0.70},
    "alignment-relaxed": {"identity": 0.70, "aligned_fraction": 0.75, "mapq": 1, "chunk_fraction": 0.70, "chunk_identity": 0.60},
    "remap-strict": {"mapping_accuracy": 0.99, "mapping_coverage": 0.90},
    "remap-relaxed": {"mapping_accuracy": 0.95, "mapping_coverage": 0.85},
}


def minimum_rules(limits: Mapping[str, float], columns: Sequence[str]) -> list[tuple[str, Column]]:
    """Ordered (reason, passes) rules for the limits whose column exists; a missing value fails."""
    return [
        (f"low_{name}", F.coalesce(F.col(name) >= limit, F.lit(False))) for name, limit in limits.items() if name in columns
    ]


def qc_filter(df: DataFrame, rules: Sequence[tuple[str, Column]] | str, keep_all: bool = False) -> DataFrame:
    """Apply ordered rules; the first failing one is the ``reject_reason``. ``rules`` may name a preset."""
    if isinstance(rules, str):
        rules = minimum_rules(PRESETS[rules], df.columns)
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules], F.lit(None).cast("string"))
    tagged = df.withColumn("reject_reason", reason)
    return tagged if keep_all else tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_counters(tagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per reason, ``written`` for the kept ones and ``seen`` for all: partial counts, then one small merge."""
    reason = F.coalesce("reject_reason", F.lit("written"))
    rows = tagged.groupBy(*by, reason.alias("counter")).agg(F.count(F.lit(1)).alias("rows"))
    seen = rows.groupBy(*by).agg(F.sum("rows").alias("rows")).withColumn("counter", F.lit("seen"))
    return rows.unionByName(seen)


def typical_length(df: DataFrame, col: str, n: float = 2.5) -> DataFrame:
    """Rows strictly within mean +- n population standard deviations. The two bounds are one-row subqueries."""
    stats = df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"))
    low = stats.select(F.col("m") - n * F.col("s")).scalar()
    high = stats.select(F.col("m") + n * F.col("s")).scalar()
    return df.where((F.col(col) > low) & (F.col(col) < high))


def _share(total: Column, fraction: float) -> Column:
    """max(1, round half to even)."""
    return F.greatest(F.lit(1), F.bround(total * F.lit(float(fraction))).cast("bigint"))


def holdout_split(
    df: DataFrame,
    mode: str = "none",
    fraction: float = 0.1,
    runs: Sequence[str] = (),
    sites: Sequence[str] = (),
    ident: str = "sample_id",
    run: str = "run_id",
    site: str = "site_key",
    source: Sequence[str] = (),
    common_to: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` (train / validation).

    ``none``: a random ``fraction`` of each ``source``; ``leave-run``: the listed runs; ``leave-site``: the listed
    sites, or a fraction of the distinct sites (``no_A`` excluded) over all rows, or of the sites present in every
    value of ``common_to``.
    """
    valid = F.lit("validation")
    if mode == "none":
        if fraction <= 0:
            return df.withColumn("split", F.lit("train"))
        ranked = seeded_rank(df, ident, source, seed, rank="_rn", size="_n")
        return ranked.withColumn(
            "split", F.when(F.col("_rn") <= _share(F.col("_n"), fraction), valid).otherwise(F.lit("train"))
        ).drop("_rn", "_n")
    if mode == "leave-run":
        if not runs:
            raise ValueError("leave-run needs runs")
        return df.withColumn("split", F.when(F.col(run).isin(*runs), valid).otherwise(F.lit("train")))
    if mode != "leave-site":
        raise ValueError(f"unknown mode {mode!r}")
    if sites:
        return df.withColumn("split", F.when(F.col(site).isin(*sites), valid).otherwise(F.lit("train")))
    pool = df.where(F.col(site) != "no_A")
    if common_to:
        names = pool.select(common_to).distinct().agg(F.count(F.lit(1)).alias("n"))
        pool = pool.groupBy(site).agg(F.count_distinct(common_to).alias("_s")).where(F.col("_s") == names.scalar())
    distinct = seeded_rank(pool.select(site).distinct(), site, (), seed, rank="_rn", size="_n")
    held = distinct.where(F.col("_rn") <= _share(F.col("_n"), fraction)).select(site, valid.alias("split"))
    return df.join(held, site, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def leave_one_group_out(
    df: DataFrame, col: str, groups: Sequence[str], valid_mode: str = "train-groups", split: str = "split"
) -> DataFrame:
    """One frame with a ``fold`` column instead of a copy per held-out group.

    Train rows of a fold are those of the other groups. Validation rows: the other groups (``train-groups``), the
    fold's own (``heldout-group``), all (``keep-all``) or none.
    """
    tests = {
        "train-groups": F.col("fold") != F.col(col),
        "heldout-group": F.col("fold") == F.col(col),
        "keep-all": F.lit(True),
        "none": F.lit(False),
    }
    if valid_mode not in tests:
        raise ValueError(f"unknown validation mode {valid_mode!r}")
    folds = df.withColumn("fold", F.explode(F.array(*[F.lit(g) for g in groups])))
    is_train = F.col(split) == "train"
    return folds.where(F.when(is_train, F.coalesce(F.col("fold") != F.col(col), F.lit(True))).otherwise(tests[valid_mode]))


def allow_list(df: DataFrame, col: str, values: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose value is listed; a DataFrame of values becomes a semi-join."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(col)).distinct(), col, "left_semi")
    return df.where(F.col(col).isin(*values))


def seeded_limit(df: DataFrame, n: int, ident: str, seed: int = 42) -> DataFrame:
    """The first n rows of a random order: a distributed top-k on the seed key, or for many rows their rank in it.

    A top-k ends in one task with n rows, so it serves up to ``TOP_ROWS``; ranks are found in bounded parts. The rows are the same.
    """
    if n <= TOP_ROWS:
        return df.orderBy(seed_key(seed, ident), ident).limit(n)
    return seeded_rank(df, ident, seed=seed, rank="_rank").where(F.col("_rank") <= n).drop("_rank")


def validate_contract(
    df: DataFrame,
    required: Sequence[str] = (),
    checks: Mapping[str, Column] | None = None,
    equal_lengths: Sequence[tuple[str, str]] = (),
    width: tuple[str, int] | None = None,
    bag: tuple[str, str] | None = None,
) -> DataFrame:
    """(check, violations) rows. Missing columns come from the schema; row checks share one aggregate; bag purity
    counts the bags that span more than one ratio."""
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    tests = dict(checks or {})
    for a, b in equal_lengths:
        if a in df.columns and b in df.columns:
            tests[f"length:{a}={b}"] = F.size(a) == F.size(b)
    if width and width[0] in df.columns:
        tests[f"width:{width[0]}<={width[1]}"] = F.size(width[0]) <= width[1]
    out = spark.createDataFrame([(f"missing:{c}", 1) for c in missing], "check string, violations bigint")
    if tests:
        names = list(tests)
        row = df.agg(*[F.count_if(~F.coalesce(tests[n], F.lit(False))).alias(f"v{i}") for i, n in enumerate(names)])
        pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(names)])
        out = out.unionByName(row.select(F.inline(pairs)))
    if bag:
        spans = df.groupBy(bag[0]).agg(F.min(bag[1]).alias("_a"), F.max(bag[1]).alias("_b"))
        out = out.unionByName(
            spans.agg(F.count_if(F.col("_a") != F.col("_b")).alias("violations")).select(
                F.lit(f"bag_purity:{bag[0]}").alias("check"), "violations"
            )
        )
    return out


def matching_splits(a: DataFrame, b: DataFrame, split: str = "split") -> DataFrame:
    """Rows of ``check, violations``: validation must exist in both inputs or in neither."""
    def has(df: DataFrame) -> DataFrame:
        return df.agg(F.coalesce(F.bool_or(F.col(split) == "validation"), F.lit(False)).alias("h"))

    return has(a).withColumn("other", has(b).scalar()).select(
        F.lit("validation_in_both_or_neither").alias("check"), (F.col("h") != F.col("other")).cast("bigint").alias("violations")
    )


