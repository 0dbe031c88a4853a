"""Bag-level scores and calibration against known mixture ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordering import attach, quantiles, seeded_rank
from .metrics import ratio

# Clamp of bag scores inside the cross entropy, and its companions.
LOSS_EPS = 1e-6
LOSSES = ("bce", "mse", "huber")


def fallback_bag_key(sample_key: Column, bag_size: int | None) -> Column:
    """Bag of a sample that carries none: ``floor(key / bag_size)``, or one global bag."""
    return F.floor(sample_key / F.lit(int(bag_size))) if bag_size else F.lit(0).cast("bigint")


def bag_scores(
    reads: DataFrame, bag: str = "bag_key", score: str = "read_score", target: str | Column = "bag_target"
) -> DataFrame:
    """Mean read score and target per bag. Reads count equally: feed it per-read means, never per-site rows."""
    goal = F.lit(float(target)) if isinstance(target, (int, float)) else (F.col(target) if isinstance(target, str) else target)
    out = reads.groupBy(F.col(bag).alias("bag_key")).agg(
        F.avg(goal.cast("double")).alias("target_fraction"),
        F.avg(score).alias("bag_score"),
        F.count(F.lit(1)).alias("num_reads"),
    )
    return out.withColumn("target_ratio", F.col("target_fraction") * 100.0)


def ratio_calibration(
    bags: DataFrame, target: str = "target_fraction", score: str = "bag_score", missing_corr: float | None = None
) -> DataFrame:
    """Per ratio, and overall (NULL ratio), the score distribution and errors against the target.

    ``missing_corr`` is the correlation reported where it is undefined (fewer than two bags, no spread).
    """
    t, s = F.col(target).cast("double"), F.col(score).cast("double")
    rows = bags.select(t.alias("target"), s.alias("score"), F.explode(F.array(t, F.lit(None).cast("double"))).alias("ratio"))
    err = F.col("score") - F.col("target")
    stats = rows.groupBy("ratio").agg(
        F.count(F.lit(1)).alias("bags"),
        F.avg("score").alias("mean_score"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err).alias("bias"),
        # a grand total has both spreads; inside one ratio the target is constant and the correlation undefined
        F.when(
            (F.count(F.lit(1)) > 1) & (F.min("target") < F.max("target")) & (F.min("score") < F.max("score")),
            F.try_divide(F.covar_pop("score", "target"), F.stddev_pop("score") * F.stddev_pop("target")),
        ).alias("corr"),
    )
    stats = stats.withColumn("corr", F.coalesce("corr", F.lit(missing_corr).cast("double")))
    qs = quantiles(rows, "score", {"p10": 0.1, "median": 0.5, "p90": 0.9}, ["ratio"])
    return attach(stats, qs, ["ratio"])


def bag_report(
    calls: DataFrame,
    samples: DataFrame,
    bag: str = "bag_key",
    ratio: str = "ratio",
    read: str = "read_id",
    prob: str = "prob",
    expected: Sequence[float] | None = None,
) -> DataFrame:
    """Per-site calls to a report per mixture ratio (NULL ratio = all bags): sites -> read means -> bag means -> ratios.

    ``samples`` gives each read its bag and true ratio. A read counts once in its bag however many sites it has. Beside the
    errors of :func:`ratio_calibration` stand the step to the next lower ratio and whether all steps are monotonic.
    """
    from .metrics import monotonicity
    from .sites import read_scores

    reads = read_scores(calls, [read], prob).join(samples.select(read, bag, ratio), read)
    table = ratio_calibration(bag_scores(reads, bag, "read_score", ratio))
    steps = monotonicity(table.where("ratio IS NOT NULL"), "ratio", "mean_score", expected)
    return attach(table, steps.drop("mean_score"), ["ratio"], "left")


def proportion_loss(
    bags: DataFrame,
    kind: str = "bce",
    tolerance: float = 0.0,
    delta: float = 1.0,
    target: str = "target_fraction",
    score: str = "bag_score",
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean bag objective. With a tolerance the target becomes the nearest end of [t-tol, t+tol] (cut to [0, 1]).

    Inside the interval cross entropy has weight 0 (the bag still counts in the mean); squared and Huber errors are 0.
    """
    if kind not in LOSSES:
        raise ValueError(f"unknown loss {kind!r}")
    p, t = F.col(score).cast("double"), F.col(target).cast("double")
    weight = F.lit(1.0)
    if tolerance > 0:
        low = F.least(F.greatest(t - tolerance, F.lit(0.0)), F.lit(1.0))
        high = F.least(F.greatest(t + tolerance, F.lit(0.0)), F.lit(1.0))
        weight = F.when((p < low) | (p > high), 1.0).otherwise(0.0)
        t = F.least(F.greatest(p, low), high)
    if kind == "bce":
        q = F.least(F.greatest(p, F.lit(LOSS_EPS)), F.lit(1.0 - LOSS_EPS))
        item = -(t * F.ln(q) + (1.0 - t) * F.ln(1.0 - q)) * weight
    else:
        gap = F.abs(p - t)
        item = gap * gap
        if kind == "huber":
            item = F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta))
    return bags.groupBy(*by).agg(F.avg(item).alias("loss"), F.count(F.lit(1)).alias("bags"))


def control_bags(
    reads: DataFrame,
    ident: str,
    label: str,
    score: str,
    bag_size: int,
    neg_max: float = 0.01,
    pos_min: float = 0.99,
    seed: int = 42,
) -> DataFrame:
    """Full bags of clearly negative / clearly positive reads; leftovers and ambiguous reads stay out."""
    side = F.when(F.col(label) <= neg_max, F.lit(0.0)).when(F.col(label) >= pos_min, F.lit(1.0))
    rows = reads.select(F.col(ident), F.col(score).cast("double").alias("_score"), side.alias("target_fraction"))
    ranked = seeded_rank(rows.where("target_fraction IS NOT NULL"), ident, ["target_fraction"], seed)
    bags = ranked.groupBy("target_fraction", F.floor((F.col("rn") - 1) / bag_size).alias("bag")).agg(
        F.avg("_score").alias("bag_score"), F.count(F.lit(1)).alias("num_reads")
    )
    return bags.where(F.col("num_reads") == bag_size).withColumn("target_ratio", F.col("target_fraction") * 100.0)


def control_bag_summary(reads: DataFrame, label: str, bag_size: int, neg_max: float = 0.01, pos_min: float = 0.99) -> DataFrame:
    neg, pos = F.count_if(F.col(label) <= neg_max), F.count_if(F.col(label) >= pos_min)
    out = reads.where(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("num_reads"), neg.alias("num_negative_reads"), pos.alias("num_positive_reads")
    )
    n, p = F.col("num_negative_reads"), F.col("num_positive_reads")
    return out.select(
        "*",
        (F.col("num_reads") - n - p).alias("num_ambiguous_reads"),
        F.floor(n / bag_size).alias("num_negative_bags"),
        F.floor(p / bag_size).alias("num_positive_bags"),
    )


def control_comparison(metrics: DataFrame, name: str = "dataset", negative: str = "ivt", positive: str = "full_mod") -> DataFrame:
    """Confusion counts and rates rebuilt from the metric rows of the 0 % and the 100 % control.

    ``metrics`` holds num_sites, accuracy, recall, mean_prob and median_prob per dataset.
    """

    def of(which: str, column: str) -> Column:
        return F.max(F.when(F.col(name) == which, F.col(column).cast("double")))

    row = metrics.where(F.col(name).isin(negative, positive)).agg(
        of(negative, "num_sites").alias("num_negative_sites"),
        of(positive, "num_sites").alias("num_positive_sites"),
        of(negative, "accuracy").alias("_acc"),
        of(positive, "recall").alias("_rec"),
        *[of(w, f"{k}_prob").alias(f"{t}_{k}_prob") for w, t in ((negative, "negative"), (positive, "positive")) for k in ("mean", "median")],
    )
    neg, pos = F.col("num_negative_sites"), F.col("num_positive_sites")
    row = row.withColumn("tn", F.col("_acc") * neg).withColumn("tp", F.col("_rec") * pos)
    row = row.withColumn("fp", neg - F.col("tn")).withColumn("fn", pos - F.col("tp"))
    tn, tp, fp, fn = (F.col(c) for c in ("tn", "tp", "fp", "fn"))
    return row.select(
        "num_negative_sites", "num_positive_sites", "tn", "fp", "tp", "fn",
        ratio(fp, neg).alias("fpr"),
        ratio(fn, pos).alias("fnr"),
        ratio(tn, neg).alias("specificity"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, pos + neg).alias("accuracy"),
        "negative_mean_prob", "negative_median_prob", "positive_mean_prob", "positive_median_prob",
        (F.col("positive_mean_prob") - F.col("negative_mean_prob")).alias("gap_mean"),
        (F.col("positive_median_prob") - F.col("negative_median_prob")).alias("gap_median"),
    )


def pool_single_class(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro-average over runs that each hold one class, from their predicted-positive rates.

    ``runs`` holds num_positive, num_negative, predicted_positive_rate, bce and mean_prob. A run with both classes
    has no confusion counts, so it makes the pooled counts of its group NULL.
    """
    p, n = F.col("num_positive").cast("double"), F.col("num_negative").cast("double")
    called = F.coalesce(F.nanvl(F.col("predicted_positive_rate"), F.lit(None)), F.lit(0.0)) * (p + n)
    only_p, only_n = (p > 0) & (n == 0), (n > 0) & (p == 0)
    rows = runs.select(
        *by, p.alias("p"), n.alias("n"), (~only_p & ~only_n).alias("_both"),
        F.when(only_p, called).when(only_n, 0.0).alias("tp"),
        F.when(only_n, n - called).when(only_p, 0.0).alias("tn"),
        (F.col("bce") * (p + n)).alias("_bce"),
        (F.col("mean_prob") * (p + n)).alias("_prob"),
    )
    s = rows.groupBy(*by).agg(
        F.sum("p").alias("num_positive"), F.sum("n").alias("num_negative"),
        F.when(~F.bool_or("_both"), F.sum("tp")).alias("tp"), F.when(~F.bool_or("_both"), F.sum("tn")).alias("tn"),
        F.sum("_bce").alias("_bce"), F.sum("_prob").alias("_prob"),
    )
    pos, neg = F.col("num_positive"), F.col("num_negative")
    recall, spec = ratio(F.col("tp"), pos, None), ratio(F.col("tn"), neg, None)
    return s.select(
        *by, "num_positive", "num_negative", (pos + neg).alias("num_sites"),
        recall.alias("recall"), spec.alias("specificity"),
        F.when(recall.isNull(), spec).when(spec.isNull(), recall).otherwise((recall + spec) / 2.0).alias("balanced_accuracy"),
        ratio(F.col("tp") + F.col("tn"), pos + neg, None).alias("accuracy"),
        ratio(F.col("_bce"), pos + neg, None).alias("bce"),
        ratio(F.col("_prob"), pos + neg, None).alias("mean_prob"),
    )


def single_class_rate(runs: DataFrame) -> DataFrame:
    """Per run recall (positives only) or specificity (negatives only), with the name of the rate."""
    only_p = (F.col("num_positive") > 0) & (F.col("num_negative") == 0)
    only_n = (F.col("num_negative") > 0) & (F.col("num_positive") == 0)
    rate = F.col("predicted_positive_rate")
    return runs.withColumn("rate_kind", F.when(only_p, F.lit("recall")).when(only_n, F.lit("specificity"))).withColumn(
        "rate", F.when(only_p, rate).when(only_n, 1.0 - rate)
    )


def paired_delta(a: DataFrame, b: DataFrame, key: Sequence[str], score: str = "bag_score", target: str = "target_fraction") -> DataFrame:
    """Bags scored by both sides: difference of scores and of absolute errors (b - a)."""
    left = a.select(*key, F.col(target).alias("target"), F.col(score).alias("score_a"))
    right = b.select(*key, F.col(score).alias("score_b"))
    sa, sb, t = F.col("score_a"), F.col("score_b"), F.col("target")
    return left.join(right, list(key)).select(
        *key, "target", "score_a", "score_b", (sb - sa).alias("score_delta"), (F.abs(sb - t) - F.abs(sa - t)).alias("abs_error_delta")
    )
