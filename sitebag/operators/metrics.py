"""Binary and multiclass metrics built on one intermediate: the score histogram.

``score_histogram`` shrinks (label, score) rows to counts per distinct score with a partial aggregate; every
threshold, ROC, PR and ranked metric is then integer arithmetic over those counts, so results do not depend on
partitioning. ``by`` turns each metric into a per-group metric within the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordering import attach, ordered_prefix, quantiles, search_sorted

# Fixed value: clipping of probabilities inside the cross entropy.
BCE_EPS = 1e-7


def ratio(num: Column, den: Column, zero_division: float | None = 0.0) -> Column:
    """num / den as double; ``zero_division`` where den is 0 (or None for NULL)."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(zero_division).cast("double"))


def wide(c: Column) -> Column:
    """Counts whose products may leave 64 bits."""
    return c.cast("decimal(38,0)")


def score_histogram(df: DataFrame, label: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Positives ``p`` and negatives ``n`` per distinct score."""
    y = F.col(label)
    return (
        df.where(F.col(score).isNotNull() & y.isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("p"),
            F.sum(F.when(y == 1, 0).otherwise(1)).cast("bigint").alias("n"),
        )
    )


def cumulate(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts from the highest score down: tp/fp including, ``_before`` excluding the row's score."""
    out = ordered_prefix(hist, [-F.col("score")], ["p", "n"], by)
    return out.select(
        *by,
        "score",
        "p",
        "n",
        F.col("p_before").alias("tp_before"),
        F.col("n_before").alias("fp_before"),
        (F.col("p_before") + F.col("p")).alias("tp"),
        (F.col("n_before") + F.col("n")).alias("fp"),
        F.col("p_total").alias("positives"),
        F.col("n_total").alias("negatives"),
    )


def confusion_rates(
    tp: Column, fp: Column, tn: Column, fn: Column, zero_division: float | None = 0.0
) -> list[Column]:
    """All rates derived from the four counts."""
    z = zero_division
    recall, specificity = ratio(tp, tp + fn, z), ratio(tn, tn + fp, z)
    return [
        ratio(tp + tn, tp + tn + fp + fn, z).alias("accuracy"),
        ((recall + specificity) / 2.0).alias("balanced_accuracy"),
        ratio(tp, tp + fp, z).alias("precision"),
        recall.alias("recall"),
        specificity.alias("specificity"),
        ratio(2 * tp, 2 * tp + fp + fn, z).alias("f1"),
        ratio(fp, fp + tn, z).alias("fpr"),
        ratio(fp, tp + fp, z).alias("fdr"),
        ratio(tp + fn, tp + tn + fp + fn, z).alias("positive_rate"),
        ratio(tp + fp, tp + tn + fp + fn, z).alias("predicted_positive_rate"),
    ]


def _confusion(y: Column, hit: Column) -> list[Column]:
    def n(c: Column, name: str) -> Column:
        return F.count_if(c).alias(name)

    pos, neg = y == 1, y != 1
    return [n(pos & hit, "tp"), n(neg & ~hit, "tn"), n(neg & hit, "fp"), n(pos & ~hit, "fn")]


def threshold_metrics(
    df: DataFrame,
    threshold: float,
    label: str = "y",
    score: str = "score",
    by: Sequence[str] = (),
    zero_division: float | None = 0.0,
) -> DataFrame:
    """Confusion counts and rates at one threshold (score >= threshold is positive): one partial aggregate."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by).agg(
        *_confusion(F.col(label), F.col(score) >= threshold)
    )
    c = {k: F.col(k) for k in ("tp", "fp", "tn", "fn")}
    return counts.select(*by, "tp", "tn", "fp", "fn", *confusion_rates(**c, zero_division=zero_division))


def probability_profile(
    df: DataFrame, label: str = "y", score: str = "score", by: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """Cross entropy, means and medians overall and per class, q05 of positives and q95 of negatives."""
    y, p = F.col(label), F.col(score).cast("double")
    clipped = F.least(F.greatest(p, F.lit(BCE_EPS)), F.lit(1.0 - BCE_EPS))
    rows = df.where(p.isNotNull() & y.isNotNull())
    means = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_sites"),
        F.avg(-F.when(y == 1, F.ln(clipped)).otherwise(F.ln(1.0 - clipped))).alias("bce"),
        F.avg(p).alias("mean_prob"),
        F.avg(F.when(y == 1, p)).alias("mean_positive_prob"),
        F.avg(F.when(y != 1, p)).alias("mean_negative_prob"),
    )
    # one tagged stream for the three quantile sets: all rows, positives, negatives
    tagged = rows.select(
        *by, F.explode(F.array(F.lit("all"), F.when(y == 1, F.lit("pos")).otherwise(F.lit("neg")))).alias("_set"), p.alias("_p")
    )
    qs = quantiles(tagged, "_p", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, [*by, "_set"], approx)
    pick = lambda s, q: F.max(F.when(F.col("_set") == s, F.col(q)))
    flat = qs.groupBy(*by).agg(
        pick("all", "q50").alias("median_prob"),
        pick("pos", "q50").alias("median_positive_prob"),
        pick("neg", "q50").alias("median_negative_prob"),
        pick("pos", "q05").alias("positive_q05"),
        pick("neg", "q95").alias("negative_q95"),
    )
    return attach(means, flat, list(by))


def step_grid(steps: int = 100) -> list[float]:
    """0, 1/steps, .., 1."""
    return [i / steps for i in range(steps + 1)]


def threshold_counts(hist: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """tp/fp/fn/tn for every threshold from one pass over a score histogram.

    A score falls into one of len(thresholds)+1 cells; each cell then adds to the thresholds at or below it. The
    fan-out works on cells (a constant number per group), not on rows.
    """
    edges = sorted(float(t) for t in thresholds)
    grid = F.array(*[F.lit(t) for t in edges])
    cells = hist.withColumn("_cell", search_sorted(grid, F.col("score"), len(edges)))
    cells = cells.groupBy(*by, "_cell").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    spread = cells.select(*by, "_cell", "p", "n", F.posexplode(grid).alias("_i", "threshold"))
    above = F.col("_cell") > F.col("_i")
    out = spread.groupBy(*by, "threshold").agg(
        F.sum(F.when(above, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("n"))).alias("tn"),
        F.sum(F.when(above, 0).otherwise(F.col("p"))).alias("fn"),
    )
    return out


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float] | None = None,
    label: str = "y",
    score: str = "score",
    by: Sequence[str] = (),
    zero_division: float | None = 0.0,
) -> DataFrame:
    """:func:`threshold_metrics` at many thresholds (default 0, 0.01, .., 1) in one job."""
    counts = threshold_counts(score_histogram(df, label, score, by), thresholds or step_grid(), by)
    c = {k: F.col(k) for k in ("tp", "fp", "tn", "fn")}
    return counts.select(*by, "threshold", "tp", "tn", "fp", "fn", *confusion_rates(**c, zero_division=zero_division))


def roc_curve(cum: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr, threshold) at every distinct score, led by (0, 0) with a NULL threshold."""
    points = cum.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("negatives"), None).alias("fpr"),
        ratio(F.col("tp"), F.col("positives"), None).alias("tpr"),
    )
    start = cum.select(*by).distinct() if by else cum.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
    zero = F.lit(0.0)
    return start.select(*by, F.lit(None).cast("double").alias("threshold"), zero.alias("fpr"), zero.alias("tpr")).unionByName(points)


def pr_curve(cum: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(recall, precision, threshold) at every distinct score, led by (0, 1), with the prevalence baseline."""
    base = ratio(F.col("positives"), F.col("positives") + F.col("negatives"), None).alias("baseline")
    points = cum.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("positives"), None).alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp"), None).alias("precision"),
        base,
    )
    start = cum.groupBy(*by).agg(F.max("positives").alias("positives"), F.max("negatives").alias("negatives"))
    start = start.where(F.col("positives").isNotNull()).select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("recall"),
        F.lit(1.0).alias("precision"),
        base,
    )
    return start.unionByName(points)


def auc_summary(cum: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (integer trapezoids, divided once), both PR areas and the prevalence; NULL with one class only.

    ``average_precision`` is the step sum, ``pr_auc_trapezoid`` joins points starting from (recall 0, precision 1).
    """
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    before = F.col("tp_before") + F.col("fp_before")
    prec = tp / (tp + fp)
    prec_before = F.when(before > 0, F.col("tp_before") / before).otherwise(1.0)
    sums = cum.groupBy(*by).agg(
        F.sum("p").alias("positives"),
        F.sum("n").alias("negatives"),
        F.sum(wide(n) * wide(2 * F.col("tp_before") + p)).alias("_area"),
        F.sum(p * prec).alias("_ap"),
        F.sum(p * (prec + prec_before) / 2.0).alias("_trap"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    pos, neg = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return sums.select(
        *by,
        "positives",
        "negatives",
        F.when(both, F.col("_area").cast("double") / (2.0 * pos * neg)).alias("roc_auc"),
        F.when(both, F.col("_ap") / pos).alias("average_precision"),
        F.when(both, F.col("_trap") / pos).alias("pr_auc_trapezoid"),
        ratio(F.col("positives"), F.col("positives") + F.col("negatives"), None).alias("prevalence"),
    )


def partial_auc(cum: DataFrame, max_fpr: float, by: Sequence[str] = ()) -> DataFrame:
    """Raw and McClish-standardised ROC area up to ``max_fpr``; the last segment is cut by interpolation."""
    limit = F.col("negatives") * F.lit(float(max_fpr))
    width = F.greatest(F.least(F.col("fp").cast("double"), limit) - F.col("fp_before"), F.lit(0.0))
    # height at the cut, on the segment from (fp_before, tp_before) to (fp, tp)
    rise = F.when(F.col("n") > 0, F.col("p") * width / F.col("n")).otherwise(0.0)
    area = F.sum(width * (F.col("tp_before") + rise / 2.0))
    sums = cum.groupBy(*by).agg(
        area.alias("_a"), F.sum("p").alias("_pos"), F.sum("n").alias("_neg")
    )
    raw = F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), F.col("_a") / F.col("_pos") / F.col("_neg"))
    low, high = max_fpr * max_fpr / 2.0, float(max_fpr)
    return sums.select(
        *by,
        raw.alias("partial_auc"),
        (F.lit(0.5) * (1.0 + (raw - low) / (high - low))).alias("partial_auc_standardized"),
    )


def tpr_at_fpr(cum: DataFrame, levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Best TPR with FPR <= level and the score that reaches it (highest such score on ties); 0 / NULL if none.

    A group without negatives has no such score either, so it too gives 0 / NULL.
    """
    spread = cum.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    allowed = (F.col("negatives") > 0) & (F.try_divide("fp", "negatives") <= F.col("level"))
    best = F.max_by(
        F.struct("tp", "score", "positives"), F.when(allowed, F.struct(F.col("tp"), F.col("score")))
    )
    out = spread.groupBy(*by, "level").agg(best.alias("_b"))
    return out.select(
        *by,
        "level",
        F.when(F.col("_b.positives") > 0, F.col("_b.tp") / F.col("_b.positives")).otherwise(0.0).alias("tpr"),
        F.when(F.col("_b.tp") > 0, F.col("_b.score")).alias("threshold"),
    )


def sensitivity_at_fdr(
    df: DataFrame,
    levels: Sequence[float],
    keys: Sequence[str],
    label: str = "y",
    score: str = "score",
    by: Sequence[str] = (),
) -> DataFrame:
    """Largest recall over row prefixes whose FDR <= level; rows ordered by score, ties by ``keys``.

    Recall only grows at a positive row, and the FDR of a prefix is lowest right after one, so only the prefix
    counts at positive rows matter.
    """
    rows = df.where(F.col(score).isNotNull()).select(
        *by,
        F.col(score).cast("double").alias("_s"),
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        (F.col(label) == 1).cast("bigint").alias("p"),
        (F.col(label) != 1).cast("bigint").alias("n"),
    )
    ranked = ordered_prefix(rows, [-F.col("_s"), *[F.col(f"_key{i}") for i in range(len(keys))]], ["p", "n"], by)
    fp, tp = F.col("n_before") + F.col("n"), F.col("p_before") + F.col("p")
    fdr = fp / (fp + tp)
    best = ranked.groupBy(*by).agg(
        F.max("p_total").alias("_pos"),
        *[F.max(F.when(fdr <= float(x), tp)).alias(f"_l{i}") for i, x in enumerate(levels)],
    )
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("level"), F.col(f"_l{i}").alias("tp")) for i, x in enumerate(levels)])
    return best.select(*by, "_pos", F.explode(pairs).alias("_e")).select(
        *by, F.col("_e.level").alias("level"), F.coalesce(ratio(F.col("_e.tp"), F.col("_pos"), 0.0), F.lit(0.0)).alias("sensitivity")
    )


TOP_ROWS = 100_000


def top_n_hits(
    df: DataFrame, ns: Sequence[int], keys: Sequence[str], label: str = "y", score: str = "score"
) -> DataFrame:
    """Share of positives among the first n rows (n capped at the row count).

    Up to ``TOP_ROWS`` by a distributed top-k and a window over what it leaves; for more by ranks found in bounded buckets.
    """
    wanted = sorted({int(n) for n in ns if n > 0})
    rows = df.select(*[F.col(k) for k in dict.fromkeys([*keys, score, label])])
    if wanted[-1] <= TOP_ROWS:
        order = [F.col(score).desc(), *[F.col(k).asc() for k in keys]]
        numbered = rows.orderBy(*order).limit(wanted[-1]).withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    else:
        one = rows.withColumn("_one", F.lit(1).cast("bigint"))
        numbered = ordered_prefix(one, [-F.col(score), *[F.col(k) for k in keys]], ["_one"]).withColumn("_rn", F.col("_one_before") + 1)
    out = numbered.withColumn("n", F.explode(F.array(*[F.lit(n) for n in wanted]))).where(F.col("_rn") <= F.col("n"))
    return out.groupBy("n").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 1).alias("hits"),
        (F.count_if(F.col(label) == 1) / F.count(F.lit(1))).alias("fraction"),
    )


def grouped_metrics(
    df: DataFrame,
    grouping: Sequence[Sequence[str]],
    threshold: float = 0.5,
    label: str = "y",
    score: str = "score",
    zero_division: float | None = None,
) -> DataFrame:
    """Threshold metrics, means, medians, outer quantiles per class and AUCs for several groupings in one job.

    GROUPING SETS over (grouping, score) builds the histograms of all groupings together; columns outside a set are
    NULL and ``group_by`` names the set.
    """
    columns = list(dict.fromkeys(c for g in grouping for c in g))
    y = F.col(label)
    rows = df.where(F.col(score).isNotNull() & y.isNotNull()).select(
        *columns, F.col(score).cast("double").alias("score"), y.alias("_y")
    )
    sets = [[F.col(c) for c in g] + [F.col("score")] for g in grouping]
    names = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    hist = rows.groupingSets(sets, *columns, "score").agg(
        names.alias("group_by"),
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("bigint").alias("p"),
        F.sum(F.when(F.col("_y") == 1, 0).otherwise(1)).cast("bigint").alias("n"),
    )
    by = ["group_by", *columns]
    cum = cumulate(hist, by)
    areas = auc_summary(cum, by)
    hit = F.col("score") >= threshold
    p, n, s = F.col("p"), F.col("n"), F.col("score")
    clipped = F.least(F.greatest(s, F.lit(BCE_EPS)), F.lit(1.0 - BCE_EPS))
    counts = hist.groupBy(*by).agg(
        F.sum(F.when(hit, p).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, 0).otherwise(n)).alias("tn"),
        F.sum(F.when(hit, n).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(p)).alias("fn"),
        (-F.sum(p * F.ln(clipped) + n * F.ln(1.0 - clipped)) / F.sum(p + n)).alias("bce"),
        (F.sum((p + n) * s) / F.sum(p + n)).alias("mean_prob"),
        ratio(F.sum(p * s), F.sum(p), None).alias("mean_positive_prob"),
        ratio(F.sum(n * s), F.sum(n), None).alias("mean_negative_prob"),
    )
    c = {k: F.col(k) for k in ("tp", "fp", "tn", "fn")}
    counts = counts.select(
        *by, "tp", "tn", "fp", "fn", *confusion_rates(**c, zero_division=zero_division),
        "bce", "mean_prob", "mean_positive_prob", "mean_negative_prob",
    )
    return attach(attach(counts, areas, by), _cumulated_quantiles(cum, by), by)


#: Name, class (both, p = positives, n = negatives) and probability of the quantiles of a probability profile.
PROFILE_QUANTILES = (
    ("median_prob", "both", 0.5),
    ("median_positive_prob", "p", 0.5),
    ("median_negative_prob", "n", 0.5),
    ("positive_q05", "p", 0.05),
    ("negative_q95", "n", 0.95),
)


def _cumulated_quantiles(cum: DataFrame, by: Sequence[str]) -> DataFrame:
    """Linearly interpolated score quantiles per group, read off the cumulated histogram: no further sort or shuffle of rows."""
    below_p, below_n = F.col("positives") - F.col("tp"), F.col("negatives") - F.col("fp")
    parts = {
        "both": (below_p + below_n, F.col("p") + F.col("n"), F.col("positives") + F.col("negatives")),
        "p": (below_p, F.col("p"), F.col("positives")),
        "n": (below_n, F.col("n"), F.col("negatives")),
    }
    aggs = []
    for name, which, share in PROFILE_QUANTILES:
        below, own, total = parts[which]
        at = F.lit(share) * (total - 1)
        for tag, k in (("low", F.floor(at)), ("high", F.ceil(at))):
            aggs.append(F.max(F.when((below <= k) & (k < below + own), F.col("score"))).alias(f"_{name}_{tag}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_part"))
    picked = cum.groupBy(*by).agg(*aggs)

    def between(name: str) -> Column:
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        return (low + (high - low) * F.col(f"_{name}_part")).alias(name)

    return picked.select(*by, *[between(name) for name, _, _ in PROFILE_QUANTILES])


def confusion_matrix(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count(F.lit(1)).alias("rows"))


def multiclass_metrics(df: DataFrame, true: str, pred: str, conf: str, classes: Sequence[int]) -> DataFrame:
    """Support, predicted, precision, recall and F1 per class plus one ``class IS NULL`` row with the overall figures.

    Macro F1 averages over all ``classes``, also those never seen. Each cell of the confusion matrix counts once for its
    true and once for its predicted class, so the work is linear in the cells.
    """
    cells = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("q")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(conf).cast("double")).alias("conf")
    )
    rows, right = F.col("rows"), F.when(F.col("t") == F.col("q"), F.col("rows")).otherwise(0)
    zero = F.lit(0).cast("bigint")

    def side(name: str, support: Column, predicted: Column, hits: Column) -> Column:
        return F.struct(F.col(name).cast("int").alias("class"), support.alias("support"), predicted.alias("predicted"), hits.alias("hits"))

    sides = cells.select(F.inline(F.array(side("t", rows, zero, right), side("q", zero, rows, zero))))
    counts = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    axis = df.sparkSession.createDataFrame([(int(c),) for c in classes], "class int")
    per = axis.join(counts, "class", "left").fillna(0, subset=["support", "predicted", "hits"])
    totals = cells.agg(F.sum(rows).alias("_all"), F.sum(right).alias("_right"), F.sum("conf").alias("_conf"))
    per = attach(per, totals, [])
    per = per.select(
        "class",
        "support",
        "predicted",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        (F.col("_right") / F.col("_all")).alias("accuracy"),
        (F.col("_conf") / F.col("_all")).alias("mean_confidence"),
    )
    overall = per.agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.max("accuracy").alias("accuracy"),
        F.max("mean_confidence").alias("mean_confidence"),
    )
    return per.unionByName(overall.withColumn("class", F.lit(None).cast("int")))


def negative_control_curve(
    sites: DataFrame, thresholds: Sequence[float] | None = None, score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """Sites called positive at each threshold although none is: count, fraction and specificity."""
    hist = score_histogram(sites.withColumn("_y", F.lit(0)), "_y", score, by)
    counts = threshold_counts(hist, thresholds or step_grid(), by)
    return counts.select(
        *by,
        "threshold",
        (F.col("fp") + F.col("tn")).alias("sites"),
        F.col("fp").alias("false_positive_sites"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_fraction"),
        ratio(F.col("tn"), F.col("fp") + F.col("tn")).alias("specificity"),
    )


def pairwise_ratio_roc(
    bags: DataFrame,
    ratio_col: str,
    score: str = "score",
    pairs: Sequence[tuple[float, float]] | None = None,
    only_controls: bool = False,
) -> DataFrame:
    """AUC of separating the lower from the higher ratio, for given pairs or for every pair of ratios present.

    Bags collapse to counts per (ratio, score) first; only those counts are copied to the pairs they belong to.
    ``only_controls`` allows ratios 0 and 100 alone and fails on any other.
    """
    r = F.col(ratio_col)
    if only_controls:
        bags = bags.where(
            F.when(r.isin(0, 100), F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("ratio is neither 0 nor 100: "), r.cast("string"))).cast("boolean")
            )
        )
        pairs = [(0, 100)]
    counts = bags.groupBy(r.alias("_r"), F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("_c"))
    if pairs is None:
        seen = counts.agg(F.sort_array(F.collect_set("_r")).alias("_seen"))
        listed = F.col("_seen")
        counts = counts.withColumn("_seen", seen.scalar())
    else:
        listed = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in pairs])
    if pairs is None:
        partners = F.transform(
            F.filter(listed, lambda o: o != F.col("_r")),
            lambda o: F.struct(F.least(o, F.col("_r")).alias("low"), F.greatest(o, F.col("_r")).alias("high")),
        )
    else:
        partners = F.filter(listed, lambda q: (q["low"] == F.col("_r")) | (q["high"] == F.col("_r")))
    spread = counts.select("_r", "score", "_c", F.explode(partners).alias("_pair")).select(
        F.col("_pair.low").alias("low_ratio"),
        F.col("_pair.high").alias("high_ratio"),
        "score",
        F.when(F.col("_r") == F.col("_pair.high"), F.col("_c")).otherwise(0).alias("p"),
        F.when(F.col("_r") == F.col("_pair.low"), F.col("_c")).otherwise(0).alias("n"),
    )
    by = ["low_ratio", "high_ratio"]
    hist = spread.groupBy(*by, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return auc_summary(cumulate(hist, by), by).select(
        *by, F.col("negatives").alias("low_bags"), F.col("positives").alias("high_bags"), "roc_auc", "pr_auc_trapezoid"
    )


def monotonicity(
    groups: DataFrame, ratio_col: str, value: str, expected: Sequence[float] | None = None, slack: float = 1e-8
) -> DataFrame:
    """Per ratio whether its value is not below the previous one, whether all steps are, and whether the grid is complete.

    The input is one row per mixture ratio, so a single window over it is small by construction.
    """
    w = Window.orderBy(ratio_col)
    steps = groups.select(
        F.col(ratio_col),
        F.col(value),
        F.lag(value).over(w).alias("previous"),
    ).withColumn("step_ok", F.col("previous").isNull() | (F.col(value) + slack >= F.col("previous")))
    everything = Window.partitionBy()
    out = steps.withColumn("monotonic", F.min("step_ok").over(everything))
    if expected is not None:
        want = F.array(*[F.lit(float(x)) for x in expected])
        have = F.collect_set(F.col(ratio_col).cast("double")).over(everything)
        out = out.withColumn(
            "grid_complete", (F.size(F.array_except(want, have)) == 0) & (F.size(F.array_except(have, want)) == 0)
        )
    return out


def fold_metrics(
    predictions: DataFrame,
    folds: DataFrame,
    fold: str = "fold",
    group: str = "motif",
    label: str = "y",
    score: str = "score",
    threshold: float = 0.5,
    source: str | None = None,
) -> DataFrame:
    """Metrics of each fold over the rows of its own held-out group, pooled over all runs; empty folds give NULLs.

    Scanned rows are counted per (fold, source, own group or not) in a partial aggregate first, so the rows of a tree in which every
    fold lists every source are never shuffled, and sources are told apart among these counts.
    """
    rows = predictions.where(F.col(fold) == F.col(group))
    metrics = grouped_metrics(rows, [[fold]], threshold, label, score).drop("group_by")
    own = F.col(fold) == F.col(group)
    counts = predictions.groupBy(fold, *([source] if source else []), own.alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    scanned = counts.groupBy(fold).agg(
        F.sum("_n").alias("scanned_rows"),
        *([F.count_distinct(source).alias("dirs_found"),
           F.count_distinct(F.when(F.col("_own"), F.col(source))).alias("dirs_used")] if source else []),
    )
    base = folds.select(fold).distinct()
    return base.join(scanned, fold, "left").join(metrics, fold, "left")


