"""Descriptive profiles, distribution shifts, count tables and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import IGNORE, MODIFIED
from ..ordering import attach, ordered_prefix, quantiles
from .metrics import ratio


def finite(c: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _long_numeric(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    slim = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return slim.unpivot(list(keep), list(cols), "column", "value").withColumn("value", finite(F.col("value")))


def _long_text(df: DataFrame, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    slim = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in fields])
    return slim.unpivot(list(keep), list(fields), "field", "value")


def numeric_profile(df: DataFrame, group: Sequence[str], cols: Sequence[str], approx: bool = False) -> DataFrame:
    """count, finite, mean, std (population), min, max and p10/median/p90 per group and column over finite values."""
    rows = _long_numeric(df, group, cols)
    by = [*group, "column"]
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.count("value").alias("finite"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return attach(stats, quantiles(rows, "value", {"p10": 0.1, "median": 0.5, "p90": 0.9}, by, approx), by, "left")


def bag_size_profile(df: DataFrame, group: Sequence[str], bag: str) -> DataFrame:
    """Reads, bags and the spread of bag sizes per group."""
    sizes = df.groupBy(*group, bag).agg(F.count(F.lit(1)).alias("size"))
    stats = sizes.groupBy(*group).agg(
        F.sum("size").alias("reads"), F.count(F.lit(1)).alias("bags"), F.avg("size").alias("mean_bag_size"),
        F.min("size").alias("min_bag_size"), F.max("size").alias("max_bag_size"),
    )
    return attach(stats, quantiles(sizes, "size", {"median_bag_size": 0.5}, group), list(group))


# The levels of the score summary.
SUMMARY_LEVELS = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}


def quantile_summary(df: DataFrame, col: str, by: Sequence[str] = (), levels=None, approx: bool = False) -> DataFrame:
    """Mean, minimum, quantiles and maximum; one row of NULLs for no data (global form)."""
    base = df.groupBy(*by).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max")
    )
    return attach(base, quantiles(df, col, levels or SUMMARY_LEVELS, by, approx), list(by), "left")


def category_top_k(df: DataFrame, group: Sequence[str], fields: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values per group and field (ties by value) with their share of the group's rows.

    The share's denominator and the ranking come from the counted table, which is ranked by prefix sums in bounded
    buckets, so a field with very many values does not end in one task.
    """
    counts = _long_text(df, group, fields).groupBy(*group, "field", "value").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = ordered_prefix(counts, [-F.col("count"), F.coalesce("value", F.lit(""))], ["_one", "count"], [*group, "field"])
    return ranked.where(F.col("_one_before") < k).select(
        *group, "field", "value", "count", (F.col("_one_before") + 1).alias("rank"), (F.col("count") / F.col("count_total")).alias("fraction")
    )


def value_fractions(df: DataFrame, side: str, left, right, fields: Sequence[str]) -> DataFrame:
    """Per field and value the share of rows on either side; the input of distance and enrichment."""
    rows = _long_text(df.where(F.col(side).isin(left, right)), [side], fields)
    per = rows.groupBy("field", "value").agg(
        F.count_if(F.col(side) == left).alias("left_count"), F.count_if(F.col(side) == right).alias("right_count")
    )
    # every row has one value per field, so the row counts of the sides are the same for all fields
    size = per.groupBy("field").agg(F.sum("left_count").alias("_l"), F.sum("right_count").alias("_r"))
    return attach(per, size, ["field"]).select(
        "field", "value", "left_count", "right_count",
        ratio(F.col("left_count"), F.col("_l"), None).alias("left_fraction"),
        ratio(F.col("right_count"), F.col("_r"), None).alias("right_fraction"),
    )


def distribution_distance(df: DataFrame, side: str, left, right, fields: Sequence[str]) -> DataFrame:
    """Total variation distance and overlap per field; NULL when a side is empty."""
    p, q = F.col("left_fraction"), F.col("right_fraction")
    return value_fractions(df, side, left, right, fields).groupBy("field").agg(
        (F.sum(F.abs(p - q)) * 0.5).alias("total_variation"),
        F.sum(F.when(p.isNotNull() & q.isNotNull(), F.least(p, q))).alias("overlap"),
        F.count(F.lit(1)).alias("values"),
    )


def category_enrichment(df: DataFrame, side: str, left, right, fields: Sequence[str], k: int) -> DataFrame:
    """The k values per field whose shares differ most (ties by value)."""
    rows = value_fractions(df, side, left, right, fields).withColumn(
        "delta", F.col("right_fraction") - F.col("left_fraction")
    )
    rows = rows.withColumn("_one", F.lit(1).cast("bigint"))
    key = [-F.abs(F.coalesce("delta", F.lit(0.0))), F.coalesce("value", F.lit(""))]
    return ordered_prefix(rows, key, ["_one"], ["field"]).where(F.col("_one_before") < k).select(
        "field", "value", "left_count", "right_count", "left_fraction", "right_fraction", "delta", (F.col("_one_before") + 1).alias("rank")
    )


def numeric_shift(df: DataFrame, side: str, left, right, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Means, medians, their differences and the standardised mean difference (pooled population variance)."""
    rows = _long_numeric(df.where(F.col(side).isin(left, right)), [side], cols)
    is_l = F.col(side) == left
    v = F.col("value")
    stats = rows.groupBy("column").agg(
        F.avg(F.when(is_l, v)).alias("left_mean"), F.avg(F.when(~is_l, v)).alias("right_mean"),
        F.var_pop(F.when(is_l, v)).alias("_lv"), F.var_pop(F.when(~is_l, v)).alias("_rv"),
    )
    med = quantiles(rows, "value", {"m": 0.5}, ["column", side], approx).groupBy("column").agg(
        F.max(F.when(is_l, F.col("m"))).alias("left_median"), F.max(F.when(~is_l, F.col("m"))).alias("right_median")
    )
    pooled = F.sqrt((F.col("_lv") + F.col("_rv")) / 2.0)
    delta = F.col("right_mean") - F.col("left_mean")
    return attach(stats, med, ["column"], "left").select(
        "column", "left_mean", "right_mean", "left_median", "right_median", delta.alias("mean_delta"),
        (F.col("right_median") - F.col("left_median")).alias("median_delta"),
        F.when(pooled > 0, delta / pooled).alias("standardized_mean_difference"),
    )


CLASSES = ("positive", "negative", "mixed", "unlabeled")


def class_balance(df: DataFrame, group: Sequence[str], cls: str = "class") -> DataFrame:
    """Counts per class and the positive/negative ratio (NULL without negatives)."""
    return df.groupBy(*group).agg(
        *[F.count_if(F.col(cls) == c).alias(c) for c in CLASSES], F.count(F.lit(1)).alias("total")
    ).withColumn("pos_neg_ratio", ratio(F.col("positive"), F.col("negative"), None))


def class_group_counts(df: DataFrame, fields: Sequence[str], motif: str = "motif", cls: str = "class") -> DataFrame:
    return _long_text(df, [motif, cls], fields).groupBy(motif, cls, "field", "value").agg(F.count(F.lit(1)).alias("count"))


def count_matrix(
    df: DataFrame, row: str, col: str, columns: Sequence[str], rows: Sequence[str] | None = None, other: str | None = None
) -> DataFrame:
    """Pivot of counts with 0 for empty cells; the column order is fixed, ``rows`` adds rows that have no data.

    Every row is counted: ``other`` names a column for values (and NULL) that are not listed; without it an unlisted
    value stops the query.
    """
    listed = F.coalesce(F.col(col).isin(*columns), F.lit(False))
    cells = [F.count_if(F.col(col) == c).alias(c) for c in columns]
    rest = F.count_if(~listed)
    checked = F.when(rest > 0, F.raise_error(F.concat(F.lit("values without a column in "), F.lit(col)))).otherwise(0)
    out = df.groupBy(row).agg(*cells, rest.alias(other) if other else checked.cast("int").alias("_checked"))
    names = [*columns, other] if other else list(columns)
    if not other:
        out = out.where("_checked = 0").drop("_checked")
    if rows is not None:
        axis = df.sparkSession.createDataFrame([(r,) for r in rows], f"{row} string")
        out = axis.unionByName(out.select(row)).distinct().join(out, row, "left")
    return out.fillna(0, subset=names)


def label_inventory(df: DataFrame, ref: str = "reference", target: str = "target", ignore: int = IGNORE) -> DataFrame:
    """Base, canonical-label, modified and ignored totals: arrays fold inside the row, then one global sum."""

    def hits(array: str, value: int) -> Column:
        return F.sum(F.size(F.filter(array, lambda x: x == value)).cast("bigint"))

    return df.agg(
        *[hits(ref, i + 1).alias(f"base_{b}") for i, b in enumerate("ACGT")],
        *[hits(target, i).alias(f"canonical_{b}") for i, b in enumerate("ACGT")],
        hits(target, MODIFIED).alias("modified"),
        hits(target, ignore).alias("ignored"),
    )


def histogram(df: DataFrame, col: str, bins: int, low: float | None = None, high: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bin counts; the last bin is closed. Without limits the data range is used.

    With limits, values below ``low`` count in bin -1 and values above ``high`` in bin ``bins``, whose left edges are
    NULL and ``high``.
    """
    x = F.col(col).cast("double")
    rows = df.where(x.isNotNull())
    if low is None or high is None:
        span = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        lo = F.lit(float(low)) if low is not None else span.select("lo").scalar()
        hi = F.lit(float(high)) if high is not None else span.select("hi").scalar()
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    rows = rows.select(*by, x.alias("_x"), lo.alias("_lo"), hi.alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    inner = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    at = F.when(F.col("_x") < F.col("_lo"), -1).when(F.col("_x") > F.col("_hi"), bins).otherwise(inner)
    return rows.groupBy(*by, at.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.max(F.col("_lo")).alias("_l"), F.max(width).alias("_w")
    ).select(*by, "bin", F.when(F.col("bin") >= 0, F.col("_l") + F.col("bin") * F.col("_w")).alias("left_edge"), "count")


def survival(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Complementary ECDF per distinct score: the share of rows strictly above it."""
    hist = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    out = ordered_prefix(hist, [F.col("score")], ["rows"], by)
    above = F.col("rows_total") - F.col("rows_before") - F.col("rows")
    return out.select(*by, "score", "rows", (above / F.col("rows_total")).alias("survival"))


def history_summary(history: DataFrame, run: str = "run", epoch: str = "epoch", train: str = "train_loss", valid: str = "valid_loss") -> DataFrame:
    """Best epoch (smallest validation loss, earliest on ties), last epoch and its train/validation gap per run."""
    rows = history.where(F.col(epoch).isNotNull())
    entry = F.struct(F.col(epoch).alias("epoch"), F.col(train).alias("train"), F.col(valid).alias("valid"))
    best = F.min_by(entry, F.when(F.col(valid).isNotNull(), F.struct(F.col(valid), F.col(epoch))))
    out = rows.groupBy(run).agg(best.alias("b"), F.max_by(entry, F.col(epoch)).alias("l"), F.count(F.lit(1)).alias("epochs"))
    return out.select(
        run, "epochs", F.col("b.epoch").alias("best_epoch"), F.col("b.valid").alias("best_valid_loss"),
        F.col("l.epoch").alias("last_epoch"), F.col("l.train").alias("last_train_loss"), F.col("l.valid").alias("last_valid_loss"),
        (F.col("l.train") - F.col("l.valid")).alias("train_valid_gap"),
    )


# Fixed values: (moderate, severe) drop of a metric between internal and held-out data.
GAP_BANDS = {
    "roc_auc": (0.05, 0.15),
    "recall": (0.2, 0.5),
    "specificity": (0.1, 0.3),
}


def generalization_gap(internal: DataFrame, heldout: DataFrame, key: str, metrics: Sequence[str], support: DataFrame | None = None) -> DataFrame:
    """Per key the drop of each metric from internal to held-out data, a band flag, and seen/unseen by train support."""
    a = internal.select(key, *[F.col(m).alias(f"{m}_internal") for m in metrics])
    b = heldout.select(key, *[F.col(m).alias(f"{m}_heldout") for m in metrics])
    out = a.join(b, key)
    for m in metrics:
        drop = F.col(f"{m}_internal") - F.col(f"{m}_heldout")
        moderate, severe = GAP_BANDS.get(m, GAP_BANDS["roc_auc"])
        flag = F.when(drop > severe, F.lit("severe")).when(drop > moderate, F.lit("moderate"))
        out = out.withColumn(f"{m}_drop", drop).withColumn(f"{m}_flag", flag.when(drop.isNotNull(), F.lit("small")))
    if support is not None:
        out = out.join(support.select(key, "train_support"), key, "left").withColumn("train_support", F.coalesce("train_support", F.lit(0)))
        out = out.withColumn("seen", F.when(F.col("train_support") > 0, F.lit("seen")).otherwise(F.lit("unseen")))
    return out


