"""Queries: site statistics, read and bag scores, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bags as B
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import sites as S
from .registry import query, rounded

SITES_SQL = """
sites AS (SELECT contig, pos, strand, count(*) AS coverage, count(prob) AS num_mod_calls,
    CAST(coalesce(sum(CAST(round(prob*10) AS BIGINT)), 0) AS BIGINT) AS tenths
  FROM v_calls GROUP BY ALL),
scores AS (SELECT contig, pos, strand, coverage, num_mod_calls, num_mod_calls/coverage::DOUBLE AS mod_fraction,
    (tenths*1e-1)/coverage AS mean_prob_zero_filled,
    CASE WHEN num_mod_calls > 0 THEN (tenths*1e-1)/num_mod_calls END AS mean_called_prob FROM sites)
"""


def site_table(get, **kw):
    return S.site_stats(get("v_calls"), exact_sum=0.1, **kw)


@query(
    "a1_site_stats",
    f"""WITH {SITES_SQL}, med AS (SELECT contig, pos, strand, quantile_cont(prob, 0.5) AS m FROM v_calls GROUP BY ALL)
    SELECT s.*, round(m, 6) AS median_called_prob, mean_prob_zero_filled AS score,
      CAST(mean_prob_zero_filled >= 0.3 AS INT) AS predicted
    FROM scores s JOIN med USING (contig, pos, strand)""",
)
def _(get, spark):
    return rounded(site_table(get, threshold=0.3, median="exact"), "median_called_prob")


@query(
    "a2_collapse_strand",
    """SELECT contig, pos, '.' AS strand, count(*) AS coverage, count(prob) AS num_mod_calls,
      (CAST(sum(CAST(round(prob*10) AS BIGINT)) AS BIGINT)*1e-1)/count(prob) AS mean_called_prob
    FROM v_calls GROUP BY contig, pos""",
)
def _(get, spark):
    out = S.site_stats(S.collapse_strand(get("v_calls")), exact_sum=0.1)
    return out.select(*S.SITE, "coverage", "num_mod_calls", "mean_called_prob")


@query(
    "j1_label_sites",
    f"""WITH {SITES_SQL} SELECT s.contig, s.pos, s.strand, coverage, mean_prob_zero_filled AS score,
      CAST(g.pos IS NOT NULL AS INT) AS is_gold, g.name AS gold_name, g.support AS gold_support
    FROM scores s LEFT JOIN v_gold g USING (contig, pos, strand) WHERE coverage >= 5""",
)
def _(get, spark):
    sites = S.min_coverage(site_table(get), 5)
    return S.label_sites(sites, get("v_gold")).select(*S.SITE, "coverage", "score", "is_gold", "gold_name", "gold_support")


@query(
    "j2_coverage_counts",
    f"""WITH {SITES_SQL} SELECT count(*) AS gold_total, count(coverage) AS covered,
      count(CASE WHEN coverage >= 8 THEN 1 END) AS covered_after_filter, count(CASE WHEN coverage IS NULL THEN 1 END) AS uncovered
    FROM v_gold LEFT JOIN scores USING (contig, pos, strand)""",
)
def _(get, spark):
    return S.coverage_counts(site_table(get), get("v_gold"), 8)


@query(
    "j2_gold_overlap",
    """WITH a AS (SELECT DISTINCT contig, pos, strand FROM v_calls), b AS (SELECT contig, pos, strand FROM v_gold)
    SELECT 'shared' AS kind, count(*) AS sites FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'gold_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    UNION ALL SELECT 'sites_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def _(get, spark):
    return S.gold_overlap(get("v_calls"), get("v_gold"))


@query("f7_min_coverage", f"WITH {SITES_SQL} SELECT contig, pos, strand, coverage FROM scores WHERE coverage >= 15")
def _(get, spark):
    return S.min_coverage(site_table(get), 15).select(*S.SITE, "coverage")


@query(
    "j13_convention_sweep",
    """WITH cov AS (SELECT contig, pos, strand, count(*) AS coverage,
        (CAST(coalesce(sum(CAST(round(prob*10) AS BIGINT)),0) AS BIGINT)*1e-1)/count(*) AS score FROM v_calls GROUP BY ALL),
      flat AS (SELECT contig, pos, '.' AS strand, count(*) AS coverage,
        (CAST(coalesce(sum(CAST(round(prob*10) AS BIGINT)),0) AS BIGINT)*1e-1)/count(*) AS score FROM v_calls GROUP BY contig, pos),
      grid AS (SELECT c.convention, s.shift FROM (VALUES ('as_is'),('flip'),('ignore'),('either')) c(convention), (VALUES (-5),(0),(5)) s(shift)),
      moved AS (SELECT DISTINCT convention, shift, contig, pos + shift AS pos,
        unnest(CASE convention WHEN 'ignore' THEN ['.'] WHEN 'either' THEN ['+','-']
          WHEN 'flip' THEN [CASE strand WHEN '+' THEN '-' ELSE '+' END] ELSE [strand] END) AS strand
        FROM v_gold, grid WHERE pos + shift >= 0),
      sites AS (SELECT convention, shift, cov.* FROM grid, cov WHERE convention <> 'ignore'
        UNION ALL SELECT convention, shift, flat.* FROM grid, flat WHERE convention = 'ignore'),
      l AS (SELECT s.*, CAST(m.pos IS NOT NULL AS INT) AS y FROM sites s LEFT JOIN moved m USING (convention, shift, contig, pos, strand) WHERE coverage >= 5),
      r AS (SELECT *, row_number() OVER (PARTITION BY convention, shift ORDER BY score DESC, contig, pos, strand) AS rn FROM l),
      h AS (SELECT convention, shift, score, sum(y) AS p, sum(1-y) AS n FROM l GROUP BY ALL),
      c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM h WINDOW w AS (PARTITION BY convention, shift ORDER BY score DESC)),
      a AS (SELECT convention, shift, CAST(sum(p) AS BIGINT) AS evaluated_gold_sites, CAST(sum(n) AS BIGINT) AS evaluated_negative_sites,
          sum(n*(2*(tp-p)+p))::DOUBLE/(2*sum(p)*sum(n))::DOUBLE AS roc_auc, round(sum(p*(tp/(tp+fp)::DOUBLE))/sum(p), 6) AS average_precision,
          sum(p) FILTER (score >= 0.3) AS tp3, sum(n) FILTER (score >= 0.3) AS fp3 FROM c GROUP BY ALL),
      t AS (SELECT convention, shift, sum(y) FILTER (rn <= 100)/least(count(*), 100)::DOUBLE AS top100_gold_fraction,
          sum(y) FILTER (rn <= 500)/least(count(*), 500)::DOUBLE AS top500_gold_fraction,
          sum(y) FILTER (rn <= 1000)/least(count(*), 1000)::DOUBLE AS top1000_gold_fraction FROM r GROUP BY ALL),
      g AS (SELECT m.convention, m.shift, count(*) AS gold_sites, count(x.pos) AS covered_before_filter
        FROM moved m LEFT JOIN sites x USING (convention, shift, contig, pos, strand) GROUP BY ALL)
    SELECT convention, shift, gold_sites, covered_before_filter, evaluated_gold_sites, evaluated_negative_sites, roc_auc, average_precision,
      round(tp3/(tp3+fp3)::DOUBLE, 6) AS precision, round(tp3/evaluated_gold_sites::DOUBLE, 6) AS recall,
      round(2*tp3/(tp3+fp3+evaluated_gold_sites)::DOUBLE, 6) AS f1, top100_gold_fraction, top500_gold_fraction, top1000_gold_fraction
    FROM g JOIN a USING (convention, shift) JOIN t USING (convention, shift)""",
)
def _(get, spark):
    out = S.convention_sweep(get("v_calls"), get("v_gold"), [-5, 0, 5], floor=5, threshold=0.3, exact_sum=0.1)
    return rounded(out, "average_precision", "precision", "recall", "f1")


@query(
    "a3_read_scores",
    """SELECT read_id, round(avg(prob), 6) AS read_score, count(*) AS num_sites FROM v_calls WHERE prob IS NOT NULL GROUP BY 1""",
)
def _(get, spark):
    return rounded(S.read_scores(get("v_calls")), "read_score")


BAGS_SQL = """bags AS (SELECT contig AS bag_key, ratio AS target_fraction, avg(prob) AS bag_score, count(*) AS num_reads
  FROM v_samples GROUP BY ALL)"""


def bag_table(get):
    """Bags = (contig, ratio); the key is one string."""
    rows = get("v_samples").withColumn("bag_key", F.concat_ws("/", "contig", "ratio_label"))
    return B.bag_scores(rows, score="prob", target="ratio")


@query(
    "a4_bag_scores",
    """SELECT concat_ws('/', contig, ratio_label) AS bag_key, avg(ratio) AS target_fraction, round(avg(prob), 6) AS bag_score,
      count(*) AS num_reads, avg(ratio)*100 AS target_ratio FROM v_samples GROUP BY 1""",
)
def _(get, spark):
    return rounded(bag_table(get), "bag_score")


@query(
    "a4_fallback_bags",
    """SELECT CAST(floor(sample_id/250) AS BIGINT) AS bag_key, 0.5::DOUBLE AS target_fraction, round(avg(prob), 6) AS bag_score,
      count(*) AS num_reads, 50.0::DOUBLE AS target_ratio FROM v_samples GROUP BY 1""",
)
def _(get, spark):
    rows = get("v_samples").withColumn("bag_key", B.fallback_bag_key(F.col("sample_id"), 250))
    return rounded(B.bag_scores(rows, score="prob", target=0.5), "bag_score")


@query(
    "a15_ratio_calibration",
    f"""WITH {BAGS_SQL}, x AS (SELECT target_fraction AS ratio, * FROM bags UNION ALL SELECT NULL, * FROM bags)
    SELECT ratio, count(*) AS bags, round(avg(bag_score),6) AS mean_score, round(avg(abs(bag_score-target_fraction)),6) AS mae,
      round(sqrt(avg((bag_score-target_fraction)*(bag_score-target_fraction))),6) AS rmse, round(avg(bag_score-target_fraction),6) AS bias,
      CASE WHEN ratio IS NULL THEN round(corr(bag_score, target_fraction),6) END AS corr, round(quantile_cont(bag_score,0.1),6) AS p10,
      round(quantile_cont(bag_score,0.5),6) AS median, round(quantile_cont(bag_score,0.9),6) AS p90 FROM x GROUP BY ratio""",
)
def _(get, spark):
    return rounded(B.ratio_calibration(bag_table(get)), "mean_score", "mae", "rmse", "bias", "corr", "p10", "median", "p90")


@query(
    "a15_bag_report",
    """WITH r AS (SELECT CAST(floor(read_id/10) AS BIGINT) AS read_id, avg(prob) AS s FROM v_calls WHERE prob IS NOT NULL GROUP BY 1),
      b AS (SELECT concat_ws('/', contig, ratio_label) AS bag_key, avg(ratio) AS t, avg(s) AS s FROM r JOIN v_samples ON read_id = sample_id GROUP BY 1),
      x AS (SELECT t AS ratio, * FROM b UNION ALL SELECT NULL, * FROM b),
      k AS (SELECT ratio, count(*) AS bags, avg(s) AS m, round(avg(abs(s-t)),6) AS mae, round(sqrt(avg((s-t)*(s-t))),6) AS rmse, round(avg(s-t),6) AS bias FROM x GROUP BY 1),
      l AS (SELECT ratio, lag(m) OVER (ORDER BY ratio) AS prev, m FROM k WHERE ratio IS NOT NULL)
    SELECT k.ratio, bags, round(k.m,6) AS mean_score, mae, rmse, bias, round(prev,6) AS previous,
      CASE WHEN k.ratio IS NOT NULL THEN prev IS NULL OR l.m + 1e-8 >= prev END AS step_ok,
      CASE WHEN k.ratio IS NOT NULL THEN (SELECT bool_and(prev IS NULL OR m + 1e-8 >= prev) FROM l) END AS monotonic FROM k LEFT JOIN l ON k.ratio = l.ratio""",
)
def _(get, spark):
    """Orders as reads, their line items as sites."""
    calls = get("v_calls").withColumn("read_id", F.floor(F.col("read_id") / 10))
    samples = get("v_samples").select(F.col("sample_id").alias("read_id"), F.concat_ws("/", "contig", "ratio_label").alias("bag_key"), "ratio")
    out = B.bag_report(calls, samples).select("ratio", "bags", "mean_score", "mae", "rmse", "bias", "previous", "step_ok", "monotonic")
    return rounded(out, "mean_score", "mae", "rmse", "bias", "previous")


@query(
    "a16_proportion_loss",
    f"""WITH {BAGS_SQL}, x AS (SELECT bag_score AS p, target_fraction AS t, greatest(0, least(1, target_fraction-0.05)) AS lo,
        greatest(0, least(1, target_fraction+0.05)) AS hi FROM bags),
      e AS (SELECT p, greatest(lo, least(hi, p)) AS t2, CASE WHEN p < lo OR p > hi THEN 1.0 ELSE 0.0 END AS w, greatest(1e-6, least(1-1e-6, p)) AS q FROM x)
    SELECT 'bce' AS kind, round(avg(-(t2*ln(q)+(1-t2)*ln(1-q))*w),6) AS loss, count(*) AS bags FROM e
    UNION ALL SELECT 'mse', round(avg((p-t2)*(p-t2)),6), count(*) FROM e
    UNION ALL SELECT 'huber', round(avg(CASE WHEN abs(p-t2) <= 0.1 THEN 0.5*(p-t2)*(p-t2) ELSE 0.1*(abs(p-t2)-0.05) END),6), count(*) FROM e""",
)
def _(get, spark):
    bags = bag_table(get)
    parts = [
        B.proportion_loss(bags, kind, 0.05, 0.1).select(F.lit(kind).alias("kind"), "loss", "bags") for kind in B.LOSSES
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "loss")


@query(
    "m15_monotonicity",
    """WITH g AS (SELECT ratio*100 AS target_ratio, avg(prob) AS s FROM v_samples GROUP BY 1),
      l AS (SELECT *, lag(s) OVER (ORDER BY target_ratio) AS prev FROM g)
    SELECT target_ratio, round(s,6) AS mean_score, round(prev,6) AS previous, (prev IS NULL OR s + 1e-8 >= prev) AS step_ok,
      (SELECT bool_and(prev IS NULL OR s + 1e-8 >= prev) FROM l) AS monotonic, false AS grid_complete FROM l""",
)
def _(get, spark):
    groups = get("v_samples").groupBy((F.col("ratio") * 100).alias("target_ratio")).agg(F.avg("prob").alias("mean_score"))
    return rounded(M.monotonicity(groups, "target_ratio", "mean_score", [0, 25, 50, 75, 100]), "mean_score", "previous")


@query(
    "m14_pairwise_ratio_roc",
    """WITH b AS (SELECT ratio_label, prob FROM v_samples), q AS (SELECT DISTINCT ratio_label AS r FROM b),
      pairs AS (SELECT a.r AS lo, c.r AS hi FROM q a JOIN q c ON a.r < c.r),
      h AS (SELECT lo, hi, prob AS score, count(CASE WHEN ratio_label = hi THEN 1 END) AS p, count(CASE WHEN ratio_label = lo THEN 1 END) AS n
        FROM pairs JOIN b ON ratio_label IN (lo, hi) GROUP BY ALL),
      c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM h WINDOW w AS (PARTITION BY lo, hi ORDER BY score DESC))
    SELECT lo AS low_ratio, hi AS high_ratio, CAST(sum(n) AS BIGINT) AS low_bags, CAST(sum(p) AS BIGINT) AS high_bags,
      sum(n*(2*(tp-p)+p))::DOUBLE/(2*sum(p)*sum(n))::DOUBLE AS roc_auc,
      round(sum(p*(tp/(tp+fp)::DOUBLE + CASE WHEN tp-p+fp-n > 0 THEN (tp-p)/(tp-p+fp-n)::DOUBLE ELSE 1 END)/2)/sum(p),6) AS pr_auc_trapezoid
    FROM c GROUP BY ALL""",
)
def _(get, spark):
    return rounded(M.pairwise_ratio_roc(get("v_samples"), "ratio_label", "prob"), "pr_auc_trapezoid")


CUM_SQL = """h AS (SELECT score, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1-y) AS BIGINT) AS n FROM v_scored GROUP BY 1),
  c AS (SELECT *, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp,
    CAST(sum(p) OVER () AS BIGINT) AS pos, CAST(sum(n) OVER () AS BIGINT) AS neg FROM h WINDOW w AS (ORDER BY score DESC))"""


def cum(get):
    return M.cumulate(M.score_histogram(get("v_scored")))


@query(
    "m1_score_histogram",
    f"WITH {CUM_SQL} SELECT score, p, n, tp - p AS tp_before, fp - n AS fp_before, tp, fp, pos AS positives, neg AS negatives FROM c",
)
def _(get, spark):
    return cum(get)


@query(
    "m1_cumulate_by_motif",
    """WITH h AS (SELECT motif, score, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1-y) AS BIGINT) AS n FROM v_scored GROUP BY ALL)
    SELECT motif, score, p, n, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM h
    WINDOW w AS (PARTITION BY motif ORDER BY score DESC)""",
)
def _(get, spark):
    hist = M.score_histogram(get("v_scored"), by=["motif"])
    return M.cumulate(hist, ["motif"]).select("motif", "score", "p", "n", "tp", "fp")


RATES_SQL = """(tp+tn)/(tp+tn+fp+fn)::DOUBLE AS accuracy, (tp/(tp+fn)::DOUBLE + tn/(tn+fp)::DOUBLE)/2 AS balanced_accuracy,
  CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp)::DOUBLE END AS precision, tp/(tp+fn)::DOUBLE AS recall, tn/(tn+fp)::DOUBLE AS specificity,
  CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn)::DOUBLE END AS f1, fp/(fp+tn)::DOUBLE AS fpr,
  CASE WHEN tp+fp=0 THEN 0 ELSE fp/(tp+fp)::DOUBLE END AS fdr, (tp+fn)/(tp+tn+fp+fn)::DOUBLE AS positive_rate,
  (tp+fp)/(tp+tn+fp+fn)::DOUBLE AS predicted_positive_rate"""


@query(
    "m2_threshold_metrics",
    f"""WITH k AS (SELECT motif, count(CASE WHEN y=1 AND score>=0.5 THEN 1 END) AS tp, count(CASE WHEN y=0 AND score<0.5 THEN 1 END) AS tn,
      count(CASE WHEN y=0 AND score>=0.5 THEN 1 END) AS fp, count(CASE WHEN y=1 AND score<0.5 THEN 1 END) AS fn FROM v_scored GROUP BY 1)
    SELECT motif, tp, tn, fp, fn, {RATES_SQL} FROM k""",
)
def _(get, spark):
    return M.threshold_metrics(get("v_scored"), 0.5, by=["motif"])


@query(
    "m3_probability_profile",
    """SELECT motif, count(*) AS num_sites,
      round(avg(-CASE WHEN y=1 THEN ln(greatest(1e-7, least(1-1e-7, score))) ELSE ln(1-greatest(1e-7, least(1-1e-7, score))) END),6) AS bce,
      round(avg(score),6) AS mean_prob, round(avg(score) FILTER (y=1),6) AS mean_positive_prob, round(avg(score) FILTER (y=0),6) AS mean_negative_prob,
      round(quantile_cont(score,0.5),6) AS median_prob, round(quantile_cont(score,0.5) FILTER (y=1),6) AS median_positive_prob,
      round(quantile_cont(score,0.5) FILTER (y=0),6) AS median_negative_prob, round(quantile_cont(score,0.05) FILTER (y=1),6) AS positive_q05,
      round(quantile_cont(score,0.95) FILTER (y=0),6) AS negative_q95 FROM v_scored GROUP BY 1""",
)
def _(get, spark):
    out = M.probability_profile(get("v_scored"), by=["motif"])
    return rounded(out, *[c for c in out.columns if c not in ("motif", "num_sites")])


@query(
    "m4_threshold_sweep",
    f"""WITH t AS (SELECT i/100::DOUBLE AS threshold FROM range(101) r(i)), h AS (SELECT score, sum(y) AS p, sum(1-y) AS n FROM v_scored GROUP BY 1),
      k AS (SELECT threshold, CAST(sum(CASE WHEN score>=threshold THEN p ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN score<threshold THEN n ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN score>=threshold THEN n ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN score<threshold THEN p ELSE 0 END) AS BIGINT) AS fn FROM t, h GROUP BY 1)
    SELECT threshold, tp, tn, fp, fn, {RATES_SQL} FROM k""",
)
def _(get, spark):
    return M.threshold_sweep(get("v_scored"))


@query(
    "m5_roc_curve",
    f"""WITH {CUM_SQL} SELECT NULL::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr
    UNION ALL SELECT score, fp/neg::DOUBLE, tp/pos::DOUBLE FROM c""",
)
def _(get, spark):
    return M.roc_curve(cum(get))


AUC_SQL = """CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
  CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(n*(2*(tp-p)+p))::DOUBLE/(2*sum(p)*sum(n))::DOUBLE END AS roc_auc,
  CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(p*(tp/(tp+fp)::DOUBLE))/sum(p),6) END AS average_precision,
  CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(p*(tp/(tp+fp)::DOUBLE
    + CASE WHEN tp-p+fp-n > 0 THEN (tp-p)/(tp-p+fp-n)::DOUBLE ELSE 1 END)/2)/sum(p),6) END AS pr_auc_trapezoid,
  sum(p)::DOUBLE/(sum(p)+sum(n))::DOUBLE AS prevalence"""


@query("m5_roc_auc", f"WITH {CUM_SQL} SELECT {AUC_SQL} FROM c")
def _(get, spark):
    return rounded(M.auc_summary(cum(get)), "average_precision", "pr_auc_trapezoid")


@query(
    "m5_label_auc",
    f"""WITH h AS (SELECT motif, score, sum(y) AS p, sum(1-y) AS n FROM v_labels GROUP BY ALL),
      c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM h WINDOW w AS (PARTITION BY motif ORDER BY score DESC))
    SELECT motif, {AUC_SQL} FROM c GROUP BY 1""",
)
def _(get, spark):
    hist = M.score_histogram(get("v_labels"), by=["motif"])
    return rounded(M.auc_summary(M.cumulate(hist, ["motif"]), ["motif"]), "average_precision", "pr_auc_trapezoid")


@query(
    "m6_pr_curve",
    f"""WITH {CUM_SQL} SELECT NULL::DOUBLE AS threshold, 0::DOUBLE AS recall, 1::DOUBLE AS precision, max(pos)/(max(pos)+max(neg))::DOUBLE AS baseline FROM c
    UNION ALL SELECT score, tp/pos::DOUBLE, tp/(tp+fp)::DOUBLE, pos/(pos+neg)::DOUBLE FROM c""",
)
def _(get, spark):
    return M.pr_curve(cum(get))


@query(
    "m7_partial_auc",
    f"""WITH {CUM_SQL}, w AS (SELECT *, greatest(0, least(fp::DOUBLE, 0.1*neg) - (fp-n)) AS wd FROM c),
      a AS (SELECT sum(wd*((tp-p) + CASE WHEN n>0 THEN p*wd/n ELSE 0 END/2))/max(pos)/max(neg) AS a FROM w)
    SELECT round(a,6) AS partial_auc, round(0.5*(1+(a-0.005)/(0.1-0.005)),6) AS partial_auc_standardized FROM a""",
)
def _(get, spark):
    return rounded(M.partial_auc(cum(get), 0.1), "partial_auc", "partial_auc_standardized")


@query(
    "m8_tpr_at_fpr",
    f"""WITH {CUM_SQL}, l AS (SELECT unnest([0.0001, 0.001, 0.01, 0.1, 0.5]::DOUBLE[]) AS level),
      b AS (SELECT level, max({{'tp': tp, 's': score, 'pos': pos}}) FILTER (fp/neg::DOUBLE <= level) AS b FROM l, c GROUP BY 1)
    SELECT level, CASE WHEN b IS NULL THEN 0 ELSE b.tp/b.pos::DOUBLE END AS tpr, CASE WHEN b.tp > 0 THEN b.s END AS threshold FROM b""",
)
def _(get, spark):
    return M.tpr_at_fpr(cum(get), [0.0001, 0.001, 0.01, 0.1, 0.5])


RANKED_SQL = """r AS (SELECT prob AS score, CAST(class = 'positive' AS BIGINT) AS y, sample_id FROM v_samples),
  k AS (SELECT *, sum(y) OVER w AS tp, sum(1-y) OVER w AS fp, sum(y) OVER () AS pos FROM r
    WINDOW w AS (ORDER BY score DESC, sample_id ROWS UNBOUNDED PRECEDING))"""


def ranked(get):
    return get("v_samples").select("sample_id", F.col("prob").alias("score"), (F.col("class") == "positive").cast("int").alias("y"))


@query(
    "m9_sensitivity_at_fdr",
    f"""WITH {RANKED_SQL}, l AS (SELECT unnest([0.01, 0.3, 0.4, 0.45, 0.49, 0.6]::DOUBLE[]) AS level)
    SELECT level, coalesce(max(tp) FILTER (fp/(tp+fp)::DOUBLE <= level), 0)/max(pos)::DOUBLE AS sensitivity FROM l, k GROUP BY 1""",
)
def _(get, spark):
    return M.sensitivity_at_fdr(ranked(get), [0.01, 0.3, 0.4, 0.45, 0.49, 0.6], ["sample_id"])


@query(
    "m10_top_n_hits",
    f"""WITH {RANKED_SQL}, t AS (SELECT *, tp+fp AS rn FROM k), l AS (SELECT unnest([100, 500, 1000, 5000]) AS n)
    SELECT n, count(*) AS rows, CAST(sum(y) AS BIGINT) AS hits, sum(y)::DOUBLE/count(*)::DOUBLE AS fraction FROM l JOIN t ON rn <= n GROUP BY 1""",
)
def _(get, spark):
    return M.top_n_hits(ranked(get), [100, 500, 1000, 5000], ["sample_id"])


@query(
    "m11_grouped_metrics",
    f"""WITH g AS (SELECT 'source' AS group_by, source, NULL AS run_id, NULL AS motif, y, score FROM v_scored
        UNION ALL SELECT 'run_id', NULL, run_id, NULL, y, score FROM v_scored UNION ALL SELECT 'motif', NULL, NULL, motif, y, score FROM v_scored
        UNION ALL SELECT 'source+motif', source, NULL, motif, y, score FROM v_scored UNION ALL SELECT 'run_id+motif', NULL, run_id, motif, y, score FROM v_scored),
      h AS (SELECT group_by, source, run_id, motif, score, sum(y) AS p, sum(1-y) AS n FROM g GROUP BY ALL),
      c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM h WINDOW w AS (PARTITION BY group_by, source, run_id, motif ORDER BY score DESC)),
      a AS (SELECT group_by, source, run_id, motif, {AUC_SQL} FROM c GROUP BY ALL),
      k AS (SELECT group_by, source, run_id, motif, count(CASE WHEN y=1 AND score>=0.5 THEN 1 END) AS tp, count(CASE WHEN y=0 AND score<0.5 THEN 1 END) AS tn,
        count(CASE WHEN y=0 AND score>=0.5 THEN 1 END) AS fp, count(CASE WHEN y=1 AND score<0.5 THEN 1 END) AS fn, round(avg(score),12) AS mean_prob,
        round(avg(-CASE WHEN y=1 THEN ln(greatest(1e-7, least(1-1e-7, score))) ELSE ln(1-greatest(1e-7, least(1-1e-7, score))) END),9) AS bce,
        round(avg(score) FILTER (y=1),12) AS mean_positive_prob, round(avg(score) FILTER (y=0),12) AS mean_negative_prob,
        round(quantile_cont(score,0.5),9) AS median_prob, round(quantile_cont(score,0.5) FILTER (y=1),9) AS median_positive_prob,
        round(quantile_cont(score,0.5) FILTER (y=0),9) AS median_negative_prob, round(quantile_cont(score,0.05) FILTER (y=1),9) AS positive_q05,
        round(quantile_cont(score,0.95) FILTER (y=0),9) AS negative_q95 FROM g GROUP BY ALL)
    SELECT k.group_by, k.source, k.run_id, k.motif, tp, tn, fp, fn, {RATES_SQL}, bce, mean_prob, mean_positive_prob, mean_negative_prob,
      median_prob, median_positive_prob, median_negative_prob, positive_q05, negative_q95,
      positives, negatives, roc_auc, average_precision, pr_auc_trapezoid, prevalence
    FROM k JOIN a ON k.group_by = a.group_by AND k.source IS NOT DISTINCT FROM a.source AND k.run_id IS NOT DISTINCT FROM a.run_id
      AND k.motif IS NOT DISTINCT FROM a.motif""",
)
def _(get, spark):
    sets = [["source"], ["run_id"], ["motif"], ["source", "motif"], ["run_id", "motif"]]
    out = M.grouped_metrics(get("v_scored"), sets, zero_division=0.0)
    # scores are thousandths, so a mean over 16 rows is a tie at six digits; twelve keep clear of ties
    out = rounded(out, "mean_prob", "mean_positive_prob", "mean_negative_prob", digits=12)
    out = rounded(out, "bce", *[name for name, _, _ in M.PROFILE_QUANTILES], digits=9)
    return rounded(out, "average_precision", "pr_auc_trapezoid")


@query(
    "m13_negative_control_curve",
    f"""WITH {SITES_SQL}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.8, 0.9, 0.95, 0.99]::DOUBLE[]) AS threshold)
    SELECT threshold, count(*) AS sites, count(CASE WHEN mean_prob_zero_filled >= threshold THEN 1 END) AS false_positive_sites,
      count(CASE WHEN mean_prob_zero_filled >= threshold THEN 1 END)/count(*)::DOUBLE AS false_positive_fraction,
      count(CASE WHEN mean_prob_zero_filled < threshold THEN 1 END)/count(*)::DOUBLE AS specificity FROM t, scores WHERE coverage >= 5 GROUP BY 1""",
)
def _(get, spark):
    sites = S.min_coverage(site_table(get), 5)
    return M.negative_control_curve(sites, [0.1, 0.2, 0.3, 0.5, 0.8, 0.9, 0.95, 0.99])


@query(
    "a21_histogram",
    """SELECT y, CASE WHEN score > 0.9 THEN 18 ELSE CAST(least(floor(score/0.05), 17) AS INT) END AS bin,
      CASE WHEN score > 0.9 THEN 18 ELSE least(floor(score/0.05), 17) END*0.05 AS left_edge, count(*) AS count FROM v_scored GROUP BY ALL""",
)
def _(get, spark):
    return P.histogram(get("v_scored"), "score", 18, 0.0, 0.9, ["y"])


@query(
    "a21_survival",
    """WITH h AS (SELECT y, score, count(*) AS rows FROM v_scored GROUP BY ALL)
    SELECT y, score, rows, (sum(rows) OVER (PARTITION BY y) - sum(rows) OVER (PARTITION BY y ORDER BY score))::DOUBLE
      / (sum(rows) OVER (PARTITION BY y))::DOUBLE AS survival FROM h""",
)
def _(get, spark):
    return P.survival(get("v_scored"), "score", ["y"])


CONTROLS_SQL = """controls AS (SELECT CASE source WHEN 'F' THEN 'ivt' ELSE 'full_mod' END AS dataset, count(*) AS num_sites,
  count(CASE WHEN score < 0.5 THEN 1 END)/count(*)::DOUBLE AS accuracy, count(CASE WHEN score >= 0.5 THEN 1 END)/count(*)::DOUBLE AS recall, avg(score) AS mean_prob,
  quantile_cont(score, 0.5) AS median_prob FROM v_scored GROUP BY 1)"""


@query(
    "a17_control_comparison",
    f"""WITH {CONTROLS_SQL}, x AS (SELECT n.num_sites::DOUBLE AS neg, p.num_sites::DOUBLE AS pos, n.accuracy*n.num_sites AS tn, p.recall*p.num_sites AS tp,
        n.mean_prob AS nm, n.median_prob AS nd, p.mean_prob AS pm, p.median_prob AS pd FROM controls n, controls p WHERE n.dataset='ivt' AND p.dataset='full_mod'),
      y AS (SELECT *, neg-tn AS fp, pos-tp AS fn FROM x)
    SELECT neg AS num_negative_sites, pos AS num_positive_sites, round(tn,6) AS tn, round(fp,6) AS fp, round(tp,6) AS tp, round(fn,6) AS fn,
      round(fp/neg,6) AS fpr, round(fn/pos,6) AS fnr, round(tn/neg,6) AS specificity, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall,
      round(2*tp/(2*tp+fp+fn),6) AS f1, round((tp+tn)/(pos+neg),6) AS accuracy, round(nm,6) AS negative_mean_prob, round(nd,6) AS negative_median_prob,
      round(pm,6) AS positive_mean_prob, round(pd,6) AS positive_median_prob, round(pm-nm,6) AS gap_mean, round(pd-nd,6) AS gap_median FROM y""",
)
def _(get, spark):
    rows = get("v_scored").withColumn("dataset", F.when(F.col("source") == "F", "ivt").otherwise("full_mod"))
    rates = rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("num_sites"),
        (F.count_if(F.col("score") < 0.5) / F.count(F.lit(1))).alias("accuracy"),
        (F.count_if(F.col("score") >= 0.5) / F.count(F.lit(1))).alias("recall"),
    )
    spread = P.quantile_summary(rows, "score", ["dataset"], {"median_prob": 0.5}).select(
        "dataset", F.col("mean").alias("mean_prob"), "median_prob"
    )
    out = B.control_comparison(rates.join(spread, "dataset"))
    return rounded(out, *[c for c in out.columns if not c.startswith("num_")])


RUNS_SQL = """runs AS (SELECT motif, run_id, y, count(CASE WHEN y=1 THEN 1 END) AS num_positive, count(CASE WHEN y=0 THEN 1 END) AS num_negative,
  count(CASE WHEN score >= 0.5 THEN 1 END)/count(*)::DOUBLE AS predicted_positive_rate,
  avg(-CASE WHEN y=1 THEN ln(greatest(1e-7, least(1-1e-7, score))) ELSE ln(1-greatest(1e-7, least(1-1e-7, score))) END) AS bce,
  avg(score) AS mean_prob FROM v_scored GROUP BY motif, run_id, y)"""


def single_class_runs(get):
    rows = get("v_scored")
    keys = ["motif", "run_id", "y"]
    counts = M.threshold_metrics(rows, 0.5, by=keys)
    profile = M.probability_profile(rows, by=keys)
    return counts.join(profile, keys).select(
        *keys, (F.col("tp") + F.col("fn")).alias("num_positive"), (F.col("fp") + F.col("tn")).alias("num_negative"),
        "predicted_positive_rate", "bce", "mean_prob",
    )


@query(
    "a18_pool_single_class",
    f"""WITH {RUNS_SQL}, c AS (SELECT motif, num_positive AS p, num_negative AS n, predicted_positive_rate*(num_positive+num_negative) AS k, bce, mean_prob FROM runs),
      s AS (SELECT motif, sum(p)::DOUBLE AS pos, sum(n)::DOUBLE AS neg, sum(CASE WHEN p>0 THEN k ELSE 0 END) AS tp, sum(CASE WHEN n>0 THEN n-k ELSE 0 END) AS tn,
        sum(bce*(p+n)) AS b, sum(mean_prob*(p+n)) AS m FROM c GROUP BY 1)
    SELECT motif, pos AS num_positive, neg AS num_negative, pos+neg AS num_sites, round(tp/pos,6) AS recall, round(tn/neg,6) AS specificity,
      round((tp/pos+tn/neg)/2,6) AS balanced_accuracy, round((tp+tn)/(pos+neg),6) AS accuracy, round(b/(pos+neg),6) AS bce, round(m/(pos+neg),6) AS mean_prob FROM s""",
)
def _(get, spark):
    out = B.pool_single_class(single_class_runs(get), ["motif"])
    return rounded(out, "recall", "specificity", "balanced_accuracy", "accuracy", "bce", "mean_prob")


@query(
    "a18_single_class_rate",
    f"""WITH {RUNS_SQL} SELECT motif, run_id, y, CASE WHEN num_positive > 0 THEN 'recall' ELSE 'specificity' END AS rate_kind,
      round(CASE WHEN num_positive > 0 THEN predicted_positive_rate ELSE 1-predicted_positive_rate END,6) AS rate FROM runs""",
)
def _(get, spark):
    return rounded(B.single_class_rate(single_class_runs(get)).select("motif", "run_id", "y", "rate_kind", "rate"), "rate")


@query(
    "m16_fold_metrics",
    f"""WITH f AS (SELECT concat('r', CAST(i AS STRING)) AS run_id, m AS fold FROM range(10) t(i), (SELECT DISTINCT motif AS m FROM v_scored)),
      t AS (SELECT fold, v.motif, v.run_id, y, score FROM v_scored v JOIN f USING (run_id)),
      u AS (SELECT * FROM t WHERE fold = motif), h AS (SELECT fold, score, sum(y) AS p, sum(1-y) AS n FROM u GROUP BY ALL),
      c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM h WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
      a AS (SELECT fold, {AUC_SQL} FROM c GROUP BY 1),
      k AS (SELECT fold, count(CASE WHEN y=1 AND score>=0.5 THEN 1 END) AS tp, count(CASE WHEN y=0 AND score<0.5 THEN 1 END) AS tn, count(CASE WHEN y=0 AND score>=0.5 THEN 1 END) AS fp, count(CASE WHEN y=1 AND score<0.5 THEN 1 END) AS fn FROM u GROUP BY 1),
      s AS (SELECT fold, count(*) AS scanned_rows, count(DISTINCT run_id) AS dirs_found, count(DISTINCT CASE WHEN fold=motif THEN run_id END) AS dirs_used FROM t GROUP BY 1)
    SELECT fold, scanned_rows, dirs_found, dirs_used, tp, tn, fp, fn, recall, specificity, balanced_accuracy, roc_auc, average_precision
    FROM s JOIN (SELECT *, {RATES_SQL} FROM k) USING (fold) JOIN a USING (fold)""",
)
def _(get, spark):
    rows = get("v_scored")
    folds = rows.select(F.col("motif").alias("fold")).distinct()
    names = folds.agg(F.collect_set("fold").alias("folds"))
    tree = rows.withColumn("fold", F.explode(names.scalar()))
    out = M.fold_metrics(tree, folds, source="run_id")
    return rounded(
        out.select(
            "fold", "scanned_rows", "dirs_found", "dirs_used", "tp", "tn", "fp", "fn", "recall", "specificity", "balanced_accuracy", "roc_auc", "average_precision"
        ),
        "average_precision",
    )


@query(
    "j10_paired_delta",
    """WITH b AS (SELECT contig, ratio_label, run_id, avg(ratio) AS target, avg(prob) AS s FROM v_samples GROUP BY ALL),
      x AS (SELECT * FROM b WHERE run_id = '1-URGENT'), y AS (SELECT * FROM b WHERE run_id = '5-LOW')
    SELECT contig, ratio_label, x.target, round(x.s,6) AS score_a, round(y.s,6) AS score_b, round(y.s-x.s,6) AS score_delta,
      round(abs(y.s-x.target)-abs(x.s-x.target),6) AS abs_error_delta FROM x JOIN y USING (contig, ratio_label)""",
)
def _(get, spark):
    keys = ["contig", "ratio_label"]
    bags = get("v_samples").groupBy("run_id", *keys).agg(F.avg("ratio").alias("target_fraction"), F.avg("prob").alias("bag_score"))
    out = B.paired_delta(bags.where("run_id = '1-URGENT'"), bags.where("run_id = '5-LOW'"), keys)
    return rounded(out, "score_a", "score_b", "score_delta", "abs_error_delta")


@query(
    "w5_control_bags",
    """WITH r AS (SELECT sample_id, prob, CASE WHEN class='negative' THEN 0.0 WHEN class='positive' THEN 1.0 ELSE 0.5 END::DOUBLE AS label FROM v_samples),
      k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':','42',label::VARCHAR,sample_id::VARCHAR)), sample_id)-1)/20) AS BIGINT) AS bag
        FROM r WHERE label <> 0.5)
    SELECT label AS target_fraction, bag, round(avg(prob),6) AS bag_score, count(*) AS num_reads, label*100 AS target_ratio FROM k GROUP BY ALL HAVING count(*) = 20""",
)
def _(get, spark):
    label = F.when(F.col("class") == "negative", 0.0).when(F.col("class") == "positive", 1.0).otherwise(0.5)
    return rounded(B.control_bags(get("v_samples").withColumn("label", label), "sample_id", "label", "prob", 20), "bag_score")


@query(
    "w5_control_bag_summary",
    """SELECT count(*) AS num_reads, count(CASE WHEN class='negative' THEN 1 END) AS num_negative_reads, count(CASE WHEN class='positive' THEN 1 END) AS num_positive_reads,
      count(*)-count(CASE WHEN class IN ('negative','positive') THEN 1 END) AS num_ambiguous_reads, CAST(floor(count(CASE WHEN class='negative' THEN 1 END)/20) AS BIGINT) AS num_negative_bags,
      CAST(floor(count(CASE WHEN class='positive' THEN 1 END)/20) AS BIGINT) AS num_positive_bags FROM v_samples""",
)
def _(get, spark):
    label = F.when(F.col("class") == "negative", 0.0).when(F.col("class") == "positive", 1.0).otherwise(0.5)
    return B.control_bag_summary(get("v_samples").withColumn("label", label), "label", 20)
