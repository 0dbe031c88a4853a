"""Queries: quality rules, splits, strata, bags, balancing and profiles of the sample table
(F2-F6, F8, F9, A5-A14, J11, J15, J17, W2-W4, W6-W10, W12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import qc
from ..operators import sampling as W
from .registry import query, rounded


def key(*parts: str) -> str:
    """Checker form of the seeded order key."""
    return f"md5(concat_ws(':', '42', {', '.join(f'{p}::VARCHAR' for p in parts)}))"


def rank(by: list[str], ident: str = "sample_id") -> str:
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {key(*by, ident)}, {ident})"


RULES = [
    ("low_qscore", lambda: F.col("mean_qscore") >= 8.0),
    ("low_coverage", lambda: F.col("mapping_coverage") >= 0.85),
    ("too_short", lambda: F.col("ref_len") >= 10),
    ("unlabeled", lambda: F.col("class") != "unlabeled"),
]
REASON = """CASE WHEN mean_qscore < 8 THEN 'low_qscore' WHEN mapping_coverage < 0.85 THEN 'low_coverage' WHEN ref_len < 10 THEN 'too_short'
  WHEN class = 'unlabeled' THEN 'unlabeled' END"""


def tagged(get):
    return qc.qc_filter(get("v_samples"), [(n, ok()) for n, ok in RULES], keep_all=True)


@query("f2_qc_filter", f"SELECT sample_id, run_id, {REASON} AS reject_reason FROM v_samples")
def _(get, spark):
    return tagged(get).select("sample_id", "run_id", "reject_reason")


@query("f2_qc_preset", "SELECT sample_id, mapping_coverage FROM v_samples WHERE mapping_coverage >= 0.85 AND mean_qscore/18 >= 0.95")
def _(get, spark):
    rows = get("v_samples").withColumn("mapping_accuracy", F.col("mean_qscore") / 18)
    return qc.qc_filter(rows, "remap-relaxed").select("sample_id", "mapping_coverage")


@query(
    "f3_reject_counters",
    f"""WITH t AS (SELECT run_id, coalesce({REASON}, 'written') AS counter FROM v_samples)
    SELECT run_id, counter, count(*) AS rows FROM t GROUP BY ALL UNION ALL SELECT run_id, 'seen', count(*) FROM t GROUP BY 1""",
)
def _(get, spark):
    return qc.reject_counters(tagged(get), ["run_id"])


@query(
    "f4_typical_length",
    """WITH b AS (SELECT avg(ref_len) AS m, stddev_pop(ref_len) AS s FROM v_samples)
    SELECT sample_id, ref_len FROM v_samples, b WHERE ref_len > m - 1.1*s AND ref_len < m + 1.1*s""",
)
def _(get, spark):
    return qc.typical_length(get("v_samples"), "ref_len", 1.1).select("sample_id", "ref_len")


@query(
    "f5_holdout_random",
    f"""WITH r AS (SELECT sample_id, ratio_label, {rank(['ratio_label'])} AS rn, count(*) OVER (PARTITION BY ratio_label) AS n FROM v_samples)
    SELECT sample_id, ratio_label, CASE WHEN rn <= greatest(1, round_even(n*0.1::DOUBLE, 0)) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def _(get, spark):
    return qc.holdout_split(get("v_samples"), source=["ratio_label"]).select("sample_id", "ratio_label", "split")


@query("f5_leave_run", "SELECT sample_id, CASE WHEN run_id IN ('5-LOW','2-HIGH') THEN 'validation' ELSE 'train' END AS split FROM v_samples")
def _(get, spark):
    return qc.holdout_split(get("v_samples"), "leave-run", runs=["5-LOW", "2-HIGH"]).select("sample_id", "split")


@query(
    "f5_leave_site",
    f"""WITH s AS (SELECT DISTINCT site_key FROM v_samples), r AS (SELECT site_key, {rank([], 'site_key')} AS rn, count(*) OVER () AS n FROM s),
      h AS (SELECT site_key FROM r WHERE rn <= greatest(1, round_even(n*0.2::DOUBLE, 0)))
    SELECT sample_id, site_key, CASE WHEN h.site_key IS NOT NULL THEN 'validation' ELSE 'train' END AS split FROM v_samples LEFT JOIN h USING (site_key)""",
)
def _(get, spark):
    return qc.holdout_split(get("v_samples"), "leave-site", 0.2).select("sample_id", "site_key", "split")


@query(
    "f5_leave_common_site",
    f"""WITH s AS (SELECT site_key FROM v_samples WHERE class <> 'unlabeled' GROUP BY 1 HAVING count(DISTINCT class) = 2),
      r AS (SELECT site_key, {rank([], 'site_key')} AS rn, count(*) OVER () AS n FROM s), h AS (SELECT site_key FROM r WHERE rn <= greatest(1, round_even(n*0.2::DOUBLE, 0)))
    SELECT sample_id, site_key, CASE WHEN h.site_key IS NOT NULL THEN 'validation' ELSE 'train' END AS split FROM v_samples LEFT JOIN h USING (site_key) WHERE class <> 'unlabeled'""",
)
def _(get, spark):
    rows = get("v_samples").where("class <> 'unlabeled'")
    return qc.holdout_split(rows, "leave-site", 0.2, common_to="class").select("sample_id", "site_key", "split")


MOTIFS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SPLIT = "CASE WHEN mapping_coverage >= 0.95 THEN 'validation' ELSE 'train' END"


def with_split(get):
    return get("v_samples").withColumn("split", F.when(F.col("mapping_coverage") >= 0.95, "validation").otherwise("train"))


@query(
    "f6_leave_one_group_out",
    f"""WITH s AS (SELECT sample_id, motif, {SPLIT} AS split FROM v_samples), f AS (SELECT unnest(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']) AS fold)
    SELECT fold, split, motif, count(*) AS rows FROM s, f WHERE CASE WHEN split='train' THEN fold <> motif ELSE fold = motif END GROUP BY ALL""",
)
def _(get, spark):
    folds = qc.leave_one_group_out(with_split(get), "motif", MOTIFS, "heldout-group")
    return folds.groupBy("fold", "split", "motif").agg(F.count(F.lit(1)).alias("rows"))


@query("f7_allow_list", "SELECT sample_id, motif FROM v_samples WHERE motif IN ('BUILDING','MACHINERY')")
def _(get, spark):
    return qc.allow_list(get("v_samples"), "motif", ["BUILDING", "MACHINERY"]).select("sample_id", "motif")


@query("f8_seeded_limit", f"SELECT sample_id, prob FROM v_samples ORDER BY {key('sample_id')}, sample_id LIMIT 500")
def _(get, spark):
    return qc.seeded_limit(get("v_samples"), 500, "sample_id").select("sample_id", "prob")


@query(
    "f9_validate_contract",
    """SELECT 'missing:kmer_context' AS check, 1 AS violations UNION ALL SELECT 'prob_in_range', count(CASE WHEN NOT (prob >= 0 AND prob <= 1) THEN 1 END) FROM v_samples
    UNION ALL SELECT 'length:reference=target', count(CASE WHEN ref_len % 7 = 0 THEN 1 END) FROM v_samples UNION ALL SELECT 'width:reference<=90', count(CASE WHEN ref_len > 90 THEN 1 END) FROM v_samples
    UNION ALL SELECT 'bag_purity:site_key', count(*) FROM (SELECT site_key FROM v_samples GROUP BY 1 HAVING min(ratio_label) <> max(ratio_label))""",
)
def _(get, spark):
    rows = get("v_samples").withColumn("reference", F.array_repeat(F.lit(1), F.col("ref_len")))
    rows = rows.withColumn("target", F.array_repeat(F.lit(0), F.col("ref_len") + (F.col("ref_len") % 7 == 0).cast("int")))
    return qc.validate_contract(
        rows, ["sample_id", "kmer_context"], {"prob_in_range": (F.col("prob") >= 0) & (F.col("prob") <= 1)}, [("reference", "target")],
        ("reference", 90), ("site_key", "ratio_label"),
    )


@query(
    "f9_matching_splits",
    f"""SELECT 'validation_in_both_or_neither' AS check, CAST((SELECT bool_or({SPLIT}='validation') FROM v_samples WHERE class='positive')
      <> (SELECT bool_or({SPLIT}='validation') FROM v_samples WHERE class='negative' AND mapping_coverage < 0.9) AS BIGINT) AS violations""",
)
def _(get, spark):
    rows = with_split(get)
    return qc.matching_splits(rows.where("class = 'positive'"), rows.where("class = 'negative' AND mapping_coverage < 0.9"))


@query(
    "a5_numeric_profile",
    """WITH u AS (SELECT ratio_label, 'mean_qscore' AS "column", CASE WHEN ref_len = 0 THEN NULL ELSE mean_qscore END AS v FROM v_samples
        UNION ALL SELECT ratio_label, 'prob', prob FROM v_samples UNION ALL SELECT ratio_label, 'ref_len', ref_len FROM v_samples)
    SELECT ratio_label, "column", count(*) AS count, count(v) AS finite, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, min(v) AS min, max(v) AS max,
      round(quantile_cont(v,0.1),6) AS p10, round(quantile_cont(v,0.5),6) AS median, round(quantile_cont(v,0.9),6) AS p90 FROM u GROUP BY ALL""",
)
def _(get, spark):
    rows = get("v_samples").withColumn("mean_qscore", F.when(F.col("ref_len") == 0, F.lit(float("nan"))).otherwise(F.col("mean_qscore")))
    out = P.numeric_profile(rows, ["ratio_label"], ["mean_qscore", "prob", "ref_len"])
    return rounded(out, "mean", "std", "p10", "median", "p90")


@query(
    "a5_bag_size_profile",
    """WITH b AS (SELECT ratio_label, site_key, count(*) AS s FROM v_samples GROUP BY ALL) SELECT ratio_label, CAST(sum(s) AS BIGINT) AS reads, count(*) AS bags,
      round(avg(s),6) AS mean_bag_size, min(s) AS min_bag_size, max(s) AS max_bag_size, quantile_cont(s, 0.5) AS median_bag_size FROM b GROUP BY 1""",
)
def _(get, spark):
    return rounded(P.bag_size_profile(get("v_samples"), ["ratio_label"], "site_key"), "mean_bag_size")


@query(
    "a6_quantile_summary",
    """SELECT strand, count(prob) AS count, round(avg(prob),6) AS mean, min(prob) AS min, max(prob) AS max, round(quantile_cont(prob,0.25),6) AS q25,
      round(quantile_cont(prob,0.5),6) AS median, round(quantile_cont(prob,0.75),6) AS q75, round(quantile_cont(prob,0.9),6) AS q90,
      round(quantile_cont(prob,0.95),6) AS q95, round(quantile_cont(prob,0.99),6) AS q99 FROM v_calls GROUP BY 1""",
)
def _(get, spark):
    out = P.quantile_summary(get("v_calls"), "prob", ["strand"])
    return rounded(out, "mean", "q25", "median", "q75", "q90", "q95", "q99")


@query(
    "a7_category_top_k",
    """WITH u AS (SELECT ratio_label, 'run_id' AS field, run_id AS value FROM v_samples UNION ALL SELECT ratio_label, 'contig', contig FROM v_samples
        UNION ALL SELECT ratio_label, 'site_key', site_key FROM v_samples), c AS (SELECT ratio_label, field, value, count(*) AS count FROM u GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY ratio_label, field ORDER BY count DESC, value) AS rank, count/(sum(count) OVER (PARTITION BY ratio_label, field))::DOUBLE AS fraction FROM c)
    SELECT * FROM r WHERE rank <= 5""",
)
def _(get, spark):
    return P.category_top_k(get("v_samples"), ["ratio_label"], ["run_id", "contig", "site_key"], 5)


SIDED = "sided AS (SELECT *, CASE WHEN ratio_label = '25' THEN 'low' ELSE 'high' END AS side FROM v_samples)"


def sided(get):
    return get("v_samples").withColumn("side", F.when(F.col("ratio_label") == "25", "low").otherwise("high"))


FRACTIONS = SIDED + """, u AS (SELECT side, 'run_id' AS field, run_id AS value FROM sided UNION ALL SELECT side, 'motif', motif FROM sided
    UNION ALL SELECT side, 'contig', contig FROM sided),
  f AS (SELECT field, value, count(CASE WHEN side='low' THEN 1 END) AS left_count, count(CASE WHEN side='high' THEN 1 END) AS right_count FROM u GROUP BY ALL),
  g AS (SELECT *, left_count/(sum(left_count) OVER (PARTITION BY field))::DOUBLE AS left_fraction, right_count/(sum(right_count) OVER (PARTITION BY field))::DOUBLE AS right_fraction FROM f)"""


@query(
    "a8_distribution_distance",
    f"""WITH {FRACTIONS} SELECT field, round(0.5*sum(abs(left_fraction-right_fraction)),6) AS total_variation, round(sum(least(left_fraction,right_fraction)),6) AS overlap,
      count(*) AS values FROM g GROUP BY 1""",
)
def _(get, spark):
    return rounded(P.distribution_distance(sided(get), "side", "low", "high", ["run_id", "motif", "contig"]), "total_variation", "overlap")


@query(
    "a9_numeric_shift",
    f"""WITH {SIDED}, u AS (SELECT side, 'mean_qscore' AS "column", mean_qscore AS v FROM sided UNION ALL SELECT side, 'prob', prob FROM sided),
      s AS (SELECT "column", avg(v) FILTER (side='low') AS lm, avg(v) FILTER (side='high') AS rm, quantile_cont(v,0.5) FILTER (side='low') AS ld,
        quantile_cont(v,0.5) FILTER (side='high') AS rd, var_pop(v) FILTER (side='low') AS lv, var_pop(v) FILTER (side='high') AS rv FROM u GROUP BY 1)
    SELECT "column", round(lm,6) AS left_mean, round(rm,6) AS right_mean, round(ld,6) AS left_median, round(rd,6) AS right_median, round(rm-lm,6) AS mean_delta,
      round(rd-ld,6) AS median_delta, round((rm-lm)/sqrt((lv+rv)/2),6) AS standardized_mean_difference FROM s""",
)
def _(get, spark):
    out = P.numeric_shift(sided(get), "side", "low", "high", ["mean_qscore", "prob"])
    return rounded(out, *[c for c in out.columns if c != "column"])


@query(
    "a10_category_enrichment",
    f"""WITH {FRACTIONS}, r AS (SELECT *, right_fraction-left_fraction AS delta, row_number() OVER (PARTITION BY field ORDER BY abs(right_fraction-left_fraction) DESC, value) AS rank FROM g)
    SELECT field, value, left_count, right_count, left_fraction, right_fraction, delta, rank FROM r WHERE rank <= 3""",
)
def _(get, spark):
    return P.category_enrichment(sided(get), "side", "low", "high", ["run_id", "motif", "contig"], 3)


@query(
    "a11_class_balance",
    f"""SELECT {SPLIT} AS split, motif, count(CASE WHEN class='positive' THEN 1 END) AS positive, count(CASE WHEN class='negative' THEN 1 END) AS negative, count(CASE WHEN class='mixed' THEN 1 END) AS mixed,
      count(CASE WHEN class='unlabeled' THEN 1 END) AS unlabeled, count(*) AS total, count(CASE WHEN class='positive' THEN 1 END)/nullif(count(CASE WHEN class='negative' THEN 1 END),0)::DOUBLE AS pos_neg_ratio FROM v_samples GROUP BY ALL""",
)
def _(get, spark):
    return P.class_balance(with_split(get), ["split", "motif"])


@query(
    "a12_class_group_counts",
    """SELECT motif, class, 'run_id' AS field, run_id AS value, count(*) AS count FROM v_samples GROUP BY ALL
    UNION ALL SELECT motif, class, 'contig', contig, count(*) FROM v_samples GROUP BY ALL""",
)
def _(get, spark):
    return P.class_group_counts(get("v_samples"), ["run_id", "contig"])


@query(
    "a13_count_matrix",
    f"""SELECT motif, {', '.join(f"count(CASE WHEN run_id='{r}' THEN 1 END) AS " + '"' + r + '"' for r in ('1-URGENT', '3-MEDIUM', '5-LOW'))},
      count(CASE WHEN run_id NOT IN ('1-URGENT','3-MEDIUM','5-LOW') THEN 1 END) AS other FROM v_samples GROUP BY 1 UNION ALL SELECT 'NO_SUCH_ROW', 0, 0, 0, 0""",
)
def _(get, spark):
    return P.count_matrix(get("v_samples"), "motif", "run_id", ["1-URGENT", "3-MEDIUM", "5-LOW"], [*MOTIFS, "NO_SUCH_ROW"], other="other")


@query(
    "a14_label_inventory",
    """WITH c AS (SELECT CAST(sum(length(seq)-length(replace(seq,'A',''))) AS BIGINT) AS a, CAST(sum(length(seq)-length(replace(seq,'C',''))) AS BIGINT) AS c,
        CAST(sum(length(seq)-length(replace(seq,'G',''))) AS BIGINT) AS g, CAST(sum(length(seq)-length(replace(seq,'T',''))) AS BIGINT) AS t,
        CAST(sum(CASE WHEN read_id % 2 = 0 THEN length(seq)-length(replace(seq,'A','')) ELSE 0 END) AS BIGINT) AS am,
        CAST(sum(CASE WHEN read_id % 2 = 0 THEN length(replace(seq,'A','')) ELSE 0 END) AS BIGINT) AS ig,
        CAST(sum(CASE WHEN read_id % 2 = 1 THEN length(seq)-length(replace(seq,'C','')) ELSE 0 END) AS BIGINT) AS cc,
        CAST(sum(CASE WHEN read_id % 2 = 1 THEN length(seq)-length(replace(seq,'G','')) ELSE 0 END) AS BIGINT) AS cg,
        CAST(sum(CASE WHEN read_id % 2 = 1 THEN length(seq)-length(replace(seq,'T','')) ELSE 0 END) AS BIGINT) AS ct FROM v_seq)
    SELECT a AS base_A, c AS base_C, g AS base_G, t AS base_T, a-am AS canonical_A, cc AS canonical_C, cg AS canonical_G, ct AS canonical_T, am AS modified, ig AS ignored FROM c""",
)
def _(get, spark):
    from ..functions.labels import label_targets
    from ..functions.sequence import encode_bases

    rows = get("v_seq").withColumn("reference", encode_bases(F.col("seq")))
    target = F.when(F.col("read_id") % 2 == 0, label_targets(F.col("reference"))).otherwise(label_targets(F.col("reference"), "canonical", "canonical"))
    return P.label_inventory(rows.withColumn("target", target))


@query(
    "j11_common_strata",
    """SELECT site_key, run_id FROM v_samples GROUP BY ALL HAVING count(DISTINCT ratio_label) = (SELECT count(DISTINCT ratio_label) FROM v_samples)""",
)
def _(get, spark):
    return J.common_strata(get("v_samples"), "ratio_label", ["site_key", "run_id"])


@query(
    "j15_merge_sources",
    """SELECT sample_id, 'samples' AS source_dataset, run_id, '' AS lang, ref_len, NULL::BIGINT AS n_chars, CAST(100 AS INT) AS width FROM v_samples
    UNION ALL SELECT doc_id, 'documents', '', lang, NULL, n_chars, CAST(100 AS INT) FROM documents""",
)
def _(get, spark):
    a = get("v_samples").select("sample_id", "run_id", "ref_len")
    b = get("documents").select(F.col("doc_id").alias("sample_id"), "lang", "n_chars")
    out = J.merge_sources({"samples": a, "documents": b})
    padded = J.pad_array(F.array_repeat(F.lit(1), F.coalesce("ref_len", F.lit(0))), 100, -100)
    return out.withColumn("width", F.size(padded))


@query(
    "j17_generalization_gap",
    """WITH k AS (SELECT motif, source, count(CASE WHEN y=1 AND score>=0.3 THEN 1 END)/count(CASE WHEN y=1 THEN 1 END)::DOUBLE AS recall, count(CASE WHEN y=0 AND score<0.3 THEN 1 END)/count(CASE WHEN y=0 THEN 1 END)::DOUBLE AS specificity FROM v_scored GROUP BY ALL),
      j AS (SELECT a.motif, a.recall AS recall_internal, b.recall AS recall_heldout, a.specificity AS specificity_internal, b.specificity AS specificity_heldout
        FROM k a JOIN k b ON a.motif=b.motif WHERE a.source='F' AND b.source='O'), s AS (SELECT motif, count(*) AS n FROM v_scored WHERE source='F' AND motif <> 'PROMO' GROUP BY 1)
    SELECT motif, recall_internal, recall_heldout, specificity_internal, specificity_heldout, recall_internal-recall_heldout AS recall_drop,
      CASE WHEN recall_internal-recall_heldout > 0.5 THEN 'severe' WHEN recall_internal-recall_heldout > 0.2 THEN 'moderate' ELSE 'small' END AS recall_flag,
      specificity_internal-specificity_heldout AS specificity_drop,
      CASE WHEN specificity_internal-specificity_heldout > 0.3 THEN 'severe' WHEN specificity_internal-specificity_heldout > 0.1 THEN 'moderate' ELSE 'small' END AS specificity_flag,
      coalesce(n, 0) AS train_support, CASE WHEN n > 0 THEN 'seen' ELSE 'unseen' END AS seen FROM j LEFT JOIN s USING (motif)""",
)
def _(get, spark):
    k = M.threshold_metrics(get("v_scored"), 0.3, by=["motif", "source"])
    support = get("v_scored").where("source = 'F' AND motif <> 'PROMO'").groupBy("motif").agg(F.count(F.lit(1)).alias("train_support"))
    return P.generalization_gap(k.where("source = 'F'"), k.where("source = 'O'"), "motif", ["recall", "specificity"], support)


def bags_sql(balance: bool) -> str:
    s = "ratio_label, site_key"
    uid = "concat_ws('|', site_key, bag::VARCHAR)"
    kept = f"""kb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ratio_label ORDER BY {key('ratio_label', uid)}, {uid}) AS q FROM b)
      {'WHERE q <= (SELECT min(c) FROM (SELECT count(*) AS c FROM b GROUP BY ratio_label))' if balance else ''})"""
    return f"""WITH r AS (SELECT *, CAST(floor(({rank(['ratio_label', 'site_key'])} - 1)/4) AS BIGINT) AS bag FROM v_samples),
      b AS (SELECT {s}, bag, count(*) AS bag_reads FROM r GROUP BY ALL HAVING count(*) >= 3), {kept},
      n AS (SELECT {s}, bag, bag_reads, row_number() OVER (ORDER BY {s}, bag) - 1 AS bag_key FROM kb)
    SELECT sample_id, {s}, bag_reads, bag_key FROM r JOIN n USING ({s}, bag)"""


@query("w2_stratified_bags", bags_sql(True))
def _(get, spark):
    out = W.stratified_bags(get("v_samples"), ["site_key"], 4, 3, 0, True)
    return out.select("sample_id", "ratio_label", "site_key", "bag_reads", "bag_key")


@query("w2_unbalanced_bags", bags_sql(False))
def _(get, spark):
    out = W.stratified_bags(get("v_samples"), ["site_key"], 4, 3, 0, False)
    return out.select("sample_id", "ratio_label", "site_key", "bag_reads", "bag_key")


@query(
    "w3_common_strata_sample",
    f"""WITH c AS (SELECT site_key, ratio_label, count(*) AS n FROM v_samples GROUP BY ALL), k AS (SELECT site_key, min(n) AS keep FROM c GROUP BY 1
        HAVING count(*) = (SELECT count(DISTINCT ratio_label) FROM v_samples)),
      b AS (SELECT site_key, ratio_label, keep, row_number() OVER (ORDER BY site_key, ratio_label) - 1 AS bag_key FROM c JOIN k USING (site_key)),
      r AS (SELECT *, {rank(['ratio_label', 'site_key'])} AS rn FROM v_samples)
    SELECT sample_id, site_key, ratio_label, bag_key FROM r JOIN b USING (site_key, ratio_label) WHERE rn <= keep""",
)
def _(get, spark):
    return W.common_strata_sample(get("v_samples"), ["site_key"]).select("sample_id", "site_key", "ratio_label", "bag_key")


RATIOS = [("0", 0.0), ("25", 0.25), ("50", 0.5), ("100", 1.0)]


@query(
    "w4_synthesize_mixtures",
    f"""WITH s AS (SELECT * FROM v_samples WHERE class IN ('positive','negative')),
      k AS (SELECT contig, run_id, count(CASE WHEN class='positive' THEN 1 END) AS p, count(CASE WHEN class='negative' THEN 1 END) AS n FROM s GROUP BY ALL HAVING count(CASE WHEN class='positive' THEN 1 END) > 0 AND count(CASE WHEN class='negative' THEN 1 END) > 0),
      q AS (SELECT * FROM (VALUES (0,'0',0.0::DOUBLE,0,8),(1,'25',0.25,2,6),(2,'50',0.5,4,4),(3,'100',1.0,8,0)) v(o,label,ratio,fp,fn)),
      w AS (SELECT contig, run_id, p, n, 0 AS o, 0::BIGINT AS pf, 0::BIGINT AS nf FROM k UNION ALL
        SELECT w.contig, w.run_id, p, n, w.o+1, pf + fp*m, nf + fn*m FROM (SELECT w.*, q.fp, q.fn, least(CASE WHEN q.fp>0 THEN greatest(p-pf,0)//q.fp ELSE 999999999 END,
          CASE WHEN q.fn>0 THEN greatest(n-nf,0)//q.fn ELSE 999999999 END) AS m FROM w JOIN q ON w.o = q.o) w WHERE w.o < 4),
      d AS (SELECT w.contig, w.run_id, w.o, label, ratio, fp, fn, pf, nf, least(CASE WHEN fp>0 THEN greatest(p-pf,0)//fp ELSE 999999999 END, CASE WHEN fn>0 THEN greatest(n-nf,0)//fn ELSE 999999999 END) AS made
        FROM w JOIN q ON w.o = q.o),
      e AS (SELECT *, sum(made) OVER (ORDER BY contig, run_id, o) - made AS first FROM d WHERE made > 0),
      r AS (SELECT *, {rank(['class', 'contig', 'run_id'])} - 1 AS pos FROM s)
    SELECT sample_id, r.contig, r.run_id, class, CAST(first + floor((pos - CASE WHEN class='positive' THEN pf ELSE nf END)/(CASE WHEN class='positive' THEN fp ELSE fn END)) AS BIGINT) AS bag_key,
      e.ratio AS synthetic_ratio, e.label AS synthetic_ratio_label FROM r JOIN e ON r.contig = e.contig AND r.run_id = e.run_id
      AND pos >= CASE WHEN class='positive' THEN pf ELSE nf END AND pos < CASE WHEN class='positive' THEN pf + fp*made ELSE nf + fn*made END""",
)
def _(get, spark):
    out = W.synthesize_mixtures(get("v_samples"), ["contig", "run_id"], RATIOS, 8)
    return out.select("sample_id", "contig", "run_id", "class", "bag_key", "synthetic_ratio", "synthetic_ratio_label")


@query(
    "w4_mixture_replacement",
    """WITH k AS (SELECT contig, count(CASE WHEN class='positive' THEN 1 END) AS p, count(CASE WHEN class='negative' THEN 1 END) AS n FROM v_samples GROUP BY 1),
      q AS (SELECT * FROM (VALUES ('0',0.0::DOUBLE,0,8),('25',0.25,2,6),('50',0.5,4,4),('100',1.0,8,0)) v(label,ratio,fp,fn))
    SELECT contig, label AS synthetic_ratio_label, fp AS positives, fn AS negatives, 1 AS bags FROM k, q WHERE p > 0 AND n > 0""",
)
def _(get, spark):
    out = W.synthesize_mixtures(get("v_samples"), ["contig"], RATIOS, 8, 0, replace=True)
    return out.groupBy("contig", "synthetic_ratio_label").agg(
        F.count_if(F.col("class") == "positive").alias("positives"), F.count_if(F.col("class") == "negative").alias("negatives"),
        F.count_distinct("bag_key").alias("bags"),
    )


@query(
    "w6_stratified_split",
    f"""WITH r AS (SELECT *, {rank(['motif', 'class'])} AS rn, count(*) OVER (PARTITION BY motif, class) AS n FROM v_samples)
    SELECT sample_id, motif, class, CASE WHEN rn <= CASE WHEN n > 1 THEN least(greatest(round_even(n*0.15::DOUBLE,0),1),n-1) ELSE 0 END THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def _(get, spark):
    return W.stratified_split(get("v_samples"), ["motif", "class"], 0.15).select("sample_id", "motif", "class", "split")


@query(
    "w7_balance_classes",
    f"""WITH s AS (SELECT * FROM v_samples WHERE class IN ('positive','negative')), k AS (SELECT contig, least(count(CASE WHEN class='positive' THEN 1 END), count(CASE WHEN class='negative' THEN 1 END)) AS keep FROM s GROUP BY 1),
      r AS (SELECT *, {rank(['contig', 'class'])} AS rn FROM s) SELECT sample_id, contig, class FROM r JOIN k USING (contig) WHERE rn <= keep""",
)
def _(get, spark):
    return W.balance_classes(get("v_samples"), ["contig"]).select("sample_id", "contig", "class")


@query(
    "w8_balance_source_class",
    f"""WITH s AS (SELECT *, {SPLIT} AS split FROM v_samples WHERE class IN ('positive','negative')), c AS (SELECT split, ratio_label, class, count(*) AS n FROM s GROUP BY ALL),
      k AS (SELECT split, min(n) AS keep FROM c GROUP BY 1), r AS (SELECT *, {rank(['split', 'ratio_label', 'class'])} AS rn FROM s)
    SELECT sample_id, split, ratio_label, class FROM r JOIN k USING (split) WHERE rn <= keep""",
)
def _(get, spark):
    out = W.balance_source_class(with_split(get), "ratio_label", within=["split"])
    return out.select("sample_id", "split", "ratio_label", "class")


def mix_sql(plan: str) -> str:
    return f"""WITH {SIDED}, c AS (SELECT count(CASE WHEN side='low' THEN 1 END) AS a, count(CASE WHEN side='high' THEN 1 END) AS b FROM sided), p AS ({plan}),
      r AS (SELECT sample_id, side, {rank(['side'])} AS rn FROM sided)
    SELECT sample_id, side FROM r, p WHERE rn <= CASE side WHEN 'low' THEN pa ELSE pb END"""


@query(
    "w9_mix_two_sources",
    mix_sql("SELECT floor(least(a/2.0::DOUBLE, b/1.0::DOUBLE)*2.0) AS pa, floor(least(a/2.0::DOUBLE, b/1.0::DOUBLE)*1.0) AS pb FROM c"),
)
def _(get, spark):
    return W.mix_two_sources(sided(get), "side", ("low", "high"), (2.0, 1.0)).select("sample_id", "side")


EVERYTHING = 1 << 40  # a total above any table: what one source cannot give comes from the other, so all rows are kept


@query("w9_mix_to_total", mix_sql("SELECT a AS pa, b AS pb FROM c"))
def _(get, spark):
    return W.mix_two_sources(sided(get), "side", ("low", "high"), (1.0, 3.0), total=EVERYTHING).select("sample_id", "side")


def labelled(get):
    """Samples with a k-mer like key, a 0/1 label and a score."""
    return get("v_samples").where("class <> 'unlabeled'").select(
        "sample_id", F.col("contig").alias("kmer"), (F.col("class") == "positive").cast("int").alias("y"), F.col("prob").alias("score")
    )


KMER = f"""l AS (SELECT sample_id, contig AS kmer, CAST(class='positive' AS INT) AS y, prob AS score FROM v_samples WHERE class <> 'unlabeled'),
  q AS (SELECT kmer, count(CASE WHEN y=1 THEN 1 END) AS positives, count(CASE WHEN y=0 THEN 1 END) AS negatives, least(count(CASE WHEN y=1 THEN 1 END), count(CASE WHEN y=0 THEN 1 END)) AS kept_per_class FROM l GROUP BY 1),
  b AS (SELECT l.* FROM (SELECT *, {rank(['kmer', 'y'])} AS rn FROM l) l JOIN q USING (kmer) WHERE rn <= kept_per_class)"""


@query("w10_kmer_balanced", f"WITH {KMER} SELECT sample_id, kmer, y FROM b")
def _(get, spark):
    return W.kmer_balanced(labelled(get), "kmer", "y").select("sample_id", "kmer", "y")


@query("w10_kmer_stats", f"WITH {KMER} SELECT * FROM q")
def _(get, spark):
    return W.kmer_stats(labelled(get), "kmer", "y")


@query(
    "w10_kmer_balanced_auc",
    f"""WITH {KMER}, h AS (SELECT score, sum(y) AS p, sum(1-y) AS n FROM b GROUP BY 1), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM h WINDOW w AS (ORDER BY score DESC))
    SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, sum(n*(2*(tp-p)+p))::DOUBLE/(2*sum(p)*sum(n))::DOUBLE AS roc_auc FROM c""",
)
def _(get, spark):
    kept = W.kmer_balanced(labelled(get), "kmer", "y")
    return M.auc_summary(M.cumulate(M.score_histogram(kept))).select("positives", "negatives", "roc_auc")


@query("w12_shuffle_order", f"SELECT sample_id, {rank([])} - 1 AS position FROM v_samples")
def _(get, spark):
    return W.shuffle_order(get("v_samples")).select("sample_id", "position")
