"""Operators on small inputs with results worked out by hand or by brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sitebag.operators import bags as B
from sitebag.operators import joins as J
from sitebag.operators import metrics as M
from sitebag.operators import pairs as C
from sitebag.operators import profile as P
from sitebag.operators import qc
from sitebag.operators import sampling as W
from sitebag.operators import sites as S
from sitebag.operators import windows as N


def calls(spark, rows):
    return spark.createDataFrame(rows, "contig string, pos int, strand string, prob double")


def test_sites_labels_and_metrics(spark):
    df = calls(spark, [("chr1", 9, "+", 1.0), ("chr1", 9, "+", None), ("chr1", 19, "+", None), ("chr1", 19, "+", None)])
    sites = S.site_stats(df, median="exact")
    rows = {r["pos"]: r for r in sites.collect()}
    assert rows[9]["coverage"] == 2 and rows[9]["num_mod_calls"] == 1 and rows[9]["mean_prob_zero_filled"] == 0.5 and rows[9]["median_called_prob"] == 1.0
    assert rows[19]["median_called_prob"] is None and rows[19]["score"] == 0.0 and rows[19]["mean_called_prob"] is None
    gold = spark.createDataFrame([("chr1", 9, "+", "g", 3)], "contig string, pos int, strand string, name string, support int")
    labelled = S.label_sites(sites, gold).withColumnRenamed("is_gold", "y")
    m = M.threshold_metrics(labelled, 0.5).first()
    assert (m["tp"], m["tn"], m["fp"], m["fn"], m["fpr"]) == (1, 1, 0, 0, 0.0)
    assert M.auc_summary(M.cumulate(M.score_histogram(labelled))).first()["roc_auc"] == 1.0


def test_strand_collapse(spark):
    df = calls(spark, [("chr1", 9, "+", 0.5), ("chr1", 9, "-", None)])
    r = S.site_stats(S.collapse_strand(df)).first()
    assert (r["coverage"], r["num_mod_calls"], r["mean_called_prob"], r["strand"]) == (2, 1, 0.5, ".")


def test_conventions_move_and_flip(spark):
    gold = spark.createDataFrame([("c", 0, "+"), ("c", 10, "-"), ("c", 10, "?")], "contig string, pos int, strand string")
    out = {(r["convention"], r["shift"], r["pos"], r["strand"]) for r in S.convention_grid(gold, [-1, 1]).collect()}
    assert ("as_is", -1, 9, "-") in out and ("flip", 1, 11, "+") in out and ("ignore", 1, 1, ".") in out
    assert {("either", 1, 1, s) for s in "+-"} <= out and ("as_is", 1, 11, ".") in out
    assert not any(p < 0 for _, _, p, _ in out)


def test_negative_control(spark):
    sites = spark.createDataFrame([(0.5,), (0.1,)], "score double")
    r = M.negative_control_curve(sites, [0.5]).first()
    assert (r["false_positive_sites"], r["false_positive_fraction"], r["specificity"]) == (1, 0.5, 0.5)


def test_ties_one_class_and_two_pr_definitions(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, score double")
    r = M.auc_summary(M.cumulate(M.score_histogram(df))).first()
    assert r["roc_auc"] == 0.625  # (1/2 + 1 + 0 + 1) / 4
    assert r["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert r["pr_auc_trapezoid"] == pytest.approx(0.5 * (1 + 0.5) / 2 + 0.5 * (0.5 + 2 / 3) / 2)
    one = M.auc_summary(M.cumulate(M.score_histogram(df.where("y = 1")))).first()
    assert one["roc_auc"] is None and one["average_precision"] is None
    assert M.threshold_metrics(df.where("y = 1"), 2.0, zero_division=None).first()["precision"] is None


def brute_roc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_metrics_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.3), round(rng.random() ** 2, 2)) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, y int, score double")
    cum = M.cumulate(M.score_histogram(df))
    assert M.auc_summary(cum).first()["roc_auc"] == pytest.approx(brute_roc([(y, s) for _, y, s in rows]))
    ranked = sorted(rows, key=lambda r: (-r[2], r[0]))
    total = sum(y for _, y, _ in rows)
    levels = [0.0, 0.3, 0.6, 0.69, 0.71]
    want, tp = {lv: 0.0 for lv in levels}, 0
    for k, (_, y, _) in enumerate(ranked, 1):
        tp += y
        for lv in levels:
            if (k - tp) / k <= lv:
                want[lv] = max(want[lv], tp / total)
    got = {r["level"]: r["sensitivity"] for r in M.sensitivity_at_fdr(df, levels, ["id"]).collect()}
    assert got == pytest.approx(want)
    tops = {r["n"]: r["fraction"] for r in M.top_n_hits(df, [10, 5000, -1], ["id"]).collect()}
    assert tops == {10: sum(y for _, y, _ in ranked[:10]) / 10, 5000: total / len(rows)}
    # partial area against a fine polygon of the exact curve
    pts = sorted({(r["fpr"], r["tpr"]) for r in M.roc_curve(cum).collect()})
    area = 0.0
    for (x0, y0), (x1, y1) in itertools.pairwise(pts):
        if x0 >= 0.1:
            break
        x = min(x1, 0.1)
        y = y1 if x1 == x0 else y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        area += (x - x0) * (y0 + y) / 2
    r = M.partial_auc(cum, 0.1).first()
    assert r["partial_auc"] == pytest.approx(area)
    assert r["partial_auc_standardized"] == pytest.approx(0.5 * (1 + (area - 0.005) / 0.095))


def test_read_bag_and_loss(spark):
    sig = [1 / (1 + math.exp(-x)) for x in (0, 2, 4)]
    df = spark.createDataFrame([(0, sig[0]), (0, sig[1]), (1, sig[2]), (2, None)], "read_id int, prob double")
    reads = S.read_scores(df)
    assert reads.count() == 2
    bags = B.bag_scores(reads.withColumn("bag_key", F.lit(9)), target=0.75)
    mean = ((sig[0] + sig[1]) / 2 + sig[2]) / 2
    r = bags.first()
    assert r["bag_score"] == pytest.approx(mean) and r["target_ratio"] == 75.0
    loss = B.proportion_loss(bags).first()["loss"]
    assert loss == pytest.approx(-(0.75 * math.log(mean) + 0.25 * math.log(1 - mean)))
    inside = spark.createDataFrame([(0.5, 0.52), (0.5, 0.7)], "target_fraction double, bag_score double")
    want = -(0.55 * math.log(0.7) + 0.45 * math.log(0.3)) / 2
    assert B.proportion_loss(inside, "bce", 0.05).first()["loss"] == pytest.approx(want)
    assert B.proportion_loss(inside, "huber", 0.05, 0.1).first()["loss"] == pytest.approx(0.1 * (0.15 - 0.05) / 2)


def test_calibration_undefined_correlation(spark):
    one = spark.createDataFrame([(0.5, 0.4)], "target_fraction double, bag_score double")
    assert {r["corr"] for r in B.ratio_calibration(one).collect()} == {None}
    assert {r["corr"] for r in B.ratio_calibration(one, missing_corr=0.0).collect()} == {0.0}


def test_pooling_leaves_mixed_runs_out(spark):
    schema = "m string, num_positive int, num_negative int, predicted_positive_rate double, bce double, mean_prob double"
    runs = spark.createDataFrame([("a", 10, 0, 0.8, 0.1, 0.7), ("a", 0, 30, 0.1, 0.2, 0.2), ("b", 4, 0, 0.5, 0.3, 0.5), ("c", 1, 1, 0.5, 0.1, 0.1)], schema)
    out = {r["m"]: r for r in B.pool_single_class(runs, ["m"]).collect()}
    assert (out["a"]["recall"], out["a"]["specificity"], out["a"]["balanced_accuracy"]) == (pytest.approx(0.8), pytest.approx(0.9), pytest.approx(0.85))
    assert out["b"]["specificity"] is None and out["b"]["balanced_accuracy"] == 0.5 and out["c"]["recall"] is None


def samples(spark, per_ratio=8, ratios=("0", "50", "75", "100"), sites=("s1", "s2")):
    rows = [(f"{r}-{i}", r, sites[i % len(sites)], "positive" if i % 2 else "negative") for r in ratios for i in range(per_ratio)]
    return spark.createDataFrame(rows, "sample_id string, ratio_label string, site_key string, class string")


def test_bags_without_common_strata(spark):
    df = samples(spark, 4, sites=("only",))
    out = W.stratified_bags(df, ["site_key"], 4).collect()
    by_bag = {}
    for r in out:
        by_bag.setdefault(r["bag_key"], set()).add(r["ratio_label"])
    assert sorted(by_bag) == [0, 1, 2, 3] and all(len(v) == 1 for v in by_bag.values()) and len(out) == 16


def test_bags_fail_when_a_ratio_has_none(spark):
    df = samples(spark, 4).unionByName(spark.createDataFrame([("x", "33", "s1", "positive")], "sample_id string, ratio_label string, site_key string, class string"))
    with pytest.raises(Exception, match="no bags"):
        W.stratified_bags(df, ["site_key"], 2, 2).collect()


def simulate(p, n, ratios, size, quota):
    """Bag-by-bag drawing, as a check of the closed form."""
    out, pp, nn = {}, 0, 0
    for label, r in ratios:
        f = round(size * r)
        c, made = size - f, 0
        while (not quota or made < quota) and pp + f <= p and nn + c <= n:
            pp, nn, made = pp + f, nn + c, made + 1
        out[label] = made
    return out


@pytest.mark.parametrize("quota", [0, 1, 2])
def test_mixture_plan_equals_drawing(spark, quota):
    ratios = [("0", 0.0), ("30", 0.3), ("50", 0.5), ("100", 1.0)]
    grid = [(p, n) for p in range(0, 26, 5) for n in range(0, 26, 4)]
    counts = spark.createDataFrame(grid, "_pos long, _neg long")
    for r in W.mixture_plan(counts, ratios, 5, quota).collect():
        assert {s["label"]: s["made"] for s in r["_plan"]} == simulate(r["_pos"], r["_neg"], ratios, 5, quota)


def test_synthetic_mixtures(spark):
    rows = [(f"{c}{i}", "s", c) for c in ("positive", "negative") for i in range(6)]
    df = spark.createDataFrame(rows, "sample_id string, site_key string, class string")
    out = W.synthesize_mixtures(df, ["site_key"], [("0", 0.0), ("50", 0.5), ("100", 1.0)], 4, 1).collect()
    assert len(out) == 12 and len({r["sample_id"] for r in out}) == 12
    bags = {}
    for r in out:
        bags.setdefault((r["bag_key"], r["synthetic_ratio"]), []).append(r["class"])
    assert {k: sum(c == "positive" for c in v) / len(v) for k, v in bags.items()} == {(0, 0.0): 0.0, (1, 0.5): 0.5, (2, 1.0): 1.0}
    again = W.synthesize_mixtures(df, ["site_key"], [("50", 0.5)], 40, 0, replace=True)
    assert again.count() == 40 and again.where("class = 'positive'").count() == 20


def plan_by_loop(a, b, wa, wb, ca, cb, total):
    la, lb = min(a, ca if ca is not None else a), min(b, cb if cb is not None else b)
    t = min(total, la + lb)
    da, db = t * wa / (wa + wb), t * wb / (wa + wb)
    x = min(la, round(da))
    y = min(lb, t - x)
    while x + y < t:
        ga = da - x if x < la else float("-inf")
        gb = db - y if y < lb else float("-inf")
        if ga >= gb and x < la:
            x += 1
        elif y < lb:
            y += 1
        else:
            break
    return x, y


def test_pair_counts_equal_the_top_up_loop(spark):
    grid = list(itertools.product([0, 3, 10, 50], [0, 4, 11, 60]))
    counts = spark.createDataFrame(grid, "first long, second long")
    for wa, wb, ca, cb, total in [(1, 1, None, None, 20), (1, 3, None, 5, 30), (2, 1, 7, None, 21), (1, 2, 9, 9, 100)]:
        for r in W.pair_counts(counts, (wa, wb), (ca, cb), total).collect():
            assert (r["first_planned"], r["second_planned"]) == plan_by_loop(r["first"], r["second"], wa, wb, ca, cb, total)
    r = W.pair_counts(counts, (0, 1), (None, 7)).where("first = 50 AND second = 60").first()
    assert (r["first_planned"], r["second_planned"]) == (0, 7)


def test_splits_are_disjoint_and_bounded(spark):
    df = samples(spark, 9)
    out = W.stratified_split(df, ["ratio_label", "site_key"], 0.01)
    per = out.groupBy("ratio_label", "site_key").agg(F.count_if(F.col("split") == "validation").alias("v"), F.count("*").alias("n")).collect()
    assert out.count() == 36 and all(r["v"] == 1 for r in per)
    lone = W.stratified_split(df.limit(1), ["site_key"], 0.9).first()
    assert lone["split"] == "train"


def test_leave_one_group_out(spark):
    df = spark.createDataFrame([(i, m, s) for i, (m, s) in enumerate(itertools.product(("AGACT", "GAACT"), ("train", "validation")))], "i int, motif string, split string")
    count = lambda mode: {(r["fold"], r["split"], r["motif"]) for r in qc.leave_one_group_out(df, "motif", ["GAACT"], mode).collect()}
    assert count("none") == {("GAACT", "train", "AGACT")}
    assert count("heldout-group") - count("none") == {("GAACT", "validation", "GAACT")}
    assert count("train-groups") - count("none") == {("GAACT", "validation", "AGACT")}
    assert len(count("keep-all")) == 3


def test_fold_metrics_pool_runs(spark):
    rows = [(f, f, r, y, 0.9 if y else 0.1) for f in ("AGACT",) for r in ("r1", "r2") for y in (0, 1)] + [("AGACT", "GAACT", "r1", 1, 0.2)]
    df = spark.createDataFrame(rows, "fold string, motif string, run string, y int, score double")
    folds = spark.createDataFrame([("AGACT",), ("TGACT",)], "fold string")
    out = {r["fold"]: r for r in M.fold_metrics(df, folds, source="run").collect()}
    assert (out["AGACT"]["positives"], out["AGACT"]["negatives"], out["AGACT"]["roc_auc"], out["AGACT"]["scanned_rows"]) == (2, 2, 1.0, 5)
    assert out["TGACT"]["roc_auc"] is None and out["TGACT"]["scanned_rows"] is None


def test_monotonicity(spark):
    df = spark.createDataFrame([(0.0, 0.1), (50.0, 0.5), (100.0, 0.9)], "r double, s double")
    rows = M.monotonicity(df, "r", "s", [0, 50, 100]).collect()
    assert all(r["monotonic"] and r["grid_complete"] for r in rows)
    bad = M.monotonicity(df.withColumn("s", -F.col("s")), "r", "s", [0, 25]).collect()
    assert not bad[0]["monotonic"] and not bad[0]["grid_complete"]


def test_only_controls_rejects_other_ratios(spark):
    df = spark.createDataFrame([(0, 0.1), (100, 0.9), (50, 0.5)], "ratio int, score double")
    assert M.pairwise_ratio_roc(df.where("ratio <> 50"), "ratio", only_controls=True).first()["roc_auc"] == 1.0
    with pytest.raises(Exception, match="neither 0 nor 100"):
        M.pairwise_ratio_roc(df, "ratio", only_controls=True).collect()


def brute_windows(length, chunk, overlap):
    stride = chunk - overlap
    return [] if length < chunk else [(s, s + chunk) for s in range((length - chunk) % stride, length - chunk + 1, stride)]


def test_windows_are_anchored_at_the_end(spark):
    lengths = [0, 5, 9, 10, 11, 17, 18, 40, 41]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    got = {}
    for r in N.chunk_windows(df, "n", 10, 3).collect():
        got.setdefault(r["n"], []).append((r["window_start"], r["window_end"]))
    for n in lengths:
        assert sorted(got.get(n, [])) == brute_windows(n, 10, 3)
    with pytest.raises(ValueError):
        N.chunk_windows(df, "n", 10, 10)


def test_bases_and_units_in_windows(spark):
    rng = random.Random(5)
    emitted = sorted(rng.choices(range(120), k=40))
    reads = spark.createDataFrame([("r", 120, emitted)], "read_id string, signal_length int, emitted array<int>")
    got = {(r["window_start"], r["window_end"]): (r["left"], r["right"]) for r in J.bases_in_windows(reads, 25, 9).collect()}
    for s, e in brute_windows(120, 25, 9):
        inside = [i for i, p in enumerate(emitted) if s <= p < e]
        assert got.get((s, e)) == ((inside[0], inside[-1] + 1) if inside else None)
    units = spark.createDataFrame([(x, 120) for x in range(125)], "center_signal int, signal_length int")
    best = {r["center_signal"]: r["window_start"] for r in J.assign_best_window(units, 25, 9).collect()}
    for x in range(125):
        holding = [w for w in brute_windows(120, 25, 9) if w[0] <= x < w[1]]
        want = max(holding, key=lambda w: min(x - w[0], w[1] - x))[0] if holding else None
        assert best.get(x) == want


def greedy_by_hand(seq, patterns, mm, ident, both):
    found = []
    for pid, pat, center in patterns:
        for orient, p, c in [("+", pat, center)] + ([("-", pat[::-1], len(pat) - 1 - center)] if both else []):
            for s in range(len(seq) - len(p) + 1):
                k = sum(a != b for a, b in zip(seq[s : s + len(p)], p))
                if k <= mm and 1 - k / len(p) >= ident:
                    found.append((-(1 - k / len(p)), k, s, pid, orient, s + len(p), s + c))
    chosen = []
    for f in sorted(found):
        if not any(f[2] < o[5] and f[5] > o[2] for o in chosen):
            chosen.append(f)
    return {(f[2], f[3], f[4], f[6], f[1]) for f in found}, {(f[2], f[3], f[4], f[6], f[1]) for f in chosen}


@pytest.mark.parametrize("mm,both", [(0, False), (1, True), (2, True)])
def test_pattern_search_equals_brute_force(spark, mm, both):
    rng = random.Random(mm)
    seqs = {f"r{i}": "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 3, 6, 200, 1030, 2100]))) for i in range(12)}
    patterns = [("p1", "GGACT", 2), ("p2", "ACGTAC", 0), ("p3", "TTT", 1)]
    reads = spark.createDataFrame(list(seqs.items()), "read_id string, seq string")
    pats = spark.createDataFrame(patterns, "pattern_id string, pattern string, center int")
    hits, kept = {}, {}
    for frame, store in ((J.pattern_hits(reads, pats, mm, 0.6, both), hits), (J.find_patterns(reads, pats, max_mismatches=mm, min_identity=0.6, both_orientations=both), kept)):
        for r in frame.collect():
            store.setdefault(r["read_id"], []).append((r["start"], r["pattern_id"], r["orientation"], r["center_index"], r["mismatches"]))
    for rid, seq in seqs.items():
        all_, chosen = greedy_by_hand(seq, patterns, mm, 0.6, both)
        assert sorted(hits.get(rid, [])) == sorted(all_)
        assert sorted(kept.get(rid, [])) == sorted(chosen)


def test_pattern_centre_and_window(spark):
    reads = spark.createDataFrame([("r", "TTTGGACTAAA")], "read_id string, seq string")
    pats = spark.createDataFrame([("o", "GGACT", 2)], "pattern_id string, pattern string, center int")
    unit = J.find_patterns(reads, pats).first()
    assert unit["center_index"] == 5


def test_windows_free_of_intervals(spark):
    rng = random.Random(9)
    wins = [("r", s, s + 20) for s in range(0, 3000, 15)]
    zones = [("r", s, s + rng.randint(1, 40)) for s in rng.sample(range(3000), 25)] + [("q", 0, 3000)]
    w = spark.createDataFrame(wins, "read_id string, left int, right int")
    z = spark.createDataFrame(zones, 'read_id string, start int, end int')
    got = {r["left"] for r in J.anti_overlap(w, z, 4, 64).collect()}
    want = {s for _, s, e in wins if not any(q == "r" and s < b + 4 and e > max(a - 4, 0) for q, a, b in zones)}
    assert got == want


def test_negative_windows(spark):
    cand = spark.createDataFrame([(r, s) for r in ("a", "b") for s in range(10)], "read_id string, window_start int")
    pos = spark.createDataFrame([("a",), ("a",)], "read_id string")
    out = {r["read_id"]: r["count"] for r in N.sample_negatives(cand, pos, 3).groupBy("read_id").count().collect()}
    assert out == {"a": 6, "b": 3}
    row = spark.range(1).select(
        N.negative_targets(F.lit("CAGGACTA")).alias("c"), N.negative_targets(F.lit("CAGGACTA"), "all").alias("a"), N.negative_targets(F.lit("CAGGACTA"), "all", ["GGACT"]).alias("m")
    ).first()
    assert [i for i, x in enumerate(row["c"]) if x == 0] == [4] and [i for i, x in enumerate(row["a"]) if x == 0] == [1, 4, 7]
    assert [i for i, x in enumerate(row["m"]) if x == 0] == [4]


def test_label_windows(spark):
    wins = spark.createDataFrame([("r", 0, 30, 0, "GGACT"), ("r", 30, 60, 5, "ANA"), ("r", 60, 90, 8, "CCC"), ("r", 90, 120, 9, "AA")], "read_id string, window_start int, window_end int, left int, target_seq string")
    cols = "read_id string, window_start int, start int, center_index int, label int, pattern_id string, motif string, orientation string, identity double"
    units = spark.createDataFrame([("r", 0, 0, 2, 4, "o1", "GGACT", "+", 1.0), ("r", 0, 1, 3, 0, "o2", "X", "+", 0.5), ("r", 30, 5, 5, 4, "o", "m", "+", 1.0), ("r", 60, 8, 8, 4, "o", "m", "+", 1.0)], cols)
    out = {r["window_start"]: r for r in N.label_windows(wins, units).collect()}
    assert out[0]["target"] == [-100, -100, 4, -100, -100] and out[0]["pattern_ids"] == "o1" and out[0]["positive_count"] == 1 and out[0]["mean_identity"] == 1.0
    assert [out[k]["reject_reason"] for k in (30, 60, 90)] == ["no_label"] * 3
    assert N.label_windows(wins, units, max_length=4).where("window_start = 0").first()["reject_reason"] == "too_long"


def test_alignment_totals_against_dynamic_programming(spark):
    def dp(a, b):
        d = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            if i or j:
                opts = []
                if i and j:
                    c, m = d[i - 1][j - 1]
                    opts.append((c, m - 1) if a[i - 1] == b[j - 1] else (c + 1, m))
                if i:
                    opts.append((d[i - 1][j][0] + 1, d[i - 1][j][1]))
                if j:
                    opts.append((d[i][j - 1][0] + 1, d[i][j - 1][1]))
                d[i][j] = min(opts)
        return d[-1][-1]

    rng = random.Random(2)
    rows = []
    for k in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40)))
        b = a if k % 10 == 0 else "".join(x for x in a if rng.random() > 0.1) + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 8)))
        rows.append((k, a, b))
    left = spark.createDataFrame([(k, a) for k, a, _ in rows], "read_id int, seq string")
    right = spark.createDataFrame([(k, b) for k, _, b in rows], "read_id int, seq string")
    out = {r["read_id"]: r for r in C.alignment_ops(C.compare_callsets(left, right)).collect()}
    for k, a, b in rows:
        cost, neg = dp(a, b)
        r = out[k]
        assert r["matches"] == -neg and r["mismatches"] + r["insertions"] + r["deletions"] == cost
        assert r["matches"] + r["mismatches"] + r["insertions"] == len(a) and r["matches"] + r["mismatches"] + r["deletions"] == len(b)
    totals = C.error_rates(C.event_totals(C.alignment_ops(C.compare_callsets(left, right)))).first()
    assert totals["matches"] == sum(out[k]["matches"] for k in out) and totals["reads_a"] == 60
    assert totals["deletion_rate"] == pytest.approx(totals["deletions"] / totals["matches"])


def test_callsets_one_sided_and_summary_of_nothing(spark):
    a = spark.createDataFrame([("x", "ACG", 1.0), ("y", "A", None)], "read_id string, seq string, q double")
    b = spark.createDataFrame([("y", "AC", 2.0), ("z", "C", 1.0)], "read_id string, seq string, q double")
    pairs = C.compare_callsets(a, b, quality="q")
    rows = {r["read_id"]: r for r in pairs.collect()}
    assert rows["x"]["presence"] == "a_only" and rows["z"]["edit_distance"] is None and rows["y"]["edit_distance"] == 1 and rows["y"]["quality_delta"] is None
    assert C.presence_counts(pairs).first().asDict() == {"shared": 1, "a_only": 1, "b_only": 1}
    empty = C.callset_summary(pairs.where("presence = 'none'").withColumn("identity", F.lit(1.0))).first()
    assert empty["mean_identity"] == 0.0 and empty["median_identity"] == 0.0 and empty["mean_quality_a"] is None


def test_projection_rules(spark):
    df = spark.createDataFrame([(4, 0, "ACGT", "ACGT", 2, 1), (0, 0, "A", "C", 0, 0)], "matches int, mismatches int, seq_a string, seq_b string, target_sites int, valid_sites int")
    r = C.projection_summary(C.projection_coverage(df)).first()
    assert (r["mean_target_coverage"], r["mean_site_coverage"], r["samples_without_projection"]) == (0.5, 0.5, 1)
    none = C.projection_summary(C.projection_coverage(df.where("target_sites = 0"))).first()
    assert (none["mean_site_coverage"], none["samples_without_projection"]) == (0.0, 1)
    assert C.projection_summary(C.projection_coverage(df.where("matches > 9"))).first()["mean_target_coverage"] == 0.0


def test_path_runs_lift_sites(spark):
    rows = [(1, "ACGT", "ACGT"), (2, "ANGTTT", "ACGTT"), (3, "ACT", "ACGGT"), (4, "", "AC"), (5, None, "A"), (6, "AC", None), (7, "", "")]
    pairs = spark.createDataFrame(rows, "read_id int, seq_a string, seq_b string")
    out = C.alignment_ops(pairs, runs=True).withColumn("at", C.lift_sites(F.expr("array(0, 1, 3, 9, -1)"), F.col("runs")))
    out = {r["read_id"]: r for r in out.collect()}
    assert {k: [tuple(x) for x in out[k]["runs"]] for k in (1, 3, 4, 7)} == {1: [("=", 0, 0, 4)], 3: [("=", 0, 0, 2), ("D", 2, 2, 2), ("=", 2, 4, 1)], 4: [("D", 0, 0, 2)], 7: []}
    assert out[1]["at"] == [0, 1, 3, None, None] and out[3]["at"] == [0, 1, None, None, None]
    assert (out[2]["matches"], out[2]["mismatches"], out[2]["insertions"], out[2]["deletions"]) == (4, 1, 1, 0)
    assert out[2]["coverage_a"] == pytest.approx(4 / 6) and out[2]["coverage_b"] == pytest.approx(4 / 5)
    assert out[4]["deletions"] == 2 and out[4]["coverage_a"] == 0.0 and out[7]["matches"] == 0
    assert all(out[k][c] is None for k in (5, 6) for c in ("matches", "runs"))
    plain = {r["read_id"]: r for r in C.alignment_ops(pairs).collect()}
    assert all(plain[k][c] == out[k][c] for k in out for c in (*C.OPS, "identity", "coverage_a", "coverage_b"))


def test_distance_of_long_reads(spark):
    rng = random.Random(5)
    a = "".join(rng.choice("ACGT") for _ in range(3000))
    rows = [(1, a, a), (2, a, a[:100] + a[150:]), (3, a, a[::-1]), (4, a, None), (5, "", a), (6, None, None)]
    left = spark.createDataFrame([r[:2] for r in rows], "read_id int, seq string")
    right = spark.createDataFrame([(r[0], r[2]) for r in rows], "read_id int, seq string")
    got = [{r["read_id"]: r["edit_distance"] for r in C.compare_callsets(left, right, long_reads=x).collect()} for x in (False, True)]
    assert got[0] == got[1] and got[1][3] > 512 and got[1][5] == 3000 and got[1][4] is None


def test_manifest_join_rejects_unknown_ids(spark):
    runs = spark.createDataFrame([("b", ["o1", "o2"])], "run_id string, oligo_ids array<string>")
    reads = spark.createDataFrame([(1, "b")], "read_id int, run_id string")
    oligos = spark.createDataFrame([("o1", "ACG")], "oligo_id string, sequence string")
    assert [r["oligo_id"] for r in J.undefined_oligos(runs, oligos).collect()] == ["o2"]
    with pytest.raises(Exception, match="not in manifest: o2"):
        J.join_manifests(reads, runs, oligos).collect()


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", float("inf")), ("b", None)], "g string, x double")
    out = {r["g"]: r for r in P.numeric_profile(df, ["g"], ["x"]).collect()}
    assert (out["a"]["count"], out["a"]["finite"], out["a"]["median"], out["a"]["std"]) == (3, 2, 2.0, 1.0)
    assert (out["b"]["count"], out["b"]["finite"], out["b"]["mean"], out["b"]["median"]) == (2, 0, None, None)
    side = spark.createDataFrame([("l", "x", 1.0), ("l", "y", 3.0), ("r", "x", 2.0)], "s string, v string, n double")
    d = P.distribution_distance(side, "s", "l", "r", ["v"]).first()
    assert (d["total_variation"], d["overlap"]) == (0.5, 0.5)
    assert P.distribution_distance(side, "s", "l", "nobody", ["v"]).first()["overlap"] is None
    s = P.numeric_shift(side.withColumn("n", F.lit(2.0)), "s", "l", "r", ["n"]).first()
    assert s["mean_delta"] == 0.0 and s["standardized_mean_difference"] is None
    hist = {r["bin"]: r["count"] for r in P.histogram(side, "n", 2).collect()}
    assert hist == {0: 1, 1: 2}


def test_history(spark):
    df = spark.createDataFrame([("m", 1.0, 0.9, 0.5), ("m", 2.0, 0.5, 0.3), ("m", 3.0, 0.4, 0.3), ("m", 4.0, 0.3, None)], "run string, epoch double, train_loss double, valid_loss double")
    r = P.history_summary(df).first()
    assert (r["best_epoch"], r["last_epoch"], r["train_valid_gap"], r["epochs"]) == (2.0, 4.0, None, 4)


def test_rule_order_names_the_first_failure(spark):
    df = spark.createDataFrame([(1, 0.5, 5), (2, 0.99, 5), (3, 0.99, 30), (4, None, 30)], "i int, identity double, mapq int")
    out = {r["i"]: r["reject_reason"] for r in qc.qc_filter(df, "alignment-strict", keep_all=True).collect()}
    assert out == {1: "low_identity", 2: "low_mapq", 3: None, 4: "low_identity"}
    counters = {r["counter"]: r["rows"] for r in qc.reject_counters(qc.qc_filter(df, "alignment-strict", keep_all=True)).collect()}
    assert counters == {"low_identity": 2, "low_mapq": 1, "written": 1, "seen": 4}


def test_merge_fills_missing_fields(spark):
    a = spark.createDataFrame([(1, "x")], "i int, run string")
    b = spark.createDataFrame([(2, "y", 3.0)], "i int, motif string, q double")
    rows = {r["source_dataset"]: r for r in J.merge_sources({"a": a, "b": b}).collect()}
    assert rows["a"]["motif"] == "" and rows["a"]["q"] is None and rows["b"]["run"] == ""
    assert spark.range(1).select(J.pad_array(F.array(F.lit(1)), 3, -100).alias("p")).first()["p"] == [1, -100, -100]
