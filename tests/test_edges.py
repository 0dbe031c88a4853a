"""Rows that ordinary data do not hold: lost groups, short lines, several codes, unknown ids, unlisted values, caps."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sitebag.functions.alignment import decode_mod_tags
from sitebag.operators import joins as J
from sitebag.operators import metrics as M
from sitebag.operators import profile as P
from sitebag.operators import sampling as W
from sitebag.operators import sites as S
from sitebag.operators.pairs import compare_callsets, edit_distance
from sitebag.ordering import seeded_rank
from sitebag.session import shared_dir
from sitebag.sources.tables import read_sites


def calls(spark, seq, mm, ml, **kw):
    rows = spark.createDataFrame([(seq, mm, ml)], "seq string, mm string, ml array<int>")
    found = rows.select(decode_mod_tags(F.col("seq"), F.col("mm"), F.col("ml"), **kw).alias("c")).first()["c"]
    return [(c["query_pos"], round(c["prob"] * 255)) for c in found]


def test_groups_with_several_codes(spark):
    mm, ml = "C+mh,0,0;A+a.,0,0;", [10, 20, 30, 40, 100, 200]
    assert calls(spark, "CCAA", mm, ml) == [(2, 100), (3, 200)]
    assert calls(spark, "CCAA", mm, ml, base="C", code="h") == [(0, 20), (1, 40)]
    assert calls(spark, "CCAA", "C+76792,1;C+m;A+a,0;", [7, 9], base="C", code="76792") == [(1, 7)]
    assert calls(spark, "CCAA", "C+76792,1;C+m;A+a,0;", [7, 9]) == [(2, 9)]


def test_reverse_records_are_walked_from_the_other_end(spark):
    rows = spark.createDataFrame([("TTA", "A+a,1;", [50], True)], "seq string, mm string, ml array<int>, rev boolean")
    found = rows.select(decode_mod_tags(F.col("seq"), F.col("mm"), F.col("ml"), is_reverse=F.col("rev")).alias("c")).first()["c"]
    assert [c["query_pos"] for c in found] == [0]


def test_group_without_negatives_is_kept(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("b", 1, 0.7)], "g string, y int, score double")
    cum = M.cumulate(M.score_histogram(rows, by=["g"]), ["g"])
    got = {r["g"]: (r["tpr"], r["threshold"]) for r in M.tpr_at_fpr(cum, [0.1], ["g"]).collect()}
    assert got == {"a": (1.0, 0.9), "b": (0.0, None)}


def test_short_bed_line_stops(spark, tmp_path):
    path = tmp_path / "sites.bed"
    path.write_text("chr1\t9\t10\tx\t3\t+\nchr1\t20\n")
    with pytest.raises(PySparkException, match="fewer than 3 columns"):
        read_sites(spark, str(path), "bed").select("contig").collect()


def test_unknown_oligo_stops_whatever_is_selected(spark):
    reads = spark.createDataFrame([("r1", "run1")], "read_id string, run_id string")
    runs = spark.createDataFrame([("run1", ["o1", "o9"])], "run_id string, oligo_ids array<string>")
    oligos = spark.createDataFrame([("o1", "GGACT")], "oligo_id string, motif string")
    with pytest.raises(PySparkException, match="o9"):
        J.join_manifests(reads, runs, oligos).select("read_id", "motif").collect()
    assert J.join_manifests(reads, runs.select("run_id", F.array(F.lit("o1")).alias("oligo_ids")), oligos).count() == 1


def test_unlisted_values_are_counted_or_stop(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "r string, c string")
    got = {r["r"]: (r["x"], r["rest"]) for r in P.count_matrix(rows, "r", "c", ["x"], ["a", "b", "z"], other="rest").collect()}
    assert got == {"a": (1, 1), "b": (0, 1), "z": (0, 0)}
    with pytest.raises(PySparkException, match="without a column"):
        P.count_matrix(rows, "r", "c", ["x"]).collect()


def test_histogram_counts_values_outside(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (7.0,)], "v double")
    got = {r["bin"]: (r["left_edge"], r["count"]) for r in P.histogram(rows, "v", 2, 0.0, 1.0).collect()}
    assert got == {-1: (None, 1), 0: (0.0, 1), 1: (0.5, 2), 2: (1.0, 1)}


def test_gold_sanity_without_strand_and_base(spark):
    rows = spark.createDataFrame(
        [(".", "A", "AGTTT"), (".", "G", "GGACT"), ("+", "N", None), ("+", "A", None), ("-", "T", "GGACT")],
        "strand string, ref_base string, kmer string",
    )
    total = next(r for r in S.gold_sanity(rows).collect() if r["strand"] is None)
    assert (total["checked"], total["compatible"], total["mismatched"]) == (4, 3, 1)
    assert (total["motif_checked"], total["motif_matched"]) == (5, 3)


def test_project_calls(spark):
    rows = spark.createDataFrame(
        [("r1", 0, "c", 10, "1S3M1I2M", "AACAGAA", {"MM": "A+a.,1;", "ML": "C,255"}), ("r2", 16, "c", 5, "3M", "TAA", {"MM": "A+a,0;", "ML": "C,51"}),
         ("r3", 4, None, 0, "*", "AAA", {}), ("r4", 256, "c", 5, "3M", "AAA", {})],
        "read_id string, flag int, contig string, pos0 long, cigar string, seq string, tags map<string,string>",
    )

    def got(**kw):
        return sorted((r["read_id"], r["pos"], r["strand"], r["prob"]) for r in S.project_calls(rows, **kw).collect())

    first = [("r1", 10, "+", 1.0), ("r1", 12, "+", None), ("r1", 13, "+", None), ("r1", 14, "+", None)]
    assert got() == [*first, ("r2", 6, "-", 0.2), ("r2", 7, "-", None)]
    assert got(oriented=True) == [*first, ("r2", 5, "-", 0.2)]


def test_caps_stay_optional(spark):
    rows = spark.createDataFrame([(i, str(25 * (1 + i % 2)), f"s{i % 3}") for i in range(120)], "sample_id long, ratio_label string, site_key string")
    assert W.common_strata_sample(rows, ["site_key"], 5).count() == 30
    assert W.common_strata_sample(rows, ["site_key"]).count() == 120
    assert W.stratified_bags(rows, ["site_key"], 4, 3, 2).select("bag_key").distinct().count() == 12
    assert W.stratified_bags(rows, ["site_key"], 4, 3).select("bag_key").distinct().count() == 30


def test_edit_distance_bands(spark):
    pairs = [("kitten", "sitting"), ("", "abc"), ("x" * 700, "y" * 700), ("ab" * 80, "ba" * 80), ("same", "same")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(edit_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [3, 3, 700, 2, 0]


def test_excerpts_on_request(spark):
    rows = spark.createDataFrame([("r", "ACGT")], "read_id string, seq string")
    assert "prefix_a" not in compare_callsets(rows, rows).columns
    assert compare_callsets(rows, rows, excerpt=2).first()["prefix_a"] == "AC"


def test_shared_folder_must_be_named_off_local():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_ranks_do_not_depend_on_parts(spark):
    rows = spark.createDataFrame([(i, f"g{min(i % 7, 2)}" if i % 50 else None) for i in range(3000)], "id long, g string")
    whole = sorted((r["id"], r["rn"], r["n"]) for r in seeded_rank(rows, "id", ["g"], size="n").collect())
    cut = sorted((r["id"], r["rn"], r["n"]) for r in seeded_rank(rows, "id", ["g"], size="n", whole_rows=100).collect())
    assert whole == cut


def test_large_limits_give_the_same_rows(spark, monkeypatch):
    from sitebag.operators import metrics, qc

    df = spark.range(400).select(F.col("id"), (F.col("id") * 7 % 23 / 23).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    few = [{r["id"] for r in qc.seeded_limit(df, 150, "id").collect()}, {tuple(r) for r in metrics.top_n_hits(df, [10, 150], ["id"]).collect()}]
    monkeypatch.setattr(qc, "TOP_ROWS", 5)
    monkeypatch.setattr(metrics, "TOP_ROWS", 5)
    assert few == [{r["id"] for r in qc.seeded_limit(df, 150, "id").collect()}, {tuple(r) for r in metrics.top_n_hits(df, [10, 150], ["id"]).collect()}]


def test_long_intervals_make_few_rows(spark):
    from sitebag.operators.joins import _binned, _level, anti_overlap

    long = spark.createDataFrame([(0, 250_000_000)], "lo long, hi long")
    levels = F.concat(F.array(_level(F.col("lo"), F.col("hi"), 1024)), F.sequence(F.lit(20), F.lit(30)))
    assert long.select(F.size(_binned(F.col("lo"), F.col("hi"), levels, 1024))).first()[0] < 100
    rng = random.Random(3)
    spans = lambda n, sizes: [(rng.choice("ab"), s, s + rng.choice(sizes)) for s in (rng.randrange(0, 9000) for _ in range(n))]
    windows, zones = spans(120, [1, 60, 300, 5000]), spans(40, [1, 7, 200, 2500])
    got = anti_overlap(spark.createDataFrame(windows, "read_id string, left int, right int"), spark.createDataFrame(zones, 'read_id string, start int, end int'), 3, 16)
    want = [w for w in windows if not any(z[0] == w[0] and w[1] < z[2] + 3 and w[2] > max(z[1] - 3, 0) for z in zones)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and 0 < len(want) < len(windows)
    none = spark.createDataFrame([], "read_id string, start int, end int")
    assert anti_overlap(spark.createDataFrame(windows, "read_id string, left int, right int"), none, 3, 16).count() == len(windows)


def test_calls_are_laid_out_along_the_read(spark):
    from sitebag.functions.alignment import calls_by_place

    rows = [(1, [(2, 0.5), (5, 0.1)]), (2, []), (3, None), (4, [(0, 1.0)])]
    df = spark.createDataFrame(rows, "id int, c array<struct<query_pos:int,prob:double>>")
    got = {r["id"]: r["p"] for r in df.select("id", calls_by_place(F.col("c")).alias("p")).collect()}
    assert got == {1: [None, None, 0.5, None, None, 0.1], 2: [], 3: [], 4: [1.0]}


def test_first_reason_and_counters(spark, tmp_path):
    from sitebag.operators import chunks

    df = spark.createDataFrame([(1, 5, None), (2, 30, 2), (3, 30, 9), (4, None, 9)], "id int, q int, n int")
    why = chunks.first_reason(F.when(F.col("id") == 3, "early"), [("low_mapq", F.col("q") >= 10), ("no_a", F.col("n") > 3)])
    rows = df.withColumn("reject_reason", why)
    assert {r["id"]: r["reject_reason"] for r in rows.collect()} == {1: "low_mapq", 2: "no_a", 3: "early", 4: "low_mapq"}
    counters = {r["counter"]: r["rows"] for r in chunks.write_chunks_counted(rows.where("id <> 3").unionByName(rows.where("id = 3").withColumn("reject_reason", F.lit(None).cast("string"))), f"{tmp_path}/c").collect()}
    assert (counters["low_mapq"], counters["no_a"], counters["written"], counters["seen"], counters["too_long"]) == (2, 1, 1, 4, 0)
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/c").collect()] == [3]


def test_reference_from_bins(spark):
    from sitebag.operators.chunks import with_reference

    text = "ACGTTGCAAC" * 7
    bins = spark.createDataFrame([("c", b, max(b * 20 - 3, 0), text[max(b * 20 - 3, 0) : b * 20 + 23]) for b in range(4)], "contig string, bin long, start long, seq string")
    rows = spark.createDataFrame([(1, "c", 5, 8), (2, "c", 15, 65), (3, "c", 60, 90), (4, "d", 0, 9), (5, "c", None, None)], "id int, contig string, lo int, hi int")
    got = {r["id"]: r["reference"] for r in with_reference(rows, bins, ["id"], "lo", "hi", 20).collect()}
    assert got == {1: text[5:8], 2: text[15:65], 3: text[60:70], 4: "", 5: None}


def test_reports_at_every_nth_row(spark, tmp_path):
    from sitebag.streaming import start_progress

    schema, rng, written = "id int, reject_reason string", random.Random(2), 0
    for n in (7, 0, 25, 3, 40):
        rows = [(i, "bad" if rng.random() < 0.3 else None) for i in range(n)]
        written += sum(r[1] is None for r in rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        start_progress(stream, 10, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    got = sorted(r["written"] for r in spark.read.parquet(f"{tmp_path}/out/progress").collect())
    assert got == list(range(10, written + 1, 10)) and len(got) >= 4
