"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from sitebag.operators import sites as S
from sitebag.operators.qc import primary_only
from sitebag.sources.chunks import read_chunks, write_chunks
from sitebag.sources.fasta import read_fasta_bins
from sitebag.sources.sam import read_sam, tag_ints
from sitebag.sources.tables import read_manifest, read_result_tree, read_sites, write_report

SAM = """@HD\tVN:1.6
r1\t0\tchr1\t11\t60\t2S4M\t*\t0\t0\tGGACAA\t*\tmv:B:c,5,1,1\tns:i:100\tts:i:3\tMM:Z:A+a.,0;\tML:B:C,200
r2\t16\tchr1\t21\t7\t3M1I2M\t*\t0\t0\tACGTAC\t*\tmv:B:c,5,1\tns:i:90\tdx:i:1
r3\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*\tmv:B:c,5,1\tns:i:9
r4\t256\tchr2\t5\t9\t3M\t*\t0\t0\tACG\t*\tmv:B:c,5,1\tns:i:9
r5\t2048\tchr2\t5\t9\t3M\t*\t0\t0\tACG\t*\tmv:B:c,5,1\tns:i:9
r6\t0\tchr2\t5\t9\t2M1D1M\t*\t0\t0\tACG\t*
"""


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    rows = {r["read_id"]: r for r in read_sam(spark, str(tmp_path / "x.sam")).withColumn("ml", tag_ints(F.col("tags"), "ML")).collect()}
    assert len(rows) == 6
    assert rows["r1"]["pos0"] == 10 and rows["r1"]["tags"]["MM"] == "A+a.,0;" and rows["r1"]["ml"] == [200]
    assert rows["r3"]["contig"] is None and rows["r3"]["pos0"] == -1 and rows["r3"]["is_unmapped"]
    assert rows["r2"]["is_reverse"] and rows["r4"]["is_secondary"] and rows["r5"]["is_supplementary"]
    assert [r["read_id"] for r in primary_only(read_sam(spark, str(tmp_path / "x.sam"))).collect()] == ["r1"]


def test_bed_sites(spark, tmp_path):
    (tmp_path / "g.bed").write_text("# c\ntrack x\nchr1 9 10 first 3 +\nchr1\t9\t10\tm6A_1\t5\t+\nchr2\t4\t5\n")
    rows = {(r["contig"], r["pos"], r["strand"]): r for r in read_sites(spark, str(tmp_path / "g.bed")).collect()}
    assert rows[("chr1", 9, "+")]["name"] == "m6A_1" and rows[("chr1", 9, "+")]["support"] == 5.0
    assert rows[("chr2", 4, ".")]["name"] == "chr2:4-5"


def test_site_table_is_one_based(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("chr\tpos\tstrand\tcontext\tratio\nchr1\t14517\t-\tGGACT\t0.4145\n")
    r = read_sites(spark, str(tmp_path / "g.tsv")).first()
    assert (r["contig"], r["pos"], r["strand"], r["support"], r["name"]) == ("chr1", 14516, "-", 0.4145, "chr1:14516-14517:-")
    (tmp_path / "s.csv").write_text("Chrom,chromStart,Site ID\nc,7,x\n")
    r = read_sites(spark, str(tmp_path / "s.csv"), ignore_strand=True).first()
    assert (r["pos"], r["strand"], r["name"]) == (7, ".", "x")


def test_fasta_context(spark, tmp_path):
    seq = "ACGTTGCAAC" * 9 + "GGACT"
    body = "\n".join(seq[i : i + 7] for i in range(0, len(seq), 7))
    (tmp_path / "r.fa").write_text(f">chr1 note\n{body}\n>chr2\nACN\nTA\n")
    bins = read_fasta_bins(spark, str(tmp_path / "r.fa"), 16, 4)
    rows = {(r["contig"], r["bin"]): r for r in bins.collect()}
    assert len(rows) == 6 + 1
    for (c, b), r in rows.items():
        if c == "chr1":
            lo = max(b * 16 - 4, 0)
            assert r["start"] == lo and r["seq"] == seq[lo : (b + 1) * 16 + 4]
    sites = spark.createDataFrame([("chr1", p, s) for p in range(-1, 97) for s in "+-"] + [("chr2", 2, "+"), ("chr9", 1, "+")], "contig string, pos int, strand string")
    comp = str.maketrans("ACGT", "TGCA")
    for r in S.site_context(sites, bins, 5, bin_size=16).collect():
        if r["contig"] != "chr1":
            assert r["kmer"] is None
            continue
        p = r["pos"]
        want = seq[p - 2 : p + 3] if 2 <= p < len(seq) - 2 else None
        if want and r["strand"] == "-":
            want = want.translate(comp)[::-1]
        assert r["kmer"] == want and r["ref_base"] == (seq[p] if 0 <= p < len(seq) else None)


def test_manifest(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# note\nRun_ID\tstatus\toligos\nb1\tivt\to1, o2;o3\n# x\nb2\tmod\t\nb1\ttest\to9\n")
    aliases = {"run_id": ["run_id", "run"], "status": ["modification_status", "status"], "oligo_ids": ["oligo_ids", "oligos"], "split": ["split", "role"]}
    out = {r["run_id"]: r for r in read_manifest(spark, str(tmp_path / "m.tsv"), aliases, "run_id", ["oligo_ids"], {"split": "train"}).collect()}
    assert out["b1"]["status"] == "test" and out["b1"]["oligo_ids"] == ["o9"] and out["b2"]["oligo_ids"] == [] and out["b2"]["split"] == "train"
    (tmp_path / "e.tsv").write_text("# only\nrun_id\tstatus\n")
    with pytest.raises(ValueError, match="no rows"):
        read_manifest(spark, str(tmp_path / "e.tsv"), aliases, "run_id")


def test_result_tree(spark, tmp_path):
    for fold in ("AGACT", "GAACT"):
        for run in ("batch_r1", "batch_r2"):
            d = tmp_path / f"leave_{fold}" / f"heldout_{run}"
            d.mkdir(parents=True)
            (d / "site_predictions.tsv").write_text("sample_index\ttarget\tprob\n0\t1\t0.9\n1\t0\t0.1\n")
    args = (spark, f"{tmp_path}/leave_*/heldout_*/*.tsv", r"leave_([^/]+)/heldout_([^/]+)/", ["fold", "run"])
    rows = read_result_tree(*args, required=["target"], strip_prefixes={"run": ["batch_"]}).groupBy("fold", "run").count().collect()
    assert {(r["fold"], r["run"], r["count"]) for r in rows} == {(f, r, 2) for f in ("AGACT", "GAACT") for r in ("r1", "r2")}
    with pytest.raises(ValueError, match="missing columns"):
        read_result_tree(*args, required=["nothing"])


def test_chunks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", [1, 2]), (2, "validation", [1]), (3, "train", [])], "sample_id int, split string, reference array<int>")
    summary = {r["split"]: r for r in write_chunks(df, str(tmp_path / "c")).collect()}
    assert summary["train"]["samples"] == 2 and summary["train"]["reference_max_length"] == 2
    valid = read_chunks(spark, str(tmp_path / "c"), "validation")
    assert valid.count() == 1
    assert "PartitionFilters: [isnotnull(split" in valid._jdf.queryExecution().toString()
    assert [r["sample_id"] for r in read_chunks(spark, str(tmp_path / "c"), limit=2).collect()] == [1, 2]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    write_report(df, str(tmp_path / "t"), "tsv", ["y"])
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().asDict() == {"y": "a"}
    write_report(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).first()["x"] == 1
