"""Findings of the third round: each of these failed before its change."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from check import as_rows
from sitebag.functions.alignment import decode_mod_tags
from sitebag.operators.chunks import with_reference
from sitebag.operators.joins import anti_overlap
from sitebag.plans.bindings import TABLES

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()


def test_every_fold_scans_every_row(spark):
    """the tree of m16 lists all runs under each fold."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    folds = QUERIES["m16_fold_metrics"](spark, SF).collect()
    assert len(folds) > 1
    assert {r.scanned_rows for r in folds} == {rows}


def test_tags_of_a_long_read(spark):
    """a list of 200,000 skips; the loop of the pattern took a stack frame for each."""
    n = 200_000
    row = spark.createDataFrame([("AC" * n, "A+a.," + "0," * (n - 1) + "0;", [7] * n)], "seq string, mm string, ml array<int>")
    calls = row.select(decode_mod_tags(F.col("seq"), F.col("mm"), F.col("ml")).alias("c"))
    found = calls.select(F.size("c").alias("n"), F.get("c", n - 1)["query_pos"].alias("last")).first()
    assert (found.n, found.last) == (n, 2 * n - 2)


@pytest.fixture(scope="module")
def letterless(tmp_path_factory):
    """The smallest tables with documents that have no letters, no characters or no text."""
    folder = tmp_path_factory.mktemp("letterless")
    for t in TABLES:
        if t != "documents":
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT * FROM '{SF}/documents.parquet' UNION ALL BY NAME SELECT * FROM (VALUES (900001, '123 !!', 'en', 'web', 6),
          (900002, '', 'en', 'web', 0), (900003, NULL, 'en', 'web', 0)) t(doc_id, text, lang, source, n_chars)) TO '{folder}/documents.parquet' (FORMAT parquet)"""
    )
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["p9_label_targets", "a23_alignment_profile"])
def test_reads_without_bases(name, spark, letterless):
    """a read without bases has no targets to sum and no length."""
    folder, con = letterless
    df = QUERIES[name](spark, folder)
    cur = con.execute(entry_module.oracle_sql()[name])
    assert as_rows(df.columns, [tuple(r) for r in df.collect()]) == as_rows([d[0] for d in cur.description], cur.fetchall())


def test_a_long_row_meets_its_reference_once(spark):
    """of a row that spans many bins one piece alone carries its other columns."""
    bins = spark.range(400).select(F.lit("c").alias("contig"), F.col("id").alias("bin"), (F.col("id") * 10).alias("start"), F.lit("ACGTACGTAC").alias("seq"))
    text = "".join(chr(33 + (i * 7919 + i // 90) % 90) for i in range(20_000))
    rows = spark.createDataFrame([(i, "c", 0, 4000, text) for i in range(20)], "id int, contig string, lo int, hi int, payload string")
    out = with_reference(rows, bins, ["id"], "lo", "hi", 10)
    assert {(r.reference, r.payload) for r in out.collect()} == {("ACGTACGTAC" * 400, text)}
    carried = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(_i#" in carried and "= 0)" in carried


def test_windows_and_zones_are_read_once(spark):
    """F2, F8: one shuffle of windows and zones; every row stands once in the plan, and ties at a border do not touch."""
    windows = spark.createDataFrame([("r", 0, 10), ("r", 10, 20), ("r", 20, 30), ("q", 0, 10), (None, 0, 5)], "read_id string, left int, right int")
    zones = spark.createDataFrame([("r", 10, 12), ("r", 0, 0), ("s", 0, 100)], 'read_id string, start int, end int')
    out = anti_overlap(windows, zones)
    assert sorted((r.read_id or "", r.left) for r in out.collect()) == [("", 0), ("q", 0), ("r", 0), ("r", 20)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
