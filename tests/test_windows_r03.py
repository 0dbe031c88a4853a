"""Best windows by arithmetic, letters of windows by one cut, and units that bring their read's length along."""

import pytest

import __spark_entry__ as entry
from sitebag.operators import joins as J
from sitebag.operators import windows as W

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("chunk, overlap", [(10, 0), (10, 3), (11, 4), (12, 11), (7, 6)])
def test_best_window_is_the_first_of_the_largest_margin(spark, chunk, overlap):
    stride = chunk - overlap
    rows = [(n, x) for n in (0, chunk - 1, chunk, chunk + 1, 3 * chunk + 5) for x in range(-1, n + 1)]
    units = spark.createDataFrame(rows, "signal_length int, center_signal int")
    want = {}
    for n, x in rows:
        starts = range((n - chunk) % stride, n - chunk + 1, stride) if n >= chunk else ()
        held = [(-min(x - s, s + chunk - x), s) for s in starts if s <= x < s + chunk]
        if held:
            want[n, x] = min(held)[1]
    got = J.assign_best_window(units, chunk, overlap)
    assert {(r.signal_length, r.center_signal): r.window_start for r in got.collect()} == want
    assert got.columns == ["signal_length", "center_signal", "window_start", "window_end"]
    assert "lambda" not in plan(got)  # no list of windows for each unit


def test_units_need_no_join_for_the_length_of_their_read(spark):
    assert "Join" not in plan(entry.queries()["j7_assign_best_window"](spark, SF))
    assert plan(entry.queries()["w14_label_windows"](spark, SF)).count("Join") == 1


@pytest.mark.parametrize("chunk, overlap", [(10, 0), (10, 3), (12, 11)])
def test_sequence_windows_have_the_letters_of_their_range(spark, chunk, overlap):
    texts = [None, "", "A" * (chunk - 1), "ACGTACGTACGT"[:chunk], "".join("ACGT"[i * i % 4 - i % 3] for i in range(97)), "A\nCé" * 9]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id int, seq string")
    got = {(r.read_id, r.window_start): (r.window_end, r.target_seq) for r in W.sequence_windows(reads, chunk, overlap).collect()}
    stride = chunk - overlap
    assert got == {
        (i, s): (s + chunk, t[s : s + chunk]) for i, t in enumerate(texts) if t and len(t) >= chunk for s in range((len(t) - chunk) % stride, len(t) - chunk + 1, stride)
    }
