"""Distances and totals of unlike sequences: bit vectors, the narrow band, and one comparison for a summary."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitebag.operators import pairs as C
from sitebag.operators import wavefront


def table(a, b):
    """(distance, -matches) by the plain table."""
    row = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, 0)]
        for j, y in enumerate(b, 1):
            diagonal = (row[j - 1][0], row[j - 1][1] - 1) if x == y else (row[j - 1][0] + 1, row[j - 1][1])
            new.append(min(diagonal, (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return row[-1][0], -row[-1][1]


@pytest.mark.parametrize("letters", ["AC", "ACGT", "ACGTNé€😀"])
def test_unlike_sequences(letters):
    rng = random.Random(len(letters))
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for n, m in [(0, 0), (0, 3), (1, 1), (5, 70), (64, 65), (90, 30), (63, 1)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(40)]:
        a, b = text(n), text(m)
        cost, matches = table(a, b)
        assert wavefront.bit_distance(a, b) == cost
        for known in (None, cost):
            found = wavefront.totals(a, b, known)
            assert (found[0], sum(found[1:])) == (matches, cost)
            assert (sum(found[:3]), found[0] + found[1] + found[3]) == (n, m)


def test_edit_distance_on_both_sides_of_the_limit(spark):
    rng = random.Random(3)
    rows = [(None, "A"), ("A", None), ("", ""), ("", "ACG"), ("A" * 70, "C" * 70), ("A" * 64, "C" * 64), ("A" * 65, "C" * 65), ("é" * 200, "ACGT" * 40)]
    rows += [tuple("".join(rng.choice("ACGT") for _ in range(rng.randrange(60, 200))) for _ in "ab") for _ in range(30)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(3)
    for long_reads in (False, True):
        got = df.select("a", "b", C.edit_distance(F.col("a"), F.col("b"), long_reads).alias("d")).collect()
        assert all(r.d == (None if r.a is None or r.b is None else table(r.a, r.b)[0]) for r in got) and len(got) == len(rows)


def test_band_is_as_narrow_as_the_distance_allows(monkeypatch):
    a, b = "AC" * 40, "GT" * 45
    halves = []
    band = wavefront._banded
    monkeypatch.setattr(wavefront, "_banded", lambda x, y, half: halves.append(half) or band(x, y, half))
    cost, matches = table(a, b)
    found = wavefront.totals(a, b)
    assert (found[0], sum(found[1:])) == (matches, cost) and halves == [(cost - len(b) + len(a)) // 2]


def test_summary_compares_each_pair_once(spark):
    plan = entry.queries()["a20_callset_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan.lower()  # measured before, in the staged rows
