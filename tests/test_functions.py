"""Column functions on small inline inputs."""

import math

import pytest
from pyspark.sql import functions as F

from sitebag.functions import alignment as A
from sitebag.functions import labels as L
from sitebag.functions import sequence as Q
from sitebag.functions import signal as G
from sitebag.functions.arrays import running_sum


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict(recursive=True)


def test_call_tags_decode(spark):
    ml = F.array(F.lit(128), F.lit(255))
    r = one(spark, c=A.decode_mod_tags(F.lit("CAAACA"), F.lit("A+a.,1,0;"), ml))
    assert {x["query_pos"]: x["prob"] for x in r["c"]} == {2: 128 / 255, 3: 1.0}


def test_call_tags_skip_other_groups_and_stop_at_the_end(spark):
    ml = F.array(*[F.lit(x) for x in (9, 8, 51)])
    r = one(spark, c=A.decode_mod_tags(F.lit("ACA"), F.lit("C+m?,0,0;A+a.,1,5;"), ml))
    assert [(x["query_pos"], x["prob"]) for x in r["c"]] == [(2, 0.2)]


def test_call_tags_reverse_aware(spark):
    ml = F.array(F.lit(255))
    forward = one(spark, c=A.decode_mod_tags(F.lit("TGAT"), F.lit("A+a,0;"), ml))
    walked = one(spark, c=A.decode_mod_tags(F.lit("TGAT"), F.lit("A+a,0;"), ml, is_reverse=F.lit(True)))
    assert forward["c"][0]["query_pos"] == 2
    assert walked["c"][0]["query_pos"] == 3


def test_call_tags_round_trip(spark):
    reads = spark.createDataFrame([("r1", "CAAACAGA"), ("r2", "CCC")], "read_id string, seq string")
    calls = spark.createDataFrame(
        [("r1", 2, "m6A", 0.5), ("r1", 5, "m6A", 1.0), ("r1", 1, "canonical_A", 0.9), ("r1", 0, "m5C", 0.2)],
        "read_id string, base_index int, label string, prob double",
    )
    out = {r["read_id"]: r for r in A.encode_mod_tags(reads, calls, {"m6A": "a", "m5C": "m"}).collect()}
    assert set(out) == {"r1"}
    assert out["r1"]["mm"] == "A+a.,1,1;C+m.,0;"
    assert out["r1"]["ml"] == [128, 255, 51]


def test_cigar_walk(spark):
    r = one(spark, q=A.query_to_ref(F.lit("2S3M1I2M2D1M"), F.lit(100)), m=A.alignment_metrics(F.lit("2S3M1I2M2D1M"), F.lit(1), F.lit("A" * 9)))
    assert r["q"] == [-1, -1, 100, 101, 102, -1, 103, 104, 107]
    assert r["m"]["identity"] == pytest.approx(1 - 1 / 9)
    assert r["m"]["softclip_fraction"] == pytest.approx(2 / 9)


def test_aligned_identity_on_the_reverse_strand(spark):
    q = F.array(*[F.lit(b) for b in "TGA"])
    r = one(spark, m=A.aligned_identity(q, F.array(F.lit(10), F.lit(-1), F.lit(12)), F.lit("AAT"), F.lit(10), F.lit(True)))
    assert r["m"] == {"aligned_fraction": pytest.approx(2 / 3), "ref_span": 3, "identity": 1.0}


def test_moves_with_saturated_values(spark):
    mv = F.array(*[F.lit(x) for x in (5, 1, 0, 127, 3, -128, 127, 3, 1)])
    r = one(spark, m=G.decode_moves(mv))["m"]
    assert r["stride"] == 5
    assert r["emitted"] == [2] + [12] * 130 + [17] * 2 + [22]
    bad = one(spark, open=G.decode_moves(F.array(F.lit(5), F.lit(127))), stride=G.decode_moves(F.array(F.lit(0), F.lit(1))), neg=G.decode_moves(F.array(F.lit(5), F.lit(-3))))
    assert set(bad.values()) == {None}


def test_running_sum_is_exact_for_all_lengths(spark):
    rows = spark.range(0, 300).select("id", running_sum(F.transform(F.sequence(F.lit(0), F.col("id")), lambda x: x)).alias("s")).collect()
    for r in rows:
        assert r["s"] == [k * (k + 1) // 2 for k in range(r["id"] + 1)]


def test_quantile_normalisation(spark):
    import numpy as np

    sig = [float((i * 37) % 101) for i in range(200)]
    arr = F.array(*[F.lit(x) for x in sig])
    r = one(spark, q=G.quantile_norm(arr), z=G.normalize_signal(arr), c=G.normalize_signal(arr, "constant", F.lit(1.0), F.lit(0.0)))
    a, b = np.quantile(sig, [0.2, 0.9])
    shift, scale = max(10, 0.51 * (a + b)), max(1, 0.53 * (b - a))
    assert (r["q"]["shift"], r["q"]["scale"]) == (pytest.approx(shift), pytest.approx(scale))
    assert r["z"] == pytest.approx(list(np.clip((np.array(sig) - shift) / scale, -5, 5)))
    assert r["c"] is None


def test_logits(spark):
    r = one(
        spark, one=G.logits_to_calls(F.array(F.lit(3.0))), two=G.logits_to_calls(F.array(F.lit(0.0), F.lit(math.log(3)))),
        low=G.logits_to_calls(F.array(F.lit(0.0), F.lit(math.log(3))), 0.8), many=G.logits_to_calls(F.array(F.lit(1.0), F.lit(5.0), F.lit(5.0))),
    )
    assert (r["one"]["pred"], r["one"]["conf"]) == (0, 1.0)
    assert (r["two"]["pred"], r["two"]["conf"]) == (1, pytest.approx(0.75))
    assert (r["low"]["pred"], r["low"]["conf"]) == (0, pytest.approx(0.25))
    assert r["many"]["pred"] == 1


def test_sequences(spark):
    r = one(
        spark, n=Q.normalize_seq(F.lit(" a-cg uU ")), k=Q.normalize_seq(F.lit("acu"), keep_u=True), rc=Q.revcomp(F.lit("AACGN")), e=Q.encode_bases(F.lit("ACGUNt")),
        empty=Q.encode_bases(F.lit("")), edge=Q.centered_kmer(F.lit("ACGTA"), F.lit(1), 5), mid=Q.centered_kmer(F.lit("ACGTA"), F.lit(2), 5),
        hasn=Q.reference_kmer(F.lit("ACNTA"), F.lit(2), 3), drach=Q.motif_class(F.lit("GGACT"), F.lit(2)), not_=Q.motif_class(F.lit("CCACT"), F.lit(2)),
        trim=Q.trim_context(F.lit("ABCDEFG"), 2, 1), same=Q.trim_context(F.lit("ABC"), 0, 0), rna=Q.signal_order(F.lit("ACGU"), F.lit(False)), dna=Q.signal_order(F.lit("ACGU"), F.lit(False), "dna"),
    )
    assert r["n"] == "ACGTT" and r["k"] == "ACU" and r["rc"] == "NCGTT" and r["e"] == [1, 2, 3, 4, 0, 4] and r["empty"] == []
    assert r["edge"] == "edge" and r["mid"] == "ACGTA" and r["hasn"] is None and r["drach"] == "DRACH" and r["not_"] == "non_DRACH"
    assert r["trim"] == "CDEF" and r["same"] == "ABC" and r["rna"] == "TGCA" and r["dna"] == "ACGT"
    with pytest.raises(ValueError):
        Q.centered_kmer(F.lit("A"), F.lit(0), 4)


def test_primary_site(spark):
    r = one(spark, minus=Q.primary_site(F.lit("CCATTACC"), F.lit("c1"), F.lit(10), F.lit(18), F.lit(-1)), none=Q.primary_site(F.lit("CCC"), F.lit("c1"), F.lit(0), F.lit(3), F.lit(1)))
    assert r["minus"]["site_key"] == "c1:12:-1:A" and r["minus"]["kmer"] == "CCATT"
    assert r["none"] == {"site_key": "no_A", "site_pos": -1, "kmer": "no_A", "motif": "no_A"}


def test_marked_sequences(spark):
    r = one(
        spark, slash=Q.parse_marked_seq(F.lit("GGACU/m6AGGACC")), square=Q.parse_marked_seq(F.lit("gg[m6a]cc")), plain=Q.parse_marked_seq(F.lit("GACAG")),
        given=Q.parse_marked_seq(F.lit("AACAA"), F.lit(4)), clash=Q.parse_marked_seq(F.lit("GG/m6ACC"), F.lit(1)), not_a=Q.parse_marked_seq(F.lit("GCA"), F.lit(0)), none=Q.parse_marked_seq(F.lit("GCC")),
    )
    assert r["slash"] == {"seq": "GGACTAGGACC", "center": 5, "error": None}
    assert r["square"] == {"seq": "GGACC", "center": 2, "error": None}
    assert r["plain"]["center"] == 1 and r["given"]["center"] == 4
    assert [r[k]["error"] for k in ("clash", "not_a", "none")] == ["center_disagrees_with_mark", "center_not_A", "no_A"]


def test_labels(spark):
    ref = F.array(*[F.lit(x) for x in (1, 2, 1, 4)])
    r = one(
        spark, full=L.label_targets(ref), cand=L.label_targets(ref, "llp-candidate"), canon=L.label_targets(ref, "canonical", "zero"),
        pos=L.sample_class(F.array(F.lit(4), F.lit(-100))), pad=L.sample_class(F.array(F.lit(0), F.lit(4)), F.lit(1)), mixed=L.sample_class(F.array(F.lit(0), F.lit(4))), none=L.sample_class(F.array(F.lit(-100))),
        pct=L.normalize_ratio(F.lit(12.5)), frac=L.normalize_ratio(F.lit(0.5)), lab=L.ratio_label(F.lit(0.125)), whole=L.ratio_label(F.lit(0.5)),
        dig=L.digitize(F.lit(7.0), [5, 7, 9]), nan=L.digitize(F.lit(float("nan")), [-1, 0]), p=L.positive_prob(F.lit("canonical_A"), F.lit(1.7)),
    )
    assert r["full"] == [4, -100, 4, -100] and r["cand"] == [0, -100, 0, -100] and r["canon"] == [0, 1, 0, 3]
    assert (r["pos"], r["pad"], r["mixed"], r["none"]) == ("positive", "negative", "mixed", "unlabeled")
    assert (r["pct"], r["frac"], r["lab"], r["whole"]) == (0.125, 0.5, "12.5", "50")
    assert (r["dig"], r["nan"], r["p"]) == (2, 1, 0.0)
    with pytest.raises(Exception, match="ratio outside"):
        one(spark, x=L.normalize_ratio(F.lit(250.0)))


def test_mixed_run_labels(spark):
    ids, empty = F.array(F.lit("o1")), F.array().cast("array<string>")
    r = one(
        spark, a=L.resolve_label(F.lit("mixed"), F.lit("o1"), ids), b=L.resolve_label(F.lit("mixed"), F.lit("o2"), ids), c=L.resolve_label(F.lit("mixed"), F.lit("o1"), empty),
        d=L.resolve_label(F.lit("modified"), F.lit("o9"), empty), e=L.resolve_label(F.lit("unmodified"), F.lit("o1"), ids), s=L.normalize_status(F.lit(" Full-Mod ")),
    )
    assert list(r.values()) == [4, 0, None, 4, 0, "modified"]
