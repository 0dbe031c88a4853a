"""Queries: column functions over whole texts, samples, alignments and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import labels as L
from ..functions import sequence as Q
from ..functions import signal as G
from ..functions.arrays import let
from ..operators import metrics as M
from ..operators.chunks import with_reference
from ..sources.fasta import read_fasta_bins
from .bindings import fasta
from .registry import query, rounded

# checker helper: the letters of a read with their positions
BASES = """bases AS (SELECT read_id, length(seq) AS n, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS b,
    unnest(string_split(concat(substr(seq, 2), '-'), '')) AS nxt FROM v_seq WHERE length(seq) > 0)"""


@query(
    "p1_normalize_ratio",
    """SELECT sample_id, CASE WHEN sample_id % 2 = 0 THEN CAST(ratio_label AS DOUBLE)/100 ELSE ratio END AS ratio FROM v_samples""",
)
def _(get, spark):
    mixed = F.when(F.col("sample_id") % 2 == 0, F.col("ratio_label").cast("double")).otherwise(F.col("ratio"))
    return get("v_samples").select("sample_id", L.normalize_ratio(mixed).alias("ratio"))


@query("p2_normalize_seq", "SELECT read_id, md5(seq) AS digest FROM v_seq")
def _(get, spark):
    messy = F.concat(F.lit("  "), F.regexp_replace(F.lower(F.translate("seq", "T", "u")), "(acg)", "a-c g"), F.lit(" "))
    return get("v_seq").select("read_id", F.md5(Q.normalize_seq(messy)).alias("digest"))


@query("p3_revcomp", "SELECT read_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM v_seq")
def _(get, spark):
    return get("v_seq").select("read_id", F.md5(Q.revcomp(F.col("seq"))).alias("digest"))


@query(
    "p4_encode_bases",
    f"""WITH {BASES} SELECT v.read_id, count(i) AS n, CAST(coalesce(sum(instr('ACGT', b)),0) AS BIGINT) AS token_sum,
      true AS round_trip FROM v_seq v LEFT JOIN bases x ON v.read_id = x.read_id GROUP BY 1""",
)
def _(get, spark):
    rows = get("v_seq").withColumn("tokens", Q.encode_bases(F.col("seq")))
    return rows.select(
        "read_id", F.size("tokens").alias("n"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("token_sum"),
        (Q.decode_bases(F.col("tokens")) == F.col("seq")).alias("round_trip"),
    )


@query(
    "p5_centered_kmer",
    """SELECT read_id, CASE WHEN n//2 < 4 OR n//2 + 4 >= n THEN 'edge' ELSE substr(seq, CAST(n//2 - 3 AS INT), 9) END AS kmer,
      CASE WHEN n//2 >= 4 AND n//2 + 4 < n THEN substr(seq, CAST(n//2 - 3 AS INT), 9) END AS window_kmer FROM (SELECT *, length(seq) AS n FROM v_seq)""",
)
def _(get, spark):
    mid = F.floor(F.length("seq") / 2)
    return get("v_seq").select(
        "read_id", Q.centered_kmer(F.col("seq"), mid, 9).alias("kmer"), Q.reference_kmer(F.col("seq"), mid, 9).alias("window_kmer")
    )


@query(
    "p6_motif_class",
    """WITH k AS (SELECT read_id, seq, CASE WHEN n//2 < 2 OR n//2 + 2 >= n THEN 'edge' ELSE substr(seq, CAST(n//2 - 1 AS INT), 5) END AS kmer FROM (SELECT *, length(seq) AS n FROM v_seq))
    SELECT read_id, CASE WHEN kmer='edge' THEN 'edge' WHEN regexp_matches(kmer, '^[AGT][AG]AC[ACT]$') THEN 'DRACH' ELSE 'non_DRACH' END AS motif,
      regexp_matches(kmer, '^[AG][AG]AC[ACT]$') AS is_rrach, regexp_matches(seq, 'GAAC[AT]G') AS has_custom FROM k""",
)
def _(get, spark):
    mid = F.floor(F.length("seq") / 2)
    kmer = Q.centered_kmer(F.col("seq"), mid, 5)
    return get("v_seq").select(
        "read_id", Q.motif_class(F.col("seq"), mid).alias("motif"), Q.motif_match(kmer, "RRACH").alias("is_rrach"),
        Q.motif_match(F.col("seq"), "GAAC[AT]G").alias("has_custom"),
    )


@query(
    "p7_digitize",
    """WITH x AS (SELECT sample_id, CASE WHEN ref_len = 0 THEN -1 ELSE mean_qscore END AS q, mapping_coverage AS c FROM v_samples)
    SELECT sample_id, CAST(len(list_filter([0, 7, 9.5, 12]::DOUBLE[], lambda e: e <= q)) AS INT) AS q_bin,
      CAST(len(list_filter([0.85, 0.9]::DOUBLE[], lambda e: e <= c)) AS INT) AS coverage_bin FROM x""",
)
def _(get, spark):
    q = F.when(F.col("ref_len") == 0, F.lit(float("nan"))).otherwise(F.col("mean_qscore"))
    return get("v_samples").select(
        "sample_id", L.digitize(q, [0, 7, 9.5, 12]).alias("q_bin"), L.digitize(F.col("mapping_coverage"), [0.85, 0.9]).alias("coverage_bin")
    )


@query(
    "p8_primary_site",
    f"""WITH {BASES}, a AS (SELECT read_id, arg_min(i, abs(i - (n-1)/2.0)*1000000 + i/1000000.0) AS mid FROM bases WHERE b = 'A' GROUP BY 1),
      s AS (SELECT v.read_id, seq, length(seq) AS n, mid, CASE WHEN v.read_id % 2 = 0 THEN 1 ELSE -1 END AS strand,
        v.read_id*10 AS r_st, v.read_id*10 + length(seq) AS r_en FROM v_seq v LEFT JOIN a ON v.read_id = a.read_id),
      p AS (SELECT *, CASE WHEN strand = -1 THEN r_en - 1 - (n-1-mid) ELSE r_st + (n-1-mid) END AS pos,
        CASE WHEN mid < 2 OR mid + 2 >= n THEN 'edge' ELSE substr(seq, CAST(mid-1 AS INT), 5) END AS k FROM s)
    SELECT read_id, CASE WHEN mid IS NULL THEN 'no_A' ELSE concat('c:', pos, ':', strand, ':A') END AS site_key, coalesce(pos, -1) AS site_pos,
      CASE WHEN mid IS NULL THEN 'no_A' ELSE k END AS kmer,
      CASE WHEN mid IS NULL THEN 'no_A' WHEN k='edge' THEN 'edge' WHEN regexp_matches(k, '^[AGT][AG]AC[ACT]$') THEN 'DRACH' ELSE 'non_DRACH' END AS motif FROM p""",
)
def _(get, spark):
    strand = F.when(F.col("read_id") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    start = F.col("read_id") * 10
    site = Q.primary_site(F.col("seq"), F.lit("c"), start, start + F.length("seq"), strand)
    return get("v_seq").select("read_id", site.alias("s")).select("read_id", "s.*")


def _targets_sql(mode, non_a):
    a = 4 if mode == "full-mod" else 0
    rest = "CASE b WHEN 'A' THEN {a} WHEN 'C' THEN {c} WHEN 'G' THEN {g} WHEN 'T' THEN {t} END"
    c, g, t = (1, 2, 3) if non_a == "canonical" else (-100, -100, -100)
    return rest.format(a=a, c=c, g=g, t=t)


@query(
    "p9_label_targets",
    f"""WITH {BASES} SELECT v.read_id, CAST(coalesce(sum({_targets_sql('full-mod', 'ignore')}),0) AS BIGINT) AS full_mod_sum,
      CAST(coalesce(sum({_targets_sql('canonical', 'canonical')}),0) AS BIGINT) AS canonical_sum,
      CAST(coalesce(sum({_targets_sql('llp-candidate', 'ignore')}),0) AS BIGINT) AS candidate_sum
    FROM v_seq v LEFT JOIN bases x ON v.read_id = x.read_id GROUP BY 1""",
)
def _(get, spark):
    rows = get("v_seq").withColumn("t", Q.encode_bases(F.col("seq")))
    fold = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        "read_id", fold(L.label_targets(F.col("t"))).alias("full_mod_sum"), fold(L.label_targets(F.col("t"), "canonical", "zero")).alias("canonical_sum"),
        fold(L.label_targets(F.col("t"), "llp-candidate")).alias("candidate_sum"),
    )


@query(
    "p10_sample_class",
    """SELECT read_id, CASE WHEN n > 0 AND read_id % 3 = 0 AND contains(seq, 'A') THEN 'positive' WHEN read_id % 3 = 1 AND contains(seq, 'A') THEN 'negative'
      WHEN read_id % 3 = 2 AND contains(substr(seq, 1, n//2), 'A') AND contains(substr(seq, n//2 + 1), 'A') THEN 'mixed'
      WHEN read_id % 3 = 2 AND contains(substr(seq, 1, n//2), 'A') THEN 'positive' WHEN read_id % 3 = 2 AND contains(seq, 'A') THEN 'negative' ELSE 'unlabeled' END AS class
    FROM (SELECT *, CAST(length(seq) AS INT) AS n FROM v_seq)""",
)
def _(get, spark):
    rows = get("v_seq").withColumn("t", Q.encode_bases(F.col("seq"))).withColumn("h", F.floor(F.length("seq") / 2).cast("int"))
    mod, can = L.label_targets(F.col("t")), L.label_targets(F.col("t"), "canonical")
    both = F.concat(F.slice(mod, F.lit(1), F.col("h")), F.slice(can, F.col("h") + 1, F.size("t") - F.col("h")))
    target = F.when(F.col("read_id") % 3 == 0, mod).when(F.col("read_id") % 3 == 1, can).otherwise(both)
    padded = rows.withColumn("target", F.concat(target, F.array(F.lit(4).cast("smallint"))))
    return padded.select("read_id", L.sample_class(F.col("target"), F.size("t")).alias("class"))


@query(
    "p11_alignment_metrics",
    """SELECT read_id, CASE WHEN cigar <> '*' THEN greatest(0, 1 - nm/(n - clip + 2)::DOUBLE) END AS identity,
      CASE WHEN cigar <> '*' THEN (n - clip - 1)/n::DOUBLE WHEN n > 0 THEN 0 END AS aligned_fraction,
      CASE WHEN cigar <> '*' THEN clip/n::DOUBLE WHEN n > 0 THEN 0 END AS softclip_fraction FROM v_aligned""",
)
def _(get, spark):
    m = A.alignment_metrics(F.col("cigar"), F.col("nm"), F.col("seq"))
    return get("v_aligned").select("read_id", m.alias("m")).select("read_id", "m.*")


# checker helper: reference position per query base of the alignments built by v_aligned
PLACED = """bases AS (SELECT * EXCLUDE (seq), unnest(range(n)) AS i, unnest(string_split(seq, '')) AS b FROM v_aligned WHERE cigar <> '*'),
  placed AS (SELECT *, CASE WHEN i < clip THEN -1 WHEN i < clip + third THEN pos0 + i - clip WHEN i = clip + third THEN -1
    WHEN i < clip + 2*third + 1 THEN pos0 + i - clip - 1 ELSE pos0 + i - clip - 1 + 2 END AS ref_pos FROM bases)"""


@query(
    "p12_query_to_ref",
    f"""WITH {PLACED} SELECT v.read_id, count(ref_pos) AS n, coalesce(count(CASE WHEN ref_pos >= 0 THEN 1 END), 0) AS aligned, CAST(coalesce(sum(ref_pos), 0) AS BIGINT) AS position_sum, max(ref_pos) AS last
    FROM v_aligned v LEFT JOIN placed p ON v.read_id = p.read_id GROUP BY 1""",
)
def _(get, spark):
    rows = get("v_aligned").select("read_id", A.query_to_ref(F.col("cigar"), F.col("pos0")).alias("r"))
    return rows.select(
        "read_id", F.size("r").alias("n"), F.size(F.filter("r", lambda p: p >= 0)).alias("aligned"),
        F.aggregate("r", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("position_sum"), F.array_max("r").alias("last"),
    )


def called_bases(get, *more):
    """Calls at every A that is followed by C, with ``more`` columns of their read; the probability is a function of read and position."""
    at = let(
        Q.bases(F.col("seq")),
        lambda b: F.filter(F.transform(b, lambda x, i: F.when((x == "A") & (F.get(b, i + 1) == "C"), i)), lambda x: x.isNotNull()),
    )
    reads = get("v_seq").select("read_id", "seq", *more)  # before the explode, or each call would compute them from the whole read
    rows = reads.select(*[c for c in reads.columns if c != "seq"], F.explode(at).alias("base_index"))
    return rows.withColumn("prob", ((F.col("base_index") * 37 + F.col("read_id")) % 256) / 255.0).withColumn("label", F.lit("m6A"))


CALLS = f"""{BASES}, adenines AS (SELECT read_id, i, nxt = 'C' AS called, row_number() OVER (PARTITION BY read_id ORDER BY i) - 1 AS occ
    FROM bases WHERE b = 'A'),
  called AS (SELECT read_id, i, occ, (i*37 + read_id) % 256 AS level, occ - coalesce(lag(occ) OVER (PARTITION BY read_id ORDER BY i) + 1, 0) AS skip
    FROM adenines WHERE called)"""


@query(
    "p14_encode_mod_tags",
    f"""WITH {CALLS} SELECT read_id, md5(concat('A+a.,', string_agg(skip::VARCHAR, ',' ORDER BY i), ';')) AS mm_digest, count(*) AS calls,
      CAST(sum(level) AS BIGINT) AS ml_sum FROM called GROUP BY 1""",
)
def _(get, spark):
    tags = A.encode_mod_tags(get("v_seq"), called_bases(get), {"m6A": "a"})
    return tags.select(
        "read_id", F.md5("mm").alias("mm_digest"), F.size("ml").alias("calls"), F.aggregate("ml", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ml_sum")
    )


@query(
    "p13_decode_mod_tags",
    f"""WITH {CALLS} SELECT read_id, count(*) AS calls, CAST(sum(i) AS BIGINT) AS position_sum, CAST(sum(level) AS BIGINT) AS level_sum,
      CAST(max(i) AS BIGINT) AS last FROM called GROUP BY 1""",
)
def _(get, spark):
    tags = A.encode_mod_tags(get("v_seq"), called_bases(get), {"m6A": "a"})
    rows = get("v_seq").join(tags, "read_id")
    rows = rows.select("read_id", A.decode_mod_tags(F.col("seq"), F.concat(F.lit("C+m?,0;"), "mm"), F.concat(F.array(F.lit(7)), "ml")).alias("c"))
    fold = lambda f: F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + f(x))
    return rows.select(
        "read_id", F.size("c").alias("calls"), fold(lambda x: x["query_pos"]).alias("position_sum"),
        fold(lambda x: F.round(x["prob"] * 255).cast("bigint")).alias("level_sum"), F.get("c", F.size("c") - 1)["query_pos"].cast("bigint").alias("last"),
    )


def move_table(seq):
    """One emission per base; A waits a step after it, G before it, T uses a saturated run that sums to 1."""
    steps = F.translate(seq, "ACGT", "abcd")
    for code, text in (("a", "1,0,"), ("b", "1,"), ("c", "0,1,"), ("d", "-128,127,2,")):
        steps = F.replace(steps, F.lit(code), F.lit(text))
    return F.split(F.concat(F.lit("5,"), F.rtrim(steps, F.lit(","))), ",").cast("array<int>")


MOVES = f"""{BASES}, steps AS (SELECT read_id, i, b, CASE WHEN b IN ('A','G') THEN 2 ELSE 1 END AS w FROM bases),
  emitted AS (SELECT read_id, i, (sum(w) OVER (PARTITION BY read_id ORDER BY i) - w + CASE WHEN b='G' THEN 1 ELSE 0 END)*5 + 2 AS place FROM steps)"""


@query(
    "p15_decode_moves",
    f"""WITH {MOVES} SELECT read_id, CAST(5 AS BIGINT) AS stride, count(*) AS emitted, CAST(sum(place) AS BIGINT) AS position_sum, CAST(max(place) AS BIGINT) AS last FROM emitted GROUP BY 1""",
)
def _(get, spark):
    rows = get("v_seq").where("seq <> ''").select("read_id", G.decode_moves(move_table(F.col("seq"))).alias("m"))
    return rows.select(
        "read_id", "m.stride", F.size("m.emitted").alias("emitted"), F.aggregate("m.emitted", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("position_sum"),
        F.array_max("m.emitted").alias("last"),
    )


@query(
    "p16_normalize_signal",
    """WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(lower(text), '[^a-z]', '', 'g'), ''), lambda c: (ascii(c) - 5.0)::DOUBLE*0.5) AS sig
        FROM documents WHERE length(regexp_replace(lower(text), '[^a-z]', '', 'g')) > 0),
      q AS (SELECT doc_id, sig, list_sort(sig) AS o, len(sig) AS n FROM s),
      e AS (SELECT doc_id, sig, o[CAST(floor(0.2::DOUBLE*(n-1)) AS INT)+1] + (o[CAST(ceil(0.2::DOUBLE*(n-1)) AS INT)+1] - o[CAST(floor(0.2::DOUBLE*(n-1)) AS INT)+1])*(0.2::DOUBLE*(n-1) - floor(0.2::DOUBLE*(n-1))) AS a,
        o[CAST(floor(0.9::DOUBLE*(n-1)) AS INT)+1] + (o[CAST(ceil(0.9::DOUBLE*(n-1)) AS INT)+1] - o[CAST(floor(0.9::DOUBLE*(n-1)) AS INT)+1])*(0.9::DOUBLE*(n-1) - floor(0.9::DOUBLE*(n-1))) AS b FROM q),
      p AS (SELECT doc_id, sig, greatest(10, 0.51::DOUBLE*(a+b)) AS shift, greatest(1, 0.53::DOUBLE*(b-a)) AS scale FROM e),
      x AS (SELECT doc_id, shift, scale, unnest(sig) AS v FROM p)
    SELECT doc_id, round(shift,6) AS shift, round(scale,6) AS scale, count(*) AS n, round(sum(greatest(-5, least(5, (v-shift)/scale))),6) AS total,
      count(CASE WHEN abs((v-shift)/scale) >= 5 THEN 1 END) AS clipped FROM x GROUP BY ALL""",
)
def _(get, spark):
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    rows = get("documents").select("doc_id", letters.alias("t")).where("t <> ''")
    sig = G.calibrate(F.transform(F.split("t", ""), lambda c: F.ascii(c).cast("double")), F.lit(-5.0), F.lit(0.5))
    rows = rows.select("doc_id", sig.alias("sig"))
    rows = rows.select("doc_id", G.quantile_norm(F.col("sig")).alias("q"), G.normalize_signal(F.col("sig")).alias("z"))
    out = rows.select(
        "doc_id", "q.shift", "q.scale", F.size("z").alias("n"), F.aggregate("z", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.size(F.filter("z", lambda x: F.abs(x) >= 5)).alias("clipped"),
    )
    return rounded(out, "shift", "scale", "total")


NAMED = "SELECT p_partkey, p_size, translate(regexp_replace(p_name, '[^a-z]', ''@G@), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM part"


@query(
    "p17_parse_marked_seq",
    f"""WITH n AS ({NAMED.replace('@G@', ", 'g'")}), x AS (SELECT *, p_size % 4 AS kind, length(s)//2 AS h FROM n),
      a AS (SELECT p_partkey, min(struct_pack(d := abs(i - (length(s)-1)/2.0), i := i)) AS m FROM (SELECT p_partkey, s, unnest(range(length(s))) AS i FROM x) WHERE substr(s, i+1, 1)='A' GROUP BY 1),
      y AS (SELECT x.p_partkey, kind, CASE WHEN kind = 3 THEN s ELSE concat(substr(s,1,CAST(h AS INT)), 'A', substr(s, CAST(h AS INT)+1)) END AS seq, h, m FROM x LEFT JOIN a USING (p_partkey))
    SELECT p_partkey, seq, CAST(CASE WHEN kind = 3 THEN m.i ELSE h END AS INT) AS center, CASE WHEN kind = 3 AND m IS NULL THEN 'no_A' END AS error FROM y""",
)
def _(get, spark):
    s = F.translate(F.regexp_replace("p_name", "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    half = F.floor(F.length("s") / 2).cast("int")
    mark = F.when(F.col("p_size") % 4 == 0, "/m6A").when(F.col("p_size") % 4 == 1, "[m6A]").when(F.col("p_size") % 4 == 2, "m6a").otherwise("")
    rows = get("part").select("p_partkey", "p_size", s.alias("s"))
    text = F.concat(F.substring("s", F.lit(1), half), F.lit(" "), mark, F.substring("s", half + 1, F.length("s")))
    return rows.select("p_partkey", Q.parse_marked_seq(text).alias("m")).select("p_partkey", "m.*")


@query(
    "p18_resolve_label",
    """SELECT sample_id, CASE WHEN run_id IN ('1-URGENT','2-HIGH') THEN 4 WHEN run_id = '3-MEDIUM' THEN 0 WHEN run_id = '5-LOW' THEN NULL
      WHEN motif IN ('MACHINERY','BUILDING') THEN 4 ELSE 0 END AS label FROM v_samples""",
)
def _(get, spark):
    run = F.col("run_id")
    status = F.when(run == "1-URGENT", "full-mod").when(run == "2-HIGH", "m6A").when(run == "3-MEDIUM", "IVT").otherwise("test")
    ids = F.when(run == "5-LOW", F.array().cast("array<string>")).otherwise(F.array(F.lit("MACHINERY"), F.lit("BUILDING")))
    return get("v_samples").select("sample_id", L.resolve_label(L.normalize_status(status), F.col("motif"), ids).alias("label"))


@query(
    "p19_positive_prob",
    """SELECT source, motif, y, CAST(sum(CASE WHEN y=1 THEN CAST(round(score*1000) AS BIGINT) ELSE 1000-CAST(round(score*1000) AS BIGINT) END) AS BIGINT) AS prob_sum,
      CAST(count(CASE WHEN y=1 THEN 1 END) AS BIGINT) AS positives FROM v_scored GROUP BY ALL""",
)
def _(get, spark):
    name = F.when(F.col("y") == 1, "M6A").otherwise("canonical_A")
    p = L.positive_prob(name, F.col("score"))
    return get("v_scored").groupBy("source", "motif", "y").agg(
        F.sum(F.round(p * 1000).cast("bigint")).alias("prob_sum"), F.sum(L.binary_label(name).cast("bigint")).alias("positives")
    )


@query(
    "p20_logits_to_calls",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      w AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS w FROM e)
    SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS pred, round(1/list_sum(w), 6) AS conf FROM w""",
)
def _(get, spark):
    call = G.logits_to_calls(F.transform("embedding", lambda x: x.cast("double")))
    rows = get("embeddings").select("vec_id", call.alias("c")).select("vec_id", "c.pred", "c.conf")
    return rounded(rows, "conf")


@query(
    "m12_multiclass_metrics",
    """WITH e AS (SELECT label AS t, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      r AS (SELECT t, CAST(list_position(v, list_max(v)) - 1 AS INT) AS q, 1/list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS conf FROM e),
      c AS (SELECT CAST(i AS INT) AS class FROM range(64) x(i)),
      p AS (SELECT class, (SELECT count(*) FROM r WHERE t = class) AS support, (SELECT count(*) FROM r WHERE q = class) AS predicted,
        (SELECT count(*) FROM r WHERE t = class AND q = class) AS hits FROM c),
      m AS (SELECT class, support, predicted, CASE WHEN predicted = 0 THEN 0 ELSE hits/predicted::DOUBLE END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE hits/support::DOUBLE END AS recall, CASE WHEN support + predicted = 0 THEN 0 ELSE 2*hits/(support+predicted)::DOUBLE END AS f1 FROM p),
      o AS (SELECT count(CASE WHEN t = q THEN 1 END)/count(*)::DOUBLE AS accuracy, round(avg(conf),6) AS mean_confidence FROM r)
    SELECT class, support, predicted, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, accuracy, mean_confidence FROM m, o
    UNION ALL SELECT NULL, CAST(sum(support) AS BIGINT), CAST(sum(predicted) AS BIGINT), round(avg(precision),6), round(avg(recall),6), round(avg(f1),6), max(accuracy), max(mean_confidence) FROM m, o""",
)
def _(get, spark):
    call = G.logits_to_calls(F.transform("embedding", lambda x: x.cast("double")))
    rows = get("embeddings").select("label", call.alias("c")).select("label", "c.pred", "c.conf")
    return rounded(M.multiclass_metrics(rows, "label", "pred", "conf", range(64)), "precision", "recall", "f1", "mean_confidence")


@query(
    "m12_confusion_matrix",
    """WITH e AS (SELECT label AS t, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
    SELECT t AS true_label, CAST(list_position(v, list_max(v)) - 1 AS INT) AS pred_label, count(*) AS rows FROM e GROUP BY ALL""",
)
def _(get, spark):
    call = G.logits_to_calls(F.transform("embedding", lambda x: x.cast("double")))
    return M.confusion_matrix(get("embeddings").select("label", call["pred"].alias("pred")), "label", "pred")


@query(
    "p21_signal_order",
    """SELECT read_id, md5(CASE WHEN read_id % 2 = 0 THEN reverse(seq) ELSE seq END) AS rna, md5(CASE WHEN read_id % 2 = 1 THEN reverse(seq) ELSE seq END) AS dna FROM v_seq""",
)
def _(get, spark):
    rev = F.col("read_id") % 2 == 1
    return get("v_seq").select(
        "read_id", F.md5(Q.signal_order(F.col("seq"), rev)).alias("rna"), F.md5(Q.signal_order(F.col("seq"), rev, "dna")).alias("dna")
    )


@query(
    "p22_ratio_label",
    """SELECT sample_id, CASE WHEN ref_len % 8 IN (0, 4) THEN CAST(CAST((ref_len % 8)*125/10 AS INT) AS VARCHAR) WHEN ref_len % 8 IN (2, 6) THEN CAST(CAST((ref_len % 8)*125/10 AS INT) AS VARCHAR)
      ELSE CAST((ref_len % 8)*12.5::DOUBLE AS VARCHAR) END AS label FROM v_samples""",
)
def _(get, spark):
    return get("v_samples").select("sample_id", L.ratio_label((F.col("ref_len") % 8) / 8.0).alias("label"))


@query("p23_trim_context", "SELECT read_id, md5(substr(seq, 6, CAST(greatest(length(seq) - 9, 0) AS INT))) AS digest FROM v_seq")
def _(get, spark):
    return get("v_seq").select("read_id", F.md5(Q.trim_context(F.col("seq"), 5, 4)).alias("digest"))


@query(
    "p24_aligned_identity",
    f"""WITH {PLACED}, j AS (SELECT p.read_id, p.i, p.n, p.ref_pos, p.flag, CASE WHEN (p.flag // 16) % 2 = 1 THEN translate(p.b, 'ACGT', 'TGCA') ELSE p.b END AS b,
        c.b AS r
        FROM placed p LEFT JOIN (SELECT contig, unnest(range(length(ref_seq))) AS ref_pos, unnest(string_split(ref_seq, '')) AS b FROM v_contigs) c USING (contig, ref_pos)),
      g AS (SELECT read_id, n, count(CASE WHEN ref_pos >= 0 THEN 1 END)/count(*)::DOUBLE AS aligned_fraction, max(ref_pos) - min(CASE WHEN ref_pos >= 0 THEN ref_pos END) + 1 AS ref_span,
        CASE WHEN count(r) = 0 THEN 0 ELSE count(CASE WHEN b = r THEN 1 END)/count(r)::DOUBLE END AS identity FROM j GROUP BY ALL)
    SELECT read_id, aligned_fraction, ref_span, identity, ref_span >= 25 AND ref_span <= ceil(2.5*n) AS span_ok FROM g""",
)
def _(get, spark):
    """The reference comes from its bins: each read meets those it spans, no contig is ever one value; places are laid out after that."""
    places = A.query_to_ref(F.col("cigar"), F.col("pos0"))
    rows = get("v_aligned").where("cigar <> '*'").select("read_id", "n", "seq", "contig", "flag", "cigar", "pos0")
    span = let(F.filter(places, lambda p: p >= 0), lambda known: F.struct(F.array_min(known).alias("low"), (F.array_max(known) + 1).alias("high")))
    rows = rows.withColumn("span", span).select(*rows.columns, "span.*")
    rows = with_reference(rows, read_fasta_bins(spark, fasta(get, spark), 500, 16), ["read_id"], "low", "high", 500)
    rows = rows.withColumn("places", places)
    m = A.aligned_identity(Q.bases(F.col("seq")), F.col("places"), F.col("reference"), F.col("low"), F.col("flag").bitwiseAND(16) != 0)
    out = rows.select("read_id", "n", m.alias("m")).select("read_id", "n", "m.*")
    return out.withColumn("span_ok", A.span_allowed(F.col("ref_span"), F.col("n"))).drop("n")
