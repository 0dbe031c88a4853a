"""Queries through files and streams: what Spark derives from the tables is written below the shared folder and read
back by the readers (S1-S9, A22, A25, J12, X1, X2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import sites as S
from ..session import stage_path
from ..sources.chunks import read_chunks, write_chunks
from ..sources.fasta import read_fasta_bins
from ..sources.sam import tag_double, tag_int, tag_ints
from ..sources.tables import read_history, read_manifest, read_result_tree, read_sites, write_report
from ..streaming import latest, start_progress, start_updates, stream_counters, stream_site_stats
from .bindings import fasta
from .q_reads import sam_records
from .q_samples import REASON, SPLIT, tagged, with_split
from .registry import query, rounded


@query(
    "s1_read_sam",
    """SELECT concat('r', read_id) AS read_id, flag, CASE WHEN flag & 4 = 0 THEN contig END AS contig, CASE WHEN flag & 4 = 0 THEN pos0 ELSE -1 END AS pos0, mapq,
      nullif(cigar, '*') AS cigar, CASE WHEN seq <> '' THEN md5(seq) END AS digest, flag & 4 <> 0 AS is_unmapped, flag & 256 <> 0 AS is_secondary, flag & 2048 <> 0 AS is_supplementary,
      flag & 16 <> 0 AS is_reverse, CAST(nm AS BIGINT) AS nm, (n*5 + 10)::DOUBLE AS ns, CASE WHEN read_id % 4 = 0 THEN 200 END AS ml FROM v_aligned""",
)
def _(get, spark):
    return sam_records(get, spark).select(
        "read_id", "flag", "contig", "pos0", "mapq", "cigar", F.md5("seq").alias("digest"), "is_unmapped", "is_secondary", "is_supplementary", "is_reverse",
        tag_int(F.col("tags"), "NM").alias("nm"), tag_double(F.col("tags"), "ns").alias("ns"), F.get(tag_ints(F.col("tags"), "ML"), 0).alias("ml"),
    )


def chunk_table(get, spark):
    path = stage_path(spark, "chunks")
    write_chunks(with_split(get), path, summary=False)
    return path


@query("s2_read_chunks", f"SELECT sample_id, {SPLIT} AS split, ratio_label, ref_len FROM v_samples")
def _(get, spark):
    return read_chunks(spark, chunk_table(get, spark)).select("sample_id", "split", "ratio_label", "ref_len")


@query("s2_read_split", f"SELECT sample_id, ratio_label, ref_len FROM v_samples WHERE {SPLIT} = 'validation'")
def _(get, spark):
    return read_chunks(spark, chunk_table(get, spark), "validation").select("sample_id", "ratio_label", "ref_len")


@query("s2_read_ids", "SELECT sample_id, ratio_label, ref_len FROM v_samples WHERE sample_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')")
def _(get, spark):
    ids = get("orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("sample_id"))
    return read_chunks(spark, chunk_table(get, spark), ids=ids).select("sample_id", "ratio_label", "ref_len")


@query(
    "s3_write_chunks",
    f"SELECT {SPLIT} AS split, count(*) AS samples, CAST(min(ref_len) AS BIGINT) AS reference_min_length, CAST(max(ref_len) AS BIGINT) AS reference_max_length FROM v_samples GROUP BY 1",
)
def _(get, spark):
    rows = with_split(get).select("sample_id", "split", F.array_repeat(F.lit(1).cast("tinyint"), F.col("ref_len")).alias("reference"))
    out = write_chunks(rows, stage_path(spark, "chunks"))
    return out.select("split", "samples", F.col("reference_min_length").cast("bigint"), F.col("reference_max_length").cast("bigint"))


@query(
    "s4_read_manifest",
    """WITH l AS (SELECT p_brand, arg_max(p_partkey, p_partkey) AS k FROM part GROUP BY 1)
    SELECT l.p_brand AS run_id, p_type AS status, 'none' AS ligation, CASE WHEN p_size % 2 = 0 THEN concat('o', p_size, '|', p_type) ELSE concat('o', p_size) END AS ids FROM l JOIN part ON p_partkey = k""",
)
def _(get, spark):
    path = stage_path(spark, "manifest")
    ids = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("o"), F.col("p_size"), F.lit(" ; "), F.col("p_type"))).otherwise(F.concat(F.lit("o"), F.col("p_size"), F.lit(",")))
    rows = get("part").orderBy("p_partkey").select(F.col("p_brand").alias("Name"), F.col("p_type").alias("Label"), F.lit("").alias("ligation"), ids.alias("Oligos"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    out = read_manifest(
        spark, path, {"run_id": ["run_id", "run", "name"], "status": ["modification_status", "status", "label"], "ligation": ["ligation_strategy", "ligation"], "ids": ["oligo_ids", "oligos"]},
        "run_id", ["ids"], {"ligation": "none"}, ["run_id"],
    )
    return out.withColumn("ids", F.array_join("ids", "|"))


@query(
    "s5_read_sites_bed",
    """WITH x AS (SELECT concat('c', p_size % 3) AS contig, p_partkey // 2 AS pos, CASE p_size % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand, p_partkey, p_size FROM part)
    SELECT contig, pos, strand, pos + 1 AS "end", concat('s', max(p_partkey)) AS name, arg_max(p_size, p_partkey)::DOUBLE AS support FROM x GROUP BY ALL""",
)
def _(get, spark):
    path = stage_path(spark, "bed")
    k, size = F.col("p_partkey"), F.col("p_size")
    strand = F.when(size % 4 == 0, "+").when(size % 4 == 1, "-").otherwise("*")
    pos = F.floor(k / 2)
    get("part").orderBy(k).select(
        F.concat_ws("\t", F.concat(F.lit("c"), size % 3), pos, pos + 1, F.concat(F.lit("s"), k), size, strand)
    ).write.text(path)
    return read_sites(spark, path).select("contig", "pos", "strand", "end", "name", "support")


@query(
    "s5_read_sites_table",
    """WITH x AS (SELECT concat('c', p_size % 3) AS contig, p_partkey // 2 AS pos, '.' AS strand, p_partkey, p_size FROM part)
    SELECT contig, pos, strand, pos + 1 AS "end", concat(contig, ':', pos, '-', pos + 1, ':', CASE z % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END) AS name,
      CASE WHEN z % 5 > 0 THEN z/10::DOUBLE END AS support FROM (SELECT contig, pos, strand, arg_max(p_size, p_partkey) AS z FROM x GROUP BY 1, 2, 3)""",
)
def _(get, spark):
    path = stage_path(spark, "table")
    k, size = F.col("p_partkey"), F.col("p_size")
    strand = F.when(size % 4 == 0, "+").when(size % 4 == 1, "-").otherwise("?")
    rows = get("part").orderBy(k).select(
        F.concat(F.lit("c"), size % 3).alias("Chr"), (F.floor(k / 2) + 1).alias("Pos"), strand.alias("Strand"),
        F.when(size % 5 > 0, (size / 10).cast("string")).otherwise("n/a").alias("Mod_Ratio"),
    )
    rows.write.option("header", True).csv(path)
    return read_sites(spark, path, ignore_strand=True).select("contig", "pos", "strand", "end", "name", "support")


@query(
    "s6_read_fasta_bins",
    """WITH b AS (SELECT contig, ref_seq, unnest(range((length(ref_seq) + 499)//500)) AS bin FROM v_contigs)
    SELECT contig, bin, greatest(bin*500 - 16, 0) AS start, md5(substr(ref_seq, CAST(greatest(bin*500 - 16, 0) + 1 AS INT), CAST((bin+1)*500 + 16 - greatest(bin*500 - 16, 0) AS INT))) AS digest FROM b""",
)
def _(get, spark):
    return read_fasta_bins(spark, fasta(get, spark), 500, 16).select("contig", "bin", "start", F.md5("seq").alias("digest"))


CONTEXT = """ctx AS (SELECT site_id, s.contig, pos, strand, CASE WHEN pos < length(ref_seq) THEN substr(ref_seq, CAST(pos+1 AS INT), 1) END AS ref_base,
    CASE WHEN pos >= 2 AND pos + 2 < length(ref_seq) THEN CASE WHEN strand = '-' THEN reverse(translate(substr(ref_seq, CAST(pos-1 AS INT), 5), 'ACGT', 'TGCA')) ELSE substr(ref_seq, CAST(pos-1 AS INT), 5) END END AS kmer
  FROM v_sites s LEFT JOIN v_contigs c ON s.contig = c.contig)"""


def contexts(get, spark, motif=None):
    return S.site_context(get("v_sites"), read_fasta_bins(spark, fasta(get, spark), 500, 16), 5, motif, bin_size=500)


@query("j12_site_context", f"WITH {CONTEXT} SELECT * FROM ctx")
def _(get, spark):
    return contexts(get, spark)


@query("j12_motif_sites", f"WITH {CONTEXT} SELECT site_id, kmer FROM ctx WHERE regexp_matches(kmer, '^[AGT][AG]AC[ACT]$')")
def _(get, spark):
    return contexts(get, spark, "DRACH").select("site_id", "kmer")


@query(
    "a22_gold_sanity",
    f"""WITH {CONTEXT}, o AS (SELECT CASE WHEN strand = '+' AND site_id % 7 = 3 THEN '.' ELSE strand END AS strand,
        CASE WHEN site_id % 11 = 5 AND ref_base IS NOT NULL THEN 'N' ELSE ref_base END AS seen, kmer FROM ctx),
      x AS (SELECT strand, CASE WHEN seen <> 'N' THEN seen END AS ref_base,
        CASE WHEN seen <> 'N' THEN CASE strand WHEN '+' THEN seen = 'A' WHEN '-' THEN seen = 'T' ELSE seen IN ('A', 'T') END END AS fits,
        coalesce(regexp_matches(kmer, '^[AGT][AG]AC[ACT]$'), false)
          OR (strand = '.' AND coalesce(regexp_matches(reverse(translate(kmer, 'ACGT', 'TGCA')), '^[AGT][AG]AC[ACT]$'), false)) AS m FROM o),
      g AS (SELECT strand, ref_base, count(ref_base) AS checked, count(CASE WHEN fits THEN 1 END) AS compatible, count(CASE WHEN NOT fits THEN 1 END) AS mismatched,
        count(*) AS motif_checked, count(CASE WHEN m THEN 1 END) AS motif_matched FROM x GROUP BY ALL),
      u AS (SELECT * FROM g WHERE ref_base IS NOT NULL UNION ALL SELECT NULL, NULL, CAST(sum(checked) AS BIGINT), CAST(sum(compatible) AS BIGINT),
        CAST(sum(mismatched) AS BIGINT), CAST(sum(motif_checked) AS BIGINT), CAST(sum(motif_matched) AS BIGINT) FROM g)
    SELECT *, compatible/nullif(checked,0)::DOUBLE AS compatible_fraction, motif_matched/nullif(motif_checked,0)::DOUBLE AS motif_fraction FROM u""",
)
def _(get, spark):
    """Some sites without strand, some over an unknown base."""
    rows = contexts(get, spark)
    rows = rows.withColumn("strand", F.when((F.col("strand") == "+") & (F.col("site_id") % 7 == 3), ".").otherwise(F.col("strand")))
    unknown = (F.col("site_id") % 11 == 5) & F.col("ref_base").isNotNull()
    return S.gold_sanity(rows.withColumn("ref_base", F.when(unknown, "N").otherwise(F.col("ref_base"))))


@query("s7_write_report", "SELECT motif, run_id, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives FROM v_scored GROUP BY ALL")
def _(get, spark):
    path = stage_path(spark, "report")
    table = get("v_scored").groupBy("motif", "run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"), F.max("score").alias("unused"))
    write_report(table, path, "tsv", ["motif", "run_id", "rows", "positives"])
    return spark.read.option("sep", "\t").option("header", True).schema("motif string, run_id string, rows bigint, positives bigint").csv(path)


@query(
    "s8_read_result_tree",
    "SELECT motif AS fold, substr(run_id, 2) AS heldout_run, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(CAST(round(score*1000) AS BIGINT)) AS BIGINT) AS score_sum FROM v_scored GROUP BY ALL",
)
def _(get, spark):
    path = stage_path(spark, "tree")
    rows = get("v_scored").select("id", "y", "score", F.col("motif").alias("leave"), F.col("run_id").alias("heldout"))
    salt = F.pmod(F.xxhash64("id"), F.lit(8))  # a large run is written by several tasks
    rows.repartition("leave", "heldout", salt).write.partitionBy("leave", "heldout").option("sep", "\t").option("header", True).csv(path)
    tree = read_result_tree(
        spark, f"{path}/*/*/*.csv", "leave=([^/]+)/heldout=([^/]+)/", ["fold", "heldout_run"], ["y", "score"], schema="id bigint, y int, score double", strip_prefixes={"heldout_run": ["run_", "r"]}
    )
    return tree.groupBy("fold", "heldout_run").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"), F.sum(F.round(F.col("score") * 1000).cast("bigint")).alias("score_sum")
    )


HISTORY = """hist AS (SELECT run, epoch, f/100::DOUBLE AS train_loss, CASE WHEN m <> 6 THEN o/100::DOUBLE END AS valid_loss FROM
    (SELECT o_orderpriority AS run, year(o_orderdate)*12 + month(o_orderdate) AS epoch, month(o_orderdate) AS m, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f,
      count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS o FROM orders GROUP BY 1, 2, 3))"""


def history(get, spark):
    path = stage_path(spark, "history")
    month = F.month("o_orderdate")
    rows = get("orders").groupBy(F.col("o_orderpriority").alias("log"), (F.year("o_orderdate") * 12 + month).alias("epoch"), month.alias("m")).agg(
        (F.count_if(F.col("o_orderstatus") == "F") / 100).alias("train_loss"), (F.count_if(F.col("o_orderstatus") != "F") / 100).alias("v")
    )
    rows = rows.select("log", "epoch", "train_loss", F.when(F.col("m") != 6, F.col("v").cast("string")).otherwise("nan?").alias("valid_loss"))
    rows.write.partitionBy("log").option("header", True).csv(path)
    return read_history(spark, f"{path}/*/*.csv", "log=([^/]+)/", ["epoch", "train_loss", "valid_loss"])


@query("s9_read_history", f"WITH {HISTORY} SELECT run, epoch::DOUBLE AS epoch, train_loss, valid_loss FROM hist")
def _(get, spark):
    return history(get, spark).select("run", "epoch", "train_loss", "valid_loss")


@query(
    "a25_history_summary",
    f"""WITH {HISTORY}, b AS (SELECT run, arg_min(epoch, (valid_loss, epoch)) AS best_epoch, min(valid_loss) AS best_valid_loss FROM hist WHERE valid_loss IS NOT NULL GROUP BY 1),
      l AS (SELECT run, count(*) AS epochs, max(epoch) AS last_epoch FROM hist GROUP BY 1)
    SELECT run, epochs, best_epoch::DOUBLE AS best_epoch, best_valid_loss, last_epoch::DOUBLE AS last_epoch, h.train_loss AS last_train_loss, h.valid_loss AS last_valid_loss,
      round(h.train_loss - h.valid_loss, 6) AS train_valid_gap FROM l JOIN b USING (run) JOIN hist h USING (run) WHERE h.epoch = l.last_epoch""",
)
def _(get, spark):
    return rounded(P.history_summary(history(get, spark)), "train_valid_gap")


def replay(spark, frame_of, name, keys):
    """Run a streaming query over what is there and return its final table."""
    out, log = stage_path(spark, name), stage_path(spark, f"{name}-log")
    query_ = start_updates(frame_of, out, log)
    query_.awaitTermination()
    return latest(spark.read.parquet(out), keys)


def arriving(spark, rows, key):
    """The rows as a stream that arrives in several micro-batches, one file each."""
    path = stage_path(spark, "arriving")
    rows.repartition(4, key).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def event_calls(get):
    return get("events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("contig"), F.col("user_id").alias("pos"), F.when(F.col("value") > 1, F.col("value")).alias("prob")
    )


@query(
    "x1_stream_site_stats",
    """SELECT event_type AS contig, user_id AS pos, count(*) AS coverage, count(CASE WHEN value > 1 THEN value END) AS num_mod_calls,
      round(coalesce(sum(CASE WHEN value > 1 THEN value END), 0)/count(*), 6) AS mean_prob_zero_filled FROM events GROUP BY ALL""",
)
def _(get, spark):
    stream = arriving(spark, event_calls(get), "event_id")
    stats = stream_site_stats(stream, ["contig", "pos"], ident="event_id", event_time="ts", watermark="365 days")
    return rounded(replay(spark, stats, "sites", ["contig", "pos"]), "mean_prob_zero_filled")


@query(
    "x1_stream_windows",
    """SELECT event_type AS contig, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS coverage, count(CASE WHEN value > 1 THEN value END) AS num_mod_calls,
      round(coalesce(sum(CASE WHEN value > 1 THEN value END), 0)/count(*), 6) AS mean_prob_zero_filled FROM events GROUP BY ALL""",
)
def _(get, spark):
    stream = arriving(spark, event_calls(get), "event_id")
    stats = stream_site_stats(stream, ["contig"], ident="event_id", event_time="ts", watermark="365 days", window="1 day")
    out = replay(spark, stats, "windows", ["contig", "window"])
    out = out.select("contig", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "coverage", "num_mod_calls", "mean_prob_zero_filled")
    return rounded(out, "mean_prob_zero_filled")


@query("x2_stream_counters", f"SELECT coalesce({REASON}, 'written') AS counter, count(*) AS rows FROM v_samples GROUP BY 1")
def _(get, spark):
    stream = arriving(spark, tagged(get).select("sample_id", "reject_reason"), "sample_id")
    return replay(spark, stream_counters(stream), "counters", ["counter"])


@query(
    "x1_stream_medians",
    """SELECT event_type AS contig, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS coverage, quantile_disc(CASE WHEN value > 1 THEN value END, 0.5) AS median_called_prob
    FROM events GROUP BY ALL""",
)
def _(get, spark):
    """Median by day from the sketch in the streaming state, over several micro-batches."""
    stream = arriving(spark, event_calls(get), "event_id")
    stats = stream_site_stats(stream, ["contig"], ident="event_id", event_time="ts", watermark="365 days", window="1 day", median=True, accuracy=1_000_000)
    out = replay(spark, stats, "medians", ["contig", "window"])
    return out.select("contig", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "coverage", "median_called_prob")


@query(
    "x2_stream_each_hundred",
    f"""WITH t AS (SELECT count(CASE WHEN {REASON} IS NULL THEN 1 END) AS written, count({REASON}) AS rejected FROM v_samples)
    SELECT unnest(generate_series(CAST(100 AS BIGINT), written - written % 100, 100)) AS written, true AS between FROM t""",
)
def _(get, spark):
    """A report at every hundredth accepted row; its rejected rows lie between those of its micro-batch's ends."""
    stream = arriving(spark, tagged(get).select("sample_id", "reject_reason"), "sample_id")
    path = stage_path(spark, "progress")
    start_progress(stream, 100, path, stage_path(spark, "log")).awaitTermination()
    found = spark.read.parquet(f"{path}/progress")
    total = tagged(get).agg(F.count("reject_reason")).scalar()
    return found.select("written", ((F.col("rejected_before") <= F.col("rejected")) & (F.col("rejected") <= total)).alias("between"))
