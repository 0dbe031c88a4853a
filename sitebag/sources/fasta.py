"""FASTA as overlapping bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ordering import ordered_prefix


def read_fasta_bins(spark: SparkSession, path: str, bin_size: int = 10000, pad: int = 64) -> DataFrame:
    """Rows (contig, bin, start, seq): bin b holds [b*bin_size - pad, (b+1)*bin_size + pad) of its contig.

    The file is read by line, in splits. Prefix sums over the lines of a file (in bounded buckets) give each line the number
    of its record and its offset, so a contig is never one row and no task sees more than its lines. Letters before the
    first header belong to no record. The contig is the header up to white space.
    """
    text = F.col("value")
    is_head = text.startswith(">")
    line = F.when(is_head, F.get(F.split(F.substring("value", 2, 1 << 20), r"\s+"), 0)).otherwise(F.regexp_replace(text, r"\s", ""))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        line.alias("line"),
        is_head.cast("bigint").alias("_head"),
        F.when(is_head, 0).otherwise(F.length(line)).cast("bigint").alias("_letters"),
    )
    placed = ordered_prefix(lines, [F.col("_block"), F.col("_line")], ["_head", "_letters"], ["_file"])
    heads = placed.where("_head = 1").select(
        "_file", (F.col("_head_before") + 1).alias("_record"), F.col("line").alias("contig"), F.col("_letters_before").alias("_first")
    )
    body = placed.where("_letters > 0").withColumn("_record", F.col("_head_before")).join(heads, ["_file", "_record"])
    start = F.col("_letters_before") - F.col("_first")
    lines = body.select("contig", "line", start.alias("from"), (start + F.col("_letters")).alias("end"))
    low = F.greatest(F.floor((F.col("from") - pad) / F.lit(float(bin_size))), F.lit(0))
    high = F.floor((F.col("end") - 1 + pad) / F.lit(float(bin_size)))
    spread = lines.withColumn("bin", F.explode(F.sequence(low, high)))
    cut_from = F.greatest(F.col("bin") * bin_size - pad, F.lit(0))
    cut_to = (F.col("bin") + 1) * bin_size + pad
    a, b = F.greatest(F.col("from"), cut_from), F.least(F.col("end"), cut_to)
    pieces = spread.where(b > a).select(
        "contig", "bin", a.alias("at"), F.substring("line", (a - F.col("from") + 1).cast("int"), (b - a).cast("int")).alias("piece")
    )
    # a bin collects at most bin_size + 2*pad letters
    bins = pieces.groupBy("contig", "bin").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("_p"))
    return bins.select(
        "contig", "bin", F.get("_p", 0)["at"].alias("start"), F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("seq"),
    ).where(F.col("bin") * bin_size < F.col("start") + F.length("seq"))
