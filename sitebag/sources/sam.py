"""Text SAM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.qc import FLAG_REVERSE, FLAG_SECONDARY, FLAG_SUPPLEMENTARY, FLAG_UNMAPPED


def parse_sam(lines: DataFrame, value: str = "value") -> DataFrame:
    """SAM lines -> typed records with a tag map; header lines are dropped, positions become 0-based (-1 unmapped)."""
    rows = lines.where((F.col(value) != "") & ~F.col(value).startswith("@")).select(F.split(value, "\t").alias("f"))
    flag = F.get("f", 1).cast("int")
    tags = F.map_from_entries(
        F.transform(
            F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))),
            lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v")),
        )
    )

    def bit(mask: int) -> Column:
        return flag.bitwiseAND(mask) != 0

    def starred(i: int) -> Column:
        return F.when(F.get("f", i) != "*", F.get("f", i))

    return rows.select(
        F.get("f", 0).alias("read_id"),
        flag.alias("flag"),
        starred(2).alias("contig"),
        (F.get("f", 3).cast("bigint") - 1).alias("pos0"),
        F.get("f", 4).cast("int").alias("mapq"),
        starred(5).alias("cigar"),
        starred(9).alias("seq"),
        starred(10).alias("qual"),
        bit(FLAG_UNMAPPED).alias("is_unmapped"),
        bit(FLAG_SECONDARY).alias("is_secondary"),
        bit(FLAG_SUPPLEMENTARY).alias("is_supplementary"),
        bit(FLAG_REVERSE).alias("is_reverse"),
        tags.alias("tags"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Splittable by line."""
    return parse_sam(spark.read.text(path))


def tag_int(tags: Column, name: str) -> Column:
    return tags[name].try_cast("bigint")


def tag_double(tags: Column, name: str) -> Column:
    return tags[name].try_cast("double")


def tag_ints(tags: Column, name: str) -> Column:
    """Integer array tag (``B:C,1,2``): the leading element type is dropped."""
    text = tags[name]
    return F.when(text.contains(","), F.slice(F.split(text, ","), 2, F.greatest(F.size(F.split(text, ",")) - 1, F.lit(0))).cast("array<int>")).when(
        text.isNotNull(), F.array().cast("array<int>")
    )
