"""The sample table: Parquet partitioned by split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "validation")


def read_chunks(
    spark: SparkSession, path: str, split: str | None = None, limit: int | None = None, ids: DataFrame | None = None, ident: str = "sample_id"
) -> DataFrame:
    """One or both splits (partition pruning), optionally only listed ids (semi-join) or the first rows by id."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    if ids is not None:
        df = df.join(ids.select(ident), ident, "left_semi")
    if limit is not None:
        df = df.orderBy(ident).limit(limit)
    return df


def chunk_summary(df: DataFrame) -> DataFrame:
    """Rows per split and, for array columns, the smallest and largest length."""
    arrays = [c for c, t in df.dtypes if t.startswith("array")]
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.min(F.size(c)).alias(f"{c}_min_length") for c in arrays],
        *[F.max(F.size(c)).alias(f"{c}_max_length") for c in arrays],
    )


def write_chunks(df: DataFrame, path: str, summary: bool = True, mode: str = "errorifexists") -> DataFrame | None:
    """Write the splits; the summary is one aggregate over the written table, stored as JSON beside it."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    if not summary:
        return None
    out = chunk_summary(df.sparkSession.read.schema(df.schema).parquet(path))
    out.write.mode(mode).json(f"{path.rstrip('/')}_summary")
    return df.sparkSession.read.schema(out.schema).json(f"{path.rstrip('/')}_summary")
