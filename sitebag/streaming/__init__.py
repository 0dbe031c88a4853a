"""Structured Streaming forms of the running site statistics and counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_site_stats(
    calls: DataFrame,
    keys: Sequence[str],
    prob: str = "prob",
    ident: str | None = None,
    event_time: str | None = None,
    watermark: str = "1 hour",
    window: str | None = None,
    median: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """Running coverage, called count and zero-filled mean per site, with ``median`` also the median of the called values.

    The median comes from a mergeable quantile sketch that is part of the streaming state: bounded by ``accuracy`` whatever
    the coverage, it names a called value whose rank is within ``calls / accuracy`` of the middle (exact below ``accuracy`` calls).

    With an event time late calls are bounded by the watermark and repeated calls (``ident``) are dropped inside it;
    ``window`` adds a time window to the key, so closed windows leave the state.
    """
    if event_time:
        calls = calls.withWatermark(event_time, watermark)
        if ident:
            calls = calls.dropDuplicatesWithinWatermark([ident])
    by = [F.col(k) for k in keys]
    if window:
        by.append(F.window(event_time, window).alias("window"))
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("coverage"),
        F.count(prob).alias("num_mod_calls"),
        (F.coalesce(F.sum(prob), F.lit(0.0)) / F.count(F.lit(1))).alias("mean_prob_zero_filled"),
        *([F.percentile_approx(prob, 0.5, accuracy).alias("median_called_prob")] if median else []),
    )


def stream_counters(rows: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """Running rows per reject reason; kept rows count as ``written``."""
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("written")).alias("counter")).agg(F.count(F.lit(1)).alias("rows"))


def start_progress(rows: DataFrame, every: int, path: str, checkpoint: str, reason: str = "reject_reason") -> StreamingQuery:
    """Report at every ``every``-th accepted row of a stream of tagged rows: ``written``, and the rows rejected until then.

    A micro-batch is counted by a partial aggregate; its totals and the multiples they pass are written under its id beside the
    running totals, which the next one reads. Running a batch again replaces both, so every multiple is reported once. Rows of
    one micro-batch have no order, so ``rejected_before`` and ``rejected`` are the counts at the batch's two ends.
    """
    spark = rows.sparkSession
    start = "written long, rejected long"
    spark.createDataFrame([(0, 0)], start).coalesce(1).write.mode("ignore").parquet(f"{path}/totals/-1")

    def sink(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        kept = F.col(reason).isNull()
        counts = batch.agg(F.count_if(kept).alias("more"), F.count_if(~kept).alias("worse"))
        before = session.read.schema(start).parquet(f"{path}/totals/{number - 1}")
        now = counts.withColumn("_t", before.select(F.struct("written", "rejected")).scalar())
        after = [(F.col("_t.written") + F.col("more")).alias("written"), (F.col("_t.rejected") + F.col("worse")).alias("rejected")]
        now.select(*after).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/{number}")
        first = F.floor(F.col("_t.written") / every) + 1
        last = F.floor((F.col("_t.written") + F.col("more")) / every)
        passed = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        seen = now.select(F.explode(passed).alias("_k"), "_t", "worse")
        seen.select(
            (F.col("_k") * every).alias("written"), F.col("_t.rejected").alias("rejected_before"), (F.col("_t.rejected") + F.col("worse")).alias("rejected")
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/progress/batch_id={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def start_updates(
    frame: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Run an update-mode query over what is available; each batch's updates are written under its batch id.

    Rewriting a batch after a failure replaces the same folder, so the table holds every update once.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if on_batch:
            on_batch(batch, batch_id)

    return (
        frame.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current value per key from the written updates: the one of the highest batch."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    out = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_r"))
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
