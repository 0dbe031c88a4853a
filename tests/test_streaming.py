"""Streaming statistics over files that arrive one after another."""

from pyspark.sql import functions as F

from sitebag.streaming import latest, start_updates, stream_counters, stream_site_stats

SCHEMA = "call_id int, ts timestamp, contig string, pos int, prob double"


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "call_id int, ts string, contig string, pos int, prob double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.mode("append").parquet(folder)


def test_running_site_statistics(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))

    def step():
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        start_updates(stream_site_stats(stream, ["contig", "pos"], ident="call_id", event_time="ts", watermark="1 day"), out, log).awaitTermination()
        return {(r["contig"], r["pos"]): r for r in latest(spark.read.parquet(out), ["contig", "pos"]).collect()}

    arrive(spark, src, [(1, "2024-01-01 00:00:00", "c", 1, 0.5), (2, "2024-01-01 00:01:00", "c", 1, None), (3, "2024-01-01 00:02:00", "c", 2, 1.0)])
    first = step()
    assert (first[("c", 1)]["coverage"], first[("c", 1)]["mean_prob_zero_filled"]) == (2, 0.25)
    # a repeated call is dropped, a new one counted; the other site keeps its value
    arrive(spark, src, [(1, "2024-01-01 00:00:00", "c", 1, 0.5), (4, "2024-01-01 00:03:00", "c", 1, 1.0)])
    second = step()
    assert (second[("c", 1)]["coverage"], second[("c", 1)]["num_mod_calls"]) == (3, 2)
    assert second[("c", 2)]["coverage"] == 1


def test_running_counters(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    seen = []
    for rows in ([("a", None), ("b", "short")], [("c", None)]):
        spark.createDataFrame(rows, "id string, reject_reason string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("id string, reject_reason string").parquet(src)
        start_updates(stream_counters(stream), out, log, lambda df, i: seen.append(i)).awaitTermination()
    assert {r["counter"]: r["rows"] for r in latest(spark.read.parquet(out), ["counter"]).collect()} == {"written": 2, "short": 1}
    assert len(seen) >= 2
