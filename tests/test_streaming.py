from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strandflow.streaming import counts


def files(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return counts.streamed(spark, str(folder), files_per_trigger=1)


def test_late_rows_are_dropped(spark, tmp_path):
    t = datetime(2024, 1, 1)
    hour = timedelta(hours=1)
    batches = [[(t, "a", 1.0), (t + 5 * hour, "a", 1.0)], [(t + 10 * hour, "a", 1.0)], [(t, "a", 7.0), (t + 10 * hour, "a", 2.0)]]
    stream = counts.event_windows(files(spark, tmp_path / "ev", batches, "ts timestamp, event_type string, value double"), late="1 hour")
    got = {r.start: (r.n, r.total) for r in counts.run_to_end(stream, ["start", "event_type"]).collect()}
    assert got == {t: (1, 1.0), t + 5 * hour: (1, 1.0), t + 10 * hour: (2, 3.0)}  # the late 7.0 changes nothing


def test_rows_delivered_again_count_once(spark, tmp_path):
    t = datetime(2024, 1, 1)
    batches = [[(1, "AAAAA", t), (2, "CCCCC", t)], [(1, "AAAAA", t + timedelta(days=3))]]
    rows = counts.once(files(spark, tmp_path / "r", batches, "read_id long, seq string, loaded_at timestamp"), "read_id", "loaded_at", "30 days")
    got = {r.kmer: r.n for r in counts.run_to_end(counts.kmer_counts(rows, 5), ["kmer"]).collect()}
    assert got == {"AAAAA": 1, "CCCCC": 1}


def test_an_empty_stream(spark, tmp_path):
    stream = counts.event_windows(files(spark, tmp_path / "e", [[]], "ts timestamp, event_type string, value double"))
    assert counts.run_to_end(stream, ["start", "event_type"]).count() == 0


def test_checkpoints_forget_guessed_sizes(spark):
    from strandflow.session import LARGEST_GUESS_BITS, cut

    df = spark.range(100).select(F.col("id").alias("a"))
    for i in range(12):
        df = cut(df.join(df.select(F.col("a")), "a"))
    assert df.count() == 100
    assert int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() <= max(LARGEST_GUESS_BITS, 64)


def test_large_checkpoints_are_not_broadcast(spark):
    """By the guess, or the compressed size, whole tables of reads and edges went through the driver."""
    from strandflow.session import written_once

    rows = spark.range(100).select(F.col("id").alias("a"), F.array_repeat(F.lit(30), 5).alias("q"))
    df = written_once(spark, ("large, not broadcast",), lambda: (rows,))[0]
    met = df.join(df.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")
    assert len(met.collect()) == 100
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
