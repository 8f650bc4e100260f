"""Structured Streaming: windowed and running counts, written to a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.dna import canonical, kmers_of
from strandflow.session import shared_folder


def streamed(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A parquet folder or a single file as a stream, with the schema of what lies there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", hadoop.getName()).parquet(hadoop.getParent().toString())
    return reader.parquet(path)


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling window; rows later than the watermark are dropped, which bounds the state."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    wide = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return wide.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(rows: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key once: a row delivered again within ``late`` of the first is dropped, and the key forgotten after that."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.dropDuplicatesWithinWatermark([key])


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of canonical k-mers so far; state is one count per distinct k-mer, as the result is."""
    return reads.where(F.length("seq") >= k).select(F.explode(kmers_of(F.translate("seq", "N", "A"), k)).alias("fwd")).groupBy(canonical(F.col("fwd")).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream over what is there; of each key the row that was put out last.

    Every batch is written as parquet below the shared folder, under its number, so a batch that is
    run again after a failure replaces itself; offsets and state lie in a checkpoint beside it.
    Nothing passes through the driver. In mode ``append`` rows are final as they come.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long").parquet(f"{folder}/rows")
    if mode == "append":
        return rows.drop("batch")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*")
