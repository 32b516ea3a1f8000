"""Streams over event files.

All run with the ``availableNow`` trigger here; with another trigger the same
queries run on.  State and output live in the shared folder, so a restarted
query goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.sources.staging import shared_folder


def event_stream(spark: SparkSession, path: str, files: int = 50) -> DataFrame:
    """Parquet files at ``path``, a file or a folder, as a stream, some at a time."""
    schema = spark.read.parquet(path).schema
    # a pattern, as the file source takes a lone file only by one
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    for f in schema:
        if f.dataType.typeName() == "timestamp_ntz":
            stream = stream.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return stream


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and read what it wrote.

    Appended rows go through the exactly-once file sink.  Update mode keeps
    each batch's rows with its number; the caller takes the last of a key.
    """
    spark = stream.sparkSession
    base = shared_folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").outputMode("append").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch_id={number}")

    query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


def progress(events: DataFrame, by: str, done: Column) -> DataFrame:
    """Running counts of done and open events of each job, in update mode."""
    counts = events.groupBy(by).agg(F.count_if(done).alias("processed"), F.count_if(~done).alias("queued"))
    rows = drain(counts, "update")
    last = rows.groupBy(by).agg(F.max("batch").alias("batch"))
    return rows.join(last, [by, "batch"]).drop("batch")


def replay(events: DataFrame, key: str, terminal: Column) -> DataFrame:
    """Finished events, each key once however often it comes."""
    return drain(events.filter(terminal).dropDuplicates([key]))


def tail(events: DataFrame, cursor: str, after: int) -> DataFrame:
    """Rows behind a cursor."""
    return drain(events.filter(F.col(cursor) > after))


def windowed(events: DataFrame, time: str, size: str, late: str | None, by: str) -> DataFrame:
    """Counts in tumbling windows: an addition of this engine.

    With ``late``, events of windows that ended that long before the newest
    time of earlier batches are dropped and old windows leave the state;
    without, every event counts in whatever order it comes.
    """
    counts = (events.withWatermark(time, late) if late else events).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))
    rows = drain(counts, "update").select(F.col("window.start").alias("start"), by, "n", "batch")
    last = rows.groupBy("start", by).agg(F.max("batch").alias("batch"))
    return rows.join(last, ["start", by, "batch"]).drop("batch")
