"""Streaming form of the acquisition log: late data, repeats, windows, pairs.

Results go to Parquet below the shared folder, written by the tasks of each batch;
nothing passes through the driver.  A batch that runs again writes the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellurion.sources.scratch import fresh_path

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "2 hours", width: str = "1 day") -> DataFrame:
    """Counts and sums by window and type of events whose id was not seen within the watermark."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("v"))


def paired(events: DataFrame, hours: float, late: str = "2 hours") -> DataFrame:
    """Ascending (view) and descending (click) acquisitions of a track at most ``hours`` apart: an interval join of two streams.

    Each side keeps a row as long as the other's watermark can still bring a partner, and
    a pair is given as soon as both are there.
    """
    side = lambda kind, p: events.where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{p}_track"), F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts")).withWatermark(f"{p}_ts", late)
    bound = F.expr(f"interval {int(hours * 3600)} seconds")
    near = (F.col("asc_track") == F.col("desc_track")) & F.col("desc_ts").between(F.col("asc_ts") - bound, F.col("asc_ts") + bound)
    return side("view", "asc").join(side("click", "desc"), near).select(F.col("asc_track").alias("track"), "asc_id", "desc_id", F.abs(F.unix_millis("asc_ts") - F.unix_millis("desc_ts")).alias("dt_ms"))


def run_to_files(stream: DataFrame) -> DataFrame:
    """Drive a stream that only adds rows over what is there now; its rows, from the files that it wrote."""
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, "stream-rows")
    q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_to_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Drive a stream that changes rows over what is there now; the last version of each key's row."""
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, "stream-updates")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/_batch=-1")  # a stream without batches has a result too
    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))
    return rows.withColumn("_newest", newest).where("_newest = 1").select(*stream.columns)
