"""Streams: facts of new files as they arrive, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirlight.functions.detect import file_type
from weirlight.operators.extract import extract_facts

FILE = "path string, modificationTime timestamp, length long, content binary"


def fact_stream(spark: SparkSession, root: str, out: str, checkpoint: str, as_of: str | None = None) -> StreamingQuery:
    """Appends the facts of new files under root to a Parquet table, each batch in a folder of its own number, so that a batch that runs again replaces itself."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(root)

    def batch(df: DataFrame, number: int) -> None:
        text = df.withColumn("content", F.col("content").cast("string")).withColumn("relative_path", F.col("path"))
        typed = text.withColumn("file_type", file_type(F.col("path"), F.col("content"))).where("file_type != 'unknown'")
        extract_facts(typed, as_of).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Number and sum of events by type and window; on a stream, rows later than the watermark are left out."""
    value = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.round(value, 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drained(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now and reads what it wrote."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
