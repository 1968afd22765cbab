"""Daily aggregation as a stream: watermarked tumbling and sliding windows, online scoring against fitted tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.cluster import nearest
from ..operators.shared import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with a time zone free ts cast for watermarks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(rows: DataFrame, key: str = "event_type", delay: str = "1 day") -> DataFrame:
    """key, day, n, total, mean of each calendar day; days later than the watermark are dropped."""
    found = rows.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), key)
    found = found.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return found.select(key, F.to_date("window.start").alias("day"), "n", "total", "mean")


def sliding(rows: DataFrame, days: int = 3, key: str = "event_type", delay: str = "1 day") -> DataFrame:
    """key, day (first of the window), n, total of each window of `days` days, one a day."""
    found = rows.withWatermark("ts", delay).groupBy(F.window("ts", f"{days} days", "1 day"), key)
    found = found.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(key, F.to_date("window.start").alias("day"), "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes", key: str = "user_id", delay: str = "1 day") -> DataFrame:
    """key, start, end, n of each session: events no further apart than gap."""
    found = rows.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def assign_online(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """A stream of (idx, features) with cluster: a stream-static join against fitted centroids."""
    return nearest(rows, centres)


def drained(rows: DataFrame, mode: str = "complete", keys: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """All that a finite stream yields, as a batch: runs it until its input is used up.

    Tasks write each batch to a folder of its number under path (the shared folder's own one by default), so that a batch
    that runs again replaces itself; a later call with the same path goes on from the stream's log there. Mode append
    reads all batches, complete the last one, update the last row of each of keys. Update frees what the watermark has
    passed, complete keeps all groups. Columns of the sink's own start with `_batch`.
    """
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = rows.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch_rows", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/_batch={number}")

    run = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/log").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    found = kept(spark, f"{path}/rows", StructType([*schema.fields, StructField("_batch_rows", LongType())]))
    if mode == "append":
        return found.drop("_batch_rows")
    if mode == "complete":
        # One number: that of the last batch that holds rows.
        last = found.agg(F.max("_batch_rows")).first()[0]
        return found.where(F.col("_batch_rows") == last).drop("_batch_rows")
    newest = found.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "_batch_rows").alias("_batch_row"))
    return newest.select("_batch_row.*")


def kept(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a sink's folder; none if no batch has been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def run_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(daily(event_stream(spark, sf_dir)), "update", ("event_type", "day"))


def run_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(sliding(event_stream(spark, sf_dir)), "update", ("event_type", "day"))
