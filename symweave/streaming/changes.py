"""Change streams: windows, sessions, duplicate suppression and maintenance of an index by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.session import scratch
from symweave.sources.records import KeptTable

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: An event may come so much later than the newest one; duplicates are known and windows stay open for as long.
LATE = "60 days"


def event_stream(spark: SparkSession, d: str, pattern: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """The events of a data folder as a stream of files, with event time ``at`` and its watermark; with ``files_per_batch`` so many files make a micro-batch."""
    rows = spark.readStream.schema(EVENT).option("pathGlobFilter", pattern)
    rows = rows.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else rows
    return rows.parquet(d).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)


def _run(writer, spark: SparkSession) -> None:
    """Run a stream over all that is there."""
    query = writer.option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()


def _maintain(rows: DataFrame, key: str, mode: str, change: Callable[[KeptTable, DataFrame], DataFrame]) -> DataFrame:
    """The table that the batches of a stream bring up to date by the rows that ``change`` makes of the table and a batch.

    Only the buckets of keys in a batch are written again; a batch that is run twice is known by its number and left out.
    """
    spark = rows.sparkSession
    table = KeptTable(spark, scratch(spark, "kept"), key)

    def keep(batch: DataFrame, number: int) -> None:
        done = table.tag()
        if done is None or done < number:
            table.upsert(change(table, batch), tag=number)

    _run(rows.writeStream.outputMode(mode).foreachBatch(keep), spark)
    return table.read()


def tumbling(spark: SparkSession, d: str, **kw) -> DataFrame:
    """``(event_type, day, n, total)`` per type and day of event time: a streaming aggregate in update mode, whose state forgets days older than the watermark."""
    out = event_stream(spark, d, **kw).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    rows = out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total").withColumn("cell", F.concat_ws("|", "event_type", F.col("day").cast("string")))
    return _maintain(rows, "cell", "update", lambda _, batch: batch).drop("cell")


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """``(user_id, started, ended, n)``: bursts of events of a user that follow each other within ``gap``; the debounce of a change stream. Works on tables and streams."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    rows = events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")


def deduplicated(spark: SparkSession, d: str, **kw) -> DataFrame:
    """``(user_id, n)``: events per user after duplicate ids are suppressed within the watermark."""
    rows = event_stream(spark, d, **kw).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")
    out = scratch(spark, "unique")
    _run(rows.writeStream.format("parquet").option("path", out).outputMode("append"), spark)
    return spark.read.schema(rows.schema).parquet(out).groupBy("user_id").agg(F.count("*").alias("n"))


def maintained_index(spark: SparkSession, d: str, **kw) -> DataFrame:
    """``(user_id, last_at, n)``: an index of the distinct events of each user that every micro-batch brings up to date.

    The ids seen are kept as state across batches within the watermark, so an event that comes again in a later batch is not counted. A batch is reduced to its keys and joined with their rows of the kept
    table; keys it does not touch are not computed again, and buckets without them not written.
    """
    rows = event_stream(spark, d, **kw).dropDuplicatesWithinWatermark(["event_id"]).select("user_id", "ts")

    def change(table: KeptTable, batch: DataFrame) -> DataFrame:
        new = batch.groupBy("user_id").agg(F.max("ts").alias("last_at"), F.count("*").alias("n"))
        if table.tag() is None:
            return new
        old = table.read().join(new.select("user_id"), "user_id", "left_semi")
        return old.unionByName(new).groupBy("user_id").agg(F.max("last_at").alias("last_at"), F.sum("n").alias("n"))

    return _maintain(rows, "user_id", "append", change)


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    """``(event_type, started, n, users)`` in overlapping windows of event time; an event falls in every window that holds it. Works on tables and streams."""
    w = F.window(F.col("ts").cast("timestamp"), width, step)
    rows = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.01).alias("users"))
    return rows.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("started"), "n", "users")
