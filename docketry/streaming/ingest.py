"""Incremental ingestion and windows over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.sources.sinks import new_only


def ingest(stream: DataFrame, store: str, checkpoint: str, key: str = "source_url", transform: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Append what isn't stored yet of every micro-batch to the parquet table ``store``.

    A batch that is run again after a failure finds its rows stored and adds
    none, so the table has each key once.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = transform(batch) if transform else batch
        # only a folder that isn't there is a first batch; one that can't be read fails the batch
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        stored = spark.read.parquet(store) if there else rows.limit(0)
        new_only(rows, stored, key).write.mode("append").parquet(store)

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def first_seen(stream: DataFrame, key: str, time: str, within: str = "7 days") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, by: str = "event_type", time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and key; works on streams (late rows are dropped behind the watermark) and tables."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, by: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key that end after ``gap`` without an event."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
