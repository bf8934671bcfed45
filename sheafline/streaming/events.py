"""Counters as a stream: admission, rate limits, once-per-page events, abandoned runs, merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import merged_by_path
from ..operators.reports import admitted

LATENESS = "10 minutes"


def stamped(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn("event_time", F.timestamp_seconds(F.col(ts)))


def within_rate(requests: DataFrame, client: str, time: str, most: int = 30, window: str = "10 seconds", lateness: str = LATENESS) -> DataFrame:
    """Per client and window, the requests that were admitted and those that were over."""
    w = requests.withWatermark(time, lateness) if requests.isStreaming else requests
    per = w.groupBy(client, F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return per.select(client, F.col("w.start").alias("since"), F.least("requests", F.lit(most)).alias("admitted"), F.greatest(F.col("requests") - most, F.lit(0)).alias("dropped"))


def once_per(events: DataFrame, keys: list[str], time: str = "event_time", lateness: str = LATENESS) -> DataFrame:
    """The first event of each key; state is forgotten after ``lateness`` (T4, T5)."""
    if events.isStreaming:
        return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def abandoned(events: DataFrame, lateness: str = "30 minutes", time: str = "event_time") -> DataFrame:
    """Runs that were bundled and not exported within a session of a visit."""
    e = events.where("run IS NOT NULL")
    if e.isStreaming:
        e = e.withWatermark(time, lateness)
    s = e.groupBy("page", "run", F.session_window(time, lateness).alias("s")).agg(F.max((F.col("name") == "bundle_size").cast("int")).alias("bundled"), F.max((F.col("name") == "output_taken").cast("int")).alias("exported"))
    return s.where("bundled = 1 AND exported = 0").select("page", "run", F.col("s.start").alias("since"))


def admit_stream(batches: DataFrame, body: str, names: list[str]) -> DataFrame:
    """Posted batches as event rows stamped on arrival."""
    return admitted(batches, body, names, F.unix_timestamp(F.current_timestamp()))


def appended(rows: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Everything there is now, appended to a table of files."""
    w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w.trigger(availableNow=True).start()


def merged_stream(rows: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: list[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces rows of its keys and appends the others."""

    def each(batch: DataFrame, _: int) -> None:
        old = read()
        new = batch if old is None else merged_by_path(old, batch, key).drop("place")
        write(new)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
