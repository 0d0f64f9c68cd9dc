"""Event streams: windows with watermarks, running progress, deduplication; the same functions serve batch frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LOG = "type string, timestamp timestamp, run_id string, agent_name string, tech_id string, progress int, total int, level string, error string"


def source(spark: SparkSession, path: str, schema: str = EVENT, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def _late(df: DataFrame, delay: str) -> DataFrame:
    """A watermark on streams. Event times without a zone are read in the session's."""
    if not df.isStreaming:
        return df
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(df: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Per window and type: events and mean value."""
    w = F.window("ts", width)
    out = _late(df, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("avg_value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "avg_value")


def sliding(df: DataFrame, width: str = "1 hour", step: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    out = _late(df, delay).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("window_start"), "events")


def sessions(df: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    out = _late(df, delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def distinct_events(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once; a stream remembers ids for the length of the delay only."""
    return _late(df, delay).dropDuplicatesWithinWatermark(["event_id"]) if df.isStreaming else df.dropDuplicates(["event_id"])


def progress(log: DataFrame) -> DataFrame:
    """Per run: technologies done, of how many, and the whole percentage."""
    done = F.count_if(F.col("type") == "technology_complete")
    return log.groupBy("run_id").agg(done.alias("done"), F.max("total").alias("total")).withColumn("pct", F.when(F.col("total") > 0, F.floor(100 * F.col("done") / F.col("total")).cast("int")).otherwise(0))


def not_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items a checkpoint has not marked yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that is there now, in micro-batches, then stop; a restart with the same checkpoint skips what was read."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
