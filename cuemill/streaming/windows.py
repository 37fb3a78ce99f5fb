"""Streaming forms: sessions and frames by event time, and late or repeated events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str, lateness: str) -> DataFrame:
    """key, first, last_plus_gap, n of each session, emitted once the watermark has passed it."""
    s = F.session_window(F.col(at), gap)
    return events.withWatermark(at, lateness).groupBy(key, s.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("last_plus_gap"), "n")


def frames(events: DataFrame, at: str, width: str, lateness: str, value: str) -> DataFrame:
    """start, n, total of tumbling frames."""
    return events.withWatermark(at, lateness).groupBy(F.window(F.col(at), width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def once(events: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """Events whose keys were not seen within the lateness before."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def closed(stream: DataFrame, at: str, folder: str, far: str = "9000-01-01") -> DataFrame:
    """A bounded stream with a marker row in the far future, written to a folder: the watermark passes all the rest. All but its time is null in the marker."""
    spark = stream.sparkSession
    row = [(F.lit(far).cast("timestamp") if f.name == at else F.lit(None).cast(f.dataType)).alias(f.name) for f in stream.schema.fields]
    spark.range(1).select(*row).coalesce(1).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now and writes what it emits."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
