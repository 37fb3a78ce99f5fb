"""Nearest row in time of the same entity within a tolerance, as a stateful streaming join.

Both sides are streams with an event time. Spark buffers them in state per entity and time bucket; the range
condition on the two event times bounds how long a row can still find partners, so a candidate is evicted and a
left row without one is emitted (left outer) once the watermark has passed its tolerance horizon. An aggregation
behind the join keeps the nearest candidate of each left row and emits it when the watermark has passed the
row's time. Buckets are several tolerances wide; a left row looks into the one or two buckets its horizon
touches, so entities of any size spread over many keys, few left rows and no right rows are copied.

`replay` runs the join over bounded tables: everything available is read, then a marker row far in the future
moves the watermark past all rows, so every row is answered and none is late.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.session import shared_dir

#: Event time of the marker rows that close a replay.
FAR = "9000-01-01 00:00:00"
#: A stream's first watermark is 1970, and what isn't after it is late: a replay's times are moved by this many microseconds (about 1000 years).
SHIFT = 31_556_952_000_000_000
#: Width of a bucket in tolerances, 2 at least. Of the left rows, 2 in so many look into two buckets.
BUCKET_TOLERANCES = 16
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}


def nearest_in_time(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: str, tolerance_ms: int, lateness: str = "0 seconds", outer: bool = False
) -> DataFrame:
    """keys, left_id columns, right_id and distance_us of the nearest right row in time; streaming in, streaming out.

    left: keys, left_id columns and `at` TIMESTAMP; right: keys, right_id and `at`. Keys are never null. A distance
    of exactly the tolerance counts. Of equally near rows the one with the smallest right_id is taken. A left or
    right row that is repeated gives one answer. With outer, a left row without a partner comes with nulls.
    Rows later than `lateness` behind the newest may be lost, as in every watermarked stream.
    """
    width = BUCKET_TOLERANCES * tolerance_ms * 1000
    micros = F.unix_micros("at")
    low, high = F.floor((micros - tolerance_ms * 1000) / width), F.floor((micros + tolerance_ms * 1000) / width)
    a = left.select(*[F.col(k).alias(f"l_{k}") for k in keys], *[F.col(c).alias(f"i_{c}") for c in left_id], "at", F.explode(F.array_distinct(F.array(low, high))).alias("l_bucket"))
    a = a.withColumnRenamed("at", "l_at").withWatermark("l_at", lateness)
    b = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(right_id).alias("r_id"), F.col("at").alias("r_at"), F.floor(micros / width).alias("r_bucket"))
    b = b.withWatermark("r_at", lateness)
    span = F.expr(f"interval {tolerance_ms} milliseconds")
    on = (F.col("l_bucket") == F.col("r_bucket")) & (F.col("r_at") >= F.col("l_at") - span) & (F.col("r_at") <= F.col("l_at") + span)
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    found = a.join(b, on, "leftOuter" if outer else "inner")
    far = F.abs(F.unix_micros("r_at") - F.unix_micros("l_at"))
    best = found.groupBy("l_at", *[f"l_{k}" for k in keys], *[f"i_{c}" for c in left_id]).agg(F.min(F.when(F.col("r_id").isNotNull(), F.struct(far.alias("d"), F.col("r_id").alias("r")))).alias("best"))
    return best.select(*[F.col(f"l_{k}").alias(k) for k in keys], *[F.col(f"i_{c}").alias(c) for c in left_id], F.col("best.r").alias(right_id), F.col("best.d").alias("distance_us"))


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _closed(stream: DataFrame, base: str, side: str) -> DataFrame:
    """The stream and a marker row: no key or id of a table is like the marker's, so it never pairs."""
    spark = stream.sparkSession
    far = []
    for f in stream.schema.fields:
        is_text = isinstance(f.dataType, T.StringType)
        far.append((F.lit(FAR).cast("timestamp") if f.name == "at" else F.lit(f"\0{side}") if is_text else F.lit(-1).cast(f.dataType)).alias(f.name))
    spark.range(1).select(*far).coalesce(1).write.parquet(f"{base}/{side}")
    moved = stream.withColumn("at", F.timestamp_micros(F.unix_micros("at") + SHIFT))
    return moved.unionByName(spark.readStream.schema(stream.schema).parquet(f"{base}/{side}"))


def replay(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: str, tolerance_ms: int, outer: bool = False) -> DataFrame:
    """Runs nearest_in_time over all that the two streams hold now and returns the written answers as a table.

    Cases as nearest_in_time; nothing is late, with times from the year 1000 to 7000. Empty inputs give an empty table.
    """
    spark = left.sparkSession
    base = f"{shared_dir(spark)}/nearest-{uuid.uuid4().hex[:12]}"
    with _conf(spark, ROCKS):
        joined = nearest_in_time(_closed(left, base, "left"), _closed(right, base, "right"), keys, left_id, right_id, tolerance_ms, outer=outer)
        run = joined.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
        run.awaitTermination()
    return spark.read.schema(joined.schema).parquet(f"{base}/out")


